"""Queries of sources and sinks: tables are written in each file format and read back; and kernels on exact pieces.

The SQL states what must come back from the tables themselves, without any file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import sequence as S
from ..operators import align, common, mapping, refbuild
from ..sources import aligned, fastx, tables
from . import adapt
from .sequence_queries import _RECORDS_SQL, RC, _records

SQL: dict[str, str] = {}
#: bases as qualities, among them the letters that begin records and separators
QUALITY = "I@+J"
WRAP = 60


def _written(rows: DataFrame, name: str) -> str:
    """A folder of text files with rows (read_id, value) in order, deleted like a stored table."""
    path = common.shared_path(rows.sparkSession, name)
    common.owned(rows.sparkSession, path)
    fastx.write_text(rows, path)
    return path


def _reads(spark, sf_dir) -> DataFrame:
    own = adapt.reads(spark, sf_dir).withColumn("seq", F.coalesce("seq", F.lit("")))
    return own.select("read_id", F.concat(F.lit("d"), F.col("read_id").cast("string")).alias("name"), "seq", F.translate("seq", "ACGT", QUALITY).alias("qual"))


_READS_SQL = adapt.with_sql("reads", then=f", own AS (SELECT read_id, 'd' || read_id AS name, coalesce(seq, '') AS seq, translate(coalesce(seq, ''), 'ACGT', '{QUALITY}') AS qual FROM reads)\n")


def _scanned(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def fastq_scan(spark, sf_dir):
    """Reads written as FASTQ of four lines and read back."""
    own = _reads(spark, sf_dir)
    return _scanned(fastx.read_fastq(spark, _written(fastx.fastq_text(own), "fastq")))


def fastq_wrapped_scan(spark, sf_dir):
    """The same with a mate's suffix, lines of sixty letters, and a blank line after every record."""
    lines = lambda c: F.regexp_replace(c, f"(.{{{WRAP}}})(?=.)", "$1\n")
    own = _reads(spark, sf_dir).where("seq <> ''")
    value = F.concat(F.lit("@"), "name", F.lit("/1 comment\n"), lines("seq"), F.lit("\n+\n"), lines("qual"), F.lit("\n"))
    return _scanned(fastx.read_fastq(spark, _written(own.select("read_id", value.alias("value")), "fastq")))


SQL["fastq_scan"] = _READS_SQL + "SELECT name, length(seq) AS n, md5(seq) AS seq_md5, md5(qual) AS qual_md5 FROM own"
SQL["fastq_wrapped_scan"] = SQL["fastq_scan"] + " WHERE seq <> ''"


def _mates(spark, sf_dir) -> DataFrame:
    return _reads(spark, sf_dir).withColumns({"seq2": S.reverse_complement(F.col("seq")), "qual2": F.reverse("qual")})


def _paired(rows: DataFrame) -> DataFrame:
    return rows.select("name", *(F.md5(c).alias(f"{c}_md5") for c in ("seq1", "qual1", "seq2", "qual2")))


def mate_files(spark, sf_dir):
    """Two files of mates, paired by number."""
    own = _mates(spark, sf_dir)
    first = own.withColumn("name", F.concat("name", F.lit("/1")))
    second = own.select("read_id", F.concat("name", F.lit("/2")).alias("name"), F.col("seq2").alias("seq"), F.col("qual2").alias("qual"))
    a, b = (fastx.read_fastq(spark, _written(fastx.fastq_text(x), "fastq")) for x in (first, second))
    return _paired(fastx.pairs(a, b))


def interleaved_file(spark, sf_dir):
    """One file with the mates in turn, found to be so by its first names."""
    record = lambda seq, qual: F.concat(F.lit("@"), "name", F.lit("\n"), seq, F.lit("\n+\n"), qual)
    value = F.concat(record("seq", "qual"), F.lit("\n"), record("seq2", "qual2"))
    rows = fastx.read_fastq(spark, _written(_mates(spark, sf_dir).select("read_id", value.alias("value")), "fastq"))
    if not fastx.looks_interleaved(rows):
        return rows.select("name")
    return _paired(fastx.interleaved(rows))


SQL["mate_files"] = SQL["interleaved_file"] = _READS_SQL + f"SELECT name, md5(seq) AS seq1_md5, md5(qual) AS qual1_md5, md5({RC.format('seq')}) AS seq2_md5, md5(reverse(qual)) AS qual2_md5 FROM own"


def _panel(spark, sf_dir) -> DataFrame:
    """Alleles with two exons, the first one base long."""
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")), F.struct(F.lit(2).alias("s"), (F.length("seq") - 1).alias("e")))
    return adapt.alleles(spark, sf_dir).where("length(seq) > 2").withColumn("exons", spans)


def _exon_text(panel: DataFrame) -> DataFrame:
    return panel.select("seq_idx", "name", F.concat_ws(" ", F.flatten(F.transform("exons", lambda x: F.array(x["s"].cast("string"), x["e"].cast("string"))))).alias("exons"), F.md5("seq").alias("seq_md5"), F.col("weight").cast("long").alias("weight"))


def panel_scan(spark, sf_dir):
    """The panel written as FASTA and read back; equal sequences become one."""
    return _exon_text(fastx.read_panel(spark, _written(tables.panel_lines(_panel(spark, sf_dir)), "panel")))


def panel_scan_listed(spark, sf_dir):
    """The same for the alleles of a list: those of the genes G0 to G3."""
    own = _panel(spark, sf_dir)
    return _exon_text(fastx.read_panel(spark, _written(tables.panel_lines(own), "panel"), own.where("gene < 'G4'").select("name")))


_PANEL_SQL = """SELECT row_number() OVER (ORDER BY min(seq_idx)) - 1 AS seq_idx, arg_min(name, seq_idx) AS name, '0 0 2 ' || (length(seq) - 1) AS exons, md5(seq) AS seq_md5, count(*) AS weight
FROM alleles WHERE length(seq) > 2{0} GROUP BY seq"""
SQL["panel_scan"] = adapt.with_sql("alleles", then=_PANEL_SQL.format(""))
SQL["panel_scan_listed"] = adapt.with_sql("alleles", then=_PANEL_SQL.format(" AND gene < 'G4'"))


def coordinate_lines(spark, sf_dir):
    """The panel as FASTA with its genes' places, line by line."""
    r = adapt.table(spark, sf_dir, "region")
    gene, at = F.concat(F.lit("G"), F.col("r_regionkey").cast("string")), F.col("r_regionkey").cast("long") * 100
    coords = r.select(gene.alias("gene"), F.concat(F.lit("chr"), (F.col("r_regionkey") + 1).cast("string")).alias("chrom"), at.alias("start"), (at + 50).alias("end"), F.lit("-").alias("strand"))
    path = _written(tables.coordinate_lines(refbuild.annotate(_panel(spark, sf_dir), coords)), "coord")
    return fastx.read_fasta(spark, path).select("name", "comment", F.md5("seq").alias("seq_md5"))


SQL["coordinate_lines"] = adapt.with_sql("alleles", then="""SELECT name, CASE WHEN r_regionkey IS NULL THEN 'chr19 -1 -1 +' ELSE 'chr' || (r_regionkey + 1) || ' ' || (r_regionkey * 100) || ' ' || (r_regionkey * 100 + 50) || ' -' END AS comment, md5(seq) AS seq_md5
FROM alleles LEFT JOIN region ON gene = 'G' || r_regionkey WHERE length(seq) > 2""")


def allele_lines(spark, sf_dir):
    """Chosen alleles with their qualities, as written."""
    own = adapt.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_idx"), F.col("p_name").alias("name"), F.col("p_size").alias("quality"))
    return spark.read.text(_written(tables.allele_lines(own), "alleles")).select(F.col("value").alias("line"))


SQL["allele_lines"] = "SELECT p_name || ' ' || p_size AS line FROM part"


def sam_scan(spark, sf_dir):
    """Events as SAM, in order of coordinates by their header; reads of the reverse strand are turned back."""
    own = _records(spark, sf_dir).withColumn("text", F.concat(F.lit("AACG"), F.repeat(F.lit("T"), (F.col("rec") % 5).cast("int"))))
    contig = F.when(F.col("tid") < 0, "*").otherwise(F.concat(F.lit("chr"), F.col("tid").cast("string")))
    mate = F.when(F.col("rec") % 3 == 0, "=").when(F.col("rec") % 3 == 1, "*").otherwise("chr2")
    cells = ("qname", F.col("flags").cast("string"), contig, (F.col("pos") + 1).cast("string"), F.lit("0"), "cigar", mate, F.col("rec").cast("string"), (-F.col("distance")).cast("string"), "text", F.when(F.col("rec") % 4 == 0, "*").otherwise(F.translate("text", "ACGT", QUALITY)))
    lines = own.select(F.col("rec").alias("read_id"), F.concat_ws("\t", *cells).alias("value"))
    top = "\n".join(["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:chr{i}\tLN:1000000" for i in range(5))])
    header, rows = aligned.read_sam(spark, _written(spark.createDataFrame([(-1, top)], "read_id long, value string").unionByName(lines), "sam"))
    return rows.select(F.lit(aligned.sort_order(header)).alias("sorted"), (F.col("rec") - 6).alias("rec"), "qname", "flags", "tid", "pos", "cigar", "mtid", "mpos", "distance", "seq", "qual")


SQL["sam_scan"] = _RECORDS_SQL + f""", t AS (SELECT *, 'AACG' || repeat('T', rec % 5) AS s FROM records)
, u AS (SELECT *, CASE WHEN rec % 4 = 0 THEN NULL ELSE translate(s, 'ACGT', '{QUALITY}') END AS q FROM t)
SELECT 'coordinate' AS sorted, row_number() OVER (ORDER BY rec) - 1 AS rec, qname, CAST(flags AS INT) AS flags, CAST(tid AS INT) AS tid, pos, cigar, CAST(CASE rec % 3 WHEN 0 THEN tid WHEN 1 THEN -1 ELSE 2 END AS INT) AS mtid, rec - 1 AS mpos, abs(distance) AS distance,
  CASE WHEN flags & 16 <> 0 THEN {RC.format('s')} ELSE s END AS seq, CASE WHEN flags & 16 <> 0 THEN reverse(q) ELSE q END AS qual FROM u"""


def database_scan(spark, sf_dir):
    """Alleles as entries of an EMBL flat file: two exons, the second of every third entry followed by `pseudo`, some partial."""
    i, text = F.col("seq_idx"), lambda x: F.lit(f"FT                   {x}\n")
    body = F.regexp_replace(F.lower("seq"), f"(.{{1,{WRAP}}})", f"     $1 {WRAP}\n")
    value = F.concat(
        F.lit("ID   X\n"), F.lit('FT                   /allele="'), "name", F.lit('"\nFT   exon            3..7\nFT   intron          8..8\nFT   exon            <9..'), (i + 20).cast("string"), F.lit("\n"),
        F.when(i % 3 == 0, text("/pseudo")).otherwise(""), F.when(i % 4 == 0, text("/partial")).otherwise(""), F.lit("SQ   Sequence\n"), body, F.lit("//"),
    )
    rows = tables.read_database(spark, _written(adapt.alleles(spark, sf_dir).where("seq <> ''").select(i.alias("read_id"), value.alias("value")), "database"))
    spans = F.concat_ws(" ", F.transform("exons", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))))
    return rows.select("name", spans.alias("exons"), "partial", F.md5("seq").alias("seq_md5"))


SQL["database_scan"] = adapt.with_sql("alleles", then="SELECT name, '2-6' || CASE WHEN seq_idx % 3 = 0 THEN '' ELSE ' 8-' || (seq_idx + 19) END AS exons, seq_idx % 4 = 0 AS partial, md5(lower(seq)) AS seq_md5 FROM alleles WHERE seq <> ''")


def gtf_scan(spark, sf_dir):
    """Customers as lines of a GTF; of each gene the first `gene` line counts, and one gene has another name."""
    i = F.col("c_custkey")
    cells = (
        F.concat(F.when(i % 2 == 0, "chr").otherwise(""), (i % 22 + 1).cast("string")), F.lit("src"), F.when(i % 3 == 0, "exon").otherwise("gene"), i.cast("string"), (i + 10).cast("string"), F.lit("."),
        F.when(i % 5 == 0, "-").otherwise("+"), F.lit("."), F.concat(F.lit('gene_id "x"; gene_name "N'), F.col("c_nationkey").cast("string"), F.lit('";')),
    )
    value = F.concat(F.when(i % 50 == 0, "# comment\n").otherwise(""), F.concat_ws("\t", *cells))
    path = _written(adapt.table(spark, sf_dir, "customer").select(i.alias("read_id"), value.alias("value")), "gtf")
    return tables.read_gtf(spark, path, {"N7": "HLA-N7"})


SQL["gtf_scan"] = """WITH g AS (SELECT c_nationkey, min(c_custkey) AS i FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_nationkey)
SELECT CASE c_nationkey WHEN 7 THEN 'HLA-N7' ELSE 'N' || c_nationkey END AS gene, 'chr' || (i % 22 + 1) AS chrom, i AS start, i + 10 AS "end", CASE WHEN i % 5 = 0 THEN '-' ELSE '+' END AS strand FROM g"""


def _call_rows(spark, sf_dir) -> DataFrame:
    """Calls of both slots in a row, as the caller returns them; the sample is part of the gene's name."""
    slot = lambda k, c, none: F.coalesce(F.max(F.when(F.col("slot") == k, F.col(c))), F.lit(none))
    own = adapt.calls(spark, sf_dir).withColumn("name", F.concat_ws(",", "alleles"))
    cells = [slot(k, c, none).alias(f"{out}{k}") for k in (1, 2) for c, none, out in (("name", ".", "allele"), ("abundance", 0.0, "abundance"), ("quality", -1, "quality"))]
    return own.groupBy(F.concat_ws("_", "sample", "gene").alias("gene")).agg(F.count("*").alias("num_alleles"), *cells).withColumn("secondary", F.lit("x;1.0;0"))


def call_file_scan(spark, sf_dir):
    """Calls written as genotype lines and read back for a cohort."""
    rows = tables.read_calls(spark, _written(tables.genotype_lines(_call_rows(spark, sf_dir)), "calls"))
    return rows.select("gene", "slot", F.concat_ws(",", "alleles").alias("alleles"), "abundance", F.col("quality").cast("int").alias("quality"))


def copy_file_scan(spark, sf_dir):
    """The same lines read for copy numbers, where a set of alleles is one name."""
    rows = tables.read_copies(spark, _written(tables.genotype_lines(_call_rows(spark, sf_dir)), "calls"))
    return rows.select("gene", "slot", F.col("allele").alias("alleles"), "abundance", "quality")


SQL["call_file_scan"] = SQL["copy_file_scan"] = adapt.with_sql("calls", then="SELECT sample || '_' || gene AS gene, CAST(slot AS INT) AS slot, array_to_string(alleles, ',') AS alleles, CAST(abundance AS DOUBLE) AS abundance, CAST(quality AS INT) AS quality FROM calls")


def frequency_scan(spark, sf_dir):
    """Parts as an allele-frequency table with two header lines."""
    i = F.col("p_partkey")
    name = F.concat(F.when(i % 2 == 0, "HLA-").otherwise(""), F.lit("L"), (i % 7).cast("string"), F.lit("*"), F.col("p_size").cast("string"), F.lit(":"), i.cast("string"))
    lines = adapt.table(spark, sf_dir, "part").select(i.alias("read_id"), F.concat_ws("\t", name, F.lit("0.5"), (F.col("p_size") % 9).cast("string")).alias("value"))
    top = spark.createDataFrame([(-1, "frequencies\nallele\tfrequency\tcount")], "read_id long, value string")
    rows = tables.read_frequencies(spark, _written(top.unionByName(lines), "frequencies"))
    return rows.select("locus", F.concat_ws(":", "fields").alias("fields"), "n")


SQL["frequency_scan"] = "SELECT 'L' || (p_partkey % 7) AS locus, p_size || ':' || p_partkey AS fields, CAST(p_size % 9 AS DOUBLE) AS n FROM part"


def matrix_lines(spark, sf_dir):
    """A wide table as tab-separated text, header first."""
    own = adapt.table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample"), F.col("n_regionkey").cast("string").alias("G*1"), F.lit("0").alias("inconsistency"))
    return fastx.numbered(spark, _written(tables.matrix_lines(own), "matrix")).select("n", "line")


SQL["matrix_lines"] = """SELECT 0 AS n, 'sample' || chr(9) || 'G*1' || chr(9) || 'inconsistency' AS line UNION ALL SELECT row_number() OVER (ORDER BY n_name), n_name || chr(9) || n_regionkey || chr(9) || '0' FROM nation"""


def length_rules(spark, sf_dir):
    """Bases that hits must cover, k inferred from a length, and whether a number passes as a flag from 0 to 1000."""

    def checked(x: float) -> bool:
        try:
            return maths.check_range("x", x, 0, 1000) == x
        except ValueError:
            return False

    whole = lambda f: F.udf(f, "int")
    x = F.col("x")
    hits = [whole(lambda n, p=p, a=a: maths.hit_length(n, p, a))(x).alias(f"hit_{'paired' if p else 'single'}{'_aligned' if a else ''}") for p in (False, True) for a in (False, True)]
    own = adapt.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10).alias("x"))
    return own.select("c_custkey", *hits, whole(maths.infer_kmer_length)("c_custkey").alias("k"), F.udf(checked, "boolean")(x).alias("in_range"))


_HITS = ", ".join(f"greatest({n}, CAST(trunc(c_acctbal / 10) AS INT) // 5) AS hit_{name}" for name, n in (("single", 23), ("single_aligned", 17), ("paired", 27), ("paired_aligned", 21)))
SQL["length_rules"] = f"SELECT c_custkey, {_HITS}, CASE WHEN c_custkey = 0 THEN 1 ELSE CAST(length(ltrim(bin(c_custkey), '0')) + 1 AS INT) // 2 + 1 END AS k, c_acctbal / 10 BETWEEN 0 AND 1000 AS in_range FROM customer"

# kernels on pieces whose places are known


def substitution_alignment(spark, sf_dir):
    """Each allele against a copy with another base at every fortieth place: the alignment stays on the diagonal."""
    n = F.length("seq")
    parts = F.transform(F.sequence(F.lit(0), F.floor(n / 40).cast("int")), lambda i: F.concat(F.substring("seq", i * 40 + 1, F.lit(39)), F.translate(F.substring("seq", i * 40 + 40, F.lit(1)), "ACGT", "CGTA")))
    own = adapt.alleles(spark, sf_dir).where("seq <> ''").select("seq_idx", F.col("seq").alias("t"), F.array_join(parts, "").alias("p"))

    @F.pandas_udf("ops string, matches int, mismatches int, gaps int")
    def aligned_to(t, p):
        import pandas as pd

        found = [align.align(x, y) for x, y in zip(t, p, strict=True)]
        return pd.DataFrame([("".join("=XID"[o] for o in x), *align.edit_counts(x)) for x in found], columns=["ops", "matches", "mismatches", "gaps"])

    return own.select("seq_idx", aligned_to("t", "p").alias("x")).select("seq_idx", "x.*")


SQL["substitution_alignment"] = adapt.with_sql("alleles", then="""SELECT seq_idx, substring(repeat(repeat('=', 39) || 'X', CAST(length(seq) // 40 + 1 AS INT)), 1, CAST(length(seq) AS INT)) AS ops,
  CAST(length(seq) - length(seq) // 40 AS INT) AS matches, CAST(length(seq) // 40 AS INT) AS mismatches, 0 AS gaps FROM alleles WHERE seq <> ''""")


def _pieces(spark, sf_dir, size: int, step: int) -> DataFrame:
    """(read_id, k, seq): stretches of the alleles' sequences."""
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - size) / step).cast("int"))
    own = adapt.alleles(spark, sf_dir).where(F.length("seq") >= size).select("seq_idx", "seq", F.explode(starts).alias("k"))
    return own.select((F.col("seq_idx") * 1_000_000 + F.col("k")).alias("read_id"), "k", F.substring("seq", F.col("k") * step + 1, F.lit(size)).alias("seq"))


def exact_overlaps(spark, sf_dir):
    """Pieces of a hundred bases, every second one turned round: their perfect places by seeds, chains, alignment and extension."""
    own = _pieces(spark, sf_dir, 100, 10)
    reads = own.select("read_id", F.when(F.col("k") % 2 == 1, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    found = mapping.map_reads(reads, adapt.alleles(spark, sf_dir), 27).where("similarity = 1 AND clip = 0")
    return found.select("read_id", "seq_idx", "strand", "start", "end", "match")


def _windows_sql(size: int, name: str) -> str:
    return f"{name} AS (SELECT seq_idx, i, substring(seq, i + 1, {size}) AS s FROM alleles, range(0, greatest(0, length(seq) - {size - 1})) AS t(i))"


SQL["exact_overlaps"] = adapt.with_sql("alleles", then=", " + _windows_sql(100, "w") + """
SELECT p.seq_idx * 1000000 + p.i // 10 AS read_id, w.seq_idx, CAST(CASE WHEN p.i // 10 % 2 = 1 THEN -1 ELSE 1 END AS INT) AS strand, CAST(w.i AS INT) AS start, CAST(w.i + 99 AS INT) AS "end", 200 AS match FROM w p JOIN w USING (s) WHERE p.i % 10 = 0""")


def exact_fragments(spark, sf_dir):
    """Mates of sixty bases from pieces of 130: all alleles where both fit, at the widest places, with full weight."""
    own = _pieces(spark, sf_dir, 130, 10)
    frags = own.select(F.lit("S").alias("sample"), "read_id", F.substring("seq", 1, 60).alias("seq1"), S.reverse_complement(F.substring("seq", 71, 60)).alias("seq2"))
    found = mapping.fragment_assignments(frags, adapt.alleles(spark, sf_dir), 27)
    return found.select("read_id", "seq_idx", "start", "end", *(F.col(c).cast("double").alias(c) for c in ("weight", "qual", "adjust")))


SQL["exact_fragments"] = adapt.with_sql("alleles", then=", " + _windows_sql(60, "w") + ", " + _windows_sql(130, "p") + """
, f AS (SELECT seq_idx * 1000000 + i // 10 AS read_id, substring(s, 1, 60) AS a, substring(s, 71, 60) AS b FROM p WHERE i % 10 = 0)
, m AS (SELECT f.read_id, x.seq_idx, x.i AS i, y.i AS j FROM f JOIN w x ON x.s = f.a JOIN w y ON y.s = f.b AND y.seq_idx = x.seq_idx WHERE y.i > x.i)
SELECT read_id, seq_idx, CAST(i AS INT) AS start, CAST(j + 59 AS INT) AS "end", CAST(1 AS DOUBLE) AS weight, CAST(1 AS DOUBLE) AS qual, CAST(1 AS DOUBLE) AS adjust
FROM (SELECT *, row_number() OVER (PARTITION BY read_id, seq_idx ORDER BY i - j, i) AS rn FROM m) WHERE rn = 1""")


OWN = (
    fastq_scan, fastq_wrapped_scan, mate_files, interleaved_file, panel_scan, panel_scan_listed, coordinate_lines, allele_lines, sam_scan, database_scan, gtf_scan, call_file_scan, copy_file_scan,
    frequency_scan, matrix_lines, length_rules, substitution_alignment, exact_overlaps, exact_fragments,
)
QUERIES = {f.__name__: f for f in OWN}
