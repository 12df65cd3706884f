"""Queries of reference building, kernels and the smaller rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import sequence as S
from ..operators import align, assign, common, extract, mapping, refbuild, variants
from . import adapt, pipeline
from .sequence_queries import _RECORDS_SQL, _records

SQL: dict[str, str] = {}


def gene_coord_left_join(spark, sf_dir):
    r = adapt.table(spark, sf_dir, "region")
    coords = r.select(F.concat(F.lit("G"), F.col("r_regionkey").cast("string")).alias("gene"), F.concat(F.lit("chr"), (F.col("r_regionkey") + 1).cast("string")).alias("chrom"), (F.col("r_regionkey") * 100).cast("long").alias("start"), (F.col("r_regionkey") * 100 + 50).cast("long").alias("end"), F.when(F.col("r_regionkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    return refbuild.annotate(adapt.alleles(spark, sf_dir), coords).select("name", "chrom", "start", "end", "strand")


SQL["gene_coord_left_join"] = adapt.with_sql("alleles", then=""", c AS (SELECT 'G' || r_regionkey AS gene, 'chr' || (r_regionkey + 1) AS chrom, CAST(r_regionkey * 100 AS BIGINT) AS s, CAST(r_regionkey * 100 + 50 AS BIGINT) AS e, CASE WHEN r_regionkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM region)
SELECT name, coalesce(chrom, 'chr19') AS chrom, coalesce(s, -1) AS "start", coalesce(e, -1) AS "end", coalesce(strand, '+') AS strand FROM alleles LEFT JOIN c USING (gene)""")


def _raw(spark, sf_dir):
    """Benchmark items as database entries of two exons."""
    a, n = adapt.alleles(spark, sf_dir), F.length("seq")
    at = lambda share: F.floor(n * share).cast("int")
    spans = F.array(F.struct(at(0.15).alias("s"), at(0.4).alias("e")), F.struct(at(0.5).alias("s"), (at(0.9) - F.col("seq_idx") % 3).cast("int").alias("e")))
    return a.select(F.col("seq_idx").alias("ord"), "name", spans.alias("exons"), (F.col("seq_idx") % 5 == 4).alias("partial"), F.lower("seq").alias("seq"))


def _panel_rows(panel):
    return panel.select("seq_idx", "name", F.concat_ws(" ", F.flatten(F.transform("exons", lambda x: F.array(x["s"].cast("string"), x["e"].cast("string"))))).alias("exons"), "seq")


def refbuild_rna(spark, sf_dir):
    return _panel_rows(refbuild.build(_raw(spark, sf_dir), False))


def refbuild_dna(spark, sf_dir):
    return _panel_rows(refbuild.build(_raw(spark, sf_dir), True))


def affine_alignment(spark, sf_dir):
    """Each allele against a copy with a change and a gap."""
    a = adapt.alleles(spark, sf_dir).select("seq_idx", F.col("seq").alias("t"))
    own = a.withColumn("p", F.expr("concat(substring(t, 1, 15), 'A', substring(t, 17, 14), substring(t, 34))"))

    @F.pandas_udf("string")
    def ops(t, p):
        import pandas as pd

        return pd.Series(["".join("=XID"[o] for o in align.align(x, y)) for x, y in zip(t, p, strict=True)])

    return own.select("seq_idx", ops("t", "p").alias("ops"))


def _fragments(spark, sf_dir, changed: bool = False):
    """Fragments of 130 bases, as mates of 60, along the whole of all alleles (ten bases apart) and documents (fifty-five
    apart); shorter sequences and ends are single reads. Optionally alleles have another base at every hundredth place."""
    a = adapt.alleles(spark, sf_dir).select((F.col("seq_idx") * 2).alias("source"), "seq")
    if changed:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("seq") / 100).cast("int")), lambda i: F.concat(F.substring("seq", i * 100 + 1, F.lit(99)), F.translate(F.substring("seq", i * 100 + 100, F.lit(1)), "ACGT", "CGTA")))
        a = a.withColumn("seq", F.array_join(parts, ""))
    own = a.unionByName(adapt.reads(spark, sf_dir).select((F.col("read_id") * 2 + 1).alias("source"), "seq")).where("seq <> ''")
    step = F.when(F.col("source") % 2 == 0, 10).otherwise(55)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length("seq") - 130) / step).cast("int")))
    # bytes, of which a piece is cut out without walking there; a mate's reverse complement is a piece of the whole one's
    own = own.select("source", F.length("seq").alias("n"), step.alias("step"), starts.alias("starts"), F.col("seq").cast("binary").alias("seq"), S.reverse_complement("seq").cast("binary").alias("back"))

    def cut(k):
        at = k * F.col("step")
        whole = F.col("n") - at >= 130
        return F.struct(F.substring("seq", at + 1, F.when(whole, 60).otherwise(130)).alias("seq1"), F.when(whole, F.substring("back", F.col("n") - at - 129, F.lit(60))).alias("seq2"))

    own = own.select("source", F.posexplode(F.transform("starts", cut)).alias("k", "piece"))
    sample = F.concat(F.lit("S"), (F.col("source") % 4).cast("string"))
    return own.select(sample.alias("sample"), (F.col("source") * 1_000_000 + F.col("k")).alias("read_id"), F.col("piece.seq1").cast("string").alias("seq1"), F.col("piece.seq2").cast("string").alias("seq2"))


def fragment_placements(spark, sf_dir):
    """Best placements of mates, weighed."""
    out = mapping.fragment_assignments(_fragments(spark, sf_dir), adapt.alleles(spark, sf_dir), 27)
    return out.select("sample", "read_id", "seq_idx", "start", "end", F.col("weight").cast("double").alias("weight"), F.col("adjust").cast("double").alias("adjust"))


def _run(spark, sf_dir):
    a = adapt.alleles(spark, sf_dir)
    panel = a.select("seq_idx", "name", F.array(F.struct(F.lit(0).alias("s"), (F.length("seq") - 1).alias("e"))).alias("exons"), "seq", F.lit(1).alias("weight"))
    return pipeline.Run(_fragments(spark, sf_dir), panel)


def genotype_calls(spark, sf_dir):
    """Calls of two samples from reads: placement, coverage, classes, EM, selection, qualities."""
    return _run(spark, sf_dir).calls()


def genotype_metrics(spark, sf_dir):
    return _run(spark, sf_dir).metrics()


def distinct_read_sequences(spark, sf_dir):
    return assign.distinct_reads(adapt.reads(spark, sf_dir)).select(F.md5("seq").alias("seq_md5"), "n")


SQL["distinct_read_sequences"] = adapt.with_sql("reads", then="SELECT md5(seq) AS seq_md5, count(*) AS n FROM reads GROUP BY seq")


def chromosome_resolution(spark, sf_dir):
    n = adapt.table(spark, sf_dir, "nation")
    known = n.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "chr").otherwise(""), F.col("n_nationkey").cast("string")).alias("chrom"))
    names = n.select(F.concat(F.when(F.col("n_nationkey") % 3 == 0, "chr").otherwise(""), F.col("n_nationkey").cast("string")).alias("name"))
    return extract.resolve_chromosomes(names, known)


SQL["chromosome_resolution"] = "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'chr' ELSE '' END || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'chr' ELSE '' END || n_nationkey AS chrom FROM nation"


def read_length_sample(spark, sf_dir):
    own = _records(spark, sf_dir).withColumn("seq", F.repeat(F.lit("A"), (F.col("rec") % 40 + 60).cast("int")))
    return extract.read_length_sample(own, 700)


SQL["read_length_sample"] = _RECORDS_SQL + ", own AS (SELECT * FROM records WHERE flags & 2304 = 0 ORDER BY rec LIMIT 700) SELECT CAST(sum(rec % 40 + 60) AS BIGINT) AS bases, count(*) AS reads FROM own WHERE flags & 128 = 0"


def single_end_first(spark, sf_dir):
    return extract.single_ends(_records(spark, sf_dir))


SQL["single_end_first"] = _RECORDS_SQL + "SELECT qname, rec FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY CAST(flags & 4 <> 0 AS INT), tid, pos, rec) AS rn FROM records WHERE flags & 2304 = 0) WHERE rn = 1"


def exon_comments(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "7").otherwise(F.concat_ws(" ", F.lit("2"), F.col("p_size").cast("string"), (F.col("p_size") + 9).cast("string"), F.lit("90 99"))).alias("c"))
    own = p.select("p_partkey", F.posexplode_outer(S.exons(F.col("c"), F.lit(100))).alias("k", "x"))
    return own.select("p_partkey", F.col("k").cast("long").alias("k"), F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


SQL["exon_comments"] = """SELECT p_partkey, NULL :: BIGINT AS k, NULL :: BIGINT AS s, NULL :: BIGINT AS e FROM part WHERE p_size % 4 = 1
UNION ALL SELECT p_partkey, 0, 0, 99 FROM part WHERE p_size % 4 = 0
UNION ALL SELECT p_partkey, 0, p_size, p_size + 9 FROM part WHERE p_size % 4 > 1 UNION ALL SELECT p_partkey, 1, 90, 99 FROM part WHERE p_size % 4 > 1"""


def substrings(spark, sf_dir):
    c = adapt.table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 25 - 5).cast("int").alias("a"), (F.col("c_custkey") % 11 - 3).cast("int").alias("n"))
    return c.select("c_custkey", S.clamped_substring(F.col("c_name"), F.col("a"), F.col("n")).alias("part"))


SQL["substrings"] = """WITH c AS (SELECT c_custkey, c_name, length(c_name) AS l, c_custkey % 25 - 5 AS a, c_custkey % 11 - 3 AS n FROM customer)
, b AS (SELECT *, greatest(0, CASE WHEN a < 0 THEN l + a ELSE a END) AS x FROM c)
, d AS (SELECT *, CASE WHEN n < 0 THEN l + n ELSE least(l, x + n) END AS y FROM b)
SELECT c_custkey, CASE WHEN y > x THEN substring(c_name, x + 1, y - x) ELSE '' END AS part FROM d"""


def log_normal_scores(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(maths.log_normal_score(F.sqrt("p_retailprice"), F.lit(30.0), F.sqrt(F.col("p_size").cast("double"))), 6).alias("score"))


SQL["log_normal_scores"] = "SELECT p_partkey, round(-0.5 * power((sqrt(p_retailprice) - 30) / sqrt(p_size), 2) - ln(sqrt(p_size)), 6) AS score FROM part"


def python_floats(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part")
    x = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 7 == 1, F.col("p_partkey") * 10000000.0).otherwise(F.col("p_size") / 4)
    return p.select("p_partkey", maths.python_float(x).alias("text"))


SQL["python_floats"] = "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '0' WHEN p_size % 7 = 1 THEN (p_partkey * 10000000) || '.0' ELSE CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR) END AS text FROM part"


def mean_alleles_per_read(spark, sf_dir):
    per = adapt.assignments(spark, sf_dir).groupBy("read_id").agg(F.count("*").alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean"))


SQL["mean_alleles_per_read"] = adapt.with_sql("assignments", then="SELECT round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM assignments GROUP BY read_id)")


def site_prefix_sums(spark, sf_dir):
    """Candidate sites up to each position, by which a range is seen to be empty."""
    c = adapt.coverage(spark, sf_dir).withColumn("site", (F.col("depth") % 3 == 0).cast("int"))
    return c.select("seq_idx", "pos", F.sum("site").over(Window.partitionBy("seq_idx").orderBy("pos")).alias("upto"))


SQL["site_prefix_sums"] = adapt.with_sql("coverage", then="SELECT CAST(seq_idx AS INT) AS seq_idx, CAST(pos AS INT) AS pos, CAST(sum(CAST(depth % 3 = 0 AS INT)) OVER (PARTITION BY seq_idx ORDER BY pos) AS BIGINT) AS upto FROM coverage")


def overlap_truncation(spark, sf_dir):
    """Reads with more than three overlaps keep those within 0.05 of their best's similarity."""
    a = adapt.assignments(spark, sf_dir).select("read_id", "allele", "similarity", (F.col("end") - F.col("start")).alias("match"))
    top = a.groupBy("read_id").agg(F.count("*").alias("n"), F.max_by("similarity", F.struct("match", "similarity")).alias("best"))
    own = a.join(top, "read_id").where((F.col("n") <= 3) | (F.col("similarity") >= F.col("best") - 0.05))
    return own.select("read_id", "allele", F.round("similarity", 6).alias("similarity"))


SQL["overlap_truncation"] = adapt.with_sql("assignments", then=""", a AS (SELECT read_id, allele, similarity, "end" - "start" AS match FROM assignments)
, b AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS n, first_value(similarity) OVER (PARTITION BY read_id ORDER BY match DESC, similarity DESC) AS best FROM a)
SELECT read_id, allele, round(similarity, 6) AS similarity FROM b WHERE n <= 3 OR similarity >= best - CAST(0.05 AS DOUBLE)""")


def representative_alleles(spark, sf_dir):
    c = adapt.calls(spark, sf_dir).select("sample", "gene", (F.col("slot") - 1).alias("rank"), F.col("ord").alias("seq_idx"), F.col("abundance").alias("ec_abundance"), "quality")
    return variants.representative_rows(c)


SQL["representative_alleles"] = adapt.with_sql("calls", then='SELECT sample, gene, CAST(slot - 1 AS INT) AS rank, ord AS seq_idx, abundance AS ec_abundance, CAST(quality AS INT) AS quality FROM calls WHERE slot <= 2 AND quality >= 1')


def seeded_bases(spark, sf_dir):
    """Random flanks of the alleles' genes, in their order."""
    r = maths.Rand48(17)
    genes = sorted(x.gene for x in adapt.alleles(spark, sf_dir).select("gene").distinct().collect())
    return spark.createDataFrame([(g, r.bases(refbuild.UTR), r.bases(refbuild.UTR)) for g in genes], "gene string, five string, three string")


def variant_lines(spark, sf_dir):
    """Novel variants of one sample as text."""
    run = _run(spark, sf_dir)
    own = _fragments(spark, sf_dir, True).select(F.col("read_id").alias("frag"), "seq1", "seq2")
    abundance = {r.seq_idx: 1.0 for r in run.panel.select("seq_idx").collect()}
    return variants.variant_lines(variants.call_variants(own, common.stored(run.panel, "panel"), abundance, run.hit_length))


OWN = (
    gene_coord_left_join, refbuild_rna, refbuild_dna, affine_alignment, fragment_placements, genotype_calls, genotype_metrics, distinct_read_sequences, chromosome_resolution, read_length_sample, single_end_first,
    exon_comments, substrings, log_normal_scores, python_floats, mean_alleles_per_read, site_prefix_sums, overlap_truncation, representative_alleles, seeded_bases, variant_lines,
)
QUERIES = {f.__name__: f for f in OWN}
