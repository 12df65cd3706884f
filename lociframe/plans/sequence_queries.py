"""Queries over sequences: k-mers, complexity, names, diagonals, intervals, aligned records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import assign, kmer
from . import adapt

K, HIT_LENGTH = 11, 27
SQL: dict[str, str] = {}


def _windows(source: str, key: str, k: int, out: str, seq: str = "seq") -> str:
    """A relation (key, offset, kmer) of all windows of ACGT, as a DuckDB CTE."""
    return f"""{out} AS (SELECT * FROM (SELECT {key}, i AS "offset", substring({seq}, i + 1, {k}) AS kmer FROM {source}, range(0, length({seq}) - {k - 1}) AS t(i) WHERE length({seq}) >= {k}) WHERE NOT regexp_matches(kmer, '[^ACGT]'))"""


RC = "reverse(translate(regexp_replace({0}, '[^ACGTN]', 'N', 'g'), 'ACGT', 'TGCA'))"


def _hits_sql(k: int) -> str:
    return adapt.with_sql("alleles", "reads", then=", " + _windows("alleles", "seq_idx", k, "aw") + f""", posted AS (
  SELECT seq_idx, "offset", kmer FROM (SELECT *, lag(kmer) OVER (PARTITION BY seq_idx ORDER BY "offset") AS prev FROM aw)
  WHERE ("offset" = 0 AND kmer <> repeat('A', {k})) OR ("offset" > 0 AND ("offset" = 1 OR prev IS NULL OR prev <> kmer)))
, strands AS (SELECT read_id, 1 AS strand, seq FROM reads UNION ALL SELECT read_id, -1, {RC.format("seq")} FROM reads)
, """ + _windows("strands", "read_id, strand", k, "rw") + """
, hits AS (SELECT read_id, strand, seq_idx, rw."offset" AS read_offset, posted."offset" AS "offset" FROM rw JOIN posted USING (kmer))
""")


def kmer_candidates(spark, sf_dir):
    """Reads with an allele whose k-mer hits cover enough: the flagship query."""
    posted = kmer.postings(adapt.alleles(spark, sf_dir), K)
    return kmer.gate(kmer.hits(adapt.reads(spark, sf_dir), posted, K), K, HIT_LENGTH)


SQL["kmer_candidates"] = _hits_sql(K) + f""", n AS (SELECT read_id, strand, seq_idx, count(*) AS hits FROM hits GROUP BY ALL)
SELECT read_id, strand, seq_idx, hits FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY hits DESC, strand, seq_idx) AS rn FROM n) WHERE rn = 1 AND {K} * hits >= {HIT_LENGTH}"""


def bucket_gate(spark, sf_dir):
    """The same with a longer k-mer, for which few reads pass."""
    posted = kmer.postings(adapt.alleles(spark, sf_dir), 15)
    return kmer.gate(kmer.hits(adapt.reads(spark, sf_dir), posted, 15), 15, 300)


SQL["bucket_gate"] = _hits_sql(15) + """, n AS (SELECT read_id, strand, seq_idx, count(*) AS hits FROM hits GROUP BY ALL)
SELECT read_id, strand, seq_idx, hits FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY hits DESC, strand, seq_idx) AS rn FROM n) WHERE rn = 1 AND 15 * hits >= 300"""


def kmer_count(spark, sf_dir):
    return kmer.counts(adapt.reads(spark, sf_dir), 9)


SQL["kmer_count"] = adapt.with_sql("reads", then=", " + _windows("reads", "read_id", 9, "w") + """
SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM w GROUP BY 1""")


def kmer_index_postings(spark, sf_dir):
    return kmer.with_repeats(kmer.postings(adapt.alleles(spark, sf_dir), 9))


_POSTED9 = adapt.with_sql("alleles", then=", " + _windows("alleles", "seq_idx", 9, "w") + """, posted AS (
  SELECT seq_idx, "offset", kmer FROM (SELECT *, lag(kmer) OVER (PARTITION BY seq_idx ORDER BY "offset") AS prev FROM w)
  WHERE ("offset" = 0 AND kmer <> 'AAAAAAAAA') OR ("offset" > 0 AND ("offset" = 1 OR prev IS NULL OR prev <> kmer)))
""")
SQL["kmer_index_postings"] = _POSTED9 + """SELECT kmer, seq_idx, CAST("offset" AS INT) AS "offset", count(*) OVER (PARTITION BY kmer) AS repeats FROM posted"""


def repeat_kmer_filter(spark, sf_dir):
    """K-mers that are repeats, and how many alleles have them."""
    posted = kmer.postings(adapt.alleles(spark, sf_dir), 5)
    return posted.groupBy("kmer").agg(F.count("*").alias("repeats"), F.countDistinct("seq_idx").alias("alleles")).where(F.col("repeats") >= kmer.REPEAT / 5)


SQL["repeat_kmer_filter"] = adapt.with_sql("alleles", then=", " + _windows("alleles", "seq_idx", 5, "w") + """, posted AS (
  SELECT seq_idx, "offset", kmer FROM (SELECT *, lag(kmer) OVER (PARTITION BY seq_idx ORDER BY "offset") AS prev FROM w)
  WHERE ("offset" = 0 AND kmer <> 'AAAAA') OR ("offset" > 0 AND ("offset" = 1 OR prev IS NULL OR prev <> kmer)))
SELECT kmer, count(*) AS repeats, count(DISTINCT seq_idx) AS alleles FROM posted GROUP BY kmer HAVING count(*) >= 20""")


def _pairs(spark, sf_dir):
    return kmer.similarity(kmer.profiles(adapt.alleles(spark, sf_dir), 7))


_PAIRS_SQL = adapt.with_sql("alleles", then=", " + _windows("alleles", "seq_idx", 7, "w") + """, prof AS (
  SELECT seq_idx, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM w GROUP BY ALL)
, size AS (SELECT seq_idx, sum(n) AS size FROM prof GROUP BY seq_idx)
, shared AS (SELECT x.seq_idx AS a, y.seq_idx AS b, sum(least(x.n, y.n)) AS common, sum(x.n) AS ab, sum(y.n) AS ba FROM prof x JOIN prof y ON x.kmer = y.kmer AND x.seq_idx < y.seq_idx GROUP BY ALL)
""")


def kmer_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


SQL["kmer_jaccard"] = _PAIRS_SQL + "SELECT a, b, round(common / (sa.size + sb.size - common), 6) AS jaccard FROM shared JOIN size sa ON sa.seq_idx = a JOIN size sb ON sb.seq_idx = b"


def kmer_containment(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("a_in_b", 6).alias("a_in_b"), F.round("b_in_a", 6).alias("b_in_a"))


SQL["kmer_containment"] = _PAIRS_SQL + "SELECT a, b, round(ab / sa.size, 6) AS a_in_b, round(ba / sb.size, 6) AS b_in_a FROM shared JOIN size sa ON sa.seq_idx = a JOIN size sb ON sb.seq_idx = b"


def _parts(seq, n: int):
    """A sequence in parts of n bases, the last one shorter; an empty sequence is one empty part."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(seq) - 1) / n).cast("int"))), lambda i: F.substring(seq, i * n + 1, F.lit(n)))


def _parts_sql(seq: str, n: int) -> str:
    return f"[substring({seq}, CAST(i * {n} + 1 AS BIGINT), {n}) FOR i IN range(0, greatest(0, (length({seq}) - 1) // {n}) + 1)]"


def canonical_revcomp(spark, sf_dir):
    seq = F.col("seq")
    return adapt.alleles(spark, sf_dir).select("seq_idx", S.reverse_complement(seq).alias("rc"), S.canonical(seq).alias("canonical"), S.base_codes(seq).alias("codes"), F.concat_ws(",", F.transform(_parts(seq, 20), lambda x: S.kmer_code(x).cast("string"))).alias("part_codes"))


SQL["canonical_revcomp"] = adapt.with_sql("alleles", then=f"""SELECT seq_idx, {RC.format("seq")} AS rc, least(seq, {RC.format("seq")}) AS canonical, translate(regexp_replace(seq, '[^ACGT]', 'T', 'g'), 'ACGT', '0123') AS codes,
  array_to_string([CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(x AS BIGINT) FOR x IN string_split(translate(p, 'ACGT', '0123'), '') IF x <> '']), lambda a, b: a * 4 + b) AS VARCHAR) FOR p IN {_parts_sql("seq", 20)}], ',') AS part_codes FROM alleles""")


def low_complexity(spark, sf_dir):
    """Whether a read is low in complexity, and how many of its parts of twelve bases are."""
    seq = F.col("seq")
    low_parts = F.size(F.filter(_parts(seq, 12), S.low_complexity)).cast("long")
    return adapt.reads(spark, sf_dir).select("read_id", S.low_complexity(seq).alias("low"), low_parts.alias("low_parts"))


def _low(seq: str) -> str:
    c = [f"(length({seq}) - length(replace({seq}, '{b}', '')))" for b in "ACGTN"]
    return f"({' OR '.join(f'{x} >= length({seq}) // 2' for x in c[:4])} OR {c[4]} >= length({seq}) // 10 OR {' + '.join(f'CAST({x} <= 2 AS INT)' for x in c[:4])} >= 2)"


SQL["low_complexity"] = adapt.with_sql("reads", then=f"SELECT read_id, {_low('seq')} AS low, len([p FOR p IN {_parts_sql('seq', 12)} IF {_low('p')}]) AS low_parts FROM reads")


def overlap_low_complexity(spark, sf_dir):
    """The same by the rule for overlaps, in parts of fifteen and sixty bases."""
    low = lambda n: F.size(F.filter(_parts(F.col("seq"), n), S.low_complexity_span)).cast("long")
    return adapt.reads(spark, sf_dir).select("read_id", low(15).alias("low"), low(60).alias("low_long"))


def _low_span(seq: str) -> str:
    c = [f"(length({seq}) - length(replace({seq}, '{b}', '')))" for b in "ACGT"]
    return f"(7 * ({' + '.join(f'CASE WHEN {x} <= 2 THEN {x} ELSE 0 END' for x in c)}) < length({seq}) AND {' + '.join(f'CAST({x} <= 2 AS INT)' for x in c)} >= 2)"


SQL["overlap_low_complexity"] = adapt.with_sql("reads", then=f"SELECT read_id, len([p FOR p IN {_parts_sql('seq', 15)} IF {_low_span('p')}]) AS low, len([p FOR p IN {_parts_sql('seq', 60)} IF {_low_span('p')}]) AS low_long FROM reads")


def _with_n(seq):
    return F.regexp_replace(seq, "^GT|CAT|TTT", "NNN")


def effective_length(spark, sf_dir):
    own = adapt.reads(spark, sf_dir).withColumn("seq", _with_n(F.col("seq")))
    return own.select("read_id", S.effective_length(F.col("seq")).cast("long").alias("eff_len"))


SQL["effective_length"] = adapt.with_sql("reads", then=", n AS (SELECT read_id, regexp_replace(seq, '^GT|CAT|TTT', 'NNN', 'g') AS seq FROM reads)\nSELECT read_id, length(regexp_replace(regexp_replace(seq, '^N+', ''), 'N+', 'N', 'g')) AS eff_len FROM n")


def separators(spark, sf_dir):
    """Separator positions of alleles with N, and whether a range crosses one."""
    own = adapt.alleles(spark, sf_dir).withColumn("seq", _with_n(F.col("seq"))).withColumn("sep", S.separators(F.col("seq")))
    return own.select("seq_idx", F.size("sep").cast("long").alias("n"), F.concat_ws(",", F.transform("sep", lambda x: x.cast("string"))).alias("places"), S.crosses_separator(F.lit(5), F.lit(12), F.col("sep")).alias("crosses"))


SQL["separators"] = adapt.with_sql("alleles", then="""
, n AS (SELECT seq_idx, regexp_replace(seq, '^GT|CAT|TTT', 'NNN', 'g') AS seq FROM alleles)
, s AS (SELECT seq_idx, list_concat(list_concat([-1], [i - 1 FOR i IN range(1, length(seq) + 1) IF substring(seq, i, 1) = 'N']), [length(seq)]) AS sep FROM n)
SELECT seq_idx, len(sep) AS n, array_to_string(sep, ',') AS places, len([x FOR x IN sep IF x BETWEEN 5 AND 12]) > 0 AS crosses FROM s""")


def length_mode_fix(spark, sf_dir):
    own = adapt.alleles(spark, sf_dir).select("seq_idx", "gene", (F.length("seq") - F.length("seq") % 20).alias("length"))
    return assign.length_mode(own, 40).select("seq_idx", "gene", F.col("length").cast("long").alias("length"), F.col("fixed").cast("long").alias("fixed"))


SQL["length_mode_fix"] = adapt.with_sql("alleles", then="""
, l AS (SELECT seq_idx, gene, length(seq) - length(seq) % 20 AS length FROM alleles)
, m AS (SELECT gene, length AS mode FROM (SELECT gene, length, row_number() OVER (PARTITION BY gene ORDER BY count(*) DESC, length) AS rn FROM l GROUP BY gene, length) WHERE rn = 1)
SELECT seq_idx, gene, length, CASE WHEN length < mode - 40 THEN mode ELSE length END AS fixed FROM l JOIN m USING (gene)""")


def string_mode(spark, sf_dir):
    return assign.text_mode(adapt.table(spark, sf_dir, "part").select("p_brand", "p_size"), "p_brand", "p_size")


SQL["string_mode"] = """SELECT p_brand, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, v DESC) AS rn FROM (SELECT p_brand, CAST(p_size AS VARCHAR) AS v, count(*) AS n FROM part GROUP BY ALL)) WHERE rn = 1"""


def _names(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, ["", "N", "L", "x", "Q"])), (k % 5 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.lit("HLA-"), F.substring("p_brand", 7, 1), F.lit("*"), (k % 90).cast("string"), F.lit(":"), F.col("p_size").cast("string"), F.lit(":"), (k % 7).cast("string"), F.lit(":0"), (k % 3).cast("string"), suffix).alias("name"))


_NAMES_SQL = """WITH names AS (SELECT p_partkey, 'HLA-' || substring(p_brand, 7, 1) || '*' || (p_partkey % 90) || ':' || p_size || ':' || (p_partkey % 7) || ':0' || (p_partkey % 3) || ['', 'N', 'L', 'x', 'Q'][p_partkey % 5 + 1] AS name FROM part)
"""


def allele_name_parse(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("p_partkey", S.gene(n).alias("gene"), S.major_allele(n).alias("major"), S.major_allele(n, digits=3).alias("by_digits"), S.major_allele(n, 1).alias("exonic"))


SQL["allele_name_parse"] = _NAMES_SQL + r"""SELECT p_partkey, split_part(name, '*', 1) AS gene, array_to_string(string_split(name, ':')[1:3], ':') AS major, regexp_extract(name, '^([^*]*(?:\*.{0,3})?)', 1) AS by_digits, split_part(name, ':', 1) AS exonic FROM names"""


def null_expression(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", S.null_expression(F.col("name")).alias("is_null"))


SQL["null_expression"] = _NAMES_SQL + "SELECT p_partkey, contains(name, '*') AND regexp_matches(name, '[0-9][NLSCAQ]$') AS is_null FROM names"


def mate_suffix_trim(spark, sf_dir):
    e = adapt.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("r"), F.col("event_id").cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("n"))
    return e.select("event_id", S.without_mate(F.col("n")).alias("name"), S.without_mate(F.col("n"), 3).alias("cut"))


SQL["mate_suffix_trim"] = "WITH e AS (SELECT event_id, 'r' || event_id || '/' || (event_id % 3) AS n FROM events) SELECT event_id, regexp_replace(n, '/[12]$', '') AS name, substring(n, 1, greatest(0, length(n) - 3)) AS cut FROM e"


def alt_contig(spark, sf_dir):
    name = F.concat(F.lit("chr"), (F.col("user_id") % 23).cast("string"), F.element_at(F.array(*map(F.lit, ["", "_alt", ".1", "*"])), (F.col("event_id") % 4 + 1).cast("int")))
    return adapt.table(spark, sf_dir, "events").select(name.alias("chrom")).groupBy("chrom").agg(F.count("*").alias("n")).withColumn("alt", S.alternative_contig(F.col("chrom")))


SQL["alt_contig"] = "WITH e AS (SELECT 'chr' || (user_id % 23) || ['', '_alt', '.1', '*'][event_id % 4 + 1] AS chrom FROM events) SELECT chrom, count(*) AS n, regexp_matches(chrom, '[_.*]') AS alt FROM e GROUP BY chrom"


def dedup_sequences(spark, sf_dir):
    own = adapt.reads(spark, sf_dir).select(F.col("read_id").alias("seq_idx"), F.col("read_id").cast("string").alias("name"), "seq")
    return assign.dedup_sequences(own).select("seq_idx", "name", F.length("seq").cast("long").alias("length"), "weight")


SQL["dedup_sequences"] = adapt.with_sql("reads", then="SELECT min(read_id) AS seq_idx, CAST(min(read_id) AS VARCHAR) AS name, length(seq) AS length, count(*) AS weight FROM reads WHERE seq <> '' GROUP BY seq")


def _found(spark, sf_dir, k=K):
    return kmer.hits(adapt.reads(spark, sf_dir), kmer.postings(adapt.alleles(spark, sf_dir), k), k)


def diagonal_runs(spark, sf_dir):
    return assign.diagonal_runs(_found(spark, sf_dir)).where("hits >= 3")


SQL["diagonal_runs"] = _hits_sql(K) + """, d AS (SELECT read_id, strand, seq_idx, read_offset - "offset" AS diag, count(*) AS n FROM hits GROUP BY ALL)
, g AS (SELECT *, CAST(diag - lag(diag) OVER w > 10 AS INT) AS cut FROM d WINDOW w AS (PARTITION BY read_id, strand, seq_idx ORDER BY diag))
, r AS (SELECT *, CAST(coalesce(sum(cut) OVER (PARTITION BY read_id, strand, seq_idx ORDER BY diag), 0) AS BIGINT) AS run FROM g)
SELECT read_id, strand, seq_idx, run, CAST(min(diag) AS INT) AS low, CAST(max(diag) AS INT) AS high, CAST(sum(n) AS BIGINT) AS hits, CAST(arg_max(diag, n * 1000000 - diag) AS INT) AS dominant FROM r GROUP BY read_id, strand, seq_idx, run HAVING sum(n) >= 3"""


def covered_length(spark, sf_dir):
    return assign.covered_length(_found(spark, sf_dir), ["read_id", "strand", "seq_idx"], "read_offset", K).where("covered >= 27")


SQL["covered_length"] = _hits_sql(K) + f""", o AS (SELECT DISTINCT read_id, strand, seq_idx, read_offset FROM hits)
, s AS (SELECT *, read_offset - lag(read_offset) OVER (PARTITION BY read_id, strand, seq_idx ORDER BY read_offset) AS step FROM o)
SELECT read_id, strand, seq_idx, CAST(sum(CASE WHEN step IS NULL OR step > {K - 1} THEN {K} ELSE step END) AS BIGINT) AS covered FROM s GROUP BY ALL HAVING sum(CASE WHEN step IS NULL OR step > {K - 1} THEN {K} ELSE step END) >= 27"""


def interval_semi_join(spark, sf_dir):
    return assign.overlapping(adapt.positions(spark, sf_dir), adapt.intervals(spark, sf_dir)).select("rec", "chrom")


SQL["interval_semi_join"] = adapt.with_sql("positions", "intervals", then="SELECT rec, CAST(chrom AS INT) AS chrom FROM positions p WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = p.chrom AND s <= g_end AND e > g_start)")


def _records(spark, sf_dir):
    """Events as aligned records: name, flags, tid, pos, cigar."""
    e = adapt.table(spark, sf_dir, "events")
    i = F.col("event_id")
    flags = F.element_at(F.array(*map(F.lit, [99, 147, 83, 163, 77, 141, 4, 0, 16, 256, 2048, 73])), (i % 12 + 1).cast("int"))
    cigar = F.element_at(F.array(*map(F.lit, ["50M", "10S30M5I20M", "20M100N30M", "5H10M2D10M3S", "10=1X10=50N5M", "*"])), (i % 6 + 1).cast("int"))
    return e.select(F.col("event_id").alias("rec"), F.concat(F.lit("q"), F.floor(i / 2).cast("string")).alias("qname"), flags.alias("flags"), F.when(i % 12 == 6, -1).otherwise((F.col("user_id") % 5).cast("int")).alias("tid"), (i * 3).alias("pos"), cigar.alias("cigar"), (F.col("value") * 10).cast("long").alias("distance"))


_RECORDS_SQL = """WITH records AS (SELECT event_id AS rec, 'q' || CAST(floor(event_id / 2) AS BIGINT) AS qname, [99, 147, 83, 163, 77, 141, 4, 0, 16, 256, 2048, 73][event_id % 12 + 1] AS flags,
  CASE WHEN event_id % 12 = 6 THEN -1 ELSE user_id % 5 END AS tid, event_id * 3 AS pos, ['50M', '10S30M5I20M', '20M100N30M', '5H10M2D10M3S', '10=1X10=50N5M', '*'][event_id % 6 + 1] AS cigar, CAST(trunc(value * 10) AS BIGINT) AS distance FROM events)
"""


def cigar_segments(spark, sf_dir):
    own = _records(spark, sf_dir).select("rec", F.posexplode(S.cigar_segments(F.col("pos"), F.col("cigar"))).alias("k", "s"))
    return own.select("rec", F.col("k").cast("long").alias("k"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))


SQL["cigar_segments"] = _RECORDS_SQL + r""", ops AS (SELECT rec, pos, unnest([{'i': i, 'n': CAST(substring(x, 1, length(x) - 1) AS BIGINT), 'op': substring(x, -1)} FOR x, i IN regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')], recursive := true) FROM records)
, used AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(CAST(op = 'N' AS INT)) OVER (PARTITION BY rec ORDER BY i) AS part FROM ops WHERE op IN ('M', 'D', '=', 'X', 'N'))
, segs AS (SELECT rec, part, min(pos + before) AS a, max(pos + before + n - 1) AS b FROM used WHERE op <> 'N' GROUP BY rec, part)
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY part) - 1 AS k, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM segs"""


def flag_predicates(spark, sf_dir):
    f = F.col("flags")
    return _records(spark, sf_dir).select("rec", S.is_first_mate(f).alias("first"), S.is_reverse(f).alias("rev"), S.is_primary(f).alias("prim"), S.is_paired(f).alias("paired"), S.is_aligned(f).alias("aligned"), S.template_aligned(f, F.col("tid")).alias("template"))


SQL["flag_predicates"] = _RECORDS_SQL + "SELECT rec, flags & 128 = 0 AS first, flags & 16 <> 0 AS rev, flags & 2304 = 0 AS prim, flags & 1 <> 0 AS paired, flags & 4 = 0 AS aligned, NOT (flags & 13 = 13 OR flags & 5 = 4 OR tid < 0) AS template FROM records"


def library_stats(spark, sf_dir):
    from ..operators import extract

    return extract.library_stats(_records(spark, sf_dir).withColumn("seq", F.lit("A" * 50)), first=100_000).select("read_len", "frag_len", "frag_sd")


SQL["library_stats"] = _RECORDS_SQL + """, own AS (SELECT * FROM records WHERE flags & 2304 = 0 ORDER BY rec LIMIT 100000)
, p AS (SELECT distance, row_number() OVER (ORDER BY distance, rec) AS rn, count(*) OVER () AS n FROM own WHERE flags & 1 <> 0 AND flags & 12 = 0 AND distance > 0)
, kept AS (SELECT distance FROM p WHERE rn <= ceil(0.7 * n))
, a AS (SELECT CAST(floor(avg(distance)) AS BIGINT) AS mean FROM kept)
SELECT 50 AS read_len, (SELECT mean + 50 FROM a) AS frag_len, (SELECT CAST(greatest(1, floor(sqrt(floor(avg((distance - mean) * (distance - mean)))))) AS BIGINT) FROM kept, a) AS frag_sd"""


def two_pass_name_join(spark, sf_dir):
    from ..operators import extract

    rec = _records(spark, sf_dir)
    names = assign.overlapping(rec.select("rec", F.col("tid").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 50).alias("end"), "qname"), adapt.intervals(spark, sf_dir)).select("qname")
    return extract.mates_of(rec, names).select("qname", "first_rec", "second_rec")


SQL["two_pass_name_join"] = adapt.with_sql("intervals", then="," + _RECORDS_SQL[4:] + """, names AS (SELECT DISTINCT qname FROM records r WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chrom = r.tid AND pos <= g_end AND pos + 50 > g_start))
, own AS (SELECT * FROM records WHERE flags & 2304 = 0 AND NOT (flags & 13 = 13 OR flags & 5 = 4 OR tid < 0) AND qname IN (SELECT qname FROM names))
SELECT qname, min(rec) FILTER (flags & 128 = 0) AS first_rec, min(rec) FILTER (flags & 128 <> 0) AS second_rec FROM own GROUP BY qname HAVING count(*) FILTER (flags & 128 = 0) > 0 AND count(*) FILTER (flags & 128 <> 0) > 0""")


def qname_groups(spark, sf_dir):
    from ..operators import extract

    return extract.name_groups(_records(spark, sf_dir))


SQL["qname_groups"] = _RECORDS_SQL + "SELECT qname, count(*) AS n, min(rec) AS first_rec, count(*) = 1 AS lone FROM records WHERE flags & 2304 = 0 GROUP BY qname"


def exonic_position(spark, sf_dir):
    """Places of positions within exons given by a header comment."""
    own = adapt.positions(spark, sf_dir).withColumn("spans", S.exons(F.concat_ws(" ", F.lit("3 10 19 30"), (F.lit(40) + F.col("chrom")).cast("string"), F.lit("60 99")), F.lit(100)))
    pos = (F.col("rec") % 110).cast("int")
    return own.select("rec", S.in_exon(pos, F.col("spans")).alias("inside"), S.exonic_position(pos, F.col("spans")).cast("long").alias("place"))


SQL["exonic_position"] = adapt.with_sql("positions", then=""", p AS (SELECT rec, rec % 110 AS pos, 40 + chrom AS e2 FROM positions)
SELECT rec, pos BETWEEN 10 AND 19 OR pos BETWEEN 30 AND e2 OR pos BETWEEN 60 AND 99 AS inside,
  CASE WHEN pos BETWEEN 10 AND 19 THEN pos - 10 WHEN pos BETWEEN 30 AND e2 THEN pos - 20 WHEN pos BETWEEN 60 AND 99 THEN 10 + (e2 - 29) + pos - 60 ELSE -1 END AS place FROM p""")


def representative_sequence(spark, sf_dir):
    return assign.representative(adapt.alleles(spark, sf_dir))


SQL["representative_sequence"] = adapt.with_sql("alleles", then="SELECT gene, seq_idx FROM (SELECT gene, seq_idx, row_number() OVER (PARTITION BY gene ORDER BY seq, seq_idx) AS rn FROM alleles) WHERE rn = 1")


def kmer_hits_repeats(spark, sf_dir):
    """Hits of alleles as reads per strand and allele, where k-mers of three postings or more are passed over, five in a row at most."""
    own = adapt.alleles(spark, sf_dir)
    found = kmer.hits(own.select(F.col("seq_idx").alias("read_id"), "seq"), kmer.postings(own, K), K, repeats=3)
    return found.groupBy("read_id", "strand", "seq_idx").agg(F.count("*").alias("hits"))


SQL["kmer_hits_repeats"] = _hits_sql(K).replace(adapt.SQL["reads"], "reads AS (SELECT seq_idx AS read_id, seq FROM alleles)") + f""", frequent AS (SELECT kmer FROM posted GROUP BY kmer HAVING count(*) >= 3)
, met AS (SELECT rw.read_id, rw.strand, rw."offset" AS o FROM rw JOIN frequent USING (kmer) JOIN reads ON reads.read_id = rw.read_id WHERE rw."offset" > 0 AND rw."offset" < length(reads.seq) - {K})
, runs AS (SELECT *, o - row_number() OVER (PARTITION BY read_id, strand ORDER BY o) AS run FROM met)
, passed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id, strand, run ORDER BY o) - 1 AS i FROM runs) WHERE i % 6 <> 5)
SELECT read_id, strand, seq_idx, count(*) AS hits FROM hits WHERE NOT EXISTS (SELECT 1 FROM passed p WHERE p.read_id = hits.read_id AND p.strand = hits.strand AND p.o = hits.read_offset) GROUP BY ALL"""


def read_overlaps(spark, sf_dir):
    """Scored overlaps of every read (chaining and alignment kernels)."""
    from ..operators import mapping

    return mapping.map_reads(adapt.reads(spark, sf_dir), adapt.alleles(spark, sf_dir), hit_length=HIT_LENGTH, k=K, local=True)


OWN = (
    kmer_candidates, bucket_gate, kmer_count, kmer_index_postings, repeat_kmer_filter, kmer_jaccard, kmer_containment, canonical_revcomp, low_complexity, overlap_low_complexity,
    effective_length, separators, length_mode_fix, string_mode, allele_name_parse, null_expression, mate_suffix_trim, alt_contig, dedup_sequences, diagonal_runs, covered_length, interval_semi_join,
    cigar_segments, flag_predicates, library_stats, two_pass_name_join, qname_groups, exonic_position, representative_sequence, kmer_hits_repeats, read_overlaps,
)
QUERIES = {f.__name__: f for f in OWN}
