"""Queries over assignments, calls and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths
from ..operators import assign, cohort, genotype, variants
from . import adapt

SQL: dict[str, str] = {}


def _mates(spark, sf_dir):
    """Order lines as overlaps of two mates: even suppliers are first mates."""
    line = adapt.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 9).cast("int").alias("seq_idx"), F.when(F.col("l_suppkey") % 4 < 2, 1).otherwise(-1).alias("strand"),
        (F.col("l_suppkey") % 50).cast("int").alias("start"), (F.col("l_suppkey") % 50 + 20).cast("int").alias("end"), F.floor(F.col("l_quantity")).cast("int").alias("match"), (F.col("l_suppkey") % 2).alias("mate"),
    )
    return line.where("mate = 0").drop("mate"), line.where("mate = 1").drop("mate")


_MATES_SQL = """WITH o AS (SELECT l_orderkey AS read_id, CAST(l_partkey % 9 AS INT) AS seq_idx, CASE WHEN l_suppkey % 4 < 2 THEN 1 ELSE -1 END AS strand, CAST(l_suppkey % 50 AS INT) AS "start", CAST(l_suppkey % 50 + 20 AS INT) AS "end", CAST(floor(l_quantity) AS INT) AS match, l_suppkey % 2 AS mate FROM lineitem)
, x AS (SELECT * FROM o WHERE mate = 0), y AS (SELECT * FROM o WHERE mate = 1)
"""


def mate_pair_join(spark, sf_dir):
    return assign.pair_mates(*_mates(spark, sf_dir))


SQL["mate_pair_join"] = _MATES_SQL + """SELECT x.read_id, x.seq_idx, CASE WHEN x.strand = 1 THEN x."start" ELSE y."start" END AS "start", CASE WHEN x.strand = 1 THEN y."end" ELSE x."end" END AS "end", x.match + y.match AS match
FROM x JOIN y ON x.read_id = y.read_id AND x.seq_idx = y.seq_idx AND x.strand <> y.strand AND CASE WHEN x.strand = 1 THEN x."start" < y."start" ELSE x."start" > y."start" END"""


def dangling_mates(spark, sf_dir):
    return assign.dangling(*_mates(spark, sf_dir))


SQL["dangling_mates"] = _MATES_SQL + """SELECT read_id, seq_idx, strand, "start", "end", match, false AS from_second FROM x WHERE read_id NOT IN (SELECT read_id FROM y)
UNION ALL SELECT read_id, seq_idx, strand, "start", "end", match, true FROM y WHERE read_id NOT IN (SELECT read_id FROM x)"""


def best_overlap_per_allele(spark, sf_dir):
    first, _ = _mates(spark, sf_dir)
    return assign.best_per_allele(first, F.desc("match"), "strand", "start", "end")


SQL["best_overlap_per_allele"] = _MATES_SQL + """SELECT read_id, seq_idx, strand, "start", "end", match FROM (SELECT *, row_number() OVER (PARTITION BY read_id, seq_idx ORDER BY match DESC, strand, "start", "end") AS rn FROM x) WHERE rn = 1"""


def best_tie_retention(spark, sf_dir):
    a = adapt.assignments(spark, sf_dir).select("read_id", F.col("allele").alias("seq_idx"), (F.col("end") - F.col("start")).alias("match"), "similarity")
    return assign.best_ties(a).select("read_id", "seq_idx", "match", F.round("similarity", 6).alias("similarity"), "qual")


SQL["best_tie_retention"] = adapt.with_sql("assignments", then=""", a AS (SELECT read_id, allele AS seq_idx, "end" - "start" AS match, similarity FROM assignments)
SELECT read_id, seq_idx, match, round(similarity, 6) AS similarity, CAST(1 AS DOUBLE) AS qual FROM (SELECT *, rank() OVER (PARTITION BY read_id ORDER BY match DESC, similarity DESC) AS r FROM a) WHERE r = 1""")


def assignment_weight(spark, sf_dir):
    return assign.weigh(adapt.assignments(spark, sf_dir), 0.8, 3).select("read_id", "allele", F.round(F.col("weight").cast("double"), 6).alias("weight"), F.round(F.col("adjust").cast("double"), 6).alias("adjust"))


_WEIGHT = "CASE WHEN similarity < 1 - 3 * b THEN 0.01 WHEN similarity < 1 - 2 * b THEN 0.1 WHEN similarity < 1 - b THEN 0.5 ELSE 1.0 END"
SQL["assignment_weight"] = adapt.with_sql("assignments", then=f""", w AS (SELECT *, (1 - CAST(0.8 AS DOUBLE)) / 4 AS b, max(similarity) OVER (PARTITION BY read_id) AS top, count(*) OVER (PARTITION BY read_id) AS n FROM assignments)
SELECT read_id, allele, round(CAST(CAST({_WEIGHT} AS FLOAT) AS DOUBLE), 6) AS weight, round(CAST(CAST(CASE WHEN top < 1 THEN 0.25 ELSE 1.0 END AS FLOAT) * CAST({_WEIGHT} AS FLOAT) AS DOUBLE), 6) AS adjust FROM w WHERE n <= 3""")


def _groups(spark, sf_dir):
    a = adapt.assignments(spark, sf_dir).withColumn("weight", maths.assignment_weight(F.col("similarity")))
    return assign.coalesce_reads(a)


_GROUPS_SQL = adapt.with_sql("assignments", then=f""", weighed AS (SELECT read_id, allele, qual, "start", "end", {_WEIGHT} AS weight FROM (SELECT *, (1 - CAST(0.8 AS DOUBLE)) / 4 AS b FROM assignments))
, keyed AS (SELECT read_id, string_agg(allele || ':' || qual, ',' ORDER BY allele) AS k FROM weighed GROUP BY read_id)
, grouped AS (SELECT *, min(read_id) OVER (PARTITION BY k) AS rg_first, count(*) OVER (PARTITION BY k) AS n_reads FROM keyed)
, groups AS (SELECT rg_first, n_reads, allele, qual, CASE WHEN qual = 1 THEN min("start") ELSE arg_min("start", w.read_id) END AS "start", CASE WHEN qual = 1 THEN min("end") ELSE arg_min("end", w.read_id) END AS "end", sum(weight) AS weight
  FROM weighed w JOIN grouped g ON w.read_id = g.read_id GROUP BY rg_first, n_reads, allele, qual)
, signed AS (SELECT allele, string_agg(rg_first || ':' || qual, ',' ORDER BY rg_first) AS s FROM groups GROUP BY allele)
, classes AS (SELECT allele, min(allele) OVER (PARTITION BY s) AS ec, count(*) OVER (PARTITION BY s) AS ec_size FROM signed)
""")


def read_coalesce(spark, sf_dir):
    return _groups(spark, sf_dir).withColumn("weight", F.round("weight", 6))


SQL["read_coalesce"] = _GROUPS_SQL + 'SELECT rg_first, n_reads, allele, qual, "start", "end", round(CAST(weight AS DOUBLE), 6) AS weight FROM groups'


def equivalence_classes(spark, sf_dir):
    return assign.equivalence_classes(_groups(spark, sf_dir))


SQL["equivalence_classes"] = _GROUPS_SQL + "SELECT allele, ec, ec_size FROM classes"


def ec_prune_max_qual(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return assign.prune_by_quality(g, assign.equivalence_classes(g)).withColumn("total_qual", F.col("total_qual").cast("long"))


SQL["ec_prune_max_qual"] = _GROUPS_SQL + ", t AS (SELECT g.allele, ec, CAST(sum(qual) AS BIGINT) AS total_qual FROM groups g JOIN classes c ON g.allele = c.allele GROUP BY ALL) SELECT allele, ec, total_qual FROM (SELECT *, max(total_qual) OVER (PARTITION BY ec) AS top FROM t) WHERE total_qual = top"


def _em(spark, sf_dir, rounds):
    g = _groups(spark, sf_dir)
    ec = assign.equivalence_classes(g)
    edges = assign.group_classes(g, ec)
    lengths = ec.select("ec").distinct().withColumn("length", 1000 + 10 * F.col("ec"))
    return ec, assign.em_rounds(edges, lengths.select("ec", F.lit(1.0).alias("share")), lengths, rounds), lengths


def _em_sql(rounds: int) -> str:
    out = _GROUPS_SQL + """, n AS (SELECT rg_first, max(weight) AS n FROM groups GROUP BY rg_first)
, edges AS (SELECT g.rg_first, c.ec, n.n FROM groups g JOIN classes c ON g.allele = c.allele JOIN n ON g.rg_first = n.rg_first GROUP BY ALL)
, lengths AS (SELECT DISTINCT ec, 1000 + 10 * ec AS length FROM classes)
, s0 AS (SELECT ec, 1.0 :: DOUBLE AS share FROM lengths)"""
    for i in range(rounds):
        out += f"""
, p{i} AS (SELECT e.rg_first, e.ec, e.n, s.share, sum(s.share) OVER (PARTITION BY e.rg_first) AS total FROM edges e JOIN s{i} s ON e.ec = s.ec)
, r{i} AS (SELECT ec, sum(n * share / CASE WHEN total = 0 THEN 1 ELSE total END) AS reads FROM p{i} GROUP BY ec)
, s{i + 1} AS (SELECT r.ec, reads, reads / length / sum(reads / length) OVER () AS share FROM r{i} r JOIN lengths l ON r.ec = l.ec)"""
    return out


def em_fixed_rounds(spark, sf_dir):
    _, share, _ = _em(spark, sf_dir, 3)
    return share.select("ec", F.round("share", 6).alias("share"), F.round("reads", 4).alias("reads"))


SQL["em_fixed_rounds"] = _em_sql(3) + " SELECT ec, round(share, 6) AS share, round(reads, 4) AS reads FROM s3"


def abundance_rollup(spark, sf_dir):
    ec, share, lengths = _em(spark, sf_dir, 1)
    alleles = ec.select("allele", F.concat(F.lit("G"), (F.col("allele") % 4).cast("string")).alias("gene"), F.concat(F.lit("M"), F.floor(F.col("allele") / 2).cast("string")).alias("major"))
    out = assign.roll_up(ec.join(lengths, "ec").select("allele", "ec", "length"), share.select("ec", "reads"), alleles)
    return out.select("gene", F.round("gene_abundance", 4).alias("gene_abundance"), F.round("max_major", 4).alias("max_major"))


SQL["abundance_rollup"] = _em_sql(1) + """, a AS (SELECT c.allele, reads / length * 1000 / ec_size AS x FROM classes c JOIN s1 ON c.ec = s1.ec JOIN lengths l ON c.ec = l.ec)
, m AS (SELECT 'G' || (allele % 4) AS gene, 'M' || CAST(floor(allele / 2) AS BIGINT) AS major, sum(x) AS x FROM a GROUP BY ALL)
SELECT gene, round(sum(x), 4) AS gene_abundance, round(max(x), 4) AS max_major FROM m GROUP BY gene"""


def ec_likelihood_filter(spark, sf_dir):
    g = _groups(spark, sf_dir)
    ec = assign.equivalence_classes(g)
    span = g.join(ec, "allele").groupBy("ec", "allele").agg(F.min("start").alias("low"), (F.max("end") - F.col("allele") * 3).alias("high"))
    members = span.withColumn("length", F.lit(100)).withColumn("ec_abundance", F.lit(2.0) + F.col("ec"))
    return assign.likelihood_filter(members, 0.5).select("ec", "allele", F.round("likelihood", 6).alias("likelihood"))


SQL["ec_likelihood_filter"] = _GROUPS_SQL + """, s AS (SELECT ec, g.allele, min("start") AS low, max("end") - g.allele * 3 AS high FROM groups g JOIN classes c ON g.allele = c.allele GROUP BY ec, g.allele)
, l AS (SELECT ec, allele, power(least(high - low + 1, 100) / 100, 2.0 + ec) AS likelihood FROM s)
SELECT ec, allele, round(likelihood, 6) AS likelihood FROM (SELECT *, max(likelihood) OVER (PARTITION BY ec) AS top FROM l) WHERE likelihood = top OR likelihood / top >= 0.5"""


def ec_entropy(spark, sf_dir):
    g = _groups(spark, sf_dir)
    total = g.groupBy("allele").agg(F.sum("weight").alias("abundance"))
    members = assign.equivalence_classes(g).join(total, "allele").withColumn("major", F.concat(F.lit("M"), F.col("allele").cast("string"))).withColumn("abundance", F.col("abundance") + F.col("allele"))
    return assign.class_entropy(members).select("ec", "size", F.round("entropy", 6).alias("entropy"), "series")


SQL["ec_entropy"] = _GROUPS_SQL + """, t AS (SELECT c.ec, c.allele, sum(weight) + c.allele AS x FROM groups g JOIN classes c ON g.allele = c.allele GROUP BY c.ec, c.allele)
, p AS (SELECT *, x / sum(x) OVER (PARTITION BY ec) AS p FROM t)
SELECT ec, count(*) AS size, round(0.0 - sum(p * ln(p)), 6) AS entropy, string_agg('M' || allele, ';' ORDER BY allele) AS series FROM p GROUP BY ec"""


def coverage_stats(spark, sf_dir):
    out = assign.coverage_stats(adapt.coverage(spark, sf_dir), 0.5)
    return out.select("seq_idx", "cov_min", "cov_p10", "cov_median", F.round("frac_covered", 6).alias("frac_covered"))


_COVERAGE_SQL = adapt.with_sql("coverage", then=""", d AS (SELECT seq_idx, list_sort(list(depth)) AS d FROM coverage GROUP BY seq_idx)
""")
SQL["coverage_stats"] = _COVERAGE_SQL + "SELECT CAST(seq_idx AS INT) AS seq_idx, d[1] AS cov_min, d[least(len(d) // 10, len(d) - 1) + 1] AS cov_p10, d[len(d) // 2 + 1] AS cov_median, round(len([x FOR x IN d IF x > 0]) / len(d), 6) AS frac_covered FROM d"


def missing_coverage(spark, sf_dir):
    return assign.coverage_stats(adapt.coverage(spark, sf_dir), 0.8).select("seq_idx", F.col("missing").cast("long").alias("missing"))


SQL["missing_coverage"] = _COVERAGE_SQL + "SELECT CAST(seq_idx AS INT) AS seq_idx, len([x FOR x IN d IF x < greatest(1.0, d[len(d) // 2 + 1] * 0.8)]) AS missing FROM d"


def _cells(spark, sf_dir):
    """Pileup cells of events: seq_idx, pos, base, weight, read_id."""
    e = adapt.table(spark, sf_dir, "events")
    base = F.element_at(F.array(*map(F.lit, "ACGT")), (F.floor(F.col("value") * 100) % 4 + 1).cast("int"))
    return e.select((F.col("user_id") % 20).cast("int").alias("seq_idx"), (F.col("event_id") % 50).cast("int").alias("pos"), base.alias("base"), (F.col("user_id") % 3 + 1).alias("weight"), F.col("event_id").alias("read_id"))


_CELLS_SQL = "WITH cells AS (SELECT CAST(user_id % 20 AS INT) AS seq_idx, CAST(event_id % 50 AS INT) AS pos, substring('ACGT', CAST(floor(value * 100) AS BIGINT) % 4 + 1, 1) AS base, user_id % 3 + 1 AS weight, event_id AS read_id FROM events)\n"


def pileup(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("seq_idx", "pos", "base").agg(F.sum("weight").alias("depth"))


SQL["pileup"] = _CELLS_SQL + "SELECT seq_idx, pos, base, CAST(sum(weight) AS BIGINT) AS depth FROM cells GROUP BY ALL"


def variant_candidates(spark, sf_dir):
    depth = _cells(spark, sf_dir).groupBy("seq_idx", "pos", "base").agg(F.sum("weight").alias("depth"))
    ref = depth.select("seq_idx", "pos").distinct().withColumn("ref", F.element_at(F.array(*map(F.lit, "ACGT")), ((F.col("seq_idx") + F.col("pos")) % 4 + 1).cast("int")))
    return variants.candidate_sites(depth, ref).select("seq_idx", "pos", "ref", "alt", "alt_depth", "ref_depth")


SQL["variant_candidates"] = _CELLS_SQL + """, d AS (SELECT seq_idx, pos, base, CAST(sum(weight) AS BIGINT) AS depth FROM cells GROUP BY ALL)
, r AS (SELECT DISTINCT seq_idx, pos, substring('ACGT', (seq_idx + pos) % 4 + 1, 1) AS ref FROM d)
SELECT r.seq_idx, r.pos, ref, a.base AS alt, a.depth AS alt_depth, coalesce(x.depth, 0) AS ref_depth FROM r JOIN d a ON a.seq_idx = r.seq_idx AND a.pos = r.pos AND a.base <> ref
LEFT JOIN d x ON x.seq_idx = r.seq_idx AND x.pos = r.pos AND x.base = ref WHERE a.depth >= 5 AND a.depth >= 0.5 * coalesce(x.depth, 0)"""


def _edges(spark, sf_dir):
    """Every event is linked with the next, or (by its value) with itself, so components are runs of events."""
    link = F.when(F.floor(F.col("value") * 100) % 4 < 3, 1).otherwise(0)
    return adapt.table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), (F.col("event_id") + link).alias("b"))


def variant_components(spark, sf_dir):
    return variants.components(_edges(spark, sf_dir))


SQL["variant_components"] = """WITH RECURSIVE edges AS (SELECT event_id AS a, event_id + CASE WHEN CAST(floor(value * 100) AS BIGINT) % 4 < 3 THEN 1 ELSE 0 END AS b FROM events)
, linked AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b)
, reach AS (SELECT a AS node, a AS other FROM linked UNION SELECT r.node, e.b FROM reach r JOIN linked e ON r.other = e.a)
SELECT node, min(other) AS root FROM reach GROUP BY node"""


def _freq(spark, sf_dir):
    return adapt.frequencies(spark, sf_dir)


def freq_prefix_match(spark, sf_dir):
    from ..operators import frequency

    table = _freq(spark, sf_dir)
    wanted = table.select("locus", F.slice("fields", 1, 1).alias("fields")).distinct().unionByName(table.select("locus", "fields"))
    return frequency.frequencies(wanted, table).select("locus", F.concat_ws(":", "fields").alias("allele"), F.round("frequency", 6).alias("frequency"))


SQL["freq_prefix_match"] = adapt.with_sql("frequencies", then=""", wanted AS (SELECT DISTINCT locus, f1, CAST(NULL AS VARCHAR) AS f2 FROM freq UNION ALL SELECT locus, f1, f2 FROM freq)
, total AS (SELECT locus, sum(n) AS t, count(*) AS k FROM freq GROUP BY locus)
SELECT w.locus, w.f1 || coalesce(':' || w.f2, '') AS allele, round((sum(f.n) + 0.5) / (any_value(t) + 0.5 * any_value(k)), 6) AS frequency
FROM wanted w JOIN freq f ON f.locus = w.locus AND f.f1 = w.f1 AND (w.f2 IS NULL OR f.f2 = w.f2) JOIN total ON total.locus = w.locus GROUP BY w.locus, w.f1, w.f2""")


def hwe_prior(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("f1"), (F.col("p_partkey") % 40 + 1).cast("double").alias("f2"))
    f2 = F.col("f2") / 41.0
    return p.select("p_partkey", F.round(maths.hwe_log_prior(F.col("f1"), f2, F.lit(False)), 6).alias("het"), F.round(maths.hwe_log_prior(F.col("f1"), f2, F.lit(True)), 6).alias("hom"), maths.null_penalty(3.0, F.col("f1") > 0.5, F.col("f2") > 20, F.col("p_partkey") % 2 == 0).alias("penalty"))


SQL["hwe_prior"] = """SELECT p_partkey, round(ln(2) + ln(p_size / 51.0) + ln((p_partkey % 40 + 1) / 41.0), 6) AS het, round(2 * ln(p_size / 51.0), 6) AS hom,
  CAST(3 AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 2 * CAST(p_size / 51.0 > 0.5 AS INT) ELSE CAST(p_size / 51.0 > 0.5 AS INT) + CAST(p_partkey % 40 + 1 > 20 AS INT) END AS penalty FROM part"""


def normal_tail_as66(spark, sf_dir):
    z = (F.col("event_id") % 400 - 200) / 10.0
    return adapt.table(spark, sf_dir, "events").select(z.alias("z")).distinct().select("z", F.round(maths.normal_tail(F.col("z")), 9).alias("tail"))


def _tail_sql(z: str) -> str:
    a, b, c, d = maths.A, maths.B, maths.C, maths.D
    x, y = f"abs({z})", f"(0.5 * {z} * {z})"
    near = f"(0.5 - {x} * ({maths.P} - {maths.Q} * {y} / ({y} + {a[0]} + ({b[0]}) / ({y} + {a[1]} + {b[1]} / ({y} + {a[2]})))))"
    inner = f"({x} + {c[5]})"
    for k in range(4, -1, -1):
        inner = f"({x} + ({c[k]}) + ({d[k]}) / {inner})"
    far = f"({maths.R} * exp(-{y}) / {inner})"
    tail = f"CASE WHEN {x} <= 1.28 THEN {near} WHEN {x} <= 7 OR ({z} >= 0 AND {x} <= 18.66) THEN {far} ELSE 0 END"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - ({tail}) END"


SQL["normal_tail_as66"] = f"WITH e AS (SELECT DISTINCT CAST((event_id % 400 - 200) AS DOUBLE) / 10 AS z FROM events) SELECT z, round({_tail_sql('z')}, 9) AS tail FROM e"


def discriminative_phred(spark, sf_dir):
    c = adapt.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_suppkey") % 30).cast("double").alias("second"))
    return c.select("l_orderkey", "l_linenumber", maths.discriminative_phred(F.col("l_quantity"), F.col("second")).alias("phred"))


SQL["discriminative_phred"] = "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 30 <= 0 THEN 60 ELSE CAST(trunc(least(60, greatest(0, -10 * log10((l_suppkey % 30) / (l_quantity + l_suppkey % 30))))) AS INT) END AS phred FROM lineitem"


def _ranked(spark, sf_dir):
    """Abundances of genes' ranks, from calls."""
    return adapt.calls(spark, sf_dir).select("sample", "gene", (F.col("slot") - 1).alias("rank"), "abundance")


def genotype_quality(spark, sf_dir):
    out = variants.rank_quality(_ranked(spark, sf_dir), cross_gene=0.001)
    return out.select("sample", "gene", "rank", "quality")


SQL["genotype_quality"] = adapt.with_sql("calls", then=f""", r AS (SELECT sample, gene, slot - 1 AS rank, abundance AS a, sum(abundance) OVER (PARTITION BY sample, gene) AS g, sum(abundance) OVER (PARTITION BY sample) AS t FROM calls)
, z AS (SELECT *, 2 * (sqrt(a) - sqrt((g - a) * 0.01 + 0.001 * (t - g))) AS z FROM r)
, q AS (SELECT *, {_tail_sql("z")} AS tail FROM z)
SELECT sample, gene, CAST(rank AS INT) AS rank, CASE WHEN a < 1 THEN 0 WHEN tail <= 0 THEN 60 ELSE CAST(trunc(least(60, greatest(0, -log10(tail)))) AS INT) END AS quality FROM q""")


def call_description(spark, sf_dir):
    return variants.slot_text(adapt.calls(spark, sf_dir))


SQL["call_description"] = adapt.with_sql("calls", then=r""", t AS (SELECT sample, gene, slot, array_to_string(alleles, ',') || chr(9) || format('{:.6f}', abundance) || chr(9) || quality AS t FROM calls)
SELECT sample, gene, count(*) AS num_alleles, coalesce(max(t) FILTER (slot = 1), '.' || chr(9) || '0' || chr(9) || '-1') AS allele1, coalesce(max(t) FILTER (slot = 2), '.' || chr(9) || '0' || chr(9) || '-1') AS allele2 FROM t GROUP BY ALL""")


def pair_search_score(spark, sf_dir):
    """Pairs of types of a gene by the weight of reads that either covers."""
    a = adapt.assignments(spark, sf_dir).where("qual = 1").select("read_id", (F.col("allele") % 3).alias("gene"), "allele", maths.assignment_weight(F.col("similarity")).alias("weight"))
    return variants.pair_coverage(a).select("gene", "j", "k", F.round("covered", 4).alias("covered"))


SQL["pair_search_score"] = adapt.with_sql("assignments", then=f""", a AS (SELECT read_id, allele % 3 AS gene, allele, {_WEIGHT} AS weight FROM (SELECT *, (1 - CAST(0.8 AS DOUBLE)) / 4 AS b FROM assignments) WHERE qual = 1)
, types AS (SELECT DISTINCT gene, allele FROM a), pairs AS (SELECT x.gene, x.allele AS j, y.allele AS k FROM types x JOIN types y ON x.gene = y.gene AND x.allele < y.allele)
, cover AS (SELECT p.gene, j, k, read_id, max(weight) AS w FROM pairs p JOIN a ON a.gene = p.gene AND (a.allele = j OR a.allele = k) GROUP BY ALL)
SELECT gene, j, k, round(CAST(sum(w) AS DOUBLE), 4) AS covered FROM cover GROUP BY ALL""")


def combine_votes(spark, sf_dir):
    return cohort.votes(adapt.calls(spark, sf_dir), 10).select("gene", "allele", "total")


_VOTES_SQL = adapt.with_sql("calls", then=""", v AS (SELECT gene, alleles[1] AS allele, CAST(sum(quality) AS BIGINT) AS total, min(sample || lpad(CAST(ord AS VARCHAR), 20, '0') || slot) AS fv FROM calls WHERE quality > 10 GROUP BY ALL)
, reps AS (SELECT gene, allele, total FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY total DESC, fv) AS rn FROM v) WHERE rn <= 2 AND total >= 30)
""")
SQL["combine_votes"] = _VOTES_SQL + "SELECT gene, allele, total FROM v"


def combine_representatives(spark, sf_dir):
    return cohort.representatives(adapt.calls(spark, sf_dir), 2, 10, 30)


SQL["combine_representatives"] = _VOTES_SQL + "SELECT gene, allele, total FROM reps"


def combine_cells(spark, sf_dir):
    c = adapt.calls(spark, sf_dir)
    return cohort.cells(c, cohort.representatives(c, 2, 10, 30), 10).withColumn("abundance", F.round("abundance", 6))


_MATCH_SQL = adapt.with_sql("calls", then=""", v AS (SELECT gene, alleles[1] AS allele, CAST(sum(quality) AS BIGINT) AS total, min(sample || lpad(CAST(ord AS VARCHAR), 20, '0') || slot) AS fv FROM calls WHERE quality > 10 GROUP BY ALL)
, reps AS (SELECT gene, allele, total FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY total DESC, fv) AS rn FROM v) WHERE rn <= 2 AND total >= 30)
, own AS (SELECT * FROM calls WHERE quality > 10)
, spread AS (SELECT sample, gene, slot, unnest(alleles) AS allele, generate_subscripts(alleles, 1) AS k FROM own)
, m AS (SELECT sample, gene, slot, arg_min(allele, k) AS match FROM spread WHERE allele IN (SELECT allele FROM reps) GROUP BY ALL)
, slots AS (SELECT own.*, match FROM own LEFT JOIN m USING (sample, gene, slot))
""")
SQL["combine_cells"] = _MATCH_SQL + "SELECT sample, match AS allele, round(sum(abundance), 6) AS abundance FROM slots WHERE match IS NOT NULL GROUP BY ALL"


def combine_matrix(spark, sf_dir):
    """The matrix, one row per sample and cell text, columns joined."""
    wide = cohort.matrix(adapt.calls(spark, sf_dir), 2, 10, 30)
    names = [c for c in wide.columns if c not in ("sample", "inconsistency")]
    return wide.select("sample", F.concat_ws("\t", *(F.col(f"`{n}`") for n in names)).alias("cells"), "inconsistency")


SQL["combine_matrix"] = _MATCH_SQL + """, grid AS (SELECT s.sample, r.allele, sum(abundance) AS x FROM (SELECT DISTINCT sample FROM calls) s CROSS JOIN (SELECT DISTINCT allele FROM reps) r LEFT JOIN slots c ON c.sample = s.sample AND c.match = r.allele GROUP BY ALL)
, line AS (SELECT sample, string_agg(CASE WHEN x IS NULL THEN '0' ELSE CAST(CAST(x AS DOUBLE) AS VARCHAR) END, chr(9) ORDER BY allele) AS cells FROM grid GROUP BY sample)
, bad AS (SELECT sample, string_agg(array_to_string(alleles, '_') || '_' || CAST(CAST(abundance AS DOUBLE) AS VARCHAR) || '_' || quality, ',' ORDER BY ord, slot, array_to_string(alleles, '_')) AS inconsistency FROM slots WHERE match IS NULL GROUP BY sample)
SELECT sample, cells, coalesce(inconsistency, '') AS inconsistency FROM line LEFT JOIN bad USING (sample)"""


def combine_inconsistencies(spark, sf_dir):
    c = adapt.calls(spark, sf_dir)
    return cohort.inconsistencies(c, cohort.representatives(c, 2, 10, 30), 10)


SQL["combine_inconsistencies"] = _MATCH_SQL + "SELECT sample, string_agg(array_to_string(alleles, '_') || '_' || CAST(CAST(abundance AS DOUBLE) AS VARCHAR) || '_' || quality, ',' ORDER BY ord, slot, array_to_string(alleles, '_')) AS inconsistency FROM slots WHERE match IS NULL GROUP BY sample"


def _copies(spark, sf_dir):
    return adapt.calls(spark, sf_dir).withColumn("allele", F.concat(F.col("gene"), F.lit("*"), F.col("slot").cast("string")))


def copynumber_anchor_fit(spark, sf_dir):
    fit = cohort.one_copy(_copies(spark, sf_dir), ["G0", "G3"], 0.1, 0.6, 1.5, 5)
    return fit.select("sample", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


_COPY_SQL = adapt.with_sql("calls", then=""", own AS (SELECT *, gene || '*' || slot AS allele, sqrt(abundance) AS x, count(*) OVER (PARTITION BY sample, gene) AS n, gene IN ('G0', 'G3') AS sure FROM calls WHERE quality > 5)
, span AS (SELECT sample, count(*) FILTER (NOT sure) AS span FROM own GROUP BY sample)
, pairs AS (SELECT sample, allele, arg_min(x, ord) AS x FROM own WHERE NOT sure AND n > 1 GROUP BY ALL)
, band AS (SELECT sample, x FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY x, allele) - 1 AS rn FROM pairs) JOIN span USING (sample) WHERE rn >= floor(span * CAST(0.1 AS DOUBLE)) AND rn < floor(span * CAST(0.6 AS DOUBLE)))
, anchors AS (SELECT sample, CASE WHEN n > 1 THEN x ELSE x / 2 END AS x FROM own WHERE sure UNION ALL SELECT * FROM band)
, fit AS (SELECT sample, avg(x) AS mean, (avg(x * x) - avg(x) * avg(x)) * 1.5 AS var FROM anchors GROUP BY sample)
""")
SQL["copynumber_anchor_fit"] = _COPY_SQL + "SELECT sample, round(mean, 6) AS mean, round(var, 6) AS var FROM fit"


def copynumber_calls(spark, sf_dir):
    c = _copies(spark, sf_dir)
    out = cohort.copy_numbers(c, cohort.one_copy(c, ["G0", "G3"], 0.1, 0.6, 1.5, 5), 5)
    return out.select("sample", "gene", "slot", "copy", F.round("ratio", 4).alias("ratio"))


_CALLED_SQL = _COPY_SQL + """, last AS (SELECT sample, allele, arg_max(abundance, ord) AS a FROM own GROUP BY ALL)
, l AS (SELECT o.sample, o.gene, o.slot, o.allele, c, -0.5 * power((sqrt(a) - mean * c) / sqrt(var * c), 2) - ln(sqrt(var * c)) AS ll FROM own o JOIN last USING (sample, allele) JOIN fit ON fit.sample = o.sample, range(1, 9) t(c))
, r AS (SELECT *, row_number() OVER (PARTITION BY sample, gene, slot ORDER BY ll DESC, c) AS rn, lead(ll) OVER (PARTITION BY sample, gene, slot ORDER BY ll DESC, c) AS second FROM l)
, called AS (SELECT sample, gene, slot, allele, c AS copy, ll - second AS ratio FROM r WHERE rn = 1)
"""
SQL["copynumber_calls"] = _CALLED_SQL + "SELECT sample, gene, CAST(slot AS INT) AS slot, CAST(copy AS INT) AS copy, round(ratio, 4) AS ratio FROM called"


def copynumber_rows(spark, sf_dir):
    c = _copies(spark, sf_dir)
    return cohort.copy_rows(c, cohort.copy_numbers(c, cohort.one_copy(c, ["G0", "G3"], 0.1, 0.6, 1.5, 5), 5), 5)


SQL["copynumber_rows"] = _CALLED_SQL + """, t AS (SELECT sample, gene, list(allele || chr(9) || copy || chr(9) || format('{:.2f}', ratio) ORDER BY slot) AS c FROM called GROUP BY ALL)
, n AS (SELECT sample, gene, count(*) FILTER (quality > 5) AS n FROM calls GROUP BY ALL)
SELECT sample, gene || chr(9) || n || chr(9) || coalesce(c[1], '.' || chr(9) || '-1' || chr(9) || '0') || chr(9) || coalesce(c[2], '.' || chr(9) || '-1' || chr(9) || '0') AS line FROM n LEFT JOIN t USING (sample, gene)"""


def sample_names(spark, sf_dir):
    """Sample names of genotype files."""
    n = F.concat(F.lit("/data/run.1/"), "p_brand", F.lit("."), F.col("p_partkey").cast("string"), F.lit("_genotype.tsv"))
    return adapt.table(spark, sf_dir, "part").select("p_partkey", variants.sample_name(n).alias("sample"))


SQL["sample_names"] = "SELECT p_partkey, p_brand || '.' || p_partkey AS sample FROM part"


def squarem_em(spark, sf_dir):
    """Calls of twelve alleles per sample by the whole caller: EM with extrapolation, selection, pair search, qualities."""
    a = adapt.assignments(spark, sf_dir).withColumn("sample", F.concat(F.lit("S"), (F.col("read_id") % 8).cast("string")))
    w = maths.assignment_weight(F.col("similarity")).cast("float")
    hits = a.select("sample", "read_id", F.col("allele").cast("long").alias("seq_idx"), "start", "end", w.alias("weight"), F.when(F.col("qual") == 1, 1.0).otherwise(0.5).cast("float").alias("qual"), w.alias("adjust"))
    rows = [(i, f"G{i % 3}*{i:03d}:01", f"G{i % 3}", f"G{i % 3}*{i:03d}", 1000 + 10 * i, 1, 0, 1000 + 10 * i, False, f"G{i % 3}*{i:03d}") for i in range(12)]
    panel = spark.createDataFrame(rows, "seq_idx long, name string, gene string, major string, length int, weight int, missing int, consensus int, null boolean, exonic string")
    return genotype.genotype(hits, panel)


def variant_group_solve(spark, sf_dir):
    """Best base choices of groups of variant sites."""
    return variants.solve_groups(variants.demo_groups(adapt.table(spark, sf_dir, "events")))


OWN = (
    mate_pair_join, dangling_mates, best_overlap_per_allele, best_tie_retention, assignment_weight, read_coalesce, equivalence_classes, ec_prune_max_qual, em_fixed_rounds, abundance_rollup,
    ec_likelihood_filter, ec_entropy, coverage_stats, missing_coverage, pileup, variant_candidates, variant_components, freq_prefix_match, hwe_prior, normal_tail_as66, discriminative_phred,
    genotype_quality, call_description, pair_search_score, combine_votes, combine_representatives, combine_cells, combine_matrix, combine_inconsistencies, copynumber_anchor_fit,
    copynumber_calls, copynumber_rows, sample_names, squarem_em, variant_group_solve,
)
QUERIES = {f.__name__: f for f in OWN}
