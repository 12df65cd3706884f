"""Relational steps between overlaps and equivalence classes: pairing, ties, weights, coalescing, classes, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from .common import stored


def dedup_sequences(seqs: DataFrame, order: str = "seq_idx", name: str = "name") -> DataFrame:
    """(order, name, seq, weight): equal non-empty sequences as one, with the first's name and their number."""
    return seqs.where("seq <> ''").groupBy("seq").agg(F.min(order).alias(order), F.min_by(name, order).alias(name), F.count("*").alias("weight")).select(order, name, "seq", "weight")


def distinct_reads(reads: DataFrame) -> DataFrame:
    """(seq, n): read sequences and how many reads have them."""
    return reads.groupBy("seq").agg(F.count("*").alias("n"))


def pair_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates' overlaps on the same allele, opposite strands, the forward one first (read_id, seq_idx, strand, start, end, match)."""
    b = second.select("read_id", "seq_idx", *(F.col(c).alias(f"{c}2") for c in ("strand", "start", "end", "match")))
    order = F.when(F.col("strand") == 1, F.col("start") < F.col("start2")).otherwise(F.col("start") > F.col("start2"))
    both = first.join(b, ["read_id", "seq_idx"]).where((F.col("strand") != F.col("strand2")) & order)
    return both.select(
        "read_id", "seq_idx", F.when(F.col("strand") == 1, F.col("start")).otherwise(F.col("start2")).alias("start"),
        F.when(F.col("strand") == 1, F.col("end2")).otherwise(F.col("end")).alias("end"), (F.col("match") + F.col("match2")).alias("match"),
    )


def dangling(first: DataFrame, second: DataFrame) -> DataFrame:
    """Overlaps of reads that have them for one mate alone, with from_second."""
    one = first.join(second.select("read_id").distinct(), "read_id", "left_anti").withColumn("from_second", F.lit(False))
    two = second.join(first.select("read_id").distinct(), "read_id", "left_anti").withColumn("from_second", F.lit(True))
    return one.unionByName(two)


def best_per_allele(found: DataFrame, *order: Column) -> DataFrame:
    """The first row per read and allele."""
    w = Window.partitionBy("read_id", "seq_idx").orderBy(*order)
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def best_ties(found: DataFrame) -> DataFrame:
    """Rows equal to their read's best (match, similarity), with quality 1."""
    top = found.groupBy("read_id").agg(F.max(F.struct("match", "similarity")).alias("top"))
    return found.join(top, "read_id").where(F.struct("match", "similarity") == F.col("top")).drop("top").withColumn("qual", F.lit(1.0))


def weigh(found: DataFrame, similarity: float = 0.8, most: int = 2000) -> DataFrame:
    """Adds weight and adjust (a quarter of it unless the read's best is perfect); reads with more than `most` alleles are left out."""
    top = found.groupBy("read_id").agg(F.max("similarity").alias("top"), F.count("*").alias("n_alleles"))
    w = maths.assignment_weight(F.col("similarity"), similarity).cast("float")
    own = found.join(top, "read_id").where(F.col("n_alleles") <= most).withColumn("weight", w)
    return own.withColumn("adjust", F.when(F.col("top") < 1, F.lit(0.25)).otherwise(1.0).cast("float") * F.col("weight")).drop("top", "n_alleles")


def lists(found: DataFrame) -> DataFrame:
    """(read_id, key, hits): a read's assignments ordered by allele; the key holds alleles and qualities."""
    hits = F.sort_array(F.collect_list(F.struct("allele", "qual", "start", "end", "weight")))
    per = found.groupBy("read_id").agg(hits.alias("hits"))
    return per.withColumn("key", F.transform("hits", lambda h: F.struct(h["allele"].alias("allele"), h["qual"].alias("qual"))))


def coalesce_reads(found: DataFrame) -> DataFrame:
    """(rg_first, n_reads, allele, qual, start, end, weight): reads with the same alleles and qualities as one group.

    A group is known by its first read. Weights add up; of assignments with quality 1 smallest start and end stay, of others the first read's.
    """
    rows = lists(found).select("read_id", "key", F.posexplode("hits").alias("k", "h"))
    one = F.col("h.qual") == 1
    g = rows.groupBy("key", "k").agg(
        F.min("read_id").alias("rg_first"), F.count("*").alias("n_reads"), F.min_by(F.struct("h.start", "h.end"), "read_id").alias("f"),
        F.min(F.when(one, F.col("h.start"))).alias("s"), F.min(F.when(one, F.col("h.end"))).alias("e"), F.sum("h.weight").alias("weight"),
    )
    at = F.col("key")[F.col("k")]
    return g.select("rg_first", "n_reads", at["allele"].alias("allele"), at["qual"].alias("qual"), F.coalesce("s", "f.start").alias("start"), F.coalesce("e", "f.end").alias("end"), "weight")


def equivalence_classes(groups: DataFrame) -> DataFrame:
    """(allele, ec, ec_size): alleles of exactly the same read groups and qualities; a class is known by its smallest allele."""
    sign = F.sort_array(F.collect_list(F.struct("rg_first", "qual")))
    per = groups.groupBy("allele").agg(F.sha2(F.to_json(sign), 256).alias("sign"))
    ec = per.groupBy("sign").agg(F.min("allele").alias("ec"), F.count("*").alias("ec_size"))
    return per.join(ec, "sign").select("allele", "ec", "ec_size")


def prune_by_quality(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(allele, ec, total_qual): members of each class with its largest summed quality."""
    total = groups.groupBy("allele").agg(F.sum("qual").alias("total_qual")).join(classes, "allele")
    top = total.groupBy("ec").agg(F.max("total_qual").alias("top"))
    return total.join(top, "ec").where("total_qual = top").select("allele", "ec", "total_qual")


def group_classes(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(rg_first, ec, qual, n): read groups and the classes they touch; n is the group's largest weight."""
    n = groups.groupBy("rg_first").agg(F.max("weight").alias("n"))
    return groups.join(classes, "allele").groupBy("rg_first", "ec").agg(F.max("qual").alias("qual")).join(n, "rg_first")


def em_step(edges: DataFrame, share: DataFrame, lengths: DataFrame) -> DataFrame:
    """One expectation-maximisation step: (ec, share, reads) from edges (rg_first, ec, n), shares and lengths (ec, length)."""
    own = edges.join(share.select("ec", "share"), "ec")
    total = own.groupBy("rg_first").agg(F.sum("share").alias("total"))
    part = F.col("n") * F.col("share") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    reads = own.join(total, "rg_first").groupBy("ec").agg(F.sum(part).alias("reads")).join(lengths, "ec")
    rate = reads.withColumn("rate", F.col("reads") / F.col("length"))
    return rate.crossJoin(rate.agg(F.sum("rate").alias("all_rates"))).select("ec", (F.col("rate") / F.col("all_rates")).alias("share"), "reads")


def em_rounds(edges: DataFrame, start: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """A fixed number of steps; the edges are written out once, and every second step's shares, so plans stay short."""
    edges, now = stored(edges, "em-edges"), start
    for i in range(rounds):
        now = em_step(edges, now, lengths)
        if i % 2 and i + 1 < rounds:
            now = stored(now, "em")
    return now


def roll_up(classes: DataFrame, reads: DataFrame, alleles: DataFrame) -> DataFrame:
    """(gene, gene_abundance, max_major): reads per kilobase of classes, spread over members, summed by major allele and gene."""
    size = classes.groupBy("ec").agg(F.count("*").alias("members"), F.min("length").alias("length"))
    own = classes.select("allele", "ec").join(size, "ec").join(reads, "ec").withColumn("abundance", F.col("reads") / F.col("length") * 1000 / F.col("members"))
    major = own.join(alleles, "allele").groupBy("gene", "major").agg(F.sum("abundance").alias("abundance"))
    return major.groupBy("gene").agg(F.sum("abundance").alias("gene_abundance"), F.max("abundance").alias("max_major"))


def likelihood_filter(members: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Rows (ec, allele, low, high, length, ec_abundance) whose reads span enough: (span / length) ** abundance at least a twentieth of the class's best."""
    span = F.least(F.col("high") - F.col("low") + 1, F.col("length")) / F.col("length")
    own = members.withColumn("likelihood", F.pow(span, F.col("ec_abundance")))
    top = own.groupBy("ec").agg(F.max("likelihood").alias("top"))
    return own.join(top, "ec").where((F.col("likelihood") == F.col("top")) | (F.col("likelihood") / F.col("top") >= cutoff)).select("ec", "allele", "likelihood")


def class_entropy(members: DataFrame) -> DataFrame:
    """(ec, size, entropy, series): entropy of members' abundances and their major alleles, joined by `;` in allele order."""
    total = members.groupBy("ec").agg(F.sum("abundance").alias("total"))
    p = F.col("abundance") / F.col("total")
    return members.join(total, "ec").groupBy("ec").agg(
        F.count("*").alias("size"), F.coalesce(F.sum(F.when(F.col("abundance") > 0, -p * F.log(p))), F.lit(0.0)).alias("entropy"),
        F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("allele", "major"))), lambda x: x["major"])).alias("series"),
    )


def coverage_stats(cells: DataFrame, ratio: float = 0.01) -> DataFrame:
    """Per allele: minimum, tenth, median (upper), covered share, and bases below a hundredth of the median (at least 1).

    cells holds one row per exon position; an allele's own positions are bounded by its length.
    """
    own = cells.groupBy("seq_idx").agg(F.sort_array(F.collect_list("depth")).alias("d"))
    n, d = F.size("d"), F.col("d")
    median = F.element_at(d, (F.floor(n / 2) + 1).cast("int"))
    cut = F.greatest(F.lit(1.0), median * ratio)
    return own.select(
        "seq_idx", d[0].alias("cov_min"), F.element_at(d, (F.least(F.floor(n * 0.1), n - 1) + 1).cast("int")).alias("cov_p10"), median.alias("cov_median"),
        (F.size(F.filter(d, lambda x: x > 0)) / n).alias("frac_covered"), F.size(F.filter(d, lambda x: x < cut)).alias("missing"),
    )


def length_mode(lengths: DataFrame, tolerance: int = 500) -> DataFrame:
    """(seq_idx, gene, length, fixed): lengths over 500 below their gene's commonest (the smallest of equals) become it."""
    n = lengths.groupBy("gene", "length").agg(F.count("*").alias("n"))
    mode = n.groupBy("gene").agg(F.max_by("length", F.struct("n", (-F.col("length")).alias("l"))).alias("mode"))
    return lengths.join(mode, "gene").select("seq_idx", "gene", "length", F.when(F.col("length") < F.col("mode") - tolerance, F.col("mode")).otherwise(F.col("length")).alias("fixed"))


def text_mode(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): the commonest value; of equals the largest as text."""
    n = values.groupBy(key, F.col(value).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by("v", F.struct("n", "v")).alias("mode"))


def representative(seqs: DataFrame) -> DataFrame:
    """(gene, seq_idx): each gene's smallest sequence as text, the first of equals."""
    return seqs.groupBy("gene").agg(F.min(F.struct("seq", "seq_idx")).alias("m")).select("gene", F.col("m.seq_idx").alias("seq_idx"))


def diagonal_runs(hits: DataFrame, radius: int = 10) -> DataFrame:
    """Hits with the number of their run: neighbouring diagonals at most `radius` apart, per read, strand and allele."""
    key = ["read_id", "strand", "seq_idx"]
    diagonals = hits.groupBy(*key, (F.col("read_offset") - F.col("offset")).alias("diag")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("diag")
    gap = F.col("diag") - F.lag("diag").over(w)
    runs = diagonals.withColumn("run", F.sum((gap > radius).cast("int")).over(w)).withColumn("run", F.coalesce("run", F.lit(0)))
    return runs.groupBy(*key, "run").agg(F.min("diag").alias("low"), F.max("diag").alias("high"), F.sum("n").alias("hits"), F.max_by("diag", F.struct("n", (-F.col("diag")).alias("d"))).alias("dominant"))


def covered_length(offsets: DataFrame, key: list[str], at: str, k: int) -> DataFrame:
    """(key, covered): bases under windows of k at these offsets, as the union of intervals."""
    w = Window.partitionBy(*key).orderBy(at)
    step = F.col(at) - F.lag(at).over(w)
    own = offsets.select(*key, at).distinct().withColumn("add", F.when(step.isNull() | (step > k - 1), F.lit(k)).otherwise(step))
    return own.groupBy(*key).agg(F.sum("add").alias("covered"))


def overlapping(positions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Positions (chrom, start, end) that touch any interval: start up to its end, end beyond its start.

    Intervals go into bins of a fixed width, so the join is on equality and no chromosome meets in one task.
    """
    width = 1024
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    g = intervals.withColumn("bin", bins(F.col("g_start"), F.col("g_end")))
    p = positions.withColumn("bin", bins(F.col("start"), F.col("end")))
    hit = p.join(g, ["chrom", "bin"]).where("start <= g_end AND end > g_start").select("rec").distinct()
    return positions.join(hit, "rec", "left_semi")
