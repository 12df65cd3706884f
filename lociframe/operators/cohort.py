"""Cohorts: representative alleles by vote, the sample-by-allele matrix, and copy numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths


def votes(calls: DataFrame, min_quality: float = 0) -> DataFrame:
    """(gene, allele, total, first_vote): summed quality of each slot's first allele, above min_quality."""
    own = calls.where(F.col("quality") > min_quality).withColumn("place", F.struct("sample", "ord", "slot"))
    return own.groupBy("gene", F.col("alleles")[0].alias("allele")).agg(F.sum("quality").alias("total"), F.min("place").alias("first_vote"))


def representatives(calls: DataFrame, per_gene: int = 2, min_quality: float = 0, min_total: float = 30) -> DataFrame:
    """(gene, allele, total): a gene's most-voted alleles, the earlier vote first among equals; the floor comes after the cut."""
    w = Window.partitionBy("gene").orderBy(F.desc("total"), "first_vote")
    own = votes(calls, min_quality).withColumn("rn", F.row_number().over(w))
    return own.where((F.col("rn") <= per_gene) & (F.col("total") >= min_total)).select("gene", "allele", "total")


def matched(calls: DataFrame, chosen: DataFrame, min_quality: float = 0) -> DataFrame:
    """Slots with `match`, the first of their alleles that is a representative (null: none)."""
    own = calls.where(F.col("quality") > min_quality)
    at = own.select("sample", "gene", "slot", F.posexplode("alleles").alias("k", "allele"))
    hit = at.join(chosen.select("allele").distinct(), "allele").groupBy("sample", "gene", "slot").agg(F.min_by("allele", "k").alias("match"))
    return own.join(hit, ["sample", "gene", "slot"], "left")


def cells(calls: DataFrame, chosen: DataFrame, min_quality: float = 0) -> DataFrame:
    """(sample, allele, abundance): filled cells of the matrix."""
    return matched(calls, chosen, min_quality).where("match is not null").groupBy("sample", F.col("match").alias("allele")).agg(F.sum("abundance").alias("abundance"))


def inconsistencies(calls: DataFrame, chosen: DataFrame, min_quality: float = 0) -> DataFrame:
    """(sample, inconsistency): slots without a representative as alleles_abundance_quality, in file order."""
    text = F.concat_ws("_", F.concat_ws("_", "alleles"), maths.python_float(F.col("abundance")), F.col("quality").cast("string"))
    own = matched(calls, chosen, min_quality).where("match is null").select("sample", F.struct("ord", "slot", text.alias("t")).alias("x"))
    return own.groupBy("sample").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"])).alias("inconsistency"))


def matrix(calls: DataFrame, per_gene: int = 2, min_quality: float = 0, min_total: float = 30) -> DataFrame:
    """One row per sample: a column for each representative allele (0 where untouched), then inconsistency.

    Representatives are at most per_gene for each gene, so the list of columns is short.
    """
    chosen = representatives(calls, per_gene, min_quality, min_total)
    names = sorted(r.allele for r in chosen.select("allele").distinct().collect())
    wide = cells(calls, chosen, min_quality).groupBy("sample").pivot("allele", names).sum("abundance") if names else calls.select("sample").distinct()
    out = calls.select("sample").distinct().join(wide, "sample", "left").join(inconsistencies(calls, chosen, min_quality), "sample", "left")
    return out.select("sample", *(maths.python_float(F.col(f"`{n}`")).alias(n) for n in names), F.coalesce("inconsistency", F.lit("")).alias("inconsistency"))


def one_copy(calls: DataFrame, nomissing: list[str], low: float = 0.0, high: float = 0.3, adjust_var: float = 1.0, min_quality: float = 0) -> DataFrame:
    """(sample, mean, var): distribution of the square root of a single copy's abundance.

    Anchors are the genes that are never missing (both alleles, or half of a lone one) and, of the alleles of other
    genes with two, those between two quantile places of all passing alleles that are no anchors.
    """
    maths.check_range("upper quantile", high, 0, 1)
    maths.check_range("lower quantile", low, 0, high)
    if not (math.isfinite(adjust_var) and adjust_var > 0):
        raise ValueError(f"adjust_var must be above 0, not {adjust_var}")
    own = calls.where(F.col("quality") > min_quality).withColumn("x", F.sqrt("abundance"))
    n = own.groupBy("sample", "gene").agg(F.count("*").alias("n"))
    own = own.join(n, ["sample", "gene"]).withColumn("sure", F.col("gene").isin(nomissing) if nomissing else F.lit(False))
    sure = own.where("sure").select("sample", F.when(F.col("n") > 1, F.col("x")).otherwise(F.col("x") / 2).alias("x"))
    span = own.groupBy("sample").agg(F.sum((~F.col("sure")).cast("int")).alias("span"))
    pairs = own.where("NOT sure AND n > 1").groupBy("sample", "allele").agg(F.min_by("x", "ord").alias("x"))
    w = Window.partitionBy("sample").orderBy("x", "allele")
    band = pairs.withColumn("rn", F.row_number().over(w) - 1).join(span, "sample")
    band = band.where((F.col("rn") >= F.floor(F.col("span") * low)) & (F.col("rn") < F.floor(F.col("span") * high))).select("sample", "x")
    fit = sure.unionByName(band).groupBy("sample").agg(F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("square"))
    return fit.select("sample", "mean", ((F.col("square") - F.col("mean") * F.col("mean")) * adjust_var).alias("var"))


def copy_numbers(calls: DataFrame, fit: DataFrame, min_quality: float = 0, most: int = 8, strict: bool = True) -> DataFrame:
    """(sample, gene, allele, slot, copy, ratio): the likeliest of 1 to 8 copies and its log likelihood over the second.

    An allele's abundance is its last one in the sample. Without a positive variance it is an error, or null if not strict.
    """
    own = calls.where(F.col("quality") > min_quality)
    last = own.groupBy("sample", "allele").agg(F.max_by("abundance", "ord").alias("abundance"))
    own = own.select("sample", "gene", "allele", "slot").join(last, ["sample", "allele"]).join(fit, "sample", "left")
    if strict:
        message = F.lit("no usable one-copy distribution: anchors need at least two differing abundances")
        own = own.withColumn("var", F.when(F.coalesce(F.col("var"), F.lit(0.0)) > 0, F.col("var")).otherwise(F.raise_error(message).cast("double")))
    else:
        own = own.withColumn("var", F.when(F.col("var") > 0, F.col("var")))
    x = F.sqrt("abundance")
    score = lambda c: maths.log_normal_score(x, F.col("mean") * c, F.sqrt(F.col("var") * c))
    # best first; of equals the smaller number of copies
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(score(c).alias("l"), F.lit(-c).alias("c")) for c in range(1, most + 1)))))
    own = own.withColumn("r", ranked)
    return own.select("sample", "gene", "allele", "slot", (-F.col("r")[0]["c"]).alias("copy"), (F.col("r")[0]["l"] - F.col("r")[1]["l"]).alias("ratio"))


def copy_rows(calls: DataFrame, copies: DataFrame, min_quality: float = 0) -> DataFrame:
    """(sample, line): gene, passing alleles, then two of allele, copy and ratio, tab-separated; `. -1 0` fills up."""
    n = calls.groupBy("sample", "gene").agg(F.sum((F.col("quality") > min_quality).cast("int")).alias("n"))
    cell = F.format_string("%s\t%d\t%.2f", "allele", "copy", "ratio")
    text = copies.groupBy("sample", "gene").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", cell.alias("t")))), lambda x: x["t"]).alias("c"))
    fill = F.lit(".\t-1\t0")
    own = n.join(text, ["sample", "gene"], "left")
    return own.select("sample", F.concat_ws("\t", "gene", F.col("n").cast("string"), F.coalesce(F.get("c", F.lit(0)), fill), F.coalesce(F.get("c", F.lit(1)), fill)).alias("line"))
