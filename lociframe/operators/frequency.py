"""Allele frequencies: observed counts rolled up or pushed down to the depth that is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small


def frequencies(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(locus, fields, frequency) of wanted (locus, fields): half a count is added to each of the locus's rows.

    A row of the table (locus, fields, n) counts if it agrees with the wanted fields as far as the shorter one goes.
    A locus that the table lacks gives null.
    """
    total = table.groupBy("locus").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    own = table.select("locus", F.col("fields").alias("f"), "n")
    short = F.least(F.size("fields"), F.size("f"))
    met = wanted.distinct().join(small(own), "locus").where(F.slice("fields", F.lit(1), short) == F.slice("f", F.lit(1), short))
    count = met.groupBy("locus", "fields").agg(F.sum("n").alias("n"))
    out = wanted.join(count, ["locus", "fields"], "left").join(small(total), "locus", "left")
    return out.select("locus", "fields", ((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("rows"))).alias("frequency"))


def read_table(rows: DataFrame) -> DataFrame:
    """(locus, fields, n) of text rows `allele, frequency, count` (columns line, ord); leading rows without a number are headers.

    The locus is what stands before `*`, without `HLA-`; fields are split at colons. A later row without a count, or a
    negative or infinite one, is an error.
    """
    parts = F.split("line", "\t")
    own = rows.select("ord", parts[0].alias("allele"), F.expr("try_cast(get(split(line, '\t'), 2) AS double)").alias("n"), "line").where("line <> ''")
    first = own.where("n is not null").agg(F.min("ord").alias("start"))
    own = own.crossJoin(first).where("ord >= start")
    bad = F.col("n").isNull() | (F.col("n") < 0) | F.col("n").isin(float("inf"), float("nan"))
    n = F.when(bad, F.raise_error(F.concat(F.lit("not a count: "), "line")).cast("double")).otherwise(F.col("n"))
    name = F.regexp_replace("allele", "^HLA-", "")
    return own.select(F.substring_index(name, "*", 1).alias("locus"), F.split(F.regexp_extract(name, r"\*(.*)$", 1), ":").alias("fields"), n.alias("n"))


def major_frequencies(majors: list[str], table: DataFrame) -> dict[str, float]:
    """Frequency of each major allele's name; those of an unknown locus are left out. As many entries as names."""
    spark = table.sparkSession
    split = [(m, m.removeprefix("HLA-").split("*", 1)[0], m.split("*", 1)[1].split(":") if "*" in m else []) for m in majors]
    wanted = spark.createDataFrame(split, "major string, locus string, fields array<string>")
    found = frequencies(wanted.select("locus", "fields"), table).distinct()
    return {r.major: r.frequency for r in wanted.join(found, ["locus", "fields"]).collect() if r.frequency is not None}
