"""The driver's tables as the engine's relations, and the same relations as DuckDB SQL.

Letters of benchmark items and documents become bases, so items are alleles and documents are reads; line items become
assignments and calls, events become positions, intervals and coverage, parts become allele counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import spread

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 6 + "AC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, name, gene, seq."""
    i = F.col("item_id")
    gene = F.concat(F.lit("G"), (i % 8).cast("string"))
    return table(spark, sf_dir, "benchmark").select(
        i.cast("long").alias("seq_idx"), F.concat(gene, F.lit("*"), F.lpad(i.cast("string"), 3, "0")).alias("name"), gene.alias("gene"), bases(F.col("text")).alias("seq")
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq; over all cores, as k-mers make thirty times as much of them."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), bases(F.col("text")).alias("seq")))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, allele, qual, similarity, start, end: order lines as reads' alignments to twelve alleles."""
    line = table(spark, sf_dir, "lineitem")
    base = line.select(
        F.col("l_orderkey").alias("read_id"),
        (F.col("l_partkey") % 6).cast("int").alias("allele"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(2).alias("qual"),
        (1 - F.col("l_discount")).alias("similarity"),
        (F.col("l_suppkey") % 50).cast("int").alias("start"),
        (F.col("l_suppkey") % 50 + F.col("l_quantity")).cast("int").alias("end"),
    )
    twin = base.where("allele < 3").withColumn("allele", F.col("allele") + 6)
    return base.unionByName(twin).groupBy("read_id", "allele").agg(
        F.min("qual").alias("qual"), F.max("similarity").alias("similarity"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, gene, slot, ord, alleles (array), abundance, quality: every order line is a call.

    A part is a sample; each two of its lines that follow one another are the slots of a gene.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    own = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(w).cast("long"))
    own = own.withColumns({"g": F.floor((F.col("ord") - 1) / 2), "slot": ((F.col("ord") - 1) % 2 + 1).cast("int")})
    name = lambda x: F.concat(F.lit("G"), F.col("g").cast("string"), F.lit("*"), x.cast("string"))
    return own.select(
        F.concat(F.lit("S"), F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("sample"),
        F.concat(F.lit("G"), F.col("g").cast("string")).alias("gene"),
        "slot",
        "ord",
        F.array(name(F.col("l_suppkey") % 7), name(F.col("l_suppkey") % 3 + 7)).alias("alleles"),
        F.col("l_quantity").alias("abundance"),
        (F.floor(F.col("l_extendedprice")) % 60).cast("int").alias("quality"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, chrom, start, end: events as aligned reads of ten bases."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("rec"), (F.col("user_id") % 5).cast("int").alias("chrom"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, g_start, g_end: every order as a short interval, seven places from the order before."""
    start = F.col("o_orderkey") * 7 + F.col("o_custkey") % 50
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("int").alias("chrom"), start.alias("g_start"), (start + 3).alias("g_end"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, pos, depth."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 20).cast("int").alias("seq_idx"), (F.col("event_id") % 100).cast("int").alias("pos")).agg(F.count("*").alias("depth"))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, fields (array), n: part brands as observed alleles."""
    name = F.regexp_extract("p_brand", "([0-9]+)", 1)
    return table(spark, sf_dir, "part").groupBy(F.substring(name, 1, 1).alias("locus"), F.array(F.substring(name, 2, 1), (F.col("p_size") % 5).cast("string")).alias("fields")).agg(F.count("*").alias("n"))


_SEQ = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"
SQL = {
    "alleles": f"alleles AS (SELECT CAST(item_id AS BIGINT) AS seq_idx, 'G' || (item_id % 8) || '*' || lpad(CAST(item_id AS VARCHAR), 3, '0') AS name, 'G' || (item_id % 8) AS gene, {_SEQ} AS seq FROM benchmark)",
    "reads": f"reads AS (SELECT doc_id AS read_id, {_SEQ} AS seq FROM documents)",
    "assignments": """assigned AS (SELECT l_orderkey AS read_id, CAST(l_partkey % 6 AS INT) AS allele, CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS qual, 1 - l_discount AS similarity,
  CAST(l_suppkey % 50 AS INT) AS s, CAST(l_suppkey % 50 + l_quantity AS INT) AS e FROM lineitem)
, assignments AS (SELECT read_id, allele, min(qual) AS qual, max(similarity) AS similarity, min(s) AS "start", max(e) AS "end"
  FROM (SELECT * FROM assigned UNION ALL SELECT read_id, allele + 6, qual, similarity, s, e FROM assigned WHERE allele < 3) GROUP BY read_id, allele)""",
    "calls": """calls AS (SELECT 'S' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS sample, 'G' || g AS gene, (ord - 1) % 2 + 1 AS slot, ord,
  ['G' || g || '*' || (l_suppkey % 7), 'G' || g || '*' || (l_suppkey % 3 + 7)] AS alleles, l_quantity AS abundance, CAST(floor(l_extendedprice) AS BIGINT) % 60 AS quality
  FROM (SELECT *, (ord - 1) // 2 AS g FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS ord FROM lineitem)))""",
    "positions": "positions AS (SELECT event_id AS rec, user_id % 5 AS chrom, event_id AS s, event_id + 10 AS e FROM events)",
    "intervals": "intervals AS (SELECT o_custkey % 5 AS chrom, o_orderkey * 7 + o_custkey % 50 AS g_start, o_orderkey * 7 + o_custkey % 50 + 3 AS g_end FROM orders)",
    "coverage": "coverage AS (SELECT user_id % 20 AS seq_idx, event_id % 100 AS pos, count(*) AS depth FROM events GROUP BY ALL)",
    "frequencies": "freq AS (SELECT substring(b, 1, 1) AS locus, substring(b, 2, 1) AS f1, CAST(p_size % 5 AS VARCHAR) AS f2, count(*) AS n FROM (SELECT *, regexp_extract(p_brand, '([0-9]+)', 1) AS b FROM part) GROUP BY ALL)",
}


def with_sql(*names: str, then: str) -> str:
    """A query over the named relations; `then` goes on after their WITH list."""
    return "WITH " + "\n, ".join(SQL[n] for n in names) + "\n" + then
