"""Helpers of the corpus operators: samples, hashing, bytes, curves; and the library's tables in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import common
from ..operators.common import dropped, matched, owned, release, shared_path, stored, temporary

__all__ = ["ALNUM", "as_bytes", "bounded_sample", "crc_mod", "dropped", "fit_logistic", "matched", "most_frequent", "owned", "prior_shift", "release", "sampled_texts", "shared_path", "ship", "sliced", "stored", "table", "temporary"]

#: Bytes after ASCII lower-casing, with everything but 0-9, a-z and non-ASCII bytes turned into a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep batches of texts small."""
    common.ship(spark)
    # texts are long rows: the default of 10,000 would put tens of MB into each batch, several times over
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def as_bytes(col: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(col.cast("string").cast("binary"), F.lit(b""))


def sliced(batches, rows: int = 1000):
    """Arrow batches in parts of at most `rows` rows, which bounds the Python objects alive at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows with distinct keys, chosen by the key's hash, alike at every size.

    No task sends more than counts of 1024 hash bins to the driver, however many tasks there are.
    """
    n = df.count()
    if n <= limit:
        return df
    if limit < 1:
        return df.limit(0)
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n * 1024 // limit))
    own = df.where(place < 1024)
    total, cut = 0, 0
    for r in sorted(own.groupBy(place.alias("b")).count().collect(), key=lambda r: r.b):
        if total + r["count"] > limit:
            break
        total, cut = total + r["count"], r.b + 1
    return own.where(place < cut)


def most_frequent(df: DataFrame, count: str, limit: int, key: str) -> DataFrame:
    """The rows with the largest counts, at most `limit` of them; keys are distinct.

    The threshold comes from a histogram of counts (single numbers up to 1023, then 64 bins a doubling), whose size does
    not depend on the data; a top-k would send k rows of every task to the driver. Of the bin that doesn't fit in whole,
    rows are chosen by the key's hash.
    """
    n = F.col(count)
    place = F.when(n < 1024, n).otherwise(384 + F.floor(64 * F.log2(n.cast("double")))).cast("int")
    total, cut = 0, None
    for r in sorted(df.groupBy(place.alias("b")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b):
        if total + r.k > limit:
            tied = bounded_sample(df.where(place == r.b), key, limit - total)
            return tied if cut is None else df.where(place >= cut).unionByName(tied)
        total, cut = total + r.k, r.b
    return df


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `limit` labelled texts per class (__id, __text, __y), and how many each class has in all; chosen by a hash of the id among every usable label row.

    The choice is made on the narrow label table, so `limit` bounds what is broadcast to the scan of the texts. An id
    with several label rows takes its largest label, one with several texts the smallest; rows with a null id or label
    are ignored.
    """
    own = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")).where(
        F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & usable
    )
    own = stored(own.groupBy("__id").agg(F.max("__y").alias("__y")), "labelled")
    chosen = bounded_sample(own.where("__y = 0"), "__id", limit).unionByName(bounded_sample(own.where("__y = 1"), "__id", limit))
    texts = docs.select(F.col("doc_id").alias("__id"), as_bytes(F.col("text")).alias("__text"))
    # 2 * limit rows of two numbers: bounded by the parameter, not by the data
    sizes = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    return texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select("__id", "__text", "__y"), sizes


def prior_shift(y, sizes: dict[int, int]) -> float:
    """What a curve fitted on labels y must be raised by, so that it holds for classes of these sizes."""
    ones = float(sum(y))
    return math.log((sizes[1] / sizes[0]) / (ones / (len(y) - ones)))


def fit_logistic(x, y, l2: float = 1e-3, rounds: int = 50):
    """Weights (bias first) of a ridge logistic regression by Newton's method; x is (n, k), standardised by the caller."""
    import numpy as np

    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2 * max(len(x), 1))
    ridge[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
