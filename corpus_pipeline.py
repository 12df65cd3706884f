"""A training-data pipeline: toxicity, quality, near-duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Rows that share id and text are one document. Null ids are allowed: a row is known by its id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import common, compress_quality, decontam, sentencepiece_fst, simhash, toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as a struct that orders by id (null last) and names the text too."""
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("k"))
    return docs.select(key.alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows that keys (column doc_id as made by _keyed) name."""
    gone = keys.select(F.col("doc_id.i").alias("__gone_i"), F.col("doc_id.k").alias("__gone_k")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone_i"]) & (F.xxhash64(docs["text"]) == gone["__gone_k"]), "left_anti")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below a half; without labels, all."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"), common.crc_mod(F.col("__id"), 5) != 0)
    return docs.where(toxicity.score(docs["text"], model, docs) < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is a half or more; without labels, all."""
    model = compress_quality.learn(docs, common.table(spark, sf_dir, "labels"), common.crc_mod(F.col("__id"), 3) != 1)
    return docs.where(compress_quality.score(docs["text"], model, docs) >= 0.5)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that with the smallest id. Texts without words are one group."""
    common.ship(spark)
    own = common.stored(simhash.deduplicate(_keyed(docs)).select("doc_id", "component_id"), "near-copies")
    out = _without(docs, own.where("doc_id != component_id"))
    again = own.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    return out if again.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op7's rule doesn't call contaminated."""
    found = decontam.contamination(_keyed(docs), common.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_bytes, round_trip of every document."""
    common.ship(spark)
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", remove_near_copies),
    ("benchmark decontamination", remove_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: learned scores and 64-bit hashes have no DuckDB form; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next. Other tables that
    a stage stored, and its predecessor's result, are deleted once it is done."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with common.temporary() as keep:
            docs = keep(common.stored(stage(spark, docs, sf_dir), f"stage{i + 1}"))
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
