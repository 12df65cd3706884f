"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints have 64 bits. Every bit gets a non-zero vector of GF(2)^(r+1); the mask of vector v keeps the bits whose
vector has inner product 1 with v. For two fingerprints that differ in at most r bits some v is orthogonal to the r
differing bits' vectors, so they agree under that mask: 2^(r+1) - 1 tables find every pair within the radius.

Only distinct fingerprints enter the tables. Small buckets are compared inside one row. A bucket above `BUCKET` distinct
fingerprints is covered again over the bits that its mask left free, which halves them; after three levels at most eight
are free and so 256 fingerprints in a bucket. Buckets give spanning edges, never all pairs, and distributed connected
components join them.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import components as graph
from . import common as C

RADIUS = 3
#: distinct fingerprints that are compared within one row, at most
BUCKET = 512


@cache
def masks(free: tuple[int, ...], radius: int = RADIUS) -> tuple[int, ...]:
    """Covering masks over the given bit positions: one for each non-zero v of GF(2)^(radius + 1)."""
    top = 1 << (radius + 1)
    vector = {bit: i % (top - 1) + 1 for i, bit in enumerate(free)}
    return tuple(sum(1 << bit for bit in free if (vector[bit] & v).bit_count() & 1) for v in range(1, top))


def bits(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(64) if mask >> i & 1)


@cache
def children(mask: int, radius: int = RADIUS) -> tuple[int, ...]:
    """Masks of the next level below a mask: its own bits, and a cover of the free ones."""
    free = bits(~mask & (1 << 64) - 1)
    return tuple(dict.fromkeys(mask | m for m in masks(free, radius)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """Majority of the bits of the shingles' XXH64 (seed 42); 0 for a text without words.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words is one shingle.
    """
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= words_in_shingle:
        return h(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: len(words) - words_in_shingle].tolist()]
    stops = (ends[words_in_shingle - 1 :] - 1).tolist()
    values = np.array([h(line[a:b], 42) for a, b in zip(begins, stops, strict=True)], dtype=">u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(values), 4096):
        total += np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed number. Null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([signed(fingerprint(t, words_in_shingle)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"]
            )

    return docs.select("doc_id", C.as_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def bucket_edges(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges (fp, smallest of its piece) of the links among the distinct fingerprints of one bucket."""
    import numpy as np

    x = np.unique(np.array(fps, dtype=np.int64))
    u = x.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(a), int(x[r])) for a, r in zip(x, label, strict=True) if a != x[r]]


def _bucket_edges(batches):
    import pyarrow as pa

    for batch in batches:
        edges = [e for fps in batch.column("fps").to_pylist() for e in bucket_edges(fps)]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Spanning edges (a, b) of the graph that links fingerprints (column fp, distinct) within RADIUS."""
    spark = distinct.sparkSession
    level = [0]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    out, old = None, []
    while True:
        steps = [(signed(m), signed(c)) for m in level for c in children(m)]
        level = list(dict.fromkeys(c for m in level for c in children(m)))
        # 15, 225 or 3375 pairs of masks
        if len(steps) <= 15:
            rows = rows.select("fp", F.explode(F.array(*(F.lit(c) for _, c in steps))).alias("mask"))
        else:
            down = spark.createDataFrame(steps, "mask long, child long")
            rows = rows.join(F.broadcast(down), "mask").select("fp", F.col("child").alias("mask"))
        rows = rows.select("fp", "mask", F.expr("fp & mask").alias("key"))
        # the number of rows of a key, without bringing the rows together
        sizes = C.stored(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        old.append(sizes)
        last = max(64 - c.bit_count() for c in level) <= bucket.bit_length() - 1
        small = rows.join(sizes if last else sizes.where(F.col("n") <= bucket), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        edges = small.select("fps").mapInArrow(_bucket_edges, "a long, b long").distinct()
        out = edges if out is None else out.unionByName(edges)
        if last or sizes.where(F.col("n") > bucket).isEmpty():
            return out
        rows = C.stored(rows.join(sizes.where(F.col("n") > bucket).select("mask", "key"), ["mask", "key"]).select("fp", "mask"), "simhash-large")


def deduplicate(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Texts link when their fingerprints differ in at most 3 bits; component_id is the smallest doc_id reachable (null ids
    don't count; null where a component has no other). Texts without words have fingerprint 0 and link like others.
    Repeated rows have equal results; an empty table gives an empty result.
    """
    own = C.stored(fingerprints(docs, words_in_shingle), "simhash")
    nodes = C.stored(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    found = graph.components(links(nodes.select("fp")))
    # every linked fingerprint with the smallest id of its component; the others stand alone
    member = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    member = C.stored(member, "simhash-member")
    lowest = C.stored(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("of")), "simhash-lowest")
    named = C.stored(C.matched(member, lowest, ["root"], "of").select("fp", "n", "component_id"), "simhash-named")
    # a fingerprint that many documents share is sent to the documents
    return C.matched(own, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
