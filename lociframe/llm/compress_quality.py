"""Quality by compression: how much better do dictionaries of good than of bad text compress a document?

Two zstandard dictionaries are trained on labelled texts, one per class. A text is compressed with each; the difference
of the sizes over their sum, and the difference per byte, go through a logistic curve fitted on other labelled texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Params:
    #: labelled documents per class for dictionaries and curve together, at most
    max_per_class: int = 3000
    dict_bytes: int = 112 << 10
    level: int = 3


N_FEATURES = 4


class Compressor:
    """Sizes of a text under both dictionaries; dictionaries are prepared once per process."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.good, self.bad, self.level = good, bad, level
        self.weights: tuple[float, ...] = ()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def sizes(self, text: bytes) -> tuple[int, int]:
        ready = self.__dict__.get("_ready")
        if ready is None:
            import zstandard as z

            ready = []
            for d in (self.good, self.bad):
                own = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=self.level)
                ready.append(z.ZstdCompressor(level=self.level, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False))
            self._ready = ready
        return len(ready[0].compress(text)), len(ready[1].compress(text))

    def features(self, text: bytes) -> tuple[float, ...]:
        """Differences of the sizes (positive: the good dictionary fits better): over their sum, per byte and per root of
        the bytes, as the noise of short texts is larger; and the better compression ratio."""
        if not text:
            return (0.0,) * N_FEATURES
        g, b = self.sizes(text)
        n = len(text) + 20
        return 20 * (b - g) / (b + g), 20 * (b - g) / n, max(-5.0, min(5.0, (b - g) / math.sqrt(n))), min(g, b) / n

    def probability(self, text: bytes) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=False))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def train(texts: list[bytes], p: Params) -> bytes:
    """A trained dictionary, or plain content where there is too little text to train on."""
    import zstandard as z

    chunks = [t[i : i + 1000] for t in texts for i in range(0, len(t), 1000)]
    content = b"".join(chunks)
    size = min(p.dict_bytes, max(256, len(content) // 8))
    if len(content) > 20_000:
        try:
            return z.train_dictionary(size, chunks, k=256, d=8, level=p.level).as_bytes()
        except z.ZstdError:
            pass  # the library refuses samples that are too alike; raw content is its documented alternative
    return content[-p.dict_bytes :] or b" " * 8


def learn(docs: DataFrame, labels: DataFrame, usable: Column, p: Params = Params()) -> Compressor:
    """Fit on at most 2 * max_per_class labelled texts; with a single class or none, every text gets that class (none: good)."""
    import numpy as np

    rows, sizes = C.sampled_texts(docs, labels, "quality", usable, p.max_per_class)
    rows = rows.withColumn(
        "__dict", F.crc32(F.concat(F.lit("part "), F.col("__id").cast("string")).cast("binary")) % 2 == 0
    )
    rows = C.stored(rows, "quality-sample")

    def dictionaries(batches):
        import pyarrow as pa

        texts = []
        for batch in batches:
            texts += zip(*(batch.column(c).to_pylist() for c in ("__id", "__text", "__y")), strict=True)
        texts.sort(key=lambda x: x[0])
        for y in (0, 1):
            if own := [t for _, t, of in texts if of == y and t]:
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([train(own, p)], pa.binary())], ["y", "d"])

    # one worker has the whole texts of 2 * max_per_class rows at most; the driver gets the dictionaries
    made = {r.y: bytes(r.d) for r in rows.where("__dict").select("__id", "__text", "__y").coalesce(1).mapInArrow(dictionaries, "y int, d binary").collect()}
    out = Compressor(made.get(1) or train([], p), made.get(0) or train([], p), p.level)
    if len(made) < 2:
        out.weights = (5.0 if 1 in made or 0 not in made else -5.0, *[0.0] * N_FEATURES)
        C.dropped(rows)
        return out
    shared = docs.sparkSession.sparkContext.broadcast(out)

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            x = [shared.value.features(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[i] for v in x], pa.float64()) for i in range(N_FEATURES)), batch.column("__y")], [*names, "y"])

    names = [f"x{i}" for i in range(N_FEATURES)]
    held = rows.where("not __dict").select("__text", "__y").mapInArrow(measure, ", ".join(f"{n} double" for n in names) + ", y int").collect()  # 2 * max_per_class rows at most
    x, y = np.array([[r[i] for i in range(N_FEATURES)] for r in held]).reshape(-1, N_FEATURES), np.array([float(r.y) for r in held])
    if len(set(y)) == 2:
        w = C.fit_logistic(x, y)
        out.weights = (float(w[0]) + C.prior_shift(y, sizes), *map(float, w[1:]))
    else:
        out.weights = (0.0, 5.0, *[0.0] * (N_FEATURES - 1))
    C.dropped(rows)
    return out


def score(text: Column, model: Compressor, df: DataFrame) -> Column:
    """Probability that a text is good, 0 to 1; null and empty texts get the curve's value at no difference."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        m = shared.value
        return pd.Series([m.probability(bytes(t)) for t in texts], dtype="float64")

    return probability(C.as_bytes(text))


def judge(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled ids whose crc32 modulo 3 is not 1. Repeated rows are scored alike; a null id is not held out;
    empty tables give empty results; without labels every text is kept.
    """
    model = learn(docs, labels, C.crc_mod(F.col("__id"), 3) != 1, p)
    out = docs.select("doc_id", F.coalesce(C.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score(F.col("text"), model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
