"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) and their leading 4 to 8 bytes.
Each token's toxic share has a Dirichlet prior centred on the share of its next shorter prefix, and at last on the share
of all training documents. A word scores the log-odds of its longest known token where these are significant, and a
small negative constant otherwise. A linear-time scan lists every maximal-scoring segment of a text; Karlin-Altschul
extreme-value statistics of clean text turn segment scores into evidence, which a logistic curve calibrates.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIXES = (8, 7, 6, 5, 4)


@dataclass(frozen=True)
class Params:
    #: labelled documents per class that the model is fitted on, at most
    max_per_class: int = 6000
    strength: float = 4.0
    min_docs: int = 5
    min_z: float = 3.0
    #: taken off each token's log-odds
    offset: float = 0.5
    #: what a word without evidence costs; the one that predicts the calibration part best is used
    penalties: tuple[float, ...] = (1.0, 0.2, 0.05, 0.02)
    #: segments with an expected number of chance occurrences below this are reported
    max_chance: float = 0.01


def tokens(word: bytes) -> list[bytes]:
    """The word, marked as whole, then its prefixes from long to short."""
    return [word + b" ", *(word[:k] for k in PREFIXES if len(word) >= k)]


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a list of numbers, in linear time."""
    out: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        k = [i, i + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= k[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= k[3]:
                k.append(j)
                out.append(k)
                break
            k = [out[j][0], k[1], out[j][2], k[3]]
            del out[j:]
    return [(a, b, d - c) for a, b, c, d, _ in out]


class Scorer:
    """Evidence of one text; made on the driver, sent to the workers (its table has tokens of at most 2 * Params.max_per_class texts)."""

    def __init__(self, table: dict[bytes, float], penalty: float, lam: float, log_k: float, max_chance: float):
        self.table, self.penalty, self.lam, self.log_k, self.max_chance = table, penalty, lam, log_k, max_chance
        self.curve = (0.0, 0.0)
        self.starts = {t.removesuffix(b" ")[:4] for t in table}

    def word(self, w: bytes) -> float:
        get = self.table.get
        if (s := get(w + b" ")) is not None:
            return s
        for k in PREFIXES:
            if len(w) >= k and (s := get(w[:k])) is not None:
                return s
        return 0.0

    def passages(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments as (first word, word after the last, score).

        Runs of words without evidence are one step of the scan, so it is linear in the words with evidence.
        """
        words = text.translate(C.ALNUM).split()
        starts = self.starts
        memo = {w: s for w in set(words) if w[:4] in starts and (s := self.word(w)) > 0}
        if not memo:
            return len(words), []
        scores, at, last, times = [], [], 0, Counter()
        for i, w in enumerate(words):
            if w in memo:
                if i > last:
                    scores.append(-self.penalty * (i - last))
                    at.append(last)
                times[w] += 1  # the k-th time a text uses a word, it counts 1/k: repeats are not new evidence
                scores.append(memo[w] / times[w])
                at.append(i)
                last = i + 1
        at.append(last)
        return len(words), [(at[a], at[b - 1] + 1, s) for a, b, s in segments(scores)]

    def evidence(self, text: bytes) -> float:
        """Normalised score: the sum of its significant segments' extreme-value scores, or the best one's."""
        n, found = self.passages(text)
        if not found:
            return -10.0
        x = [self.lam * s - self.log_k - math.log(n) for _, _, s in found]
        chance = -math.log(self.max_chance)
        return max(-10.0, min(30.0, sum(v for v in x if v > chance) or max(x)))

    def significant(self, text: bytes) -> list[tuple[int, int, float, float]]:
        """Toxic passages: first word, word after the last, score, chance of one such segment in clean text as long."""
        n, found = self.passages(text)
        out = []
        for a, b, s in found:
            chance = math.exp(min(50.0, self.log_k + math.log(n) - self.lam * s))
            if chance < self.max_chance:
                out.append((a, b, s, -math.expm1(-chance)))
        return out

    def probability(self, evidence: float) -> float:
        z = self.curve[0] + self.curve[1] * evidence
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _count(batches):
    import pyarrow as pa

    for batch in batches:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch.column("__text").to_pylist(), batch.column("__y").to_pylist(), strict=True):
            n[y].update({t for w in set(text.translate(C.ALNUM).split()) for t in tokens(w)})
        keys = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([n[0][k] for k in keys], pa.int64()), pa.array([n[1][k] for k in keys], pa.int64())], ["token", "clean", "toxic"]
        )


def learn(docs: DataFrame, labels: DataFrame, usable: Column, p: Params = Params()) -> Scorer:
    """Fit on labelled rows for which `usable` (a condition on __id) holds; without both labels nothing scores over 0.5."""
    import numpy as np

    sample, of_class = C.sampled_texts(docs, labels, "toxic", usable, p.max_per_class)
    part = F.crc32(F.concat(F.lit("part "), F.col("__id").cast("string")).cast("binary")) % 3
    sample = C.stored(sample.withColumn("__cal", part == 0), "toxicity-sample")
    sizes = {(r["__cal"], r["__y"]): r["count"] for r in sample.groupBy("__cal", "__y").count().collect()}
    n0, n1 = sizes.get((False, 0), 0), sizes.get((False, 1), 0)
    out = Scorer({}, 1.0, 1.0, 0.0, p.max_chance)
    if not (n0 and n1):
        out.curve = (-5.0, 0.0)
        C.dropped(sample)
        return out
    counts = sample.where(~F.col("__cal")).select("__text", "__y").mapInArrow(_count, "token binary, clean long, toxic long")
    counts = counts.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= p.min_docs)
    # parents are listed with their children: all tokens that min_docs of the sampled documents and any toxic one have
    rows = counts.where("toxic > 0").collect()
    n = {bytes(r.token): (r.clean, r.toxic) for r in rows}
    base = n1 / (n0 + n1)
    logit = lambda q: math.log(q / (1 - q))
    share: dict[bytes, float] = {}

    def posterior(t: bytes) -> float:
        """Toxic share of a token with the Dirichlet prior of its longest known proper prefix."""
        if t not in share:
            word = t.removesuffix(b" ")
            # a whole word may be as long as its prefix
            prior = next((posterior(word[:k]) for k in PREFIXES if k < len(t) and k <= len(word) and word[:k] in n), base)
            c, x = n[t]
            share[t] = (x + p.strength * prior) / (c + x + p.strength)
        return share[t]

    for t, (c, x) in n.items():
        s = logit(posterior(t)) - logit(base)
        z = s / math.sqrt(1 / (x + p.strength * base) + 1 / (c + p.strength * (1 - base)))
        out.table[t] = s - p.offset if z >= p.min_z and s > p.offset else 0.0
    # an entry without evidence is needed only to overrule a prefix that has some
    positive = {t for t, s in out.table.items() if s > 0}
    out = Scorer({t: s for t, s in out.table.items() if s > 0 or any(t[:k] in positive for k in PREFIXES if k < len(t))}, 1.0, 1.0, 0.0, p.max_chance)

    def clean_scores(batches):
        import pyarrow as pa

        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("__text").to_pylist():
                found.update(round(out.word(w), 6) for w in text.translate(C.ALNUM).split())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], ["s", "n"])

    use_all = not (sizes.get((True, 0), 0) and sizes.get((True, 1), 0))
    held = sample if use_all else sample.where("__cal")
    seen = held.where("__y = 0").select("__text").mapInArrow(clean_scores, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    models = [extreme_values(out, {r.s: r.n for r in seen}, penalty) for penalty in p.penalties]

    def calibration(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("__text").to_pylist()
            yield pa.RecordBatch.from_arrays([*(pa.array([m.evidence(t) for t in texts], pa.float64()) for m in models), batch.column("__y")], [*names, "y"])

    names = [f"x{i}" for i in range(len(models))]
    pairs = held.select("__text", "__y").mapInArrow(calibration, ", ".join(f"{n} double" for n in names) + ", y int").collect()  # 2 * max_per_class rows at most
    C.dropped(sample)
    y = np.array([float(r.y) for r in pairs])
    best = None
    for i, m in enumerate(models):
        x = np.array([r[i] for r in pairs])
        w = C.fit_logistic(x[:, None] / 10, y, l2=1e-5)
        m.curve = (float(w[0]), float(max(0.0, w[1] / 10)))  # the loss is that of the sample
        q = np.clip(np.array([m.probability(v) for v in x]), 1e-9, 1 - 1e-9)
        loss = -float(np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, m)
    model = best[1]
    model.curve = (model.curve[0] + C.prior_shift(y, of_class), model.curve[1])
    return model


def extreme_values(model: Scorer, seen: dict[float, int], penalty: float) -> Scorer:
    """The scorer with this penalty and the Karlin-Altschul parameters of clean text, whose word scores were counted in seen.

    lam solves E[exp(lam * score)] = 1; K is approximated by the rate at which segments start times the chance that none follows.
    """
    hits = {s: n for s, n in seen.items() if s > 0}
    top = max(model.table.values(), default=1.0)
    hits[top] = hits.get(top, 0) + 1  # one more than was seen, so that the tail is never empty
    total = sum(seen.values()) + 2
    rate = sum(hits.values()) / total
    probs = [(s, k / total) for s, k in hits.items()] + [(-penalty, 1 - rate)]
    moment = lambda lam: sum(q * math.exp(min(700.0, lam * s)) for s, q in probs)
    lo, hi = 1e-6, 1.0
    while moment(hi) < 1 and hi < 100:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 1 else (lo, mid)
    return Scorer(model.table, penalty, lo, math.log(max(1e-9, -math.expm1(-lo * penalty))) + math.log(rate), model.max_chance)


def score(text: Column, model: Scorer, df: DataFrame) -> Column:
    """Probability that a text is toxic, 0 to 1; null and empty texts count as texts without words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        m = shared.value
        return pd.Series([m.probability(m.evidence(bytes(t))) for t in texts], dtype="float64")

    return probability(C.as_bytes(text))


def passages(docs: DataFrame, model: Scorer) -> DataFrame:
    """Every significant toxic passage: doc_id, first_word, end_word, score, p_value, passage. One row per passage.

    doc_id may have any type; null and empty texts have no passage, repeated rows have theirs each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = None
                for a, b, s, q in shared.value.significant(text):
                    words = words or text.translate(C.ALNUM).split()
                    at.append(i)
                    rows.append((a, b, s, q, b" ".join(words[a:b]).decode("utf-8", "replace")))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", "first_word", "end_word", "score", "p_value", "passage"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", C.as_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, first_word int, end_word int, score double, p_value double, passage string")


def judge(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled ids whose crc32 modulo 5 is not 0. Null and empty texts have no evidence; repeated rows are
    scored alike; a null id is not held out. Empty tables give empty results or, without labels, scores below 0.5.
    """
    usable = C.crc_mod(F.col("__id"), 5) != 0
    model = learn(docs, labels, usable, p)
    out = docs.select("doc_id", F.coalesce(C.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score(F.col("text"), model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
