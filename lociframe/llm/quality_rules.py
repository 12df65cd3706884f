"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. Per language and source, a minimum-covariance-determinant estimate
gives the centre and spread of the bulk. It has three deterministic starts: median deviations alone, the covariance of
the rows' signs around the medians, and that of the rows' hyperbolic tangents. Concentration steps re-estimate centre and
spread from the `share` of rows that lie closest; after two steps of each start the one with the smallest determinant
goes on until the determinant no longer falls. A step is one aggregation of moments over all rows by group and distance
bin, so a group of any size is summed in parallel and only its bins (a fixed number) meet; of the bin in which the subset
ends, the part that fills it up counts. A text is rejected when its Mahalanobis distance exceeds a chi-square quantile.

Groups of fewer than `min_rows` rows, five for each statistic, have no estimate of their own: they join the pool of their
language, then one common pool; a pool below that rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = b"#*$%&|<>"
DIM = 5
X = [f"x{i}" for i in range(DIM)]
#: smallest spread of a statistic, added to every covariance (squared), as in regularised estimates: most clean texts have
#: exactly 0 symbols or repeats, which alone would make any other value an outlier. Set by hand to what a few symbols,
#: lines or words of a text of some hundred words come to.
FLOOR = (0.25, 0.04, 0.05, 0.12, 0.14)


@dataclass(frozen=True)
class Params:
    share: float = 0.75
    #: rounds of three concentration steps after the choice of a start, at most; a fall of the log determinant in a round
    #: that counts as none
    rounds: int = 8
    least_fall: float = 1e-3
    min_rows: int = 5 * DIM
    #: chance that a text of the bulk is rejected, were the statistics normal
    alpha: float = 1e-7
    min_words: int = 50
    max_repeat_percent: int = 50


def statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()]
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count: dict = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def measure(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, lang, source (as text), the statistics; null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(6))],
                ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), C.as_bytes(F.col("text")).alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def vector(df: DataFrame) -> DataFrame:
    """Adds x0 to x4: log length, log word length, and arcsines of the shares of symbols, repeated lines and repeated words."""
    part = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    values = [
        F.log1p(F.col("n_words").cast("double")),
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        part("n_symbols", "word_chars"),
        part("n_dup_lines", "n_lines"),
        part("n_repeat_words", "n_words"),
    ]
    return df.withColumns(dict(zip(X, values, strict=True)))


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-17 and n < 10_000:
        term *= z / (a + n)
        total += term
        n += 1
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """What the covariance of the closest `share` of a normal sample must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def squared_distance(centre: str = "centre", inverse: str = "inverse"):
    """Squared Mahalanobis distance of x0 to x4 from array columns: the centre, and the upper triangle of the inverse covariance."""
    d = [F.col(X[i]) - F.col(centre)[i] for i in range(DIM)]
    return sum(((1 if i == j else 2) * d[i] * d[j] * F.col(inverse)[k] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def moments(x: list[Column], name: str) -> list[Column]:
    """Sums of x and of its products."""
    return [F.sum(c).alias(f"{name}s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"{name}q{i}{j}") for i, j in PAIRS]


def covariance(t, name: str, n):
    """Mean and covariance from weighted rows of moments."""
    import numpy as np

    mean = np.array([t[f"{name}s{i}"].sum() for i in range(DIM)]) / n
    cov = np.zeros((DIM, DIM))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = t[f"{name}q{i}{j}"].sum() / n - mean[i] * mean[j]
    return mean, cov


FIT = "g string, of long, start int, centre array<double>, inverse array<double>, logdet double"


def _fit(t, start: int, centre, cov):
    """A row of FIT, as a dictionary."""
    import numpy as np

    inv = np.linalg.inv(cov)
    return {"g": t["g"].iloc[0], "of": int(t["of"].iloc[0]), "start": start, "centre": np.asarray(centre, float), "inverse": np.array([inv[i, j] for i, j in PAIRS]), "logdet": float(np.linalg.slogdet(cov)[1])}


def _starts(t):
    """The three starts of a group, from its medians, scales and moments of signs and tangents."""
    import numpy as np
    import pandas as pd

    centre, scale, n = np.array(t["m"].iloc[0]), np.array(t["sc"].iloc[0]), float(t["of"].iloc[0])
    out = [_fit(t, 0, centre, np.diag(scale**2))]
    for k, name in enumerate(("u", "t")):
        _, cov = covariance(t, name, n)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        correlation = 0.9 * cov / np.outer(d, d) + 0.1 * np.eye(DIM)  # drawn to the identity, so that it has an inverse
        np.fill_diagonal(correlation, 1.0)
        out.append(_fit(t, k + 1, centre, correlation * np.outer(scale, scale)))
    return pd.DataFrame(out)


def _refit(share: float):
    factor = consistency(share)

    def refit(table):
        import numpy as np
        import pandas as pd

        t = table.sort_values("bin")
        total = t["n"].cumsum().to_numpy().astype(float)
        h = math.ceil(share * total[-1])
        part = np.clip((h - (total - t["n"].to_numpy())) / t["n"].to_numpy(), 0, 1)
        sums = [c for c in t.columns if c[:2] in ("xs", "xq")]
        centre, cov = covariance(t[sums].mul(part, axis=0), "x", h)
        return pd.DataFrame([_fit(t, int(t["start"].iloc[0]), centre, factor * cov + np.diag(np.square(FLOOR)))])

    return refit


def concentrated(rows: DataFrame, fits: DataFrame, share: float, few: bool) -> DataFrame:
    """The fits (FIT, one row per group and start) after one concentration step over rows (g, x0 to x4); `few` groups are broadcast."""
    by = fits.groupBy("g").agg(F.first("of").alias("n"), F.first("of").alias("of"), F.collect_list(F.struct("start", "centre", "inverse")).alias("fits"))
    met = rows.join(F.broadcast(by.drop("n")), "g") if few else C.matched(rows, C.stored(by, "mcd"), ["g"], "n")
    each = met.withColumn("fit", F.explode("fits")).select("g", "of", *X, "fit.*")
    # bins of a sixteenth of a doubling, -160 to 480: at most 641 for a group and start
    bins = F.least(F.lit(480), F.greatest(F.lit(-160), F.floor(16 * F.log2(squared_distance() + 1e-12)).cast("int")))
    table = each.withColumn("bin", bins).groupBy("g", "start", "bin").agg(F.first("of").alias("of"), F.count("*").alias("n"), *moments([F.col(x) for x in X], "x"))
    return table.groupBy("g", "start").applyInPandas(_refit(share), FIT)


def estimate(rows: DataFrame, p: Params) -> DataFrame:
    """(g, centre, inverse, logdet), stored, for each group g of rows (columns g, x0 to x4)."""
    with C.temporary() as keep:
        array = lambda name: F.array(*(F.col(f"{name}{x}") for x in X))
        middle = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 10_000).alias(f"m{x}") for x in X))
        middle = C.stored(middle.select("g", "n", F.col("n").alias("of"), array("m").alias("m")), "mcd")
        away = [F.abs(F.col(x) - F.col("m")[i]) for i, x in enumerate(X)]
        wide = C.matched(rows, middle, ["g"], "n").groupBy("g").agg(F.count("*").alias("n"), F.first("of").alias("of"), F.first("m").alias("m"), *(F.percentile_approx(a, 0.5, 10_000).alias(f"s{x}") for a, x in zip(away, X, strict=True)))
        scale = F.array(*(F.greatest(1.4826 * F.col(f"s{x}"), F.lit(f)) for x, f in zip(X, FLOOR, strict=True)))
        wide = C.stored(wide.select("g", "n", "of", "m", scale.alias("sc")), "mcd")
        z = C.matched(rows, wide, ["g"], "n").select("g", "of", "m", "sc", *(((F.col(x) - F.col("m")[i]) / F.col("sc")[i]).alias(f"z{i}") for i, x in enumerate(X)))
        z = z.withColumn("norm", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(1e-12))))
        signs, tangents = [F.col(f"z{i}") / F.col("norm") for i in range(DIM)], [F.tanh(f"z{i}") for i in range(DIM)]
        shapes = z.groupBy("g").agg(*(F.first(c).alias(c) for c in ("of", "m", "sc")), *moments(signs, "u"), *moments(tangents, "t"))
        fits = C.stored(shapes.groupBy("g").applyInPandas(_starts, FIT), "mcd")
        few = middle.count() <= 10_000
        for _ in range(2):
            fits = concentrated(rows, fits, p.share, few)
        best = C.stored(fits, "mcd").groupBy("g").agg(F.min_by(F.struct("of", "start", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("f")).select("g", "f.*")
        now = C.stored(best.withColumn("falls", F.lit(True)), "mcd")
        for _ in range(p.rounds):
            new = now.where("falls").drop("falls")
            if new.isEmpty():
                break
            for _ in range(3):
                new = concentrated(rows, new, p.share, few)
            new = new.select("g", *(F.col(c).alias(f"new_{c}") for c in ("centre", "inverse", "logdet")))
            better = F.coalesce(F.col("new_logdet") < F.col("logdet"), F.lit(False))
            falls = F.coalesce(F.col("logdet") - F.col("new_logdet") > p.least_fall, F.lit(False))
            now = C.stored(now.join(new, "g", "left").select("g", "of", "start", *(F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "inverse", "logdet")), falls.alias("falls")), "mcd")
        return keep(C.stored(now.select("g", "centre", "inverse", "logdet"), "mcd"))


def judge(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null and empty texts have no words and fail. A null language or source is a value of its own; repeated rows are
    judged alike (each counts); an empty table gives an empty result. Texts that fail the limits don't enter estimates.
    """
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    stats = C.stored(vector(measure(docs)).withColumn("base_failed", failed), "quality-stats")
    name = F.to_json(F.struct("lang", "source"))
    pool = F.to_json(F.struct("lang"))
    sizes = stats.where("not base_failed").groupBy(name.alias("own"), pool.alias("pool")).agg(F.count("*").alias("n"))
    # groups are few next to rows: those below min_rows go to a pool
    pools = sizes.where(F.col("n") < p.min_rows).groupBy("pool").agg(F.sum("n").alias("pn"))
    rest = pools.where(F.col("pn") < p.min_rows).agg(F.sum("pn").alias("rn"))
    to = sizes.join(pools, "pool", "left").crossJoin(rest)
    group = F.when(F.col("n") >= p.min_rows, F.col("own")).when(F.col("pn") >= p.min_rows, F.concat(F.lit("pool "), "pool")).when(F.col("rn") >= p.min_rows, F.lit("rest"))
    to = C.stored(to.select("own", "n", group.alias("g")).where("g is not null"), "quality-groups")
    # a language and source may have any share of all rows: their rows never meet in one task
    rows = C.stored(C.matched(stats.where("not base_failed").withColumn("own", name), to, ["own"], "n").select("g", *X), "quality-rows")
    fit = estimate(rows, p)
    C.dropped(rows)
    judged = C.matched(stats.withColumn("own", name), C.stored(to.join(fit, "g").select("own", "n", "centre", "inverse"), "quality-fits"), ["own"], "n", "left")
    limit = chi2_quantile(1 - p.alpha, DIM)
    distance = F.when(F.col("centre").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), squared_distance())))
    out = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(limit), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
