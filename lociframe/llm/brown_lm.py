"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Words (A-Z lower-cased runs of anything but ASCII white space) and a text's end are tokens. Counts of every word come
from all training texts by a distributed sum. Classes are found in two steps. Exchange clustering moves the units of a
seed (the end, the most frequent words, the most frequent endings of the other words, one unit for the rest; `units` of
them) between classes while that raises the likelihood of the class bigrams. Then every other word that occurs `least`
times or more is put into the class under which its own neighbours, counted over all training texts, are likeliest: all
words at once, each against the seed's classes, as in distributed exchange clustering. That table of words, counts and
classes grows with the corpus and stays distributed. Words that occur less often, and unseen ones, have the class of
their ending (last three bytes). Transitions are counted anew over all training texts with the words' own classes.
The probability of a token is

    P(class | class before) * P(unit | class) * P(word | unit)

with transitions smoothed by the class frequencies and (count + 1) / (total + types + 1) for the words of an ending, of
which unseen words are one type; a word with a class of its own is a unit.

Texts become sequences of classes once: the `known` most frequent words are sent to the workers with their units; other
words of a text meet their counts and classes in a join, one row each, so nothing that grows with the
vocabulary is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

END, REST = 0, 1


@dataclass(frozen=True)
class Params:
    #: of the seed that exchange clustering puts into classes
    units: int = 1024
    #: of the units, how many are words of their own
    words: int = 512
    #: at most 256: a class is a byte of a text's sequence
    classes: int = 40
    #: words that occur so often have a class of their own, not their ending's
    least: int = 2
    sweeps: int = 8
    #: words whose counts are sent to the workers, at most
    known: int = 150_000
    #: weight of the class frequencies in a transition
    smoothing: float = 20.0


def ending(word: bytes) -> bytes:
    return word[-3:]


def word_counts(texts: DataFrame, most: int = 150_000) -> DataFrame:
    """(word, n) over all texts (column text, bytes); a worker holds the counts of about `most` words at a time."""

    def run(batches):
        import pyarrow as pa

        def out(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        c: Counter = Counter()
        for batch in C.sliced(batches):
            for text in batch.column(0).to_pylist():
                c.update(text.lower().split())
                if len(c) > most:
                    yield out(c)
                    c = Counter()
        yield out(c)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def transitions(texts: DataFrame, unit: dict[bytes, int], units: int):
    """Codes (unit * units + next unit) and counts over all texts, each begun and ended by END; units * units numbers at most."""
    shared = texts.sparkSession.sparkContext.broadcast(unit)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(units * units, np.int64)
        look = unit_lookup(shared.value)
        for batch in C.sliced(batches):
            ids = [END]
            for text in batch.column(0).to_pylist():
                ids += map(look, text.lower().split())
                ids.append(END)
            x = np.array(ids, np.int64)
            total += np.bincount(x[:-1] * units + x[1:], minlength=units * units)
        have = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], ["code", "n"])

    rows = texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return rows.column("code").to_numpy(), rows.column("n").to_numpy()


def unit_lookup(unit: dict[bytes, int], most: int = 300_000):
    """A function from a word to its unit: words that are units (keyed with a trailing space), else their ending's, else REST."""

    class Memo(dict):
        def __missing__(self, w):
            if len(self) >= most:
                self.clear()
            u = unit.get(w + b" ")
            self[w] = u = unit.get(ending(w), REST) if u is None else u
            return u

    return Memo().__getitem__


def exchange(counts, classes: int, sweeps: int):
    """Class of every unit by exchange clustering of the bigram matrix `counts`; END has class 0 to itself.

    A unit goes to the class that raises sum N(c, d) log N(c, d) - sum N(c, .) log N(c, .) - sum N(., c) log N(., c) most.
    """
    import numpy as np

    def g(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    units = len(counts)
    classes = min(classes, units)
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    label = np.zeros(units, np.int64)
    for rank, u in enumerate(x for x in order if x != END):
        label[u] = 1 + rank % max(1, classes - 1) if classes > 1 else 0
    hot = np.zeros((units, classes))
    hot[np.arange(units), label] = 1
    m = hot.T @ counts @ hot
    right, left = counts @ hot, (hot.T @ counts).T  # counts of a unit before, and after, each class
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if u == END or classes < 3:
                continue
            a, own = label[u], counts[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= own  # neighbours other than itself
            l[a] -= own
            m[a, :] -= r
            m[:, a] -= l
            m[a, a] -= own
            out_c, in_c = m.sum(1), m.sum(0)
            rs, ls = r.sum() + own, l.sum() + own
            rows = g(m + r[None, :]) - g(m)  # what row b gains, cell by cell
            cols = g(m + l[:, None]) - g(m)
            both = g(np.diag(m) + r + l + own) - g(np.diag(m))
            gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols) + both
            gain -= g(out_c + rs) - g(out_c) + g(in_c + ls) - g(in_c)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            m[b, :] += r
            m[:, b] += l
            m[b, b] += own
            if b != a:
                moved += 1
                label[u] = b
                right[:, a] -= counts[:, u]
                right[:, b] += counts[:, u]
                left[:, a] -= counts[u, :]
                left[:, b] += counts[u, :]
        if not moved:
            break
    return label


def contexts(texts: DataFrame, unit: dict[bytes, int], label, classes: int, most: int = 150_000) -> DataFrame:
    """(word, at) over all texts, of words that are no units: counts of the classes before (0 to classes - 1) and after
    (classes to 2 * classes - 1) a word, as count * 2 * classes + place; a place may come several times."""
    shared = texts.sparkSession.sparkContext.broadcast((unit, label))
    k = 2 * classes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit, label = shared.value

        class Local(dict):
            def __init__(self):
                self[b" "] = 0  # the end; no word has a space
                self.label, self.free = [int(label[END])], [False]

            def __missing__(self, w):
                u = unit.get(w + b" ")
                self.free.append(u is None)
                self.label.append(int(label[unit.get(ending(w), REST) if u is None else u]))
                self[w] = i = len(self)
                return i

        def out(local, ids):
            kind = np.int32 if len(local) * k < 1 << 31 else np.int64
            x, free = np.array(ids, kind), np.array(local.free)
            c = np.array(local.label, kind)[x]
            at = np.nonzero(free[x])[0]  # neither the first nor the last, which are ends
            code, n = np.unique(np.concatenate([x[at] * k + c[at - 1], x[at] * k + classes + c[at + 1]]), return_counts=True)
            w = code // k
            starts = np.nonzero(np.diff(w, prepend=-1))[0]
            words = list(local)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(w)), pa.int32()), pa.array(n * k + code % k))
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in w[starts]], pa.binary()), lists], ["word", "at"])

        local, ids = Local(), [END]
        for batch in C.sliced(batches):
            for text in batch.column(0).to_pylist():
                ids += map(local.__getitem__, text.lower().split())
                ids.append(0)
                if len(local) > most or len(ids) > 10 * most:
                    yield out(local, ids)
                    local, ids = Local(), [0]
        yield out(local, ids)

    rows = texts.select("text").mapInArrow(run, "word binary, at array<long>")
    return rows.groupBy("word").agg(F.flatten(F.collect_list("at")).alias("at"))


def placed(met: DataFrame, unit: dict[bytes, int], step, size, least: int) -> DataFrame:
    """(word, n, c, u) of contexts: the count and the likeliest class of a word; below `least`, c is null and u the ending's unit.

    `step` has log10 P(class | class before), `size` the tokens of each class. The end's class takes no words, unless it
    is the only one.
    """
    shared = met.sparkSession.sparkContext.broadcast((unit, step, size))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        unit, step, size = shared.value
        classes = len(size)
        shut = size <= 0
        shut[0] = classes > 1
        if shut.all():
            shut[-1] = False
        for batch in C.sliced(batches):
            at, m = batch.column("at"), batch.num_rows
            row = np.repeat(np.arange(m), pc.list_value_length(at).to_numpy(zero_copy_only=False))
            v = at.flatten().to_numpy()
            counts = np.bincount(row * 2 * classes + v % (2 * classes), v // (2 * classes), m * 2 * classes).reshape(m, 2 * classes)
            n = counts[:, :classes].sum(1)
            gain = counts[:, :classes] @ step + counts[:, classes:] @ step.T - n[:, None] * np.log10(np.maximum(size, 1))[None, :]
            gain[:, shut] = -np.inf
            rare = n < least
            ends = [unit.get(ending(w), REST) if r else REST for w, r in zip(batch.column("word").to_pylist(), rare.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(n.astype(np.int64)), pa.array(gain.argmax(1).astype(np.int32), mask=rare), pa.array(np.array(ends, np.int32), mask=~rare)],
                ["word", "n", "c", "u"],
            )

    return met.mapInArrow(run, "word binary, n long, c int, u int")


@dataclass
class Model:
    """What the workers need: units of words and endings, log10 tables, and the counts of the known words."""

    unit: dict[bytes, int]
    label: object
    step: object  # log10 P(class | class before)
    emit: object  # log10 P(unit | class), with the part of P(word | unit) that does not depend on the word
    mass: object  # log10 of what P(unit | class) is divided by, per class
    is_word: object  # units that are a word or the end
    known: dict[bytes, int]
    total: int
    types: int
    texts: int
    words: DataFrame  # (word, n, c, u) of all training words outside the seed; not sent to the workers

    def __getstate__(self):
        return self.__dict__ | {"words": None}


def steps(matrix, size, smoothing: float):
    """log10 P(class | class before) of counted transitions, smoothed by the tokens of each class."""
    import numpy as np

    freq = (size + 1) / (size.sum() + len(size))
    return np.log10((matrix + smoothing * freq[None, :]) / (matrix.sum(1, keepdims=True) + smoothing))


def fit(texts: DataFrame, p: Params = Params()) -> tuple[Model, object]:
    """Classes and emissions from all texts (column text, bytes), and the tokens of each class; the transitions are still the seed's."""
    import numpy as np

    counts = C.stored(word_counts(texts), "words")
    n_texts = texts.count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, types = size.n + n_texts, size.v + (n_texts > 0)
    top = sorted(C.most_frequent(counts, "n", p.known, "word").collect(), key=lambda r: (-r.n, r.word))
    known = {bytes(r.word): r.n for r in top}
    own_words = [bytes(r.word) for r in top[: p.words]]
    unit = {w + b" ": 2 + i for i, w in enumerate(own_words)}
    # endings of the words that have no unit: at most 2**24 sums, of which the most frequent are taken
    by_end = counts.groupBy(F.expr("substring(word, -3, 3)").alias("e")).agg(F.sum("n").alias("n"))
    ends = C.most_frequent(by_end, "n", 4 * p.units, "e").collect()
    C.dropped(counts)
    minus = Counter()
    for w in own_words:
        minus[ending(w)] += known[w]
    left = sorted(((r.n - minus[bytes(r.e)], bytes(r.e)) for r in ends), key=lambda x: (-x[0], x[1]))
    for n, e in left[: p.units - 2 - len(own_words)]:
        if n > 0:
            unit[e] = 2 + len(unit)
    units = 2 + len(unit)
    matrix = np.zeros((units, units))
    code, n = transitions(texts, unit, units)
    matrix.flat[code] = n
    label = exchange(matrix, p.classes, p.sweeps)
    classes = int(label.max()) + 1
    hot = np.zeros((units, classes))
    hot[np.arange(units), label] = 1
    cn = hot.T @ matrix.sum(0)
    words = C.stored(placed(contexts(texts, unit, label, classes), unit, steps(hot.T @ matrix @ hot, cn, p.smoothing), cn, p.least), "classes")
    # tokens and types of each unit: the seed's words, and of an ending the words that have no class of their own
    un, uv = np.zeros(units), np.zeros(units)
    un[END], uv[END] = n_texts, n_texts > 0
    un[2 : 2 + len(own_words)], uv[2 : 2 + len(own_words)] = [known[w] for w in own_words], 1
    placed_n, placed_units = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("c", "u").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row per class and per ending's unit
        if r.c is None:
            un[r.u], uv[r.u] = r.n, r.v
        else:
            placed_n[r.c], placed_units[r.c] = r.n, r.v
    cn = hot.T @ un + placed_n
    mass = np.log10(np.maximum(cn + 0.5 * (hot.sum(0) + placed_units), 0.5))
    is_word = np.zeros(units, bool)
    is_word[END] = True
    is_word[2 : 2 + len(own_words)] = True
    emit = np.log10(un + 0.5) - mass[label] - np.where(is_word, 0.0, np.log10(un + uv + 1))
    # of the words with a class of their own, the known ones become units that the workers look up
    more = [r for r in C.most_frequent(words.where("c is not null"), "n", p.known, "word").collect() if bytes(r.word) in known]
    unit |= {bytes(r.word) + b" ": units + i for i, r in enumerate(more)}
    c = np.array([r.c for r in more], np.int64)
    emit = np.append(emit, np.log10(np.array([r.n for r in more], float) + 0.5) - mass[c])
    label, is_word = np.append(label, c), np.append(is_word, np.ones(len(more), bool))
    return Model(unit, label, steps(hot.T @ matrix @ hot, cn, p.smoothing), emit, mass, is_word, known, int(total), int(types), n_texts, words), cn


def learn(texts: DataFrame, p: Params = Params()) -> Model:
    """Fit on all texts (column text, bytes)."""
    model, size = fit(texts, p)
    own = sequences(texts.select(F.lit(None).cast("long").alias("doc_id"), "text"), model, F.lit(False))
    model.step = steps(class_transitions(own, len(size)), size, p.smoothing)
    C.dropped(own)
    return model


def sequences(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Per row of docs (doc_id, text), stored: doc_id, held_out, n_tokens, n_known, base_score, emitted (log10 of the
    emissions) and seq, the class of each word as a byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        look = unit_lookup(m.unit)
        floor = math.log10(m.total + m.types + 1)
        log_of = np.full(len(m.label), -1.0)  # of units that are words; other known words are looked up
        rest = {}
        for w, n in m.known.items():
            u = m.unit.get(w + b" ")
            if u is None:
                rest[w] = math.log10(n + 1)
            else:
                log_of[u] = math.log10(n + 1)
        byte = m.label.astype(np.uint8)
        fields = ["doc_id", "held_out", "n_tokens", "n_known", "base", "emitted", "seq"]
        for batch in C.sliced(batches, 200):
            n, words, begin = batch.num_rows, [], [0]
            for text in batch.column("text").to_pylist():
                words += text.lower().split()
                begin.append(len(words))
            begin = np.array(begin)
            lengths = np.diff(begin)
            row = np.repeat(np.arange(n), lengths)
            u = np.fromiter(map(look, words), np.int64, len(words))
            logs = log_of[u]
            other = np.nonzero(logs < 0)[0]
            logs[other] = np.fromiter(map(rest.get, map(words.__getitem__, other.tolist()), repeat(-1.0)), float, len(other))
            known = logs >= 0
            add = lambda x: np.bincount(row[known], x, n)
            own, log = u[known], logs[known]
            emitted = m.emit[END] + add(m.emit[own] + np.where(m.is_word[own], 0.0, log))
            base = add(log) - floor * (lengths + 1)
            seq = byte[u].tobytes()
            other = np.nonzero(~known)[0]
            k, at = len(other), other - begin[row[other]]
            none, rid = pa.nulls, batch.column("rid").to_numpy()
            seqs = pa.array([seq[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths + 1), pa.array(np.bincount(row[known], minlength=n)), pa.array(base), pa.array(emitted), seqs]
            own = pa.StructArray.from_arrays(columns, fields)
            # a text's own row has a word that no text can have, a space and its number: it meets no count, and no two share it
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(rid, rid[row[other]])),
                    pa.array([*(b" %d" % r for r in rid.tolist()), *map(words.__getitem__, other.tolist())], pa.binary()),
                    pa.concat_arrays([none(n, pa.int32()), pa.array(at.astype(np.int32))]),
                    pa.concat_arrays([none(n, pa.int32()), pa.array(u[other].astype(np.int32))]),
                    pa.concat_arrays([own, none(k, own.type)]),
                ],
                ["rid", "word", "at", "u", "own"],
            )

    source = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out.alias("held_out"), C.as_bytes(F.col("text")).alias("text"))
    rows = source.mapInArrow(run, f"rid long, word binary, at int, u int, own struct<doc_id: {kind}, held_out: boolean, n_tokens: long, n_known: long, base: double, emitted: double, seq: binary>")
    met = rows.join(model.words.select("word", "n", "c"), "word", "left")
    other = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "u", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(-1)).alias("c"))))
    per_text = met.groupBy("rid").agg(F.max("own").alias("own"), other.alias("other")).select("own.*", "other")

    def patch(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        m = shared.value
        for batch in C.sliced(batches):
            k = batch.num_rows
            seqs = batch.column("seq").to_pylist()
            begin = np.cumsum([0, *map(len, seqs)])
            flat = np.frombuffer(b"".join(seqs), np.uint8).copy()
            row = np.repeat(np.arange(k), pc.list_value_length(batch.column("other")).to_numpy(zero_copy_only=False))
            found = batch.column("other").flatten()
            at, u, n, c = (pc.struct_field(found, x) for x in ("at", "u", "n", "c"))
            at, u, n, c = (x.to_numpy(zero_copy_only=False) for x in (at, u, n, c))
            flat[(begin[row] + at)[c >= 0]] = c[c >= 0]
            log = np.log10(n + 1)
            emitted = np.where(c >= 0, np.log10(n + 0.5) - m.mass[c], m.emit[u] + log)
            add = lambda x: np.bincount(row, x, k)
            whole = flat.tobytes()
            # the end is known once there are texts
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    batch.column("n_tokens"),
                    pa.array(batch.column("n_known").to_numpy() + add(n > 0).astype(np.int64) + int(m.types > 0)),
                    pa.array(batch.column("base").to_numpy() + add(log) + math.log10(m.texts + 1)),
                    pa.array(batch.column("emitted").to_numpy() + add(emitted)),
                    pa.array([whole[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "seq"],
            )

    return C.stored(per_text.mapInArrow(patch, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, seq binary"), "sequences")


def joined(seqs: list[bytes]):
    """Classes of several texts in a row, with the end's class 0 before, between and after them."""
    import numpy as np

    return np.frombuffer(b"\0" + b"\0".join(seqs) + b"\0", np.uint8).astype(np.int64)


def class_transitions(own: DataFrame, classes: int):
    """Counts of class after class over all sequences."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(classes * classes, np.int64)
        for batch in C.sliced(batches):
            if batch.num_rows:
                x = joined(batch.column(0).to_pylist())
                total += np.bincount(x[:-1] * classes + x[1:], minlength=classes * classes)
        have = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], ["code", "n"])

    rows = own.select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((classes, classes))
    matrix.flat[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return matrix


def score(own: DataFrame, model: Model) -> DataFrame:
    """Per sequence: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    step = model.step

    @F.pandas_udf("double")
    def stepped(seqs):
        import numpy as np
        import pandas as pd

        seqs = [bytes(x) for x in seqs]
        if not seqs:
            return pd.Series([], dtype="float64")
        x = joined(seqs)
        return pd.Series(np.add.reduceat(step[x[:-1], x[1:]], np.cumsum([0, *(len(s) + 1 for s in seqs[:-1])])))

    return own.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("emitted") + stepped("seq")).alias("score"),
    )


def judge(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Scores of all texts by a model of those whose id has a crc32 modulo 7 other than 2 (a null id: learned from).

    Null and empty texts have one token, the end. Repeated rows count and are scored each. Without training texts every
    token is unseen. base_score is the add-one unigram baseline.
    """
    held = F.coalesce(C.crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    model, size = fit(docs.where(~held).select(C.as_bytes(F.col("text")).alias("text")), p)
    own = sequences(docs, model, held)
    C.dropped(model.words)
    model.step = steps(class_transitions(own.where("not held_out"), len(size)), size, p.smoothing)
    return score(own, model)
