"""Benchmark passages in training text through a distributed positional inverted index.

The index holds every word of the corpus and is built once, whatever is searched in it. It is partitioned into shards of
`SHARD` words: consecutive documents whose words are numbered along one axis, with a gap after each document. Within a
shard every term has one posting list of its places on that axis, so a term's list over the corpus is split among as many
shards as need be and no list is longer than a shard. Everything is one table in the shared folder.

A search goes through the benchmark in blocks of at most `BLOCK` windows. A block's terms select their posting lists,
which meet shard by shard. Of each window whose terms the shard has, the rarest term's list proposes the places; the
others' lists, from rare to frequent, are intersected with it, adjusted by their offsets in the window, by binary search.
A proximity match asks instead that each of the other terms lies near enough, and then finds the shortest such stretch.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: words of a shard, at most (a longer document is a shard of its own)
SHARD = 1 << 18
#: windows, counted once for each item that has them, that are searched at a time
BLOCK = 500_000
#: places that are intersected at a time
CHUNK = 1 << 21


def words(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    return text.translate(C.ALNUM).split()


@dataclass
class Phrases:
    """A block of windows: term numbers (windows x longest, -1 beyond a window's end), sizes, and the items that have each."""

    terms: list[bytes]
    window: object
    size: object
    item_at: object
    item: object
    names: list[str]

    @staticmethod
    def of(seen: dict[tuple[int, ...], dict[str, None]], terms: dict[bytes, int]) -> Phrases:
        import numpy as np

        size = np.fromiter(map(len, seen), np.int32, len(seen))
        window = np.full((len(seen), int(size.max(initial=1))), -1, np.int32)
        for i, w in enumerate(seen):
            window[i, : len(w)] = w
        names = {n: None for items in seen.values() for n in items}
        number = {n: i for i, n in enumerate(names)}
        at = np.cumsum([0, *map(len, seen.values())]).astype(np.int64)
        item = np.fromiter((number[n] for items in seen.values() for n in items), np.int32, int(at[-1]))
        return Phrases(list(terms), window, size, at, item, list(names))

    def items(self, windows) -> list[str]:
        """Items that have any of these windows, sorted."""
        return sorted({self.names[k] for w in set(windows) for k in self.item[self.item_at[w] : self.item_at[w + 1]].tolist()})


def blocks(benchmark: DataFrame, window: int, most: int = BLOCK):
    """The benchmark as Phrases, at most `most` windows at a time; items without words have none, null ids are left out."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), C.as_bytes(F.col("text")).alias("t")).where("i is not null")
    terms: dict[bytes, int] = {}
    seen: dict[tuple[int, ...], dict[str, None]] = {}
    n = 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        own = words(bytes(r.t))
        ids = None
        for k in range(max(1, len(own) - window + 1) if own else 0):
            if n >= most:
                yield Phrases.of(seen, terms)
                terms, seen, n, ids = {}, {}, 0, None
            if ids is None:
                start, ids = k, []
            while len(ids) < min(len(own), k + window) - start:
                ids.append(terms.setdefault(own[start + len(ids)], len(terms)))
            items = seen.setdefault(tuple(ids[k - start : k - start + window]), {})
            n += r.i not in items
            items[r.i] = None
    if seen:
        yield Phrases.of(seen, terms)


class _Shard:
    """Collects documents until a shard is full; then hands out its rows."""

    def __init__(self):
        class Terms(dict):
            def __missing__(self, w):
                self[w] = n = len(self)
                return n

        self.terms, self.ids, self.rid, self.begin, self.docs = Terms({b"": 0}), [], [], [], []

    def add(self, rid: int, text: bytes) -> int:
        own = words(text)
        self.rid.append(rid)
        self.begin.append(len(self.ids))
        self.ids.extend(map(self.terms.__getitem__, own))
        self.ids.append(0)  # the gap
        return len(own)

    def rows(self, docs, n_words):
        """One row with the shard's documents, a row for each document, a row for each term's posting list."""
        import numpy as np
        import pyarrow as pa

        ids, d, t = np.array(self.ids, np.int32), len(self.rid), len(self.terms) - 1
        count = np.bincount(ids, minlength=t + 1)[1:]
        places = np.argsort(ids, kind="stable")[d:].astype(np.int32)
        begins = np.array(self.begin, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], [d], np.full(d, d), d + np.cumsum(count)]).astype(np.int32)), pa.array(np.concatenate([begins, places])))
        terms = iter(self.terms)
        next(terms)
        rids = pa.array(self.rid, pa.int64())
        none = pa.nulls
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(1 + d + t, self.rid[0])),
                pa.concat_arrays([none(1 + d, pa.binary()), pa.array(list(terms), pa.binary())]),
                lists,
                pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, d], pa.int32()), rids), none(d + t, pa.list_(pa.int64()))]),
                pa.concat_arrays([none(1, pa.int64()), rids, none(t, pa.int64())]),
                pa.concat_arrays([none(1, docs[0].type), *docs, none(t, docs[0].type)]),
                pa.concat_arrays([none(1, pa.int64()), pa.array(n_words, pa.int64()), none(t, pa.int64())]),
            ],
            ["shard", "term", "places", "rids", "rid", "doc_id", "n_words"],
        )


def index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The positional inverted index of docs (doc_id, text), stored in the shared folder.

    Rows are of three kinds: a term's posting list (shard, term, places); a document (rid, its number in the scan, doc_id,
    n_words); a shard's documents in order (shard, rids, and places: where each begins).
    """

    def run(batches):
        own, ids, n = _Shard(), [], []
        for batch in C.sliced(batches, 200):
            begin = 0
            for i, (rid, text) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                n.append(own.add(rid, text))
                if len(own.ids) >= shard:
                    ids.append(batch.column("doc_id").slice(begin, i + 1 - begin))
                    yield own.rows(ids, n)
                    own, ids, n, begin = _Shard(), [], [], i + 1
            if begin < batch.num_rows:
                ids.append(batch.column("doc_id").slice(begin))
        if n:
            yield own.rows(ids, n)

    source = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", C.as_bytes(F.col("text")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return C.stored(source.mapInArrow(run, f"shard long, term binary, places array<int>, rids array<long>, rid long, doc_id {kind}, n_words long"), "postings")


def documents(postings: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words) of every document of an index."""
    return postings.where("rid is not null").select("rid", "doc_id", "n_words")


class Lists:
    """The posting lists of one shard for a block's terms, as one sorted array of term * length + place."""

    def __init__(self, table, n_terms: int):
        import numpy as np
        import pyarrow.compute as pc

        table = table.combine_chunks()
        t = table.column("t").to_numpy()
        head = int(np.nonzero(t < 0)[0][0])
        one = table.slice(head, 1)
        self.begins = one.column("places").combine_chunks().flatten().to_numpy()
        self.rids = one.column("rids").combine_chunks().flatten().to_numpy()
        order = np.argsort(t, kind="stable")[1:]
        lists = table.column("places").take(order).combine_chunks()
        own = t[order]
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.size = np.zeros(n_terms + 1, np.int64)  # the last one stands for what lies beyond a window's end
        self.size[own] = count
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.place = lists.flatten().to_numpy().astype(np.int64)
        self.length = int(self.place.max(initial=0)) + 1 + (1 << 20)
        self.key = np.repeat(own.astype(np.int64), count) * self.length + self.place

    def alive(self, window):
        """Windows whose terms the shard has, with their columns in the order of rarity (ends last)."""
        import numpy as np

        size = self.size[window]
        size[window < 0] = np.iinfo(np.int64).max
        have = np.nonzero((size > 0).all(axis=1))[0]
        return have, np.argsort(size[have], axis=1, kind="stable")

    def proposals(self, window, have, order):
        """The rarest term's places for each of these windows, in parts: rows of `have` and places."""
        import numpy as np

        first = window[have, order[:, 0]]
        many = np.cumsum(self.size[first])
        a = 0
        while a < len(have):
            b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + CHUNK, "right")))
            n = self.size[first[a:b]]
            w = np.repeat(np.arange(a, b), n)
            within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            yield w, self.place[self.at[first[w]] + within]
            a = b

    def phrases(self, own: Phrases):
        """(window, first place) of every occurrence."""
        import numpy as np

        have, order = self.alive(own.window)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for w, s in self.proposals(own.window, have, order):
            s = s - order[w, 0]
            for j in range(1, own.window.shape[1]):
                if not len(w):
                    break
                at = order[w, j]
                t = own.window[have[w], at].astype(np.int64)
                key = t * self.length + s + at
                k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                ok = (t < 0) | ((self.key[k] == key) & (s >= 0))
                w, s = w[ok], s[ok]
            found.append((have[w], s))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, own: Phrases, slack: int):
        """(window, document, begin, end) of the shortest stretch, of at most `slack` words more than the window, that has all
        its terms, with repeats, in any order; one per window and document."""
        import numpy as np

        have, order = self.alive(own.window)
        for w, p in self.proposals(own.window, have, order):
            reach = own.size[have[w]] - 1 + slack
            for j in range(1, own.window.shape[1]):
                if not len(w):
                    break
                t = own.window[have[w], order[w, j]].astype(np.int64)
                low = t * self.length + np.maximum(0, p - reach)
                k = np.minimum(np.searchsorted(self.key, low), len(self.key) - 1)
                ok = (t < 0) | ((self.key[k] >= low) & (self.key[k] <= t * self.length + p + reach))
                w, p, reach = w[ok], p[ok], reach[ok]
            doc = np.searchsorted(self.begins, p, "right") - 1
            for i, d in sorted(set(zip(have[w].tolist(), doc.tolist(), strict=True))):
                begin = int(self.begins[d])
                end = int(self.begins[d + 1]) if d + 1 < len(self.begins) else self.length
                best = self.stretch(own.window[i, : own.size[i]].tolist(), begin, end)
                if best and best[1] - best[0] <= own.size[i] + slack:
                    yield i, d, best[0] - begin, best[1] - begin

    def stretch(self, terms: list[int], begin: int, end: int):
        """The shortest (first) stretch of a document that has these terms."""
        import heapq
        from collections import Counter, deque

        import numpy as np

        quota = Counter(terms)
        lists = []
        for t in quota:
            a, b = np.searchsorted(self.key, [t * self.length + begin, t * self.length + end])
            lists.append([(int(x) - t * self.length, t) for x in self.key[a:b]])
        have, missing, tail, best = Counter(), len(quota), deque(), None
        for p, t in heapq.merge(*lists):
            tail.append((p, t))
            have[t] += 1
            missing -= have[t] == quota[t]
            while have[tail[0][1]] > quota[tail[0][1]]:
                have[tail.popleft()[1]] -= 1
            if not missing and (best is None or p + 1 - tail[0][0] < best[1] - best[0]):
                best = (tail[0][0], p + 1)
        return best


def _met(postings: DataFrame, own: Phrases) -> DataFrame:
    """The posting lists of the block's terms (shard, t, places) and the shards' documents (t is -1)."""
    import pyarrow as pa

    spark = postings.sparkSession
    terms = spark.createDataFrame(pa.table({"term": pa.array(own.terms, pa.binary()), "t": pa.array(range(len(own.terms)), pa.int32())}))
    lists = postings.where("term is not null").join(F.broadcast(terms), "term").select("shard", "t", "places", F.lit(None).cast("array<bigint>").alias("rids"))
    return lists.unionByName(postings.where("rids is not null").select("shard", F.lit(-1).alias("t"), "places", "rids"))


def search(postings: DataFrame, own: Phrases, slack: int = 0) -> DataFrame:
    """Documents of the index with a match: rid, exact matches as merged intervals begins/stops of words, the items that they
    are of, and near_items: those with a window whose words lie, in any order, within `slack` words more than it has."""
    shared = postings.sparkSession.sparkContext.broadcast(own)

    def run(table):
        import numpy as np
        import pyarrow as pa

        phrases = shared.value
        lists = Lists(table, len(phrases.terms))
        w, s = lists.phrases(phrases)
        near: dict[int, list[int]] = {}
        for i, d, _, _ in lists.near(phrases, slack):
            near.setdefault(d, []).append(i)
        doc = np.searchsorted(lists.begins, s, "right") - 1
        out: list[list] = [[], [], [], [], []]
        for d in sorted({*doc.tolist(), *near}):
            at = doc == d
            a = s[at] - lists.begins[d]
            order = np.argsort(a, kind="stable")
            a = a[order]
            b = np.maximum.accumulate(a + phrases.size[w[at]][order]) if len(a) else a
            first = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.zeros(0, bool)
            values = (int(lists.rids[d]), a[first].tolist(), b[np.concatenate([first[1:], [True]])].tolist() if len(a) else [], phrases.items(w[at].tolist()), phrases.items(near.get(d, ())))
            for o, v in zip(out, values, strict=True):
                o.append(v)
        ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
        return pa.table([pa.array(o, t) for o, t in zip(out, (pa.int64(), ints, ints, texts, texts), strict=True)], ["rid", "begins", "stops", "items", "near_items"])

    return _met(postings, own).groupBy("shard").applyInArrow(run, "rid long, begins array<int>, stops array<int>, items array<string>, near_items array<string>")


def proximity(postings: DataFrame, own: Phrases, slack: int) -> DataFrame:
    """Documents where all words of a window, with repeats, lie within `slack` words more than it has, in any order.

    One row per document and window with its shortest such stretch: rid, doc_id, items, begin, stop.
    """
    shared = postings.sparkSession.sparkContext.broadcast(own)

    def run(table):
        import pyarrow as pa

        phrases = shared.value
        lists = Lists(table, len(phrases.terms))
        rows = [{"rid": int(lists.rids[d]), "items": phrases.items([i]), "begin": a, "stop": b} for i, d, a, b in lists.near(phrases, slack)]
        return pa.Table.from_pylist(rows, pa.schema([("rid", pa.int64()), ("items", pa.list_(pa.string())), ("begin", pa.int32()), ("stop", pa.int32())]))

    found = _met(postings, own).groupBy("shard").applyInArrow(run, "rid long, items array<string>, begin int, stop int")
    return found.join(documents(postings).select("rid", "doc_id"), "rid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, n_near_items, contaminated (and rid, its number in the scan).

    A word is hit inside any occurrence of an item's window of `window` words (a shorter item is one window). A document
    with a twentieth of its words hit is contaminated. n_near_items counts items with a window whose words follow one
    another in any order. Null and empty texts have no words; items without words or id have no window; repeated rows are
    judged alike; an empty benchmark hits nothing.
    """
    postings = index(docs, shard)
    parts = [C.stored(search(postings, own), "matches") for own in blocks(benchmark, window, block)]
    out = documents(postings)
    lists = ("begins", "stops", "items", "near_items")
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        if len(parts) > 1:
            found = found.groupBy("rid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists))
        out = out.join(found, "rid", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("array<string>" if "items" in c else "array<int>") for c in lists})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hit, n_items, near, digest = [], [], [], []
            for n, a, b, items, close in zip(*(batch.column(c).to_pylist() for c in ("n_words", *lists)), strict=True):
                if a:
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                hit.append(int((np.cumsum(edge) > 0).sum()) if a else 0)
                own = sorted(set(items or ()))
                n_items.append(len(own))
                near.append(len(set(close or ())))
                digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            longs = (pa.array(x, pa.int64()) for x in (hit, n_items, near))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("n_words"), *longs, pa.array(digest, pa.string())], ["rid", "doc_id", "n_words", "n_hit", "n_items", "n_near_items", "items_sha256"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    out = out.select("rid", "doc_id", "n_words", *lists).mapInArrow(run, f"rid long, doc_id {kind}, n_words long, n_hit long, n_items long, n_near_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
