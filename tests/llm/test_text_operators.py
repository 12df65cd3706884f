"""Corpus operators on small fixtures against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.llm import brown_lm, compress_quality, decontam, quality_rules, sentencepiece_fst, simhash, toxicity, wordpiece

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, rid long, label string"


def made(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None, 9.0, 7, 3, "x") for i, t, lang, s in rows], SCHEMA)


def odd_rows(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Ärger", "mot", "été", "x1", "Foo", "bar,", "(baz)"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n ", "en", "a"), (None, "the of and", "en", "a"), rows[0], rows[0], (n + 3, "long " * 20000, "en", "a"), (n + 4, rows[3][1], "en", "a")]
    return rows


def test_brown_model_counts_and_base(spark):
    rows = odd_rows()
    p = brown_lm.Params(units=40, words=12, classes=6, known=8, sweeps=3)
    got = brown_lm.judge(made(spark, rows), p).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    tokens = [[*WORD.findall((t or "").translate(LOW)), "\n"] for _, t, *_ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, *_), t, h in zip(rows, tokens, held))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_brown_model_is_a_distribution(spark):
    """Over all words after the end, and the end, with unseen words of each unit as one type, probabilities add up to 1."""
    rows = [(i, t, None, None) for i, t in enumerate(["a b c", "b c d", "a a b", "zz yy zz", "q r s t u", "a b"])]
    docs = made(spark, rows).select("doc_id", "text")
    model = brown_lm.learn(docs.selectExpr("cast(text as binary) as text"), brown_lm.Params(units=9, words=3, classes=3, known=100, sweeps=3))
    total = 0.0
    for u in range(len(model.label)):
        own = [w for w in model.known if model.unit.get(w + b" ", model.unit.get(brown_lm.ending(w), 1)) == u]
        base = 10 ** (model.step[0, model.label[u]] + model.emit[u])
        total += base if model.is_word[u] else base * (sum(model.known[w] + 1 for w in own) + 1)
    assert total == pytest.approx(1.0, abs=1e-9)


def test_exchange_separates_languages():
    import numpy as np

    m = np.zeros((9, 9))
    r = random.Random(0)
    for lang in ([1, 2, 3, 4], [5, 6, 7, 8]):
        for _ in range(300):
            a = 0
            for _ in range(10):
                b = r.choice(lang)
                m[a, b] += 1
                a = b
            m[a, 0] += 1
    label = brown_lm.exchange(m, 3, 10)
    assert label[0] == 0 and len(set(label[1:5])) == 1 and len(set(label[5:])) == 1 and label[1] != label[5]


def test_brown_model_classes_every_repeated_word(spark):
    """Words outside the seed get the class of their neighbours' pattern, also those that only the join knows."""
    r = random.Random(6)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    texts = [" ".join(w for _ in range(12) for w in (r.choice(left), r.choice(right))) for _ in range(150)]
    docs = made(spark, [(i, t, None, None) for i, t in enumerate([*texts, "l0 once"])])
    p = brown_lm.Params(units=14, words=12, classes=3, known=20, sweeps=8)
    model = brown_lm.learn(docs.selectExpr("cast(text as binary) as text"), p)
    got = {bytes(x.word).decode(): (x.n, x.c) for x in model.words.collect()}
    counts = Counter(w for t in [*texts, "l0 once"] for w in t.split())
    own = {w for w in counts if w.encode() + b" " not in model.unit or w in got}
    assert {w: n for w, (n, _) in got.items()} == {w: counts[w] for w in own} and got["once"][1] is None
    assert len([w for w, (n, c) in got.items() if c is not None]) == 80 - 12
    assert len({c for w, (_, c) in got.items() if w[0] == "l"}) == 1 == len({c for w, (_, c) in got.items() if w[0] == "r"}) and got["l39"][1] != got["r39"][1]


def test_brown_model_without_training_texts(spark):
    assert brown_lm.judge(made(spark, [])).count() == 0
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = brown_lm.judge(made(spark, [(one, "a b", "en", "s")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_maximal_segments_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        x = [r.choice([-3, -2, -1, 1, 2, 4]) for _ in range(r.randint(1, 12))]

        def best(lo, hi):
            found = [(sum(x[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            return max(found, default=None)

        def split(lo, hi):
            top = best(lo, hi)
            if top is None or top[0] <= 0:
                return []
            # of equal scores the shortest, so that none begins or ends with a sum of 0
            s, _, _, a, b = max((f for f in [(sum(x[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]), key=lambda f: f[:3])
            return [*split(lo, a), (a, b, s), *split(b, hi)]

        got = [(a, b, s) for a, b, s in toxicity.segments(x)]
        assert sum(s for *_, s in got) == sum(s for *_, s in split(0, len(x)))
        assert max((s for *_, s in got), default=0) == max(0, (best(0, len(x)) or [0])[0])


def toxic_corpus(n=600):
    r = random.Random(5)
    clean = [f"{a}{b}" for a in ["be", "ka", "lo", "mi", "tu"] for b in ["ra", "ne", "so", "vi", "da", "gu"]]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "vilest" + r.choice(["", "ed", "ing", "ly", "xx", "oo"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    extra = [(9000, None, None, None), (9001, "", "en", "s"), (None, "so vilest", "en", "s"), rows[0], (9002, "mira " * 30000, "en", "s")]
    got = toxicity.judge(made(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    own = [r for r in got if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) > 0.98 * len(own)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and not by[9000].predicted and not by[9001].predicted and not by[9002].predicted
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_toxic_passages(spark):
    rows, labels = toxic_corpus()
    docs = made(spark, rows)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    found = toxicity.passages(docs, model).collect()
    assert found and all("vilest" in r.passage and 0 <= r.p_value <= 1 for r in found)
    assert {r.doc_id for r in found} >= {i for i, _, t in labels if t and i % 40 == 0}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.judge(made(spark, [(1, "idiot", "en", "s")]), none).collect()] == [0]
    assert toxicity.judge(made(spark, []), none).count() == 0


def test_wordpiece_against_the_library(spark):
    from tokenizers import models

    head, tail = wordpiece.pieces(wordpiece.VOCABULARY)
    ids = {}
    for p in ["[UNK]", *head, *("##" + x for x in tail)]:
        ids.setdefault(p, len(ids))
    own = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10**6)
    rows = [*odd_rows(), (500, "日本語 \U0001f600 naïve supercalifragilistic", None, None)]

    def want(text):
        words = WORD.findall(text or "")
        pieces = [[x.value for x in own.tokenize(w)] for w in words]
        return len(words), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces)

    got = wordpiece.count_tokens(made(spark, rows), memo_size=50).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_tokens, r.n_unknown) for r in got) == sorted((i or -1, *want(t)) for i, t, *_ in rows)
    assert wordpiece.count_tokens(made(spark, [])).count() == 0


def test_wordpiece_automaton_by_brute_force():
    r = random.Random(2)
    for _ in range(40):
        pick = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
        head, tail = [pick() for _ in range(5)], [pick() for _ in range(4)]
        a = wordpiece.Automaton.build(head, tail)

        def greedy(w):
            n, i = 0, 0
            while i < len(w):
                own = head if i == 0 else tail
                k = max((len(p) for p in own if w.startswith(p, i)), default=0)
                if not k:
                    return -1
                i, n = i + k, n + 1
            return n

        for _ in range(60):
            w = "".join(r.choice("abc" if r.random() < 0.05 else "ab") for _ in range(r.randint(1, 12)))
            assert a.count(w) == greedy(w)


def test_sentencepiece_against_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.VOCABULARY)
    rows = [*odd_rows(), (500, "  two  spaces \n\n tab\t日本語 \U0001f600\U0001f600 ▁ " + " " * 37 + "end ", None, None)]
    got = {(r.doc_id, r.n_ids, r.decoded_bytes): (r.ids, r.round_trip) for r in sentencepiece_fst.encode(made(spark, rows)).collect()}
    want = {i: sp.encode(t or "") for i, t, *_ in rows}
    assert all(ids == want[i] for (i, *_), (ids, _) in got.items()) and all(same for _, same in got.values())
    docs = made(spark, [x for x in rows if x[0] is not None and x[0] < 50])
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t) for i, t, *_ in rows if i is not None and i < 50}
    assert sentencepiece_fst.encode(made(spark, [])).count() == 0


def test_sentencepiece_fuzz():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.VOCABULARY)
    t, r, memo = sentencepiece_fst.load(), random.Random(3), sentencepiece_fst.Memo(200)
    letters = "ab  \n\t▁eéñß日本\U0001f600#|.<>0123 theing"
    for k in range(1500):
        x = " " * r.randint(0, 40) * (k % 3 == 0) + "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert t.encode(x, memo) == sp.encode(x)
        assert t.decode(t.encode(x)) == sp.decode(sp.encode(x))


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            import struct

            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2]) + bytes([len(value)]) + value
    return out


def test_unigram_shortest_path():
    """A model with scores: the path of least weight, against all segmentations."""
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.2, "▁a": -2.2, "ba": -4.0, "bab": -4.1}
    model = _message((1, _message((1, b"<unk>"), (2, 0.0), (3, 2))), *((1, _message((1, p.encode()), (2, s), (3, 1))) for p, s in scores.items()), (2, _message((3, 1))), (3, _message((3, 1), (4, 1), (5, 1))))
    t = sentencepiece_fst.Transducer(model)
    assert not t.bpe

    def all_paths(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in scores for rest in all_paths(s[k:])]

    for text in ["ab", "abab", "bab ab", "ba", "aabb", "  a  b "]:
        s = t.normalize(text)
        best = max(sum(scores[x] for x in p) for p in all_paths(s))
        got = [list(scores)[i - 1] for i in t.encode(text)]
        assert "".join(got) == s and sum(scores[x] for x in got) == pytest.approx(best)
    assert t.encode("z")[-1] == 0


def test_normaliser_character_map():
    """The character map of a rule set that the library ships."""
    import sentencepiece

    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("this version has no normaliser")
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    spec = next(v for k, v in sentencepiece_fst.fields(n.serialized_model_proto()) if k == 3)
    own = sentencepiece_fst.Normalizer(spec)
    for x in ["ﬁne Ａ①", "é ½ ㎏", "plain", "", "ｶﾞ日本　x"]:
        assert own.rewrite(x) == n.normalize(x)


def test_contamination_by_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "THE"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 13, 5, 1, 20, 14])] + [(6, None), (7, "..."), (None, "w1 w2"), (1, "w1 w2 w3")]
    bench = spark.createDataFrame([(*x, 1, "e") for x in items], "item_id long, text string, rid long, terms string")
    rows = []
    for i in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            p = (r.choice(items[:6])[1]).split()
            a = r.randrange(len(p))
            k = r.randrange(len(words) + 1)
            words[k:k] = p[a : a + r.randint(1, 30)]
        rows.append((i, r.choice([" ", "--", "\n"]).join(words), "en", "s"))
    rows += odd_rows(10)[10:] + [(None, items[0][1], None, None)]

    def want(text):
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for i, t in items:
            p = ALNUM.findall((t or "").translate(LOW))
            if i is None or not p:
                continue
            for a in range(max(1, len(p) - 12)):
                q = p[a : a + 13]
                for k in range(len(w) - len(q) + 1):
                    if w[k : k + len(q)] == q:
                        hit.update(range(k, k + len(q)))
                        found.add(str(i))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    expected = sorted((i if i is not None else -1, *want(t)) for i, t, *_ in rows)
    def near(text):
        w = ALNUM.findall((text or "").translate(LOW))
        found = set()
        for i, t in items:
            p = ALNUM.findall((t or "").translate(LOW))
            for a in range(max(1, len(p) - 12) if i is not None and p else 0):
                q = sorted(p[a : a + 13])
                if any(sorted(w[k : k + len(q)]) == q for k in range(len(w) - len(q) + 1)):
                    found.add(i)
        return len(found)

    close = sorted((i if i is not None else -1, near(t)) for i, t, *_ in rows)
    for block, shard in ((decontam.BLOCK, decontam.SHARD), (60, 500)):  # in one block and shard, and in several
        got = decontam.contamination(made(spark, rows), bench, block=block, shard=shard).collect()
        assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == expected
        assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_near_items) for x in got) == close
    assert decontam.contamination(made(spark, []), bench).count() == 0
    assert not any(x.contaminated for x in decontam.contamination(made(spark, rows), bench.where("false")).collect())


def test_proximity(spark):
    """Text ids stay text; a window's words may be apart and out of order, repeats count, and documents are kept apart."""
    bench = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([("a", "red x green y y blue"), ("b", "blue green red"), ("c", "red green x x x x x x x x x x blue"), ("d", "red red green"), ("e", "blue"), ("f", None)], "doc_id string, text string")
    postings = decontam.index(docs)
    (phrases,) = decontam.blocks(bench, 13)
    got = {r.doc_id: (r.items, r.begin, r.stop) for r in decontam.proximity(postings, phrases, 3).collect()}
    assert got == {"a": (["7"], 0, 6), "b": (["7"], 0, 3)}


def test_benchmark_blocks_bound_windows(spark):
    """A long item is searched in several blocks; the windows of all blocks are those of the items."""
    r = random.Random(3)
    texts = {i: [r.choice("abcdefgh") for _ in range(n)] for i, n in enumerate([100, 5, 40])}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id long, text string")
    found = set()
    for own in decontam.blocks(bench, 13, 30):
        assert own.item_at[-1] <= 30
        for k, w in enumerate(own.window):
            found |= {(x, tuple(own.terms[t].decode() for t in w if t >= 0)) for x in own.items([k])}
    assert found == {(str(i), tuple(t[k : k + 13])) for i, t in texts.items() for k in range(max(1, len(t) - 12))}


def simhash_value(text):
    import xxhash

    w = WORD.findall((text or "").translate(LOW))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        words = [f"t{r.randrange(400)}" for _ in range(150)]
        for k in range(8):
            own = list(words)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"u{r.randrange(99)}"
            rows.append((g * 10 + k, " ".join(own), "en", "s"))
    rows += odd_rows(20)[20:]
    got = simhash.deduplicate(made(spark, rows)).collect()
    fps = [simhash_value(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            lowest[find(k)] = min(lowest.get(find(k), i), i)
    want = sorted((i if i is not None else -1, format(f, "016x"), lowest.get(find(k), -1)) for k, ((i, *_), f) in enumerate(zip(rows, fps)))
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.fingerprint, x.component_id if x.component_id is not None else -1) for x in got) == want
    assert len({c for *_, c in want}) < len(rows) - 40
    assert simhash.deduplicate(made(spark, [])).count() == 0


def test_covering_masks_meet_every_pair():
    r = random.Random(11)
    own = simhash.children(0)
    assert len(own) == 15 and max(64 - m.bit_count() for m in own) <= 33
    for _ in range(20_000):
        d = sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
        assert any(not m & d for m in own)
    # and below any mask, over the bits that it leaves free
    for m in own:
        for _ in range(500):
            free = simhash.bits(~m & (1 << 64) - 1)
            d = sum(1 << b for b in r.sample(free, 3))
            assert any(not c & d for c in simhash.children(m))


def test_large_buckets_lose_no_link(spark):
    """With a tiny bucket size every bucket of the cluster is covered again."""
    r = random.Random(13)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    root = {simhash.signed(f): simhash.signed(f) for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in simhash.links(df, bucket=32).collect():
        root[find(a)] = find(b)
    truth = {simhash.signed(f): simhash.signed(f) for f in fps}

    def find2(a):
        while truth[a] != a:
            a = truth[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                truth[find2(simhash.signed(a))] = find2(simhash.signed(b))
    ours, theirs = {}, {}
    for f in map(simhash.signed, fps):
        ours.setdefault(find(f), set()).add(f)
        theirs.setdefault(find2(f), set()).add(f)
    assert {frozenset(x) for x in ours.values()} == {frozenset(x) for x in theirs.values()}


def rule_values(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_base(spark):
    rows = odd_rows(40) + [(300, "a b c a b c d", "en", "a"), (301, "x\nx\n\n x\ny\nx" * 30, "en", "a"), (302, "# * $ % & | < >" * 20, "en", None), (303, "é à b c d", "fr", "a")]
    got = quality_rules.judge(made(spark, rows)).collect()
    want = []
    for i, t, *_ in rows:
        v = rule_values(t)
        want.append((i if i is not None else -1, *v, v[0] < 50 or 100 * v[4] > 50 * v[0]))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(made(spark, [])).count() == 0


def test_quality_rules_reject_outliers_only(spark):
    """Concentration steps against numpy over the same rows, and planted outliers."""
    r = random.Random(17)
    words = [f"{a}{b}" for a in ["be", "ka", "lo", "mi"] for b in ["ra", "ne", "so", "vida"]]
    rows = []
    for i in range(900):
        text = " ".join(r.choice(words) + str(r.randrange(10**6)) for _ in range(r.randint(60, 400)))
        if i % 10 == 0:
            text = " ".join(x + r.choice(["###", "&&&", "$$$"]) for x in text.split())
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["a", "b"]) if i > 5 else "tiny"))
    got = {x.doc_id: x for x in quality_rules.judge(made(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(0, 900, 10) if i > 5) and sum(got[i].kept for i in range(900) if i % 10) >= 808
    assert got[1].kept  # of a group too small for an estimate of its own


def test_chi_square():
    assert quality_rules.chi2_cdf(5, 5) == pytest.approx(0.5841198, abs=1e-6)
    assert quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def exact_mcd(x, share):
    """Centre and covariance of the smallest regularised determinant, by exact concentration steps from many random starts."""
    import numpy as np

    rng, floor = np.random.default_rng(1), np.diag(np.square(quality_rules.FLOOR))
    h, best = math.ceil(share * len(x)), None
    for _ in range(60):
        own = x[rng.choice(len(x), quality_rules.DIM + 1, replace=False)]
        before = np.inf
        while True:
            centre, cov = own.mean(axis=0), quality_rules.consistency(share) * np.cov(own.T, bias=True) + floor
            det = np.linalg.slogdet(cov)[1]
            if det > before - 1e-10:
                break
            before = det
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            own = x[np.argsort(d)[:h]]
        if best is None or det < best[0]:
            best = (det, centre, cov)
    return best


def test_minimum_covariance_determinant_by_brute_force(spark):
    """The determinant is the least that many random starts find; centre, covariance and outliers agree with it."""
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {}
    for name, (n, shift) in {"a": (1500, 30), "b": (800, 4)}.items():
        x = rng.normal(size=(n, quality_rules.DIM)) @ rng.normal(size=(quality_rules.DIM,) * 2) + 5
        x[: n // 6] += shift
        groups[name] = x
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in quality_rules.X))
    p = quality_rules.Params()
    fits = {r.g: r for r in quality_rules.estimate(df, p).collect()}
    limit = quality_rules.chi2_quantile(1 - p.alpha, quality_rules.DIM)
    for g, x in groups.items():
        det, centre, cov = exact_mcd(x, p.share)
        assert fits[g].logdet == pytest.approx(det, abs=0.05)
        inverse = np.zeros_like(cov)
        for k, (i, j) in enumerate(quality_rules.PAIRS):
            inverse[i, j] = inverse[j, i] = fits[g].inverse[k]
        assert np.allclose(fits[g].centre, centre, atol=0.15) and np.allclose(np.linalg.inv(inverse), cov, rtol=0.1, atol=0.1 * np.abs(cov).max())
        d = [np.einsum("ij,jk,ik->i", x - c, m, x - c) for c, m in ((np.array(fits[g].centre), inverse), (centre, np.linalg.inv(cov)))]
        clear = (d[1] < 0.9 * limit) | (d[1] > 1.1 * limit)
        assert ((d[0] > limit) == (d[1] > limit))[clear].all() and clear.mean() > 0.9


def test_quality_rules_kept_by_brute_force(spark):
    """kept of whole texts against exact estimates of the same vectors, group by group."""
    import numpy as np

    r = random.Random(23)
    words = [f"{a}{b}" for a in ["be", "ka", "lo", "mi"] for b in ["ra", "ne", "so", "vida"]]
    rows = []
    for i in range(700):
        text = "".join(r.choice(words) + str(r.randrange(10**6)) + r.choice([" ", " ", " ", " ", "\n"]) for _ in range(r.randint(55, 300)))
        if i % 9 == 0:
            text += " ".join(r.choice(["###", "&&&"]) for _ in range(r.randint(20, 200)))
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["a", None])))
    p = quality_rules.Params()
    docs = made(spark, rows)
    x = {v.doc_id: np.array([v[n] for n in quality_rules.X]) for v in quality_rules.vector(quality_rules.measure(docs)).collect()}
    got = {v.doc_id: v for v in quality_rules.judge(docs).collect()}
    limit, clear = quality_rules.chi2_quantile(1 - p.alpha, quality_rules.DIM), 0
    for group in {(lang, source) for _, _, lang, source in rows}:
        own = [i for i, _, lang, source in rows if (lang, source) == group and not got[i].base_failed]
        _, centre, cov = exact_mcd(np.array([x[i] for i in own]), p.share)
        for i in own:
            d = (x[i] - centre) @ np.linalg.inv(cov) @ (x[i] - centre)
            if not 0.7 < d / limit < 1.4:
                clear += 1
                assert got[i].kept == (d <= limit), (i, d, limit)
    assert clear > 650 and not all(v.kept for v in got.values())


def test_compression_quality_learns_from_whole_texts(spark):
    """What marks a class lies only between the starts, middles and ends of long texts."""
    r = random.Random(8)
    fill = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    marks = ("vilest slurry of nonsense ", "measured and careful prose ")
    rows = [(i, fill(5000) + marks[i % 2] * 120 + fill(14000), "en", "s") for i in range(60)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = compress_quality.learn(made(spark, rows), lab, F.lit(True))
    assert marks[1].strip().encode() in model.good and marks[0].strip().encode() in model.bad


def test_compression_quality_held_out(spark):
    r = random.Random(19)
    words = [f"{a}{b}{c}" for a in ["be", "ka", "lo", "mi"] for b in ["ra", "ne", "so", "vi"] for c in ["s", "t", "n"]]
    rows, labels = [], []
    for i in range(500):
        own = [r.choice(words) for _ in range(r.randint(20, 200))]
        good = i % 3 > 0
        text = " ".join(own) if good else " ".join(w.upper() + r.choice(["!!", "$$$", "###"]) for w in own)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame([*labels, (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    extra = [(900, None, None, None), (901, "", "en", "s"), (None, "kaso", "en", "s"), rows[1], (902, "berat " * 30000, "en", "s")]
    got = compress_quality.judge(made(spark, rows + extra), lab).collect()
    truth = {i: q for i, q, _ in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert held and sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got) and len(got) == len(rows) + len(extra)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.predicted for x in compress_quality.judge(made(spark, rows[:3]), none).collect()] == [1, 1, 1]
    assert compress_quality.judge(made(spark, []), lab).count() == 0
