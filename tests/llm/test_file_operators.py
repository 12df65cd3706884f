"""WARC archives, url templates, shared helpers and the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lociframe.llm import common, queries, url_templates, warc

PAGES = "page_id long, url string, html string, digest string, path string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows], PAGES)


def test_warc_round_trip(spark):
    big = "<p>" + "ä" * 100
    rows = [(i, f"https://h{i}/x y\r\n?q={i}", f"<html>{i} " + "lorem ipsum dolor " * (i % 40)) for i in range(300)]
    rows += [(900, "u", big), (901, None, big), (902, "u", big), (None, "u", big), (903, "u", None), (904, "u", ""), (905, "u", "x" * 99), (906, "u", "x" * 99), (900, "u", big), (907, "u", "z" * 300_000), (None, "u", "lone " * 50)]
    got = warc.archive(pages(spark, rows)).collect()
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, p in data:
        f = first.get(p)
        revisit = f is not None and i != f
        want.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(f if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert warc.archive(pages(spark, [])).count() == 0


def test_warc_archives_are_bounded(spark, tmp_path):
    """A task writes several archives; each starts with the dictionary and ends at the limit of bytes or of lines."""
    r = random.Random(1)
    rows = [(i, f"u{i}", bytes(r.randrange(256) for _ in range(r.choice([10, 900, 6000]))).hex()) for i in range(300)] + [(900, "u", r.randbytes(50_000).hex()), (901, None, None)]
    own = pages(spark, rows).coalesce(1)
    html = common.as_bytes(F.col("html"))
    trained = warc.dictionary(own, html)
    warc.write(warc.planned(own, html), str(tmp_path / "a"), trained, most=60_000, lines=64)
    files = [f.read_bytes() for f in (tmp_path / "a").glob("part-*")]
    assert len(files) > 20 and len(trained) > 1000
    for f in files:
        found = [x for x in warc.records(f)]
        assert found and next(warc.frames(f)) == trained and (len(f) <= 60_000 + 64 * 8 or len(found) == 1)
    got = {x.page_id: x.payload_digest for x in warc.read(spark, str(tmp_path / "a")).collect()}
    assert got == {str(i): hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows}


def test_warc_text_ids(spark):
    """Ids may hold line ends and percent signs."""
    rows = [("a\r\nb: c", "u", "x" * 200), ("50%41", "u", "x" * 200), (" é ", "u", ""), (None, "u", "y")]
    got = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {("a\r\nb: c", "revisit", "50%41"), ("50%41", "response", None), (" é ", "response", None), (None, "response", None)}


def archive(payloads, dictionary=True):
    import struct

    import zstandard as z

    d = z.train_dictionary(2000, [b"some words that recur %d" % i * 9 for i in range(300)]).as_bytes() if dictionary else b""
    c = z.ZstdCompressor(write_checksum=True, **({"dict_data": z.ZstdCompressionDict(d)} if d else {}))
    frames = [c.compress(warc.record("response", i, "http://a/", p, hashlib.sha256(p).hexdigest())) for i, p in enumerate(payloads)]
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(d)) + d + warc.SEPARATOR.encode().join([b"", *frames]), d


def test_warc_reader_checks(spark):
    import struct

    import zstandard as z

    data, d = archive([b"one", b"", b"x" * 200_000, bytes(range(256)) * 9])
    assert [r["payload"] for r in warc.records(data)] == [b"one", b"", b"x" * 200_000, bytes(range(256)) * 9]
    plain, _ = archive([b"abc"], dictionary=False)
    assert [r["payload"] for r in warc.records(plain)] == [b"abc"] and list(warc.records(b"")) == []
    packed = z.ZstdCompressor().compress(d)  # the dictionary itself may be compressed
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + data[8 + len(d) :]
    assert len(list(warc.records(again))) == 4
    with pytest.raises(warc.WarcError, match="dictionary"):
        list(warc.records(data[8 + len(d) :]))
    for cut in (1, 5, 300):
        with pytest.raises(warc.WarcError):
            list(warc.records(data[:-cut]))
    broken = bytearray(data)
    broken[-3] ^= 255  # within the checksum of the last frame
    with pytest.raises(warc.WarcError):
        list(warc.records(bytes(broken)))
    good = warc.record("response", 1, "http://a/", b"abc", hashlib.sha256(b"abc").hexdigest())
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good + b"x", good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"Content-Length: 3", b"Content-Length: x"), b"no header"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_warc_error_names_the_archive(spark, tmp_path):
    data, _ = archive([b"one"])
    (tmp_path / "bad.warc.zst").write_bytes(data[:-4])
    with pytest.raises(Exception, match="bad.warc.zst"):
        warc.read(spark, f"file://{tmp_path}").collect()


URLS = ["http://a.com/en/1", "https://X.EXAMPLE.com/en/7#x", "https://example.com/en/70?x", "http://b.net/de/9", "http://q.example.net/de/80", "http://c.org/es/", "http://corg/es/1", "http://com/en/", "http://a.com/en",
        "nothing", None, "", "://", "x://host", "ftp://Ä.com/en/é", "http://a.com?x=/en/", "http://a.com#/en/", "a://b://c.org/es/2", "http://c.org/ES/1", "http://example.com/en/7", "http://example.com/fr/7"]


def expected(url):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]
    fit = [(h + p, v) for v, h, p in queries.URL_RULES.rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "h"), (0, URLS[0], "h")]
    got = url_templates.judge(pages(spark, rows), queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[r.page_id if r.page_id is not None else 0]
        host, path, rule, verdict = expected(url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_templates.judge(pages(spark, []), queries.URL_RULES).count() == 0


def test_url_templates_learn(spark):
    """Numbers become wildcards, alike branches merge, and templates of hosts without labels take after their domains."""
    rules = url_templates.Rules((("block", "bad.com", "/"), ("allow", "good.com", "/")))
    rows = []
    for k in range(30):
        rows += [(f"http://bad.com/casino/{k}", "h"), (f"http://www.bad.com/bets/{k}", "h"), (f"http://good.com/news/{k}", "h")]
        rows += [(f"http://new.org/{b}/{k}", "h") for b in ("casino", "bets", "news", "other")]
        rows += [(f"http://deep.org/other/{'x/' * 80}{k}", "h")]
    got = {(r.host, r.path.split("/")[1]): (r.template, r.verdict) for r in url_templates.judge(pages(spark, [(i, *r) for i, r in enumerate(rows)]), rules).collect() if r.rule is None}
    assert got["new.org", "casino"] == got["new.org", "bets"] == ("/{bets|casino}/*", "block")
    assert got["new.org", "news"] == ("/news/*", "allow") and got["new.org", "other"] == ("/other/*", "allow")
    assert got["deep.org", "other"] == ("/other" + "/x" * 80 + "/*", "allow")


def test_url_branches_that_go_on_differently_stay_apart(spark):
    rules = url_templates.Rules((("block", "bad.com", "/"),))
    rows = [f"http://bad.com/{b}" for b in ("a", "b") for _ in range(200)] + [f"http://bad.com/c/{k}" for k in range(200)]
    rows += [f"http://x.org/{b}" for b in ("a", "b") for _ in range(50)] + [f"http://x.org/c/{k}" for k in range(50)]
    got = {(r.path[1], r.template) for r in url_templates.judge(pages(spark, [(i, u, "h") for i, u in enumerate(rows)]), rules).collect() if r.rule is None}
    assert got == {("a", "/{a|b}"), ("b", "/{a|b}"), ("c", "/c/*")}


def test_url_sql_agrees(spark, tmp_path):
    import duckdb

    r = random.Random(1)
    rows = [(i, r.choice(URLS) if r.random() < 0.3 else f"http://{r.choice(['a', 'b.example', 'c'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.choice(['x', 'y', 'z'])}/{r.randrange(90)}/{r.choice(['p', 'q'])}/t/{r.randrange(3)}", "h") for i in range(800)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((x.page_id, x.host, x.path, x.rule, x.verdict, x.template) for x in queries.op4_url_templates(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(f"select page_id, host, path, rule, verdict, template from ({queries.op4_sql(levels=7)})").fetchall()) == got


def test_bounded_sample_and_most_frequent(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 97).alias("n"))
    some = common.bounded_sample(df, "k", 700)
    ids = {r.k for r in some.collect()}
    assert 500 < len(ids) <= 700 and ids == {r.k for r in common.bounded_sample(df.repartition(7), "k", 700).collect()}
    assert common.bounded_sample(df, "k", 30_000).count() == 20_000
    top = common.most_frequent(df, "n", 1000, "k").collect()
    assert 700 < len(top) <= 1000 and min(r.n for r in top) > 90


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import ALNUM, LOW, simhash_value

    r = random.Random(23)
    words = [f"{a}{b}{c}" for a in ["be", "ka", "lo", "mi"] for b in ["ra", "ne", "so", "vi"] for c in ["s", "t", "n", "da", "gu"]]
    item = " ".join(f"bench{k}" for k in range(20))
    rows, labels, toxic, junk = [], [], set(), set()
    for i in range(500):
        own = [r.choice(words) for _ in range(r.randint(60, 200))]
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(6):
                own.insert(r.randrange(len(own)), "vilest" + r.choice(["ed", "ing", "ly"]))
        elif i % 7 == 0:
            junk.add(i)
            own = [w.upper() + r.choice(["!!", "$$$", "###"]) for w in own]
        elif i % 11 == 0:
            own[5:5] = item.split()
        rows.append([i, " ".join(own), "en", "s", 0])
        labels.append((i, int(i not in junk), int(i in toxic)))
    clean = [x for x in rows if x[0] not in toxic | junk]
    rows += [[1000 + k, x[1], "en", "s", 0] for k, x in enumerate(clean[:40])] + [[2000, None, None, None, None], [2001, "", "en", "s", 0], clean[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = sorted(x.doc_id for x in docs.collect())
    # brute force: the planted labels, all pairs of fingerprints, all windows
    kept = {x[0]: x for x in rows if x[0] not in toxic | junk}
    fps = {i: simhash_value(x[1]) for i, x in kept.items()}
    root = {i: i for i in kept}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))

    def contaminated(text):
        w = ALNUM.findall((text or "").translate(LOW))
        hit = set()
        for k in range(len(w) - 12):
            for j in range(8):
                if w[k : k + 13] == item.split()[j : j + 13]:
                    hit.update(range(k, k + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    want = sorted(i for i in ids if find(i) == i and not contaminated(kept[i][1]))
    assert got == want
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in final) == want and all(x.round_trip and x.n_ids == len(x.ids) for x in final)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_held_out_folds_follow_crc32(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), common.crc_mod(F.col("id"), 7).alias("m")).collect()
    assert all(x.m == zlib.crc32(str(x.doc_id).encode()) % 7 for x in rows)
