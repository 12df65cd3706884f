"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from . import brown_lm, common, compress_quality, decontam, quality_rules, sentencepiece_fst, simhash, toxicity, url_templates, warc, wordpiece

#: fixed by the query's contract
URL_RULES = url_templates.Rules(
    (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
)


def op1_brown_lm(spark, sf_dir):
    return brown_lm.judge(common.table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_token_counts(spark, sf_dir):
    return wordpiece.count_tokens(common.table(spark, sf_dir, "documents"))


def op4_url_templates(spark, sf_dir):
    return url_templates.judge(common.table(spark, sf_dir, "pages"), URL_RULES)


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.encode(common.table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.archive(common.table(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    return decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("rid")


def op8_simhash(spark, sf_dir):
    return simhash.deduplicate(common.table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(common.table(spark, sf_dir, "documents")).drop("distance")


def op10_compression_quality(spark, sf_dir):
    return compress_quality.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def queries():
    own = (
        op1_brown_lm, op2_toxicity, op3_token_counts, op4_url_templates, op5_sentencepiece,
        op6_warc, op7_decontamination, op8_simhash, op9_quality_rules, op10_compression_quality,
    )
    return {f.__name__: f for f in own}


OP6_SQL = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), measured AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM own
), firsts AS (
  SELECT *, min(CASE WHEN payload_bytes >= 100 THEN page_id END) OVER (PARTITION BY payload_digest) AS first FROM measured
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - 12, CAST(len(w) > 0 AS INT)) + 1)) AS t(k)
), sizes AS (
  SELECT DISTINCT size FROM windows
), grams AS (
  SELECT rid, k, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(k)
), bags AS (
  SELECT DISTINCT item, size, array_to_string(list_sort(string_split(phrase, ' ')), ' ') AS bag FROM windows
), near AS (
  SELECT rid, count(DISTINCT item) AS n_near FROM (SELECT DISTINCT rid, size, array_to_string(list_sort(string_split(phrase, ' ')), ' ') AS bag FROM grams) JOIN bags USING (size, bag) GROUP BY rid
), found AS (
  SELECT rid, k, g.size, item FROM grams g JOIN windows USING (size, phrase)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM found, unnest(range(k, k + size)) AS t(p) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)
"""


def op4_sql(rules: url_templates.Rules = URL_RULES, p: url_templates.Params = url_templates.Params(), levels: int = 5) -> str:
    """The whole operator for paths that branch off at most `levels` times."""
    fits = ", ".join(f"({i}, '{verdict}', '{h}', '{path}')" for i, (verdict, h, path) in enumerate(rules.rules))
    factor = f"sqrt(0.5 * ln(2 / {p.alpha}))"

    def fold(branches: str, keys: str) -> str:
        """Rates of branches that have labels in any domain, backed off from wide to narrow."""
        on = " AND ".join(f"x.{k} = s.{k}" for k in ["domain", *keys.split(", ")])
        own = ", ".join(f"x.{k}" for k in keys.split(", "))
        named = f"(SELECT d.k, d.domain, c.* FROM {branches} c JOIN dom d ON c.host = d.host)"
        return f"""(SELECT x.host, {own}, list_reduce(list_prepend({{'b': max(x.prior), 'l': 0.0 :: DOUBLE}}, list({{'b': s.b, 'l': s.l}} ORDER BY x.k)), lambda a, y: {{'b': (y.b + {p.smoothing} * a.b) / (y.l + {p.smoothing}), 'l': y.l}}) AS f
    FROM {named} x JOIN (SELECT domain, {keys}, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(l) AS DOUBLE) AS l FROM {named} GROUP BY ALL HAVING sum(l) > 0) s ON {on} GROUP BY x.host, {own})"""

    def unlike(share: str, count: str) -> str:
        return f"coalesce(abs({share} - lag({share}) OVER w) >= {factor} * (1 / sqrt({count}) + 1 / sqrt(lag({count}) OVER w)), false)"

    steps = []
    for k in range(levels):
        steps.append(f"""
, live{k} AS (SELECT *, segs[1] AS seg, segs[2] AS nxt FROM t{k} WHERE len(segs) > 0)
, child{k} AS (SELECT host, template, seg, sum(n) AS n, sum(blocked) AS b, sum(blocked + allowed) AS l, sum(CASE WHEN nxt IS NULL THEN n ELSE 0 END) AS ends,
    sum(CASE WHEN regexp_matches(nxt, '[0-9]') THEN n ELSE 0 END) AS variable, max(prior) AS prior, max(seen) AS seen0, min(segs) AS low, max(segs) AS high FROM live{k} GROUP BY host, template, seg)
, span{k} AS (SELECT host, template, sum(n) AS node_n, min(low) AS low, max(high) AS high FROM child{k} GROUP BY host, template)
, shared{k} AS (SELECT host, template, node_n, low[2:len([i FOR i IN range(1, least(len(low), len(high)) + 1) IF low[1:i] = high[1:i]])] AS shared FROM span{k})
, node{k} AS (SELECT *, n >= greatest({p.min_pages}, {p.min_share} * sum(n) OVER (PARTITION BY host, template)) AND NOT regexp_matches(seg, '[0-9]') AS lasting FROM child{k})
, stay{k} AS (SELECT * FROM node{k} WHERE lasting)
, rate{k} AS (SELECT c.host, c.template, c.seg, c.n, ends / c.n AS e, variable / c.n AS v, r.f.b AS rate, r.f.l AS seen, r.f IS NULL AS bare
    FROM stay{k} c LEFT JOIN {fold(f"stay{k}", "template, seg")} r ON c.host = r.host AND c.template = r.template AND c.seg = r.seg)
, cut{k} AS (SELECT *, CAST({unlike("rate", "seen")} OR {unlike("e", "n")} OR {unlike("v", "n")} AS INT) AS cut FROM rate{k} WINDOW w AS (PARTITION BY host, template, bare ORDER BY rate, e, v, seg))
, part{k} AS (SELECT *, sum(cut) OVER (PARTITION BY host, template, bare ORDER BY rate, e, v, seg) AS part FROM cut{k})
, one{k} AS (SELECT host, template, bare, part, list(seg ORDER BY seg) AS names, sum(rate * seen) / sum(seen) AS pooled, coalesce(sum(seen), 0) AS seen FROM part{k} GROUP BY ALL)
, merged{k} AS (SELECT host, template, unnest(names) AS seg, CASE WHEN len(names) > 1 THEN '{{' || array_to_string(names, '|') || '}}' ELSE names[1] END AS symbol, pooled, seen FROM one{k})
, t{k + 1} AS (
    SELECT x.host, x.path, x.n, x.blocked, x.allowed, CASE WHEN node_n < {p.min_pages} THEN [] ELSE x.segs[len(shared) + 2:] END AS segs,
           x.template || '/' || coalesce(symbol, '*') || CASE WHEN node_n < {p.min_pages} THEN repeat('/*', len(x.segs) - 1)
             ELSE coalesce(array_to_string(['/' || CASE WHEN regexp_matches(y, '[0-9]') THEN '*' ELSE y END FOR y IN shared], ''), '') END AS template,
           coalesce(pooled, x.prior) AS prior, greatest(x.seen, coalesce(m.seen, 0)) AS seen
    FROM live{k} x JOIN shared{k} h ON x.host = h.host AND x.template = h.template LEFT JOIN merged{k} m ON x.host = m.host AND x.template = m.template AND x.seg = m.seg
    UNION ALL SELECT host, path, n, blocked, allowed, segs, template, prior, seen FROM t{k} WHERE len(segs) = 0)""")
    labels = "string_split(host, '.')"
    tails = ", ".join(f"array_to_string(list_slice({labels}, greatest(1, len({labels}) - {k - 1}), len({labels})), '.')" for k in range(1, p.suffixes + 1))
    return rf"""
WITH rules(i, verdict, h, p) AS (VALUES {fits})
, parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), best AS (
  SELECT rid, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p) * 1000 - i) AS r
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY rid
), own AS (
  SELECT parts.*, r.rule AS rule, r.verdict AS said FROM parts LEFT JOIN best USING (rid)
), paths AS (
  SELECT host, path, count(*) AS n, count(*) FILTER (said = 'block') AS blocked, count(*) FILTER (said = 'allow') AS allowed FROM own GROUP BY host, path
), dom AS (
  SELECT host, domain, min(k) AS k FROM (SELECT host, unnest(l) AS domain, generate_subscripts(l, 1) AS k FROM (SELECT DISTINCT host, ['', {tails}, host] AS l FROM paths)) GROUP BY host, domain
), base AS (SELECT coalesce(sum(blocked) / nullif(sum(blocked + allowed), 0), 0.5) AS r FROM paths)
, t0 AS (
  SELECT paths.*, [s FOR s IN string_split(path, '/') IF s <> ''] AS segs, '' AS template, r AS prior, 0.0 :: DOUBLE AS seen FROM paths, base
){"".join(steps)}
, total AS (SELECT host, template, sum(blocked) AS b, sum(blocked + allowed) AS l, max(prior) AS prior, max(seen) AS seen FROM t{levels} GROUP BY host, template)
, judged AS (
  SELECT c.host, c.template, coalesce(r.f.b, c.prior) AS purity, coalesce(r.f.l, c.seen) AS labels FROM total c LEFT JOIN {fold("total", "template")} r ON c.host = r.host AND c.template = r.template
), found AS (
  SELECT t.host, t.path, t.template, labels >= {p.min_labels} AND purity >= {p.reject} AS bad FROM t{levels} t JOIN judged j ON t.host = j.host AND t.template = j.template
)
SELECT page_id, host, path, rule, CASE WHEN said IS NOT NULL THEN said WHEN bad THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN said IS NULL THEN template END AS template
FROM own JOIN found USING (host, path)
"""


def oracle_sql():
    return {"op4_url_templates": op4_sql(), "op6_warc": OP6_SQL, "op7_decontamination": OP7_SQL}
