"""URL filtering with rules and a path-template tree, in DataFrame operations only.

Hosts have a tree of path segments. Level by level, a node's segments become templates: a segment that holds too small a
share of the node, or has a digit, is variable and becomes `*`. Sibling branches that are statistically alike merge into
one, named `{a|b}`: in order of their block rates, neighbours merge where by Hoeffding's bound neither the rates nor what
follows the branches (shares of pages that end there, and that go on with a variable segment) differ. Branches without
any evidence of labels merge among themselves, by what follows alone.

Pages that a rule decides are the labels. A rate is backed off twice: over the domains that a host belongs to (all hosts,
the last one, two and three labels, the host), so that a branch takes after the branch of the same name on other hosts,
and along the path, so that a template takes after the branch it lies in. Each wider estimate is the prior of the
narrower. A template is rejected when its smoothed share of blocked labels is high and enough labels are behind it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    #: how often a path may branch off; a template goes on with `**` where its pages part even more often
    depth: int = 16
    #: share of its node below which a segment is variable, and the least number of pages of a lasting one
    min_share: float = 0.02
    min_pages: int = 3
    #: confidence of Hoeffding's bound for unlike branches
    alpha: float = 0.05
    #: domains of one to so many labels that a host's branches back off to
    suffixes: int = 3
    #: weight of a wider estimate, in labelled pages
    smoothing: float = 10.0
    min_labels: int = 5
    reject: float = 0.8


@dataclass(frozen=True)
class Rules:
    """(verdict, host, path) of each rule; a rule holds for its host and all subdomains and for paths that begin with its path."""

    rules: tuple[tuple[str, str, str], ...] = field(default=())

    def fitting(self, host: Column, path: Column) -> Column:
        """Struct (rule, verdict) of the longest rule that fits, else null; equally long ones in their order."""
        out = None
        for verdict, h, p in sorted(self.rules, key=lambda r: -len(r[1] + r[2])):
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
            out = F.when(fits, value) if out is None else out.when(fits, value)
        return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where `://` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def domains(host: Column, p: Params) -> Column:
    """What a host belongs to, from wide to narrow: all hosts (empty), its last labels, itself."""
    return F.array_distinct(F.array(F.lit(""), *(F.substring_index(host, ".", -k) for k in range(1, p.suffixes + 1)), host))


def backed_off(branches: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """(host, *keys, rate, seen) of branches (host, *keys, b, l, prior; read twice, one row per host and keys) with labels in any domain.

    rate is the block rate, smoothed from the prior over the domains to the host; seen counts the labelled pages of the
    narrowest domain that has any. A domain's sums are one row per branch name, whatever the number of its hosts.
    """
    place = domains(F.col("host"), p)
    named = branches.select(F.explode(place).alias("domain"), *keys, "b", "l")
    sums = named.groupBy("domain", *keys).agg(F.sum("b").alias("b"), F.sum("l").alias("l"), F.count("*").alias("of")).where("l > 0")
    own = branches.select("host", *keys, "prior", F.posexplode(place).alias("k", "domain"))
    met = C.matched(own, C.stored(sums, "templates-sums"), ["domain", *keys], "of")
    steps = F.sort_array(F.collect_list(F.struct("k", "b", "l")))
    first = F.struct(F.max("prior").alias("rate"), F.lit(0).cast("long").alias("seen"))
    fold = F.aggregate(steps, first, lambda a, x: F.struct(((x["b"] + p.smoothing * a["rate"]) / (x["l"] + p.smoothing)).alias("rate"), x["l"].alias("seen")))
    return met.groupBy("host", *keys).agg(fold.alias("f")).select("host", *keys, "f.rate", "f.seen")


def alike(branches: DataFrame, p: Params) -> DataFrame:
    """(host, template, seg, symbol, prior, seen) of lasting branches (host, template, seg, n, ends, variable, rate, seen, prior)."""
    # lasting branches hold min_share of their node each, so a node has 1 / min_share of them at most
    node = Window.partitionBy("host", "template", F.col("rate").isNull())
    ends, variable = F.col("ends") / F.col("n"), F.col("variable") / F.col("n")
    w = node.orderBy("rate", ends, variable, "seg")
    factor = math.sqrt(0.5 * math.log(2 / p.alpha))
    reach = lambda count: factor * (1 / F.sqrt(count) + 1 / F.sqrt(F.lag(count).over(w)))
    unlike = F.lit(False)
    for share, count in ((F.col("rate"), F.col("seen")), (ends, F.col("n")), (variable, F.col("n"))):
        unlike = unlike | F.coalesce(F.abs(share - F.lag(share).over(w)) >= reach(count), F.lit(False))
    part = branches.withColumn("cut", unlike.cast("int")).withColumn("part", F.sum("cut").over(w))
    one = part.groupBy("host", "template", F.col("rate").isNull().alias("bare"), "part").agg(
        F.sort_array(F.collect_list("seg")).alias("segs"),
        (F.sum(F.col("rate") * F.col("seen")) / F.sum(F.when(F.col("rate").isNotNull(), F.col("seen")))).alias("pooled"),
        F.coalesce(F.sum(F.when(F.col("rate").isNotNull(), F.col("seen"))), F.lit(0)).alias("seen"),
    )
    symbol = F.when(F.size("segs") > 1, F.concat(F.lit("{"), F.array_join("segs", "|"), F.lit("}"))).otherwise(F.col("segs")[0])
    return one.select("host", "template", F.explode("segs").alias("seg"), symbol.alias("symbol"), "pooled", "seen")


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays of strings have in common from their start."""
    first = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    fold = lambda s, x: F.struct(F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & x).alias("on"))
    return F.aggregate(same, first, fold, lambda s: s["n"])


def _grown(now: DataFrame, p: Params) -> DataFrame:
    """The paths with segments left (segs) with their templates one branch longer, and the others as they are.

    Where all paths of a node go on alike, they go on to where they part in one step.
    """
    live = now.where(F.size("segs") > 0).withColumn("seg", F.col("segs")[0])
    after = F.get("segs", F.lit(1))
    # sums by branch, then by node, so no node's rows need to meet
    child = live.groupBy("host", "template", "seg").agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"), F.count("*").alias("rows"),
        F.sum(F.when(after.isNull(), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(after.rlike("[0-9]"), F.col("n")).otherwise(0)).alias("variable"),
        F.max("prior").alias("prior"), F.max("seen").alias("before"), F.min("segs").alias("low"), F.max("segs").alias("high"),
    )
    child = C.stored(child, "templates-child")
    node = child.groupBy("host", "template").agg(F.sum("n").alias("node_n"), F.count("*").alias("of"), F.min("low").alias("low"), F.max("high").alias("high"))
    # the segments that all paths of the node share, after the first
    shared = F.slice("low", F.lit(2), F.greatest(F.lit(0), common_prefix(F.col("low"), F.col("high")) - 1))
    node = C.stored(node.select("host", "template", "node_n", "of", shared.alias("shared")), "templates-node")
    lasting = (F.col("n") >= F.greatest(F.lit(p.min_pages), p.min_share * F.col("node_n"))) & ~F.col("seg").rlike("[0-9]")
    child = C.stored(C.matched(child.drop("low", "high"), node, ["host", "template"], "of").withColumn("lasting", lasting), "templates-marked")
    stay = child.where("lasting")
    rates = backed_off(stay, ["template", "seg"], p)
    merged = alike(stay.select("host", "template", "seg", "n", "ends", "variable").join(rates, ["host", "template", "seg"], "left"), p)
    chosen = child.join(merged, ["host", "template", "seg"], "left").select(
        "host", "template", "seg", "rows", "node_n", "shared", F.coalesce("symbol", F.lit("*")).alias("symbol"),
        F.coalesce("pooled", "prior").alias("new_prior"), F.greatest("before", F.coalesce("seen", F.lit(0))).alias("new_seen"),
    )
    grown = C.matched(live, C.stored(chosen, "templates-chosen"), ["host", "template", "seg"], "rows")
    # nothing lasts below a node with fewer pages: the rest of its paths is variable
    lone = F.col("node_n") < p.min_pages
    rest = F.when(lone, F.repeat(F.lit("/*"), F.size("segs") - 1)).otherwise(F.array_join(F.transform("shared", lambda x: F.concat(F.lit("/"), F.when(x.rlike("[0-9]"), "*").otherwise(x))), ""))
    grown = grown.select(
        "host", "path", "n", "blocked", "allowed", F.when(lone, F.slice("segs", 1, 0)).otherwise(F.slice("segs", F.size("shared") + 2, F.size("segs"))).alias("segs"),
        F.concat("template", F.lit("/"), "symbol", rest).alias("template"), F.col("new_prior").alias("prior"), F.col("new_seen").alias("seen"),
    )
    return grown.unionByName(now.where(F.size("segs") == 0))


def templates(paths: DataFrame, p: Params = Params()) -> DataFrame:
    """(host, path, template, purity, labels) of paths (host, path, n, blocked, allowed; one row per host and path).

    purity is the smoothed share of blocked labels of the whole template, labels how many are behind it (0: none).
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    # one row: the block rate of all labelled pages
    rate = paths.agg((F.sum("blocked") / F.sum(F.col("blocked") + F.col("allowed"))).alias("r")).select(F.coalesce("r", F.lit(0.5)).alias("prior"))
    now = paths.crossJoin(F.broadcast(rate)).withColumns({"segs": segments, "template": F.lit(""), "seen": F.lit(0).cast("long")})
    now = C.stored(now.select("host", "path", "n", "blocked", "allowed", "segs", "template", "prior", "seen"), "templates")
    for _ in range(p.depth):
        if now.where(F.size("segs") > 0).isEmpty():
            break
        with C.temporary() as keep:
            new = keep(C.stored(_grown(now, p), "templates"))
        C.dropped(now)
        now = new
    now = now.withColumn("template", F.when(F.size("segs") > 0, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    total = now.groupBy("host", "template").agg(
        F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"), F.max("prior").alias("prior"), F.max("seen").alias("before"), F.count("*").alias("of")
    )
    total = C.stored(total, "templates-total")
    judged = total.join(backed_off(total, ["template"], p), ["host", "template"], "left")
    judged = judged.select("host", "template", "of", F.coalesce("rate", "prior").alias("purity"), F.coalesce("seen", "before").alias("labels"))
    return C.matched(now.select("host", "path", "template"), C.stored(judged, "templates-judged"), ["host", "template"], "of")


def judge(pages: DataFrame, rules: Rules, p: Params = Params()) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template (null where a rule decides).

    Urls that are null or have no `://` have empty host and path, form one template and are allowed unless a rule fits.
    Repeated rows count each time and get the same verdict; an empty table gives an empty result. Without labelled pages
    all pages are allowed. Branches that tie in rate and what follows are taken in order of their names.
    """
    host, path = split(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = own.withColumn("own", rules.fitting(F.col("host"), F.col("path"))).select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("said"))
    blocked, allowed = (F.sum((F.col("said") == v).cast("long")) for v in ("block", "allow"))
    paths = own.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(blocked, F.lit(0)).alias("blocked"), F.coalesce(allowed, F.lit(0)).alias("allowed"))
    paths = C.stored(paths, "paths")
    bad = (F.col("labels") >= p.min_labels) & (F.col("purity") >= p.reject)
    found = templates(paths, p).select("host", "path", "template", F.when(bad, "block").otherwise("allow").alias("learned"))
    found = C.stored(found.join(paths.select("host", "path", F.col("n").alias("of")), ["host", "path"]), "templates-found")
    undecided = C.matched(own.where("said is null").select("page_id", "host", "path"), found, ["host", "path"], "of")
    none = F.lit(None).cast("string")
    return undecided.select("page_id", "host", "path", none.alias("rule"), F.col("learned").alias("verdict"), "template").unionByName(
        own.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), none.alias("template"))
    )
