"""Novel variants from fragments' alignments, and the relational forms of call texts and qualities."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from . import align, common, mapping
from . import components as stars

COLUMNS = "frag long, mate int, seq_idx long, pos int, base string, read_pos int, op int, match int, similarity double, weight double"


def aligned_columns(fragments: DataFrame, alleles: DataFrame, abundance: dict[int, float], hit_length: int, k: int = 11, similarity: float = 0.8) -> DataFrame:
    """Alignment columns of fragments' retained placements: one row per fragment, mate, allele and column.

    fragments: frag, seq1, seq2 (null for single reads). weight is the allele's share of the abundance of the fragment's
    alleles; read_pos counts on the strand that was aligned.
    """
    common.ship(fragments.sparkSession)
    shared = common.shared_panel(alleles)  # abundance has a number for each of its sequences

    def run(batches):
        import pyarrow as pa

        (ids, seqs), share = shared.value, abundance
        index = align.index_of(seqs, k)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for r in mapping.candidates(index, batch, hit_length).to_pylist():
                a, b = r["seq1"] or "", r["seq2"]
                found = align.fragments(align.assign(index, a, hit_length, similarity)[0], None if b is None else align.assign(index, b, hit_length, similarity)[0], seqs, hit_length)
                total = sum(share.get(ids[f.seq_idx], 0.0) for f in found)
                for f in found:
                    w = share.get(ids[f.seq_idx], 0.0) / total if total else 0.0
                    for mate, o in ((1 if not f.from_second else 2, f.first), (2, f.second)):
                        if o is None:
                            continue
                        read = a if mate == 1 else b
                        seq = read if o.strand == 1 else align.revcomp(read)
                        for op, at, on in align.columns(seqs[o.seq_idx], seq, o):
                            if at < len(seqs[o.seq_idx]) and on < len(seq):
                                out.append((r["frag"], mate, ids[o.seq_idx], at, seq[on], on, op, o.match, o.similarity, w))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    return fragments.select("frag", "seq1", "seq2").mapInArrow(run, COLUMNS)


def good_columns(cols: DataFrame, slack: int = 4) -> DataFrame:
    """Columns whose placement matches nearly as well as the best one that covers the position."""
    both = cols.where(F.col("op").isin(align.EQ, align.SUB) & (F.col("base") != "N"))
    best = both.groupBy("seq_idx", "pos").agg(F.max("match").alias("best"))
    return cols.join(best, ["seq_idx", "pos"]).where(F.col("match") >= F.col("best") - slack).drop("best")


def weighted_pileup(cols: DataFrame) -> DataFrame:
    """(seq_idx, pos, base, depth, unique, reads) of good columns: summed weight, that of sole placements, number of columns."""
    own = good_columns(cols).where(F.col("op").isin(align.EQ, align.SUB) & F.col("base").isin(*"ACGT"))
    return own.groupBy("seq_idx", "pos", "base").agg(F.sum("weight").alias("depth"), F.sum(F.when(F.col("weight") == 1, F.col("weight")).otherwise(0.0)).alias("unique"), F.count("*").alias("reads"))


def candidate_sites(depth: DataFrame, ref: DataFrame, least: float = 5, factor: float = 0.5) -> DataFrame:
    """(seq_idx, pos, ref, alt, alt_depth, ref_depth): other bases with a depth of 5 and half the reference's (ref: seq_idx, pos, ref)."""
    at = depth.join(ref.where(F.col("ref").isin(*"ACGT")), ["seq_idx", "pos"])
    own = at.groupBy("seq_idx", "pos").agg(F.coalesce(F.sum(F.when(F.col("base") == F.col("ref"), F.col("depth"))), F.lit(0)).alias("ref_depth"))
    alt = at.where("base <> ref").join(own, ["seq_idx", "pos"]).where((F.col("depth") >= least) & (F.col("depth") >= factor * F.col("ref_depth")))
    return alt.select("seq_idx", "pos", "ref", F.col("base").alias("alt"), F.col("depth").alias("alt_depth"), "ref_depth")


def expand_sites(sites: DataFrame, cols: DataFrame) -> DataFrame:
    """Sites (seq_idx, pos) and all places that fragments align to them on other alleles, until none is new."""
    places = common.stored(good_columns(cols).where(F.col("op").isin(align.EQ, align.SUB)).select("frag", "mate", "read_pos", "seq_idx", "pos").distinct(), "places")
    now = common.stored(sites.select("seq_idx", "pos").distinct(), "sites")
    n = now.count()
    while True:
        touched = places.join(now, ["seq_idx", "pos"]).select("frag", "mate", "read_pos").distinct()
        new = places.join(touched, ["frag", "mate", "read_pos"], "left_semi").select("seq_idx", "pos").unionByName(now).distinct()
        new = common.stored(new, "sites")
        common.dropped(now)
        now, before, n = new, n, new.count()
        if n == before:
            return now


def site_groups(sites: DataFrame, roots: DataFrame, cols: DataFrame, share: float = 0.15) -> DataFrame:
    """(seq_idx, pos, grp): components of sites that fragments cover together, often enough for either; groups without a root are left out."""
    own = good_columns(cols).join(sites, ["seq_idx", "pos"], "left_semi")
    node = F.concat_ws(":", "seq_idx", "pos")
    depth = own.where(F.col("op").isin(align.EQ, align.SUB)).groupBy(node.alias("n")).agg(F.count("*").alias("reads"))
    at = own.select("frag", "mate", "read_pos", node.alias("n")).distinct()
    pair = at.alias("x").join(at.alias("y"), ["frag", "mate", "read_pos"]).where("x.n < y.n").groupBy(F.col("x.n").alias("a"), F.col("y.n").alias("b")).agg(F.count("*").alias("w"))
    d = lambda c: depth.select(F.col("n").alias(c), F.col("reads").alias(f"{c}_reads"))
    edges = pair.join(d("a"), "a").join(d("b"), "b").where((F.col("w") >= share * F.col("a_reads")) | (F.col("w") >= share * F.col("b_reads")))
    found = components(edges.select("a", "b"))
    all_sites = sites.withColumn("node", node).join(found, "node", "left").select("seq_idx", "pos", F.coalesce("root", "node").alias("grp"))
    rooted = all_sites.join(roots.select("seq_idx", "pos").distinct(), ["seq_idx", "pos"], "left_semi").select("grp").distinct()
    return all_sites.join(rooted, "grp", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph's edges (a, b)."""
    return stars.components(edges)


SOLVED = "grp string, seq_idx long, pos int, ref string, alt string, qual int, output_group int"


def solve_groups(members: DataFrame, most: int = 8) -> DataFrame:
    """Best base for every site of each group.

    members: grp, seq_idx, pos, ref, exon, copies (alleles of the gene), unique (map base -> unique depth), frags (array
    of struct frag, base). Groups above `most` sites, with two sites on an allele or without an exonic site are passed
    over. Of all choices of bases that with most fragments wins, then that with fewest changes; a second one as good
    makes both uncertain (qual 0, output groups 0 and 1).
    """
    own = members.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("seq_idx").alias("k"), F.bool_or("exon").alias("any_exon"))
    fit = own.where((F.col("n") <= most) & (F.col("n") == F.col("k")) & F.col("any_exon")).select("grp")
    return members.join(fit, "grp", "left_semi").groupBy("grp").applyInPandas(_solve, SOLVED)


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["seq_idx", "pos"]).reset_index(drop=True)
    n = len(pdf)
    frags = sorted({f["frag"] for row in pdf["frags"] for f in row})
    place = {f: i for i, f in enumerate(frags)}
    # which fragments a base at a site explains
    hit = np.zeros((n, 4, len(frags)), bool)
    for i, row in enumerate(pdf["frags"]):
        for f in row:
            if f["base"] in "ACGT":
                hit[i, "ACGT".index(f["base"]), place[f["frag"]]] = True
    ref = ["ACGT".index(r) if r in "ACGT" else -1 for r in pdf["ref"]]
    if n == 1 and pdf["copies"][0] == 1:
        # a lone site of a gene with one allele: changes explain the reference's fragments too, and their own only if well supported
        own = hit[0].copy()
        for b in range(4):
            if b != ref[0]:
                alt, base = int(own[b].sum()), int(own[ref[0]].sum()) if ref[0] >= 0 else 0
                unique = dict(pdf["unique"][0] or {}).get("ACGT"[b], 0.0) if pdf["unique"][0] is not None else 0.0
                sure = ((alt >= 2 and unique > 0) or alt >= 10) and alt > 0.15 * base
                hit[0, b] = (own[ref[0]] if ref[0] >= 0 else False) | (own[b] if sure else False)
    best, second = None, None
    for choice in itertools.product(range(4), repeat=n):
        cover = int(np.logical_or.reduce([hit[i, b] for i, b in enumerate(choice)]).sum())
        key = (cover, -sum(b != r for b, r in zip(choice, ref, strict=True)))
        if best is None or key > best[0]:
            best, second = (key, choice), None
        elif key == best[0]:
            second = choice
    out = []
    for group, choice in enumerate([best[1]] if second is None else [best[1], second]):
        for i, b in enumerate(choice):
            if pdf["exon"][i] and b != ref[i]:
                out.append((pdf["grp"][0], pdf["seq_idx"][i], pdf["pos"][i], pdf["ref"][i], "ACGT"[b], 60 if second is None else 0, group))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SOLVED.split(", ")])


def demo_groups(events: DataFrame) -> DataFrame:
    """Groups of up to three sites made of events."""
    base = F.element_at(F.array(*map(F.lit, "ACGT")), ((F.col("event_id") + F.floor("value")) % 4 + 1).cast("int"))
    own = events.select((F.col("user_id") % 60).alias("g"), (F.col("event_id") % 3).alias("seq_idx"), F.floor(F.col("event_id") / 5).alias("frag"), base.alias("base"))
    sites = own.groupBy("g", "seq_idx").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("frag", "base")))).alias("frags"))
    return sites.select(
        F.concat(F.lit("g"), F.col("g").cast("string")).alias("grp"), F.col("seq_idx").cast("long").alias("seq_idx"), F.lit(7).alias("pos"), F.lit("A").alias("ref"), (F.col("seq_idx") != 1).alias("exon"),
        F.lit(2).alias("copies"), F.expr("map('C', 1.0D)").alias("unique"), "frags",
    )


def call_variants(fragments: DataFrame, alleles: DataFrame, abundance: dict[int, float], hit_length: int, most: int = 8, k: int = 11, similarity: float = 0.8) -> DataFrame:
    """Novel variants: name, exon_pos (1-based), ref, alt, filter, var_support, all_support, unique_support, pos, output_group.

    alleles: seq_idx, name, gene, seq, exons. Sites come from the weighted pileup, spread to all alleles of the
    fragments that cover them, and are solved group by group.
    """
    from ..functions import sequence as S

    cols = common.stored(aligned_columns(fragments, alleles, abundance, hit_length, k, similarity), "columns")
    depth = common.stored(weighted_pileup(cols), "pileup")
    ref = alleles.select("seq_idx", "name", "exons", "seq").withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)))
    ref = ref.select("seq_idx", "name", "pos", "exons", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(1)).alias("ref"))
    roots = common.stored(candidate_sites(depth, ref.select("seq_idx", "pos", "ref")).select("seq_idx", "pos").distinct(), "roots")
    sites = expand_sites(roots, cols)
    groups = common.stored(site_groups(sites, roots, cols), "groups")
    copies = alleles.groupBy("gene").agg(F.count("*").alias("copies")).join(alleles.select("gene", "seq_idx"), "gene").select("seq_idx", F.col("copies").cast("int").alias("copies"))
    frags = cols.join(groups, ["seq_idx", "pos"], "left_semi").groupBy("seq_idx", "pos").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("frag", "base")))).alias("frags"))
    unique = depth.groupBy("seq_idx", "pos").agg(F.map_from_entries(F.collect_list(F.struct("base", "unique"))).alias("unique"), F.sum("depth").alias("all_support"))
    members = groups.join(ref, ["seq_idx", "pos"]).join(copies, "seq_idx").join(frags, ["seq_idx", "pos"]).join(unique, ["seq_idx", "pos"], "left")
    members = members.withColumn("exon", S.in_exon(F.col("pos"), F.col("exons")))
    solved = solve_groups(members.select("grp", "seq_idx", "pos", "ref", "exon", "copies", "unique", "frags"), most)
    own = solved.join(ref.select("seq_idx", "pos", "name", "exons"), ["seq_idx", "pos"])
    alt = depth.select("seq_idx", "pos", F.col("base").alias("alt"), F.col("depth").alias("var_support"), F.col("unique").alias("unique_support"))
    own = own.join(alt, ["seq_idx", "pos", "alt"], "left").join(unique.select("seq_idx", "pos", "all_support"), ["seq_idx", "pos"], "left")
    return own.select(
        "name", (S.exonic_position(F.col("pos"), F.col("exons")) + 1).alias("exon_pos"), "ref", "alt", F.when(F.col("qual") > 0, "PASS").otherwise("FAIL").alias("filter"),
        F.coalesce("var_support", F.lit(0.0)).alias("var_support"), F.coalesce("all_support", F.lit(0.0)).alias("all_support"), F.coalesce("unique_support", F.lit(0.0)).alias("unique_support"), "pos", "output_group",
    )


def variant_lines(found: DataFrame) -> DataFrame:
    """One line of text per variant."""
    return found.select(F.format_string("%s %d . %s %s . %s %.6f %.6f %.6f %d %d", "name", "exon_pos", "ref", "alt", "filter", "var_support", "all_support", "unique_support", "pos", "output_group").alias("value"))


# relational forms of what calls print


def rank_quality(ranks: DataFrame, cross_allele: float = 0.01, cross_gene: float = 0.04, least: float = 1.0) -> DataFrame:
    """Adds quality (0 to 60) to ranks (sample, gene, rank, abundance): -log10 of the chance under noise from other ranks and genes."""
    gene = ranks.groupBy("sample", "gene").agg(F.sum("abundance").alias("g"))
    whole = gene.groupBy("sample").agg(F.sum("g").alias("t"))
    own = ranks.join(gene, ["sample", "gene"]).join(whole, "sample")
    noise = (F.col("g") - F.col("abundance")) * cross_allele + cross_gene * (F.col("t") - F.col("g"))
    tail = maths.normal_tail(2 * (F.sqrt("abundance") - F.sqrt(noise)))
    score = F.least(F.lit(60.0), F.greatest(F.lit(0.0), -F.log10(F.col("tail")))).cast("int")
    own = own.withColumn("tail", tail)
    return own.withColumn("quality", F.when(F.col("abundance") < least, 0).when(F.col("tail") <= 0, 60).otherwise(score)).drop("g", "t", "tail")


def slot_text(calls: DataFrame) -> DataFrame:
    """(sample, gene, num_alleles, allele1, allele2): slots as names, abundance and quality; `.`, 0 and -1 where empty."""
    text = F.format_string("%s\t%.6f\t%d", F.concat_ws(",", "alleles"), "abundance", "quality")
    empty = F.lit(".\t0\t-1")
    slot = lambda k: F.coalesce(F.max(F.when(F.col("slot") == k, text)), empty)
    return calls.groupBy("sample", "gene").agg(F.count("*").alias("num_alleles"), slot(1).alias("allele1"), slot(2).alias("allele2"))


def pair_coverage(hits: DataFrame) -> DataFrame:
    """(gene, j, k, covered) for each pair of a gene's alleles: summed weight of the reads that either explains.

    Covered by either is what j covers and what k covers, less what both do, so pairs of reads are never formed.
    """
    per = hits.groupBy("gene", "allele").agg(F.sum("weight").alias("w"))
    a, b = per.select("gene", F.col("allele").alias("j"), F.col("w").alias("wj")), per.select("gene", F.col("allele").alias("k"), F.col("w").alias("wk"))
    x = hits.select("read_id", "gene", F.col("allele").alias("j"), F.col("weight").alias("x"))
    y = hits.select("read_id", "gene", F.col("allele").alias("k"), F.col("weight").alias("y"))
    shared = x.join(y, ["read_id", "gene"]).where("j < k").groupBy("gene", "j", "k").agg(F.sum(F.least("x", "y")).alias("both"))
    return a.join(b, "gene").where("j < k").join(shared, ["gene", "j", "k"], "left").select("gene", "j", "k", (F.col("wj") + F.col("wk") - F.coalesce("both", F.lit(0.0))).alias("covered"))


def representative_rows(chosen: DataFrame) -> DataFrame:
    """The most abundant allele per sample, gene and rank (0 and 1) with a quality of 1 or more."""
    w = Window.partitionBy("sample", "gene", "rank").orderBy(F.desc("ec_abundance"), "seq_idx")
    return chosen.where("rank <= 1 AND quality >= 1").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def sample_name(path: Column) -> Column:
    """A file's name without its last extension and without `_genotype`."""
    return F.replace(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_genotype"), F.lit(""))
