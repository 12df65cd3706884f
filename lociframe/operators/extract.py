"""Selecting candidate reads from plain reads and from aligned records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import sequence as S
from . import align, assign, common


def library_stats(records: DataFrame, first: int = 100_000) -> DataFrame:
    """(read_len, frag_len, frag_sd, paired) of the first primary records, in integers.

    frag_len and frag_sd are mean and spread of the smaller seven tenths of mate distances, if at least half the records
    have a mapped mate; otherwise 0. A spread of 0 becomes 1. The sample is bounded by `first`.
    """
    own = records.where(S.is_primary(F.col("flags"))).orderBy("rec").limit(first)
    pairs = own.where(S.is_paired(F.col("flags")) & (F.col("flags").bitwiseAND(0xC) == 0) & (F.col("distance") > 0)).select("distance", "rec")
    sizes = pairs.agg(F.sort_array(F.collect_list(F.struct("distance", "rec"))).alias("d"), F.count("*").alias("n"))
    kept = sizes.select("n", F.transform(F.slice("d", F.lit(1), F.ceil(F.col("n") * 0.7).cast("int")), lambda x: x["distance"]).alias("d"))
    mean = F.floor(F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("d"))
    spread = F.floor(F.sqrt(F.floor(F.aggregate(F.transform("d", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0).cast("long"), lambda a, x: a + x) / F.size("d"))))
    base = own.agg(F.max(F.length("seq")).alias("read_len"), F.count("*").alias("all"), F.sum(S.is_paired(F.col("flags")).cast("int")).alias("mates"))
    return base.crossJoin(kept.withColumn("mean", mean)).select(
        "read_len", F.when(F.col("n") > 0, F.col("mean") + F.col("read_len")).otherwise(0).alias("frag_len"), F.when(F.col("n") > 0, F.greatest(F.lit(1), spread)).otherwise(0).alias("frag_sd"),
        (F.col("mates") * 2 >= F.col("all")).alias("paired"),
    )


def read_length_sample(records: DataFrame, first: int = 1000) -> DataFrame:
    """(bases, reads): summed length of first mates among the first primary records."""
    own = records.where(S.is_primary(F.col("flags"))).orderBy("rec").limit(first)
    return own.where(S.is_first_mate(F.col("flags"))).agg(F.sum(F.length("seq")).alias("bases"), F.count("*").alias("reads"))


def resolve_chromosomes(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, chrom): names as the header has them: alike, without a three-letter prefix, or with `chr`; an unknown one is an error."""
    k = known.select(F.col("chrom").alias("c"))
    forms = F.array(F.col("name"), F.substring("name", 4, 1_000_000), F.concat(F.lit("chr"), "name"))
    tried = names.select("name", F.posexplode(forms).alias("i", "form")).join(common.small(k), F.col("form") == F.col("c"), "left")
    best = tried.groupBy("name").agg(F.min_by("c", F.when(F.col("c").isNotNull(), F.col("i"))).alias("chrom"))
    return best.select("name", F.when(F.col("chrom").isNotNull(), F.col("chrom")).otherwise(F.raise_error(F.concat(F.lit("no such chromosome: "), "name"))).alias("chrom"))


def missing_references(sequences: DataFrame, index: DataFrame) -> DataFrame:
    """Header sequences (name) that the reference's index lacks; must be empty before a CRAM is read."""
    return sequences.join(index, "name", "left_anti")


def candidates(reads: DataFrame, alleles: DataFrame, similarity: float = 0.8, k: int | None = None, hit_length: int | None = None, head: int = 1000) -> DataFrame:
    """Rows of reads (read_id, seq1, seq2) of which a mate is not of low complexity and hits an allele.

    The hit length comes from the mean length of the first `head` reads, k from the panel's length (at least 9), unless given.
    """
    common.ship(reads.sparkSession)
    paired = "seq2" in reads.columns
    if hit_length is None:
        mean = reads.orderBy("read_id").limit(head).agg(F.avg(F.length("seq1"))).first()[0] or 0
        hit_length = maths.hit_length(mean, paired)
    panel = common.shared_panel(alleles)
    if k is None:
        k = max(9, maths.infer_kmer_length(sum(map(len, panel.value[1]))))
    hit_length = max(hit_length, k)
    found = hits_panel(panel, k, hit_length, similarity)
    return reads.where(either_mate(found, paired))


def either_mate(found, paired: bool) -> Column:
    """Either mate passes; the cheap test stands before the kernel's."""
    one = (~S.low_complexity(F.col("seq1"))) & found(F.col("seq1"))
    if not paired:
        return one
    return one | (F.col("seq2").isNotNull() & (~S.low_complexity(F.col("seq2"))) & found(F.col("seq2")))


def hits_panel(shared, k: int, hit_length: int, similarity: float):
    """A column function: whether a read hits any allele of a shared panel."""

    @F.pandas_udf("boolean")
    def found(seqs):
        import pandas as pd

        index = align.index_of(shared.value[1], k)
        memo: dict[str, bool] = {}
        return pd.Series([memo[s] if s in memo else memo.setdefault(s, align.is_candidate(index, s, hit_length, similarity)) if s else False for s in seqs], dtype="bool")

    return found


def name_groups(records: DataFrame) -> DataFrame:
    """(qname, n, first_rec, lone) of primary records; more than two of a name are an error."""
    own = records.where(S.is_primary(F.col("flags"))).groupBy("qname").agg(F.count("*").alias("n"), F.min("rec").alias("first_rec"))
    n = F.when(F.col("n") <= 2, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("more than two primary records: "), "qname")).cast("long"))
    return own.select("qname", n.alias("n"), "first_rec", (F.col("n") == 1).alias("lone"))


def mates_of(records: DataFrame, names: DataFrame, need_aligned: bool = True) -> DataFrame:
    """(qname, first_rec, second_rec) of names of which both mates are primary (and on an aligned template)."""
    own = records.where(S.is_primary(F.col("flags")))
    if need_aligned:
        own = own.where(S.template_aligned(F.col("flags"), F.col("tid")))
    own = own.withColumn("qname", S.without_mate(F.col("qname"))).join(names.select(S.without_mate(F.col("qname")).alias("qname")).distinct(), "qname", "left_semi")
    first = S.is_first_mate(F.col("flags"))
    both = own.groupBy("qname").agg(F.min(F.when(first, F.col("rec"))).alias("first_rec"), F.min(F.when(~first, F.col("rec"))).alias("second_rec"))
    return both.where("first_rec is not null and second_rec is not null")


def single_ends(records: DataFrame) -> DataFrame:
    """One record per name: aligned ones first, then by place."""
    unaligned = (~S.is_aligned(F.col("flags"))).cast("int")
    own = records.where(S.is_primary(F.col("flags")))
    return own.groupBy("qname").agg(F.min(F.struct(unaligned.alias("u"), "tid", "pos", "rec")).alias("m")).select("qname", F.col("m.rec").alias("rec"))


def on_target(records: DataFrame, genes: DataFrame) -> DataFrame:
    """Records (tid as chrom, segments) of which any segment touches a gene interval, and that are not of low complexity."""
    spans = records.where(S.is_aligned(F.col("flags"))).select(F.col("rec").alias("r"), F.col("tid").alias("chrom"), F.explode(S.cigar_segments(F.col("pos"), F.col("cigar"))).alias("s"))
    spans = spans.select(F.col("r").alias("rec"), "chrom", F.col("s.a").alias("start"), (F.col("s.b") + 1).alias("end"))
    return records.join(assign.overlapping(spans, genes).select("rec").distinct(), "rec", "left_semi").where(~S.low_complexity(F.col("seq")))


def from_alignments(records: DataFrame, genes: DataFrame, alleles: DataFrame, similarity: float = 0.8, hit_length: int = 21, k: int = 9, abnormal: bool = False, alt: Column | None = None) -> DataFrame:
    """Fragments (qname, seq1, qual1, seq2, qual2) of aligned records that touch a gene, or whose unaligned or alternative-contig reads hit an allele.

    records: rec, qname, flags, tid, pos, cigar, seq, qual (as sequenced). Sort order does not matter. `abnormal` also
    lets mates of templates that are not aligned through, `alt` tells records on alternative contigs.
    """
    common.ship(records.sparkSession)
    found = hits_panel(common.shared_panel(alleles), k, max(hit_length, k), similarity)
    prim = records.where(S.is_primary(F.col("flags")))
    near = on_target(prim, genes).select("qname")
    loose = ~S.is_aligned(F.col("flags")) if alt is None else (~S.is_aligned(F.col("flags")) | alt)
    hit = prim.where(loose & ~S.low_complexity(F.col("seq"))).where(found(F.col("seq"))).select("qname")
    both_bad = prim.where(F.col("flags").bitwiseAND(0xD) == 0xD)
    pair = both_bad.groupBy("qname").agg(F.bool_and(~S.low_complexity(F.col("seq"))).alias("fine"), F.count("*").alias("n")).where("fine AND n = 2").select("qname")
    unaligned = pair.join(hit, "qname", "left_semi")
    aligned_hit = hit.join(both_bad.select("qname"), "qname", "left_anti")
    names = mates_of(prim, near.unionByName(aligned_hit), need_aligned=not abnormal).select("qname")
    return with_mates(prim, names.unionByName(unaligned).distinct())


def with_mates(records: DataFrame, names: DataFrame) -> DataFrame:
    """(qname, seq1, qual1, seq2, qual2) of these names, reads as they were sequenced."""
    own = records.withColumn("qname", S.without_mate(F.col("qname"))).join(names, "qname", "left_semi")
    first = S.is_first_mate(F.col("flags"))
    pick = lambda c, mine: F.min_by(F.when(mine, F.col(c)), F.when(mine, F.col("rec")))
    return own.groupBy("qname").agg(pick("seq", first).alias("seq1"), pick("qual", first).alias("qual1"), pick("seq", ~first).alias("seq2"), pick("qual", ~first).alias("qual2"))


def without_alignments(records: DataFrame, alleles: DataFrame, similarity: float = 0.8, hit_length: int = 21, k: int = 9) -> DataFrame:
    """Fragments of which a primary read hits an allele, whatever the alignment; lone reads of pairs are left out, lone single ones stay."""
    common.ship(records.sparkSession)
    found = hits_panel(common.shared_panel(alleles), k, max(hit_length, k), similarity)
    prim = records.where(S.is_primary(F.col("flags")))
    names = prim.where(~S.low_complexity(F.col("seq"))).where(found(F.col("seq"))).select(S.without_mate(F.col("qname")).alias("qname")).distinct()
    out = with_mates(prim, names)
    single = prim.where(~S.is_paired(F.col("flags"))).select(S.without_mate(F.col("qname")).alias("qname")).distinct()
    return out.where("seq1 is not null and seq2 is not null").unionByName(out.where("seq1 is null or seq2 is null").join(single, "qname", "left_semi"))
