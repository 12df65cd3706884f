"""K-mer postings, counts, similarities and the candidate gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .common import small, stored

#: postings above which a k-mer counts as a repeat
REPEAT = 100


def windows(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, offset, kmer) of every window without other letters than ACGT."""
    own = seqs.select(key, F.posexplode(S.kmers(F.col("seq"), k)).alias("offset", "kmer"))
    return own.where(~F.col("kmer").rlike("[^ACGT]"))


def postings(seqs: DataFrame, k: int, key: str = "seq_idx") -> DataFrame:
    """Index entries: windows that differ from the one before; the second window always, and never a first one of A alone.

    A run of equal windows is one base long, so only windows of a single letter are ever left out.
    """
    w = Window.partitionBy(key).orderBy("offset")
    own = windows(seqs, key, k).withColumn("prev", F.lag("kmer").over(w))
    first = (F.col("offset") == 0) & (F.col("kmer") != "A" * k)
    later = (F.col("offset") > 0) & ((F.col("offset") == 1) | F.col("prev").isNull() | (F.col("prev") != F.col("kmer")))
    return own.where(first | later).select(key, "offset", "kmer")


def with_repeats(posted: DataFrame) -> DataFrame:
    """Postings with `repeats`, the length of their k-mer's list."""
    return posted.join(posted.groupBy("kmer").agg(F.count("*").alias("repeats")), "kmer")


def counts(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of canonical k-mers over all sequences."""
    own = seqs.select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).where(~F.col("kmer").rlike("[^ACGT]"))
    return own.groupBy(S.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def profiles(seqs: DataFrame, k: int, key: str = "seq_idx") -> DataFrame:
    """(key, kmer, n) of canonical k-mers per sequence."""
    return windows(seqs, key, k).groupBy(key, S.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def similarity(profile: DataFrame, key: str = "seq_idx") -> DataFrame:
    """Pairs a < b that share k-mers: multiset Jaccard index, and containment of each in the other.

    The self-join is on k-mers of a reference panel; sequences that share none are not paired.
    """
    size = profile.groupBy(key).agg(F.sum("n").alias("size"))
    a = profile.select(F.col(key).alias("a"), "kmer", F.col("n").alias("na"))
    b = profile.select(F.col(key).alias("b"), "kmer", F.col("n").alias("nb"))
    shared = a.join(b, "kmer").where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("both"), F.sum("na").alias("a_in_b"), F.sum("nb").alias("b_in_a"))
    out = shared.join(size.select(F.col(key).alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col(key).alias("b"), F.col("size").alias("sb")), "b")
    return out.select(
        "a", "b", (F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("jaccard"), (F.col("a_in_b") / F.col("sa")).alias("a_in_b"), (F.col("b_in_a") / F.col("sb")).alias("b_in_a")
    )


def hits(reads: DataFrame, posted: DataFrame, k: int, repeats: int | None = None) -> DataFrame:
    """(read_id, strand, seq_idx, read_offset, offset) of reads' k-mers on both strands; the index is broadcast if small.

    The other strand's k-mers are looked up as reverse complements in the index, so a read's windows are listed once.
    With `repeats`, k-mers of as many postings are passed over before they meet these, unless at a read's ends, but at
    most k // 2 in a row.
    """
    own = reads.select("read_id", F.length("seq").alias("n"), F.posexplode(S.kmers(F.col("seq"), k)).alias("at", "kmer"))
    on_strand = F.when(F.col("strand") == 1, F.col("at")).otherwise(F.col("n") - k - F.col("at"))

    def stranded(index: DataFrame, *columns: str) -> DataFrame:
        return index.select("kmer", F.lit(1).alias("strand"), *columns).unionByName(index.select(S.reverse_complement(F.col("kmer")).alias("kmer"), F.lit(-1).alias("strand"), *columns))

    def found(windows: DataFrame, index: DataFrame) -> DataFrame:
        return windows.join(small(stranded(index, "seq_idx", "offset")), "kmer").select("read_id", "strand", "seq_idx", on_strand.alias("read_offset"), "offset")

    if repeats is None:
        return found(own, posted)
    marked = stored(with_repeats(posted), "postings")
    frequent = marked.where(F.col("repeats") >= repeats)
    met = own.join(small(stranded(frequent.select("kmer").distinct())), "kmer").select("read_id", "n", "kmer", "strand", on_strand.alias("o"))
    ends = (F.col("o") == 0) | (F.col("o") == F.col("n") - k)
    place = Window.partitionBy("read_id", "strand").orderBy("o")
    runs = met.where(~ends).withColumn("run", F.col("o") - F.row_number().over(place))
    turn = (F.row_number().over(Window.partitionBy("read_id", "strand", "run").orderBy("o")) - 1) % (k // 2 + 1)
    kept = met.where(ends).unionByName(runs.withColumn("turn", turn).where(F.col("turn") == k // 2).drop("run", "turn"))
    again = kept.join(small(stranded(frequent, "seq_idx", "offset")), ["kmer", "strand"]).select("read_id", "strand", "seq_idx", F.col("o").alias("read_offset"), "offset")
    return found(own, marked.where(F.col("repeats") < repeats)).unionByName(again)


def gate(found: DataFrame, k: int, hit_length: int) -> DataFrame:
    """Per read its bucket (strand, allele) with most hits, if these cover hit_length; ties go to the reverse strand, then the smaller allele."""
    n = found.groupBy("read_id", "strand", "seq_idx").agg(F.count("*").alias("hits"))
    best = n.groupBy("read_id").agg(F.max(F.struct("hits", (-F.col("strand")).alias("s"), (-F.col("seq_idx")).alias("i"))).alias("m"))
    return best.where(k * F.col("m.hits") >= hit_length).select("read_id", (-F.col("m.s")).alias("strand"), (-F.col("m.i")).alias("seq_idx"), F.col("m.hits").alias("hits"))
