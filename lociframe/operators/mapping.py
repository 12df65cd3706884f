"""Mapping reads to the panel with the alignment kernels, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import align, common

OVERLAPS = "read_id long, seq_idx long, strand int, read_start int, read_end int, start int, end int, match int, similarity double, clip int"


def map_reads(reads: DataFrame, alleles: DataFrame, hit_length: int, k: int = 11, similarity: float = 0.8, local: bool = False) -> DataFrame:
    """Overlaps of reads (read_id, seq) with alleles (seq_idx, seq): extended to the read's ends, or as chained (local) with matched bases only.

    Each distinct sequence is aligned once; reads meet its overlaps in a join. The panel is sent to the workers.
    """
    common.ship(reads.sparkSession)
    shared = common.shared_panel(alleles)

    def run(batches):
        import pyarrow as pa

        ids, seqs = shared.value
        index = align.index_of(seqs, k)
        names = ["key", "seq_idx", "strand", "read_start", "read_end", "start", "end", "match", "similarity", "clip"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        for batch in batches:
            out = []
            for seq in batch.column("seq").to_pylist():
                if local:
                    buckets = index.hits(seq)
                    found = [o for key in sorted(buckets) for o, _ in align.chain(*key, buckets[key], k, hit_length)]
                else:
                    found = align.assign(index, seq, hit_length, similarity)[0]
                out += [(seq, ids[o.seq_idx], o.strand, o.read_start, o.read_end, o.seq_start, o.seq_end, o.match, o.similarity, o.left_clip + o.right_clip) for o in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    distinct = reads.select("seq").where(F.length("seq") >= k).distinct()
    found = distinct.mapInArrow(run, OVERLAPS.replace("read_id long", "key string"))
    return reads.select("read_id", F.col("seq").alias("key")).join(found, "key").drop("key")


def candidates(index: align.Index, batch, hit_length: int):
    """The fragments of an Arrow batch (seq1, seq2) of which a mate may have overlaps; the others can't have any."""
    import pyarrow as pa

    may = [index.may_chain([s or "" for s in batch.column(c).to_pylist()], hit_length) for c in ("seq1", "seq2")]
    return batch.filter(pa.array(may[0] | may[1]))


def near_panel(fragments: DataFrame, alleles: DataFrame, hit_length: int, k: int = 11) -> DataFrame:
    """The fragments (sample, read_id, seq1, seq2) of which a mate may have overlaps; placements and pileups of all are those of these."""
    common.ship(fragments.sparkSession)
    shared = common.shared_panel(alleles)

    def run(batches):
        index = align.index_of(shared.value[1], k)
        for batch in batches:
            yield candidates(index, batch, hit_length)

    own = fragments.select("sample", "read_id", "seq1", "seq2")
    return own.mapInArrow(run, own.schema)


def fragment_assignments(fragments: DataFrame, alleles: DataFrame, hit_length: int, k: int = 11, similarity: float = 0.8, most: int = 2000, prefilter: float = 0.0, whitelist: DataFrame | None = None) -> DataFrame:
    """(sample, read_id, seq_idx, start, end, weight, qual, adjust) of fragments (sample, read_id, seq1, seq2 or null).

    Mates of one fragment are aligned, paired and weighed in one call; a fragment with more than `most` alleles, or with
    a place that touches a separator, has none. With a whitelist (seq_idx) only its alleles are returned; the others still
    count towards `most` and the fragment's best similarity.
    """
    common.ship(fragments.sparkSession)
    shared = common.shared_panel(alleles)
    band = max((1 - similarity) / 4, 0.01)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, seqs = shared.value
        index = align.index_of(seqs, k)
        memo: dict = {}

        def mapped(seq):
            if seq not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[seq] = align.assign(index, seq, hit_length, similarity, prefilter * similarity)[0]
            return memo[seq]

        names = ["sample", "read_id", "seq_idx", "start", "end", "weight", "qual", "adjust"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.float32()]
        for batch in batches:
            out = []
            for r in candidates(index, batch, hit_length).to_pylist():
                a, b = r["seq1"] or "", r.get("seq2")
                found = align.fragments(mapped(a), None if b is None else mapped(b), seqs, hit_length)
                if not found or len(found) > most or any(align.crosses(seqs[f.seq_idx], f.start, f.end) for f in found):
                    continue
                has_n = "N" in a or "N" in (b or "")
                top = max(f.similarity for f in found)
                for f in found:
                    s = f.similarity
                    w = 0.01 if s < 1 - 3 * band else 0.1 if s < 1 - 2 * band else 0.5 if s < 1 - band else 1.0
                    w = np.float32(w / 10 if has_n else w)
                    out.append((r["sample"], r["read_id"], ids[f.seq_idx], f.start, f.end, w, 1.0, np.float32(0.25 if top < 1 else 1.0) * w))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    own = fragments if "seq2" in fragments.columns else fragments.withColumn("seq2", F.lit(None).cast("string"))
    found = own.select(F.col("sample").cast("string").alias("sample"), F.col("read_id").cast("long").alias("read_id"), "seq1", "seq2").mapInArrow(
        run, "sample string, read_id long, seq_idx long, start int, end int, weight float, qual float, adjust float"
    )
    return found if whitelist is None else found.join(common.small(whitelist.select("seq_idx").distinct()), "seq_idx", "left_semi").select(*found.columns)


def pileup(reads: DataFrame, alleles: DataFrame, hit_length: int, k: int = 11, similarity: float = 0.8) -> DataFrame:
    """(seq_idx, pos, base, depth): matching bases of reads' near-best overlaps, each distinct sequence aligned once."""
    common.ship(reads.sparkSession)
    shared = common.shared_panel(alleles)

    def run(batches):
        import pyarrow as pa

        ids, seqs = shared.value
        index = align.index_of(seqs, k)
        for batch in batches:
            out = []
            for seq, n in zip(batch.column("seq").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out += [(ids[i], at, base, n) for i, at, base in align.assign(index, seq, hit_length, similarity)[1]]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["seq_idx", "pos", "base", "n"])

    own = reads.groupBy("seq").agg(F.count("*").alias("n")).where(F.length("seq") >= k)
    return own.mapInArrow(run, "seq_idx long, pos int, base string, n long").groupBy("seq_idx", "pos", "base").agg(F.sum("n").alias("depth"))


def exon_cells(piled: DataFrame, alleles: DataFrame) -> DataFrame:
    """(seq_idx, depth): one row per exon position (alleles: seq_idx, seq, exons) with the depth of its own base."""
    at = alleles.select("seq_idx", "seq", "exons", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"))
    own = at.where(S.in_exon(F.col("pos"), F.col("exons"))).select("seq_idx", "pos", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(1)).alias("base"))
    return own.join(piled, ["seq_idx", "pos", "base"], "left").select("seq_idx", F.coalesce("depth", F.lit(0)).alias("depth"))


def sample_pileup(reads: DataFrame, alleles: DataFrame, hit_length: int, k: int = 11, similarity: float = 0.8) -> DataFrame:
    """(sample, seq_idx, pos, base, depth) of reads (sample, seq): cells of a distinct sequence are made once and joined to its samples.

    Reads that can't have overlaps are left out first, so that only the others are shuffled.
    """
    common.ship(reads.sparkSession)
    shared = common.shared_panel(alleles)

    def kept(batches):
        import pyarrow as pa

        index = align.index_of(shared.value[1], k)
        for batch in batches:
            yield batch.filter(pa.array(index.may_chain([s or "" for s in batch.column("seq").to_pylist()], hit_length)))

    def run(batches):
        import pyarrow as pa

        ids, seqs = shared.value
        index = align.index_of(seqs, k)
        for batch in batches:
            out = [(seq, ids[i], at, base) for seq in batch.column("seq").to_pylist() for i, at, base in align.assign(index, seq, hit_length, similarity)[1]]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["key", "seq_idx", "pos", "base"])

    own = reads.select("sample", "seq").where(F.length("seq") >= k).mapInArrow(kept, f"sample {dict(reads.dtypes)['sample']}, seq string")
    n = common.stored(own.groupBy("sample", F.col("seq").alias("key")).agg(F.count("*").alias("n")), "kept-reads")
    # few bytes but much work: over all cores whatever their size
    spark = reads.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = n.select(F.col("key").alias("seq")).repartition(parts, "seq").distinct().mapInArrow(run, "key string, seq_idx long, pos int, base string")
    return cells.join(n, "key").groupBy("sample", "seq_idx", "pos", "base").agg(F.sum("n").alias("depth"))


def exon_cells_by_sample(piled: DataFrame, alleles: DataFrame) -> DataFrame:
    """(sample, seq_idx, depth): one row per sample, allele and exon position with the depth of its own base."""
    at = alleles.select("seq_idx", "seq", "exons", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"))
    own = at.where(S.in_exon(F.col("pos"), F.col("exons"))).select("seq_idx", "pos", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(1)).alias("base"))
    # every sample is asked for every position of the panel
    asked = piled.select("sample").distinct().crossJoin(common.small(own))
    return asked.join(piled, ["sample", "seq_idx", "pos", "base"], "left").select("sample", "seq_idx", F.coalesce("depth", F.lit(0)).alias("depth"))
