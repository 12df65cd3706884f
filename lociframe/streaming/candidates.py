"""Candidate reads from a stream of reads.

The extractor has no state once its hit length and k are fixed, so a stream needs both as parameters; batches would
otherwise choose different ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import common, extract


def candidate_stream(reads: DataFrame, alleles: DataFrame, hit_length: int, k: int, similarity: float = 0.8) -> DataFrame:
    """Rows of a streaming DataFrame (seq1, optionally seq2) of which a mate hits an allele of the (static) panel."""
    common.ship(reads.sparkSession)
    found = extract.hits_panel(common.shared_panel(alleles), k, max(hit_length, k), similarity)
    return reads.where(extract.either_mate(found, "seq2" in reads.columns))
