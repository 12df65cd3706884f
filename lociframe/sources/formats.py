"""What a file is, by its first bytes."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession


def head(spark: SparkSession, path: str, n: int = 65_536) -> bytes:
    """The first bytes of a file in any store that Spark reaches."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).open(p)
    try:
        limited = sc._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)
        return bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(limited))
    finally:
        stream.close()


def sniff(data: bytes) -> str:
    """cram, bam, sam, fastq or fasta of a file's first bytes, compressed or not; anything else is an error."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompressobj(16 + zlib.MAX_WBITS).decompress(data, 4096)
    if data[:4] == b"CRAM":
        return "cram"
    if data[:4] == b"BAM\x01":
        return "bam"
    if data[:1] == b"@":
        return "sam" if len(data) > 3 and data[1:3].isalpha() and data[1:3].isupper() and data[3:4] == b"\t" else "fastq"
    if data[:1] == b">":
        return "fasta"
    raise ValueError(f"unknown format: {data[:4]!r}")


def kind(spark: SparkSession, path: str) -> str:
    return sniff(head(spark, path))


