"""SAM and BAM.

A BAM file is a chain of compressed blocks that all begin with the same sixteen bytes. Spark's text reader splits the file
at these, so that the blocks of a split are one task's. Records run over blocks and splits: each split guesses where its
first record begins, and the guess is proved by the bytes before it, which must end the previous split's records.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import common

RECORD = "rec long, qname string, flags int, tid int, pos long, cigar string, mtid int, mpos long, distance long, seq string, qual string"
#: the 4-bit base codes of BAM; ambiguity codes read as N
BASES = "=ACMGRSVTWYHKDBN"
_PLAIN = "".join(c if c in "ACGT" else "N" for c in BASES)
OPS = "MIDNSHP=X"
#: how every block of a BAM file begins, up to its size
BLOCK = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
#: records in a row that must look like records before a split takes their place as its first
CHAIN = 4
EDGE = "file string, block long, n long, found boolean, bad boolean, head binary, tail binary"


def sort_order(header: str) -> str:
    """coordinate, queryname, grouped or unsorted, as the @HD line says."""
    for line in header.split("\n"):
        if line.startswith("@HD"):
            tags = dict(t.split(":", 1) for t in line.split("\t")[1:] if ":" in t)
            if tags.get("SO") in ("coordinate", "queryname"):
                return tags["SO"]
            if tags.get("GO") == "query":
                return "grouped"
    return "unsorted"


def sequences(header: str) -> list[str]:
    """Reference names of the @SQ lines, in order."""
    return [t[3:] for line in header.split("\n") if line.startswith("@SQ") for t in line.split("\t") if t.startswith("SN:")]


def as_sequenced(records: DataFrame) -> DataFrame:
    """Reads of the reverse strand turned back, with their qualities."""
    back = S.is_reverse(F.col("flags"))
    return records.withColumns({"seq": F.when(back, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(back, F.reverse("qual")).otherwise(F.col("qual"))})


def read_sam(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The header's text, and records (rec, qname, flags, tid, pos 0-based, cigar, mtid, mpos, distance, seq, qual) as sequenced."""
    from .fastx import numbered

    lines = numbered(spark, path)
    # header lines are few and stand first
    header = "\n".join(r.line for r in lines.where("line LIKE '@%' AND line RLIKE '^@[A-Z][A-Z]\t'").orderBy("n").collect())
    ids = {n: i for i, n in enumerate(sequences(header))}
    place = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]) if ids else F.create_map().cast("map<string,int>")
    f = F.split("line", "\t")
    tid = F.coalesce(F.try_element_at(place, f[2]), F.lit(-1))
    own = lines.where("line <> '' AND NOT line RLIKE '^@[A-Z][A-Z]\t'").select(
        F.col("n").alias("rec"), f[0].alias("qname"), f[1].cast("int").alias("flags"), tid.alias("tid"), (f[3].cast("long") - 1).alias("pos"), f[5].alias("cigar"),
        F.when(f[6] == "=", tid).otherwise(F.coalesce(F.try_element_at(place, f[6]), F.lit(-1))).alias("mtid"), (f[7].cast("long") - 1).alias("mpos"), F.abs(f[8].cast("long")).alias("distance"),
        F.when(f[9] == "*", "").otherwise(F.upper(f[9])).alias("seq"), F.when(f[10] == "*", None).otherwise(f[10]).alias("qual"),
    )
    return header, as_sequenced(own)


def bam_header(data: bytes) -> tuple[str, int] | None:
    """The header's text and where the records begin; None if data ends before that."""
    if data[:4] != b"BAM\x01"[: len(data)]:
        raise ValueError("not a BAM file")
    if len(data) < 12:
        return None
    n = struct.unpack_from("<i", data, 4)[0]
    i = 8 + n
    if len(data) < i + 4:
        return None
    n_ref = struct.unpack_from("<i", data, i)[0]
    i += 4
    for _ in range(n_ref):
        if len(data) < i + 4:
            return None
        i += 8 + struct.unpack_from("<i", data, i)[0]
    return None if len(data) < i else (data[8 : 8 + n].split(b"\0", 1)[0].decode(), i)


def record_ends(data: bytes, i: int) -> Iterator[int]:
    """Where each whole record from i on ends."""
    while len(data) >= i + 4:
        size = struct.unpack_from("<i", data, i)[0]
        if size < 32:
            raise ValueError("a record is shorter than its fixed part")
        if len(data) < i + 4 + size:
            return
        i += 4 + size
        yield i


def bam_record(data: bytes, i: int) -> tuple:
    """The record at i, in the order of RECORD without its number."""
    _, tid, pos, l_name, _, _, n_cigar, flags, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, i)
    at = i + 36
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    at += (l_seq + 1) // 2
    seq = "".join(_PLAIN[b >> 4] + _PLAIN[b & 15] for b in packed)[:l_seq]
    raw = data[at : at + l_seq]
    qual = None if not l_seq or raw[0] == 255 else "".join(chr(q + 33) for q in raw)
    return name, flags, tid, pos, cigar, mtid, mpos, abs(tlen), seq, qual


def bam_records(data: bytes):
    """The header's text, then each record as a tuple in the order of RECORD, of a decompressed BAM."""
    top = bam_header(data)
    if top is None:
        raise ValueError("the file ends within its header")
    header, i = top
    yield header
    for rec, end in enumerate(record_ends(data, i)):
        yield rec, *bam_record(data, i)
        i = end
    if i != len(data):
        raise ValueError("the file ends within a record")


def looks_like_record(data: bytes, i: int) -> bool:
    """Whether a record may begin at i: sizes that fit, places of -1 or more, a printable name that ends in zero."""
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, i)
    if l_name < 2 or min(tid, pos, mtid, mpos) < -1 or l_seq < 0 or size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return False
    name = data[i + 36 : i + 36 + l_name]
    return len(name) < l_name or (name[-1] == 0 and all(32 < c < 127 for c in name[:-1]))


def first_record(data: bytes) -> int | None:
    """The first place from which CHAIN records follow one another; None if there is none."""
    for start in range(len(data) - 35):
        i, n = start, 0
        while n < CHAIN and i + 36 <= len(data) and looks_like_record(data, i):
            i, n = i + 4 + struct.unpack_from("<i", data, i)[0], n + 1
        if n == CHAIN:
            return start
    return None


def inflated(block: bytes) -> bytes:
    """The contents of what follows BLOCK; ValueError if its size or checksum is wrong."""
    if len(block) < 10 or struct.unpack_from("<H", block)[0] + 1 != len(BLOCK) + len(block):
        raise ValueError("not a block")
    try:
        out = zlib.decompress(block[2:-8], -15)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if struct.unpack_from("<II", block, len(block) - 8) != (zlib.crc32(out), len(out)):
        raise ValueError("a block's checksum is wrong")
    return out


def split_records(blocks: Iterator[bytes], at_start: bool) -> Iterator[tuple[str, bytes]]:
    """("head", the bytes before the first record), then ("record", each whole one), then ("tail", what is left) of a split.

    The head of a file's first split is the header. A split of too few records gives ("none", all its bytes) alone; these
    are read with the bytes between splits.
    """
    data, begun, tried = b"", False, 0
    for raw in blocks:
        data += raw
        if not begun:
            if not at_start and len(data) < 2 * tried:
                continue
            tried = len(data)
            top = bam_header(data) if at_start else None
            start = (top[1] if top else None) if at_start else first_record(data)
            if start is None:
                continue
            yield "head", data[:start]
            data, begun = data[start:], True
        i = 0
        for end in record_ends(data, i):
            yield "record", data[i:end]
            i = end
        data = data[i:]
    yield "tail" if begun else "none", data


def _splits(batches) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, split, its inflated blocks) of a task's rows, in which the blocks of a split follow one another."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "block", "data")), strict=True) if r[2])
    for (file, block), own in groupby(rows, key=lambda r: r[:2]):
        yield file, block, (inflated(r[2]) for r in own)


def _edges(batches):
    """EDGE of each split: its number of whole records and the bytes before and after them."""
    import pyarrow as pa

    for file, block, blocks in _splits(batches):
        n, parts, bad = 0, {}, False
        try:
            for kind, data in split_records(blocks, block == 0):
                n += kind == "record"
                if kind != "record":
                    parts[kind] = data
        except (ValueError, UnicodeDecodeError):
            bad = True
        row = [file, block, n, "none" not in parts, bad, parts.get("head", parts.get("none", b"")), parts.get("tail", b"")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in EDGE.split(", ")])


PARSED = RECORD.split(", ")[1:]
_KINDS = {"long": "int64", "int": "int32", "string": "string", "boolean": "bool_"}


def _batches(rows: Iterator[tuple], columns: list[str], size: int = 5000):
    """Arrow batches of rows, of which the table is never held as a whole."""
    from itertools import islice

    import pyarrow as pa

    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], getattr(pa, _KINDS[c.split()[1]])()) for i, c in enumerate(columns)], [c.split()[0] for c in columns])


def _stitched(pdf):
    """Of a file's edges in order: each split's first number, and the records that run over splits with theirs (block null).

    Block -1 has the file's number of records, block -2 the header as qname. If the bytes between two splits aren't whole
    records, a guess was wrong: one row says so (rec -1).
    """
    import pandas as pd

    out, left, n = [], b"", 0
    names = ["file", "block", "rec", *(c.split()[0] for c in PARSED)]
    file = pdf["file"].iloc[0]
    bare = (None,) * len(PARSED)
    wrong = pd.DataFrame([(file, None, -1, *bare)], columns=names, dtype=object)
    try:
        for r in pdf.sort_values("block").itertuples(index=False):
            if r.bad:
                return wrong
            if r.block == 0 and r.found:
                out.append((file, -2, 0, bam_header(bytes(r.head))[0], *bare[1:]))
            else:
                left += bytes(r.head)
            if not r.found:
                continue
            i = 0
            for end in record_ends(left, 0):
                out.append((file, None, n, *bam_record(left, i)))
                i, n = end, n + 1
            if i != len(left):
                return wrong
            out.append((file, int(r.block), n, *bare))
            n, left = n + int(r.n), bytes(r.tail)
        i = 0
        for end in record_ends(left, 0):
            out.append((file, None, n, *bam_record(left, i)))
            i, n = end, n + 1
        if i != len(left):
            return wrong
    except (ValueError, struct.error, IndexError):
        return wrong
    out.append((file, -1, n, *bare))
    return pd.DataFrame(out, columns=names, dtype=object)


def read_bam(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The same of a BAM file or a folder of them, split at blocks; records are numbered over the files by name.

    A first pass inflates the blocks and finds the splits' first records; the bytes between splits, less than a record
    and some blocks each, meet in one task a file. A file that is compressed otherwise, or where a guess was wrong, makes
    the whole be read a file a task.
    """
    common.ship(spark)
    lines = spark.read.option("lineSep", BLOCK.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    blocks = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))
    edges = blocks.mapInArrow(_edges, EDGE)
    places = common.stored(edges.groupBy("file").applyInPandas(_stitched, ", ".join(["file string, block long, rec long", *PARSED])), "bam-edges")
    header = places.where("block = -2").orderBy("file").select("qname").first()
    if header is None or not places.where("rec < 0").isEmpty():
        return _read_whole(spark, path)

    def run(batches):
        def rows():
            for file, block, own in _splits(batches):
                records = (data for kind, data in split_records(own, block == 0) if kind == "record")
                for i, data in enumerate(records):
                    yield file, block, i, *bam_record(data, 0)

        yield from _batches(rows(), ["file string", "block long", "i long", *PARSED])

    # one row a file, so one task can number them
    sizes = places.where("block = -1").select("file", "rec")
    w = Window.orderBy("file")
    first = common.small(sizes.select("file", (F.sum("rec").over(w) - F.col("rec")).alias("before")))
    columns = [c.split()[0] for c in PARSED]
    starts = places.where("block >= 0").select("file", "block", F.col("rec").alias("base")).join(first, "file").select("file", "block", (F.col("base") + F.col("before")).alias("base"))
    inside = blocks.mapInArrow(run, ", ".join(["file string, block long, i long", *PARSED])).join(common.small(starts), ["file", "block"])
    between = places.where("block is null").join(first, "file").select((F.col("rec") + F.col("before")).alias("rec"), *columns)
    return header.qname, as_sequenced(inside.select((F.col("base") + F.col("i")).alias("rec"), *columns).unionByName(between))


def _read_whole(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """read_bam() of files that can't be split: a file is one task, records leave it in batches."""

    def contents(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield file, gzip.decompress(content)

    def run(batches):
        for file, data in contents(batches):
            rows = bam_records(data)
            next(rows)
            yield from _batches(((file, *r) for r in rows), ["file string", *RECORD.split(", ")])

    def sizes(batches):
        rows = ((file, *bam_header(data)[:1], sum(1 for _ in record_ends(data, bam_header(data)[1]))) for file, data in contents(batches))
        yield from _batches(rows, ["file string", "header string", "n long"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    counted = common.stored(files.mapInArrow(sizes, "file string, header string, n long"), "bam-files")
    w = Window.orderBy("file")
    before = common.small(counted.select("file", (F.sum("n").over(w) - F.col("n")).alias("before")))
    own = files.mapInArrow(run, "file string, " + RECORD).join(before, "file").withColumn("rec", F.col("rec") + F.col("before"))
    header = counted.orderBy("file").select("header").first()
    return header.header if header else "", as_sequenced(own.select(*(c.split()[0] for c in RECORD.split(", "))))
