"""WARC archives in Zstandard form: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then comes one frame per record,
compressed with it. Archives are written and read through Spark's own file formats, so any store that Spark reaches
will do. The writer is the text format with an empty skippable frame as its line separator: eight ASCII bytes that every
Zstandard reader passes over. Spark begins a new file after `ROWS` lines, and every line whose number is a multiple of that
is a dictionary. An archive that would exceed `ARCHIVE_BYTES` before is filled up with empty lines.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DICTIONARY_MAGIC = 0x184D2A5D
#: an empty skippable frame, which every reader passes over
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICT_BYTES = 32 << 10
#: pages, chosen among all by a hash, that the dictionary is trained on, at most
TRAIN_ROWS = 500
#: lines of an archive, and bytes after which none is added
ROWS = 1 << 16
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """What is wrong with an archive or a record."""


def quoted(value) -> str:
    """An id as a header's value: white space, controls and % as %XX, so that any text is one line and comes back as it was."""
    return "".join(c if " " < c != "%" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record: an HTTP response with the payload, or a revisit with its HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {quoted(page_id)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {quoted(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record in one frame: its headers (lower-case names), block and payload; raises WarcError unless all is in order."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the header has no end")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"unknown version {first[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"content-length is {n}, the frame holds {len(rest) - 4} bytes")
    block = rest[:n]
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the HTTP header has no end")
    said = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if said is not None and not said.isdigit():
        raise WarcError("the HTTP content-length is no number")
    size = None if said is None else int(said)
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response":
        if size is not None and size != len(payload):
            raise WarcError(f"the HTTP header says {size} bytes, the payload has {len(payload)}")
        if digest and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise WarcError("the payload's digest differs")
    elif headers["warc-type"] == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    return {"headers": headers, "payload": payload, "payload_bytes": len(payload) if size is None else size, "digest": digest.removeprefix("sha256:")}


def frames(archive: bytes):
    """The dictionary (or None) of an archive, then each record's frame with its place, walking the frames' block headers."""
    import zstandard as z

    i, n, first = 0, len(archive), True
    while i < n:
        if n - i < 8:
            raise WarcError(f"{n - i} bytes are left at {i}")
        magic, size = struct.unpack_from("<II", archive, i)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if i + 8 + size > n:
                raise WarcError(f"the skippable frame at {i} is cut short")
            if first:
                if magic != DICTIONARY_MAGIC:
                    raise WarcError("no dictionary frame at the start")
                d = archive[i + 8 : i + 8 + size]
                yield z.ZstdDecompressor().decompress(d) if d[:4] == b"\x28\xb5\x2f\xfd" else d
                first = False
            i += 8 + size
            continue
        if first:
            raise WarcError("no dictionary frame at the start")
        if magic != 0xFD2FB528:
            raise WarcError(f"no frame at {i}")
        try:
            info = z.get_frame_parameters(archive[i : i + 18])
            k = i + z.frame_header_size(archive[i : i + 18])
        except z.ZstdError as e:
            raise WarcError(f"frame at {i}: {e}") from e
        last = False
        while not last:
            if k + 3 > n:
                raise WarcError(f"the frame at {i} is cut short")
            h = int.from_bytes(archive[k : k + 3], "little")
            last, kind, length = bool(h & 1), h >> 1 & 3, h >> 3
            if kind == 3:
                raise WarcError(f"a reserved block in the frame at {i}")
            k += 3 + (1 if kind == 1 else length)
        k += 4 * info.has_checksum
        if k > n:
            raise WarcError(f"the frame at {i} is cut short")
        yield i, k
        i = k


def records(archive: bytes):
    """Every record of an archive, parsed and checked. An empty file has none."""
    import zstandard as z

    walk = frames(archive)
    dictionary = next(walk, None)
    if dictionary is None:
        return
    dctx = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary)) if dictionary else z.ZstdDecompressor()
    for a, b in walk:
        try:
            data = dctx.decompress(archive[a:b])
        except z.ZstdError as e:
            raise WarcError(f"frame at {a}: {e}") from e
        yield parse(data)


def dictionary(pages: DataFrame, payload: Column) -> bytes:
    """A dictionary from a bounded sample of all pages, trained in one worker; empty where there is too little or too uniform text."""

    def run(batches):
        import pyarrow as pa
        import zstandard as z

        samples = [x[k : k + 4000] for batch in batches for x in batch.column("payload").to_pylist() for k in range(0, len(x), 4000)]
        size = sum(map(len, samples))
        d = b""
        if size > 20_000 and len(samples) > 7:
            try:
                d = z.train_dictionary(min(DICT_BYTES, size // 8), samples, k=200, d=8).as_bytes()
            except z.ZstdError:
                pass  # samples that are too alike: the archives do without
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary())], ["d"])

    ids = pages.select(F.col("page_id").cast("string").alias("page_id")).where("page_id is not null")
    chosen = F.broadcast(C.bounded_sample(ids.distinct(), "page_id", TRAIN_ROWS))
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), payload.alias("payload")).join(chosen, "page_id", "left_semi").groupBy("page_id").agg(F.min("payload").alias("payload"))
    found = own.select("payload").coalesce(1).mapInArrow(run, "d binary").collect()  # one row, or none of an empty table
    return bytes(found[0].d) if found else b""


def write(rows: DataFrame, path: str, trained: bytes = b"", level: int = 3, most: int = ARCHIVE_BYTES, lines: int = ROWS) -> None:
    """Write rows (page_id, url, payload, digest, kind, refers_to) as archives of at most `most` bytes (but for one large record)."""

    def run(batches):
        import pyarrow as pa
        import zstandard as z

        cctx = z.ZstdCompressor(level=level, write_checksum=True, **({"dict_data": z.ZstdCompressionDict(trained)} if trained else {}))
        begin = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
        at = size = 0  # lines and bytes of the archive that is being written
        for batch in C.sliced(batches):
            own, out = batch.to_pydict(), []
            for r in zip(*(own[c] for c in ("kind", "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                frame = cctx.compress(record(*r))
                if at > 1 and size + len(frame) + len(SEPARATOR) > most:
                    out += [b""] * (lines - at)
                    at = lines
                if at in (0, lines):
                    out.append(begin)
                    at, size = 1, len(begin) + len(SEPARATOR)
                out.append(frame)
                at, size = at + 1, size + len(frame) + len(SEPARATOR)
                if len(out) > 4 * lines:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frame = rows.select("page_id", "url", "payload", "digest", "kind", "refers_to").mapInArrow(run, "frame binary")
    frame.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", lines).text(path)


def read(spark, path: str) -> DataFrame:
    """Per record of all archives in a folder: page_id (as text), record_type, url, payload_bytes, payload_digest, refers_to (as text).

    An archive or record that is out of order raises WarcError with the archive's name.
    """

    def run(batches):
        from urllib.parse import unquote

        import pyarrow as pa

        plain = lambda x: None if x is None else unquote(x)
        names = ["page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"]
        for batch in batches:
            for name, archive in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    for r in records(archive):
                        h = r["headers"]
                        rows.append((plain(h.get("x-page-id")), h["warc-type"], h.get("warc-target-uri"), r["payload_bytes"], r["digest"], plain(h.get("x-refers-to-page-id"))))
                except WarcError as e:
                    raise WarcError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(6)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "page_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string")


def planned(pages: DataFrame, payload: Column, least: int = 100) -> DataFrame:
    """Rows for write(): of equal payloads of at least `least` bytes the smallest page_id is a response, others revisit it."""
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = base.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a digest that many pages share is sent to the pages; no task gets all of them
    own = C.matched(base, C.stored(firsts, "warc-firsts"), ["digest"], "n", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return own.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null page_id revisits an equal payload's smallest id and is a response otherwise;
    repeated rows that have the smallest id are all responses. An empty table gives an empty result.
    """
    path, html = C.shared_path(pages.sparkSession, "warc"), C.as_bytes(F.col("html"))
    C.owned(pages.sparkSession, path)
    write(planned(pages, html), path, dictionary(pages, html))
    kind = dict(pages.dtypes)["page_id"]
    return read(pages.sparkSession, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
