"""FASTQ and FASTA."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import common


def parse(lines):
    """(name, comment, sequence, quality or None) of every record of FASTA or FASTQ lines.

    Blank lines are passed over, sequences and qualities may take several lines; a quality of another length is an error.
    """
    it = (x.rstrip("\r\n") for x in lines)
    line = next(it, None)
    while line is not None:
        if not line:
            line = next(it, None)
            continue
        if line[0] not in ">@":
            raise ValueError(f"a record starts with > or @, not {line[:20]!r}")
        fastq = line[0] == "@"
        name, _, comment = line[1:].partition(" ")
        seq: list[str] = []
        line = next(it, None)
        while line is not None and not (line[:1] in (">", "@") and not fastq) and not (fastq and line[:1] == "+"):
            seq.append(line)
            line = next(it, None)
        text, qual = "".join(seq), None
        if fastq:
            if line is None:
                raise ValueError(f"{name}: no quality")
            got: list[str] = []
            line = next(it, None)
            while line is not None and sum(map(len, got)) < len(text):
                got.append(line)
                line = next(it, None)
            qual = "".join(got)
            if len(qual) != len(text):
                raise ValueError(f"{name}: {len(text)} bases and {len(qual)} qualities")
        yield name.split("\t", 1)[0], comment, text, qual


def short_name(name: str) -> str:
    return name[:-2] if name.endswith(("/1", "/2")) else name


def numbered(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(file, n, line): lines with their 0-based number, counted per split and added up over splits and files by name.

    `sep` ends a line instead of a newline.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # one row a split, so one task can number them
    w = Window.orderBy("file", "block")
    before = sizes.select("file", "block", "first", (F.sum("size").over(w) - F.col("size")).alias("before"))
    # a split is read by one task, so ids within it are consecutive
    return lines.join(common.small(before), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("n"), "line")


def four_lines(lines: DataFrame) -> bool:
    """Whether numbered lines are FASTQ records of four lines: each fourth line starts with @ and each second after it with +."""
    at = F.col("n") % 4
    bad = ((at == 0) & ~F.col("line").startswith("@")) | ((at == 2) & ~F.col("line").startswith("+"))
    seen = lines.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    return seen.bad == 0 and seen.n % 4 == 0


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq, qual) of FASTQ, plain or compressed; read_id is the record's number.

    Records of four lines are split by lines, over all files of a folder; files with blank lines or records over more
    lines go to read_any(). A quality of another length than the sequence is an error.
    """
    lines = numbered(spark, path)
    if not four_lines(lines):
        return read_any(spark, path).select("read_id", "name", "seq", "qual")
    rows = lines.groupBy(F.floor(F.col("n") / 4).alias("read_id")).agg(*(F.max(F.when(F.col("n") % 4 == k, F.col("line"))).alias(f"l{k}") for k in (0, 1, 3)))
    bad = F.length("l1") != F.length("l3")
    seq = F.when(bad, F.raise_error(F.concat(F.lit("not a FASTQ record: "), "l0")).cast("string")).otherwise(F.col("l1"))
    return rows.select("read_id", S.without_mate(F.regexp_extract("l0", r"^@(\S*)", 1)).alias("name"), seq.alias("seq"), F.col("l3").alias("qual"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, comment, seq, qual) of FASTA or FASTQ with records over any number of lines; a file is one task, and read_id counts within it."""
    common.ship(spark)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows: list[tuple] = []
                names = ["read_id", "name", "comment", "seq", "qual"]
                make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.string()) for i in range(5)], names)
                for i, (name, comment, seq, qual) in enumerate(parse(raw.decode("latin-1").split("\n"))):
                    rows.append((i, short_name(name), comment, seq, qual))
                    if len(rows) == 5000:
                        yield make(rows)
                        rows = []
                yield make(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "read_id long, name string, comment string, seq string, qual string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, comment, seq): records are split at line starts with `>`, so a file is read in parallel."""
    rows = numbered(spark, path, "\n>").select(F.col("n").alias("ord"), F.regexp_replace("line", "^>", "").alias("r"))
    rows = rows.where("trim(r) <> ''")
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"[\r\n]", "")
    return rows.select("ord", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("comment"), seq.alias("seq"))


def read_panel(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(seq_idx, name, exons, seq, weight): a reference FASTA with equal sequences as one; `only` (name) keeps listed alleles."""
    rows = read_fasta(spark, path).where("seq <> ''")
    if only is not None:
        rows = rows.join(only.select("name").distinct(), "name", "left_semi")
    own = rows.groupBy("seq").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.min_by("comment", "ord").alias("comment"), F.count("*").alias("weight"))
    # the panel is small enough for every worker, and numbered in one task
    return own.select((F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("seq_idx"), "name", S.exons(F.col("comment"), F.length("seq")).alias("exons"), "seq", "weight")


def pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(read_id, name, seq1, qual1, seq2, qual2): two files' mates by number; other names, or one file longer, are errors."""
    b = second.select("read_id", F.col("name").alias("n2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = first.withColumnsRenamed({"seq": "seq1", "qual": "qual1"}).join(b, "read_id", "full_outer")
    bad = F.col("name").isNull() | F.col("n2").isNull() | (F.col("name") != F.col("n2"))
    name = F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("mates differ at read"), F.col("read_id").cast("string"), "name", "n2")).cast("string")).otherwise(F.col("name"))
    return both.select("read_id", name.alias("name"), "seq1", "qual1", "seq2", "qual2")


def interleaved(reads: DataFrame) -> DataFrame:
    """The same from one file with mates in turn; a lone last read is an error."""
    pick = lambda c, k: F.max(F.when(F.col("read_id") % 2 == k, F.col(c)))
    own = reads.groupBy(F.floor(F.col("read_id") / 2).alias("p")).agg(pick("name", 0).alias("name"), pick("name", 1).alias("n2"), pick("seq", 0).alias("seq1"), pick("qual", 0).alias("qual1"), pick("seq", 1).alias("seq2"), pick("qual", 1).alias("qual2"))
    name = F.when(F.col("n2").isNull() | (F.col("name") != F.col("n2")), F.raise_error(F.concat(F.lit("not a pair: "), "name")).cast("string")).otherwise(F.col("name"))
    return own.select(F.col("p").alias("read_id"), name.alias("name"), "seq1", "qual1", "seq2", "qual2")


def looks_interleaved(reads: DataFrame) -> bool:
    """Whether the first two reads share a name."""
    names = [r.name for r in reads.where("read_id < 2").orderBy("read_id").limit(2).collect()]
    return len(names) == 2 and names[0] == names[1]


def trimmed(text: Column, start: int | None, end: int | None) -> Column:
    """Bases from start to end, both included; None leaves a side."""
    if start is None and end is None:
        return text
    a = start or 0
    return F.substring(text, a + 1, (end - a + 1) if end is not None else 1_000_000_000)


def fastq_text(rows: DataFrame, name: str = "name", seq: str = "seq", qual: str = "qual", start: int | None = None, end: int | None = None) -> DataFrame:
    """(read_id, value): FASTQ text of each read, FASTA where it has no quality."""
    s, q = trimmed(F.col(seq), start, end), trimmed(F.col(qual), start, end)
    value = F.when(F.col(qual).isNull(), F.concat(F.lit(">"), name, F.lit("\n"), s)).otherwise(F.concat(F.lit("@"), name, F.lit("\n"), s, F.lit("\n+\n"), q))
    return rows.select("read_id", value.alias("value"))


def write_text(rows: DataFrame, path: str, order: str = "read_id") -> None:
    """Text in the order of a column, in as many files as the sort has partitions; their names sort in the same order."""
    rows.orderBy(order).select("value").write.mode("overwrite").text(path)
