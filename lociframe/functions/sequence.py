"""Column expressions over nucleotide sequences, allele names, read names, flags and exon lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLEMENT = ("ACGT", "TGCA")


def base_codes(seq: Column) -> Column:
    """A, C, G, T as 0 to 3; anything else as 3."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "T"), "ACGT", "0123")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base as a number (up to 31 bases); null where a base is not ACGT."""
    digits = F.split(F.translate(kmer, "ACGT", "0123"), "")
    code = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: a * 4 + d.cast("long"))
    return F.when(kmer.rlike("^[ACGT]*$"), code)


def reverse_complement(seq: Column) -> Column:
    """Complement read backwards; other letters become N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGTN]", "N")), *COMPLEMENT)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; text order is code order for a fixed length."""
    return F.least(kmer, F.translate(F.reverse(kmer), *COMPLEMENT))


def kmers(seq: Column, k: int) -> Column:
    """All windows of k bases in order; bytes are sliced, so a long sequence costs linear time."""
    raw = seq.cast("binary")
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(raw, i, F.lit(k)).cast("string"))
    return F.when(F.length(seq) >= k, windows).otherwise(F.array().cast("array<string>"))


def count_of(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def effective_length(seq: Column) -> Column:
    """Bases, where a run of N counts once and a leading run not at all."""
    return F.length(F.regexp_replace(F.regexp_replace(seq, "^N+", ""), "N+", "N"))


def low_complexity(seq: Column) -> Column:
    """A read that is mostly one base, has a tenth of N, or hardly uses two of the bases (integer divisions)."""
    n = F.length(seq)
    count = [count_of(seq, b) for b in "ACGT"]
    half, tenth = F.floor(n / 2), F.floor(n / 10)
    rare = sum(((c <= 2).cast("int") for c in count), F.lit(0))
    most = count[0] >= half
    for c in count[1:]:
        most = most | (c >= half)
    return most | (count_of(seq, "N") >= tenth) | (rare >= 2)


def low_complexity_span(seq: Column) -> Column:
    """The rule for overlaps: at least two bases with a count up to 2, unless these make up a seventh of the span."""
    count = [count_of(seq, b) for b in "ACGT"]
    low = sum((F.when(c <= 2, c).otherwise(0) for c in count), F.lit(0))
    rare = sum(((c <= 2).cast("int") for c in count), F.lit(0))
    return (7 * low < F.length(seq)) & (rare >= 2)


def gene(name: Column) -> Column:
    """Text before the first `*`."""
    return F.substring_index(name, "*", 1)


def major_allele(name: Column, fields: int = 3, digits: int | None = None) -> Column:
    """The first `fields` colon-separated fields; for names counted in digits, `*` and that many characters."""
    if digits is not None:
        return F.regexp_extract(name, rf"^([^*]*(?:\*.{{0,{digits}}})?)", 1)
    return F.substring_index(name, ":", fields)


def null_expression(name: Column) -> Column:
    """Whether an allele name ends in a digit and one of the suffixes for altered expression."""
    return name.contains("*") & name.rlike("[0-9][NLSCAQ]$")


def without_mate(read_name: Column, drop: int | None = None) -> Column:
    """A read's name without /1 or /2, or without its last `drop` characters."""
    if drop is not None:
        return F.substring(read_name, F.lit(1), F.greatest(F.lit(0), F.length(read_name) - drop))
    return F.regexp_replace(read_name, "/[12]$", "")


def alternative_contig(chrom: Column) -> Column:
    return chrom.rlike(r"[_.*]")


def exons(comment: Column, length: Column) -> Column:
    """Closed intervals of a header comment `n s1 e1 s2 e2 ...`; without numbers the whole sequence, with a lone one none."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(comment, F.lit("")), F.lit(r"(-?[0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    pairs = F.floor((F.size(numbers) - 1) / 2).cast("int")
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    listed = F.transform(F.sequence(F.lit(1), pairs), lambda i: span(F.get(numbers, 2 * i - 1), F.get(numbers, 2 * i)))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.when(F.size(numbers) == 0, F.array(span(F.lit(0), length - 1))).when(pairs < 1, none).otherwise(listed)


def in_exon(pos: Column, spans: Column) -> Column:
    return F.exists(spans, lambda x: (x["s"] <= pos) & (pos <= x["e"]))


def exonic_position(pos: Column, spans: Column) -> Column:
    """0-based place of a position within the joined exons; -1 outside."""
    before = F.aggregate(spans, F.lit(0), lambda a, x: a + F.when(x["e"] < pos, x["e"] - x["s"] + 1).when((x["s"] <= pos) & (pos <= x["e"]), pos - x["s"]).otherwise(0))
    return F.when(in_exon(pos, spans), before).otherwise(-1)


def separators(seq: Column) -> Column:
    """Positions of N, between the sentinels -1 and the length."""
    raw = seq.cast("binary")
    own = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(seq) - 1)), lambda i: F.substring(raw, i + 1, F.lit(1)) == F.lit(b"N"))
    return F.concat(F.array(F.lit(-1)), F.when(F.length(seq) > 0, own).otherwise(F.array().cast("array<int>")), F.array(F.length(seq)))


def crosses_separator(start: Column, end: Column, places: Column) -> Column:
    return F.exists(places, lambda p: (start <= p) & (p <= end))


def clamped_substring(seq: Column, start: Column, length: Column) -> Column:
    """Substring from a 0-based start that may lie outside; a negative length leaves that many bases off the end."""
    n = F.length(seq)
    begin = F.greatest(F.lit(0), F.when(start < 0, n + start).otherwise(start))
    stop = F.when(length < 0, n + length).otherwise(F.least(n, begin + length))
    return F.when(stop > begin, F.substring(seq, begin + 1, stop - begin)).otherwise("")


# flags of aligned records

def is_first_mate(flags: Column) -> Column:
    return (flags.bitwiseAND(0x80) == 0)


def is_reverse(flags: Column) -> Column:
    return flags.bitwiseAND(0x10) != 0


def is_primary(flags: Column) -> Column:
    return flags.bitwiseAND(0x900) == 0


def is_paired(flags: Column) -> Column:
    return flags.bitwiseAND(0x1) != 0


def is_aligned(flags: Column) -> Column:
    return flags.bitwiseAND(0x4) == 0


def template_aligned(flags: Column, tid: Column) -> Column:
    """Whether a record's fragment is aligned: not both mates unmapped, not an unmapped single read, and on a reference."""
    return ~((flags.bitwiseAND(0xD) == 0xD) | (flags.bitwiseAND(0x5) == 0x4) | (tid < 0))


def cigar_segments(pos: Column, cigar: Column) -> Column:
    """Closed reference segments of an alignment at a 0-based position: M, D, = and X extend, N splits, the rest is ignored."""
    ops = F.transform(
        F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)),
        lambda x: F.struct(F.regexp_extract(x, "([0-9]+)", 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")),
    )
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    state = F.struct(pos.cast("long").alias("start"), pos.cast("long").alias("at"), empty.alias("done"))
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))

    def step(s, x):
        grow = x["op"].isin("M", "D", "=", "X")
        cut = x["op"] == "N"
        done = F.when(cut & (s["at"] > s["start"]), F.concat(s["done"], span(s["start"], s["at"] - 1))).otherwise(s["done"])
        at = F.when(grow | cut, s["at"] + x["n"]).otherwise(s["at"])
        return F.struct(F.when(cut, at).otherwise(s["start"]).alias("start"), at.alias("at"), done.alias("done"))

    return F.aggregate(ops, state, step, lambda s: F.when(s["at"] > s["start"], F.concat(s["done"], span(s["start"], s["at"] - 1))).otherwise(s["done"]))
