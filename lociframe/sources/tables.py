"""Genotype, frequency, coordinate and database files, and the writers of results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import common, variants
from ..operators.refbuild import header
from .fastx import numbered


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """(sample, gene, slot, ord, alleles, abundance, quality, and both as written) of tab-separated genotype files.

    A file is a sample. Slots are those the number of alleles allows; numbers that can't be read are 0, lines without a
    gene or a number of alleles are left out.
    """
    f = F.split("line", "\t")
    rows = numbered(spark, path).select(variants.sample_name(F.col("file")).alias("sample"), "n", f.alias("f"), F.expr("try_cast(trim(get(split(line, '\t'), 1)) AS int)").alias("k"))
    rows = rows.where("size(f) >= 2 AND f[0] <> '' AND k IS NOT NULL")
    slot = lambda i, at: F.when((F.col("k") > i) & (F.size("f") > at + 2), F.struct(F.lit(i + 1).alias("slot"), *(F.get("f", F.lit(at + j)).alias(c) for j, c in enumerate(("a", "x", "q")))))
    own = rows.select("sample", F.col("f")[0].alias("gene"), "n", F.explode(F.filter(F.array(slot(0, 2), slot(1, 5)), lambda s: s.isNotNull())).alias("s"))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0))
    return own.select("sample", "gene", F.col("s.slot").alias("slot"), F.col("n").alias("ord"), F.split("s.a", ",").alias("alleles"), number("s.x").alias("abundance"), number("s.q").alias("quality"), F.col("s.x").alias("abundance_raw"), F.col("s.q").alias("quality_raw"))


def read_copies(spark: SparkSession, path: str) -> DataFrame:
    """(sample, gene, slot, ord, allele, abundance, quality) for copy numbers: split at any space, allele sets as one name.

    Slots after the second read the second's columns again; a slot with a number that can't be read is left out.
    """
    rows = numbered(spark, path).select(variants.sample_name(F.col("file")).alias("sample"), "n", F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+").alias("f"))
    rows = rows.withColumn("k", F.expr("try_cast(get(f, 1) AS int)")).where("k IS NOT NULL AND k > 0")
    own = rows.select("sample", F.col("f")[0].alias("gene"), "n", "f", F.explode(F.sequence(F.lit(1), "k")).alias("slot"))
    at = F.when(F.col("slot") == 1, 2).otherwise(5)
    get = lambda j: F.get("f", at + j)
    own = own.select("sample", "gene", "slot", (F.col("n") * 100 + F.col("slot")).alias("ord"), get(0).alias("allele"), get(1).alias("x"), get(2).alias("q"))
    return own.select("sample", "gene", "slot", "ord", "allele", F.expr("try_cast(x AS double)").alias("abundance"), F.expr("try_cast(q AS int)").alias("quality")).where("abundance IS NOT NULL AND quality IS NOT NULL")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(locus, fields, n) of an allele-frequency table; see operators.frequency.read_table."""
    from ..operators import frequency

    return frequency.read_table(numbered(spark, path).select("line", F.col("n").alias("ord")))


def read_gtf(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(gene, chrom, start, end, strand): the first `gene` row of each gene name, with `chr` before a bare chromosome."""
    f = F.split("line", "\t")
    rows = numbered(spark, path).where("line NOT LIKE '#%'").select("n", f.alias("f")).where("size(f) >= 9 AND f[2] = 'gene'")
    named = F.regexp_extract(F.col("f")[8], 'gene_name "([^"]*)"', 1)
    gene = named
    for a, b in (aliases if aliases is not None else {"HFE": "HLA-HFE"}).items():
        gene = F.when(named == a, b).otherwise(gene)
    chrom = F.when(F.col("f")[0].startswith("c"), F.col("f")[0]).otherwise(F.concat(F.lit("chr"), F.col("f")[0]))
    place = F.struct("n", chrom.alias("chrom"), F.col("f")[3].cast("long").alias("start"), F.col("f")[4].cast("long").alias("end"), F.substring(F.col("f")[6], 1, 1).alias("strand"))
    first = rows.groupBy(gene.alias("gene")).agg(F.min(place).alias("p"))
    return first.select("gene", "p.chrom", "p.start", "p.end", "p.strand")


def parse_database(text: str):
    """(name, exons as 0-based closed pairs, partial, sequence) of one entry of an EMBL flat file; None without allele or exons."""
    name, exons, partial, seq, reading = None, [], False, [], False
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("ID"):
            name, exons, partial, seq, reading = None, [], False, [], False
        elif reading:
            seq += line.split()[:-1]
        elif line.startswith("SQ"):
            reading = True
        elif line.startswith("FT"):
            if m := re.search(r'allele="([^"]*)"', line):
                name = m[1]
            elif " exon " in line:
                word = (line.split() + ["", "", ""])[2]
                if len(at := re.findall("[0-9]+", word)) >= 2:
                    exons.append((int(at[0]) - 1, int(at[1]) - 1))
            elif line.rstrip().endswith("pseudo"):
                exons = exons[:-1]
            elif " intron " not in line and line.rstrip().endswith("partial"):
                partial = True
    return (name, exons, partial, "".join(seq)) if name and exons and reading else None


def read_database(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, exons, partial, seq) of a database in EMBL format; entries end in `//`, where the file is split."""
    common.ship(spark)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            rows = [(o, *r) for o, t in zip(batch.column("ord").to_pylist(), batch.column("value").to_pylist(), strict=True) if (r := parse_database(t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([[{"s": s, "e": e} for s, e in r[2]] for r in rows], kind), pa.array([r[3] for r in rows], pa.bool_()), pa.array([r[4] for r in rows], pa.string())],
                ["ord", "name", "exons", "partial", "seq"],
            )

    rows = numbered(spark, path, "\n//").select(F.col("n").alias("ord"), F.col("line").alias("value"))
    return rows.mapInArrow(run, "ord long, name string, exons array<struct<s:int,e:int>>, partial boolean, seq string")


# writers: text in a stated order; write_text() of fastx puts it into files


def genotype_lines(calls: DataFrame) -> DataFrame:
    """(ord, value) of calls as operators.genotype returns them, one sample."""
    number = lambda c, x: F.when(F.col(c) >= 0, F.format_string("%.6f", x)).otherwise("0")
    value = F.concat_ws("\t", "gene", F.col("num_alleles").cast("string"), "allele1", number("quality1", "abundance1"), F.col("quality1").cast("string"), "allele2", number("quality2", "abundance2"), F.col("quality2").cast("string"), "secondary")
    return calls.select(F.col("gene").alias("read_id"), value.alias("value"))


def allele_lines(chosen: DataFrame) -> DataFrame:
    """(read_id, value): name and quality of the chosen alleles (seq_idx, name, quality)."""
    return chosen.select(F.col("seq_idx").alias("read_id"), F.concat_ws(" ", "name", F.col("quality").cast("string")).alias("value"))


def panel_lines(panel: DataFrame) -> DataFrame:
    """(read_id, value): the panel's FASTA."""
    return panel.select(F.col("seq_idx").alias("read_id"), F.concat(header(F.col("name"), F.col("exons")), F.lit("\n"), "seq").alias("value"))


def coordinate_lines(annotated: DataFrame) -> DataFrame:
    """(read_id, value): the panel's FASTA with places of genes in its headers."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "name", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "strand"))
    return annotated.select(F.col("seq_idx").alias("read_id"), F.concat(head, F.lit("\n"), "seq").alias("value"))


def matrix_lines(wide: DataFrame) -> DataFrame:
    """(read_id, value): the cohort matrix, header first."""
    body = wide.select(F.concat(F.lit("1"), "sample").alias("read_id"), F.concat_ws("\t", *(F.col(f"`{c}`") for c in wide.columns)).alias("value"))
    top = wide.sparkSession.createDataFrame([("0", "\t".join(wide.columns))], "read_id string, value string")
    return top.unionByName(body)
