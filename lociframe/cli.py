"""Command line: build, extract, genotype, analyze, run, combine and copy-number.

Tables are written as folders of text, `PREFIX_genotype.tsv/` and so on, in any store that Spark reaches; combine and
copy-number print.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import common, genotype, variants
from .plans import pipeline
from .sources import fastx, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lociframe", description="Genotyping of immune genes from sequencing reads")
    sub = top.add_subparsers(dest="command", required=True)

    def reads(p):
        p.add_argument("-1", "--read1")
        p.add_argument("-2", "--read2")
        p.add_argument("-u", "--single-end")
        p.add_argument("-s", "--similarity", type=float, default=0.8)
        p.add_argument("-t", "--threads", type=int, default=1, help="accepted for compatibility; Spark's master decides")

    def calling(p):
        p.add_argument("-n", "--max-alleles-per-read", type=int, default=2000)
        p.add_argument("--prefilter-frac", type=float, default=0.0)
        p.add_argument("--filter-frac", "--frac", type=float, default=0.15)
        p.add_argument("--filter-cov", "--cov", type=float, default=1.0)
        p.add_argument("--cross-gene-rate", "--crossGeneRate", type=float, default=0.04)
        p.add_argument("--emit-metrics", action="store_true")
        p.add_argument("--allele-freq")
        p.add_argument("--allele-freq-weight", type=float, default=2.0)
        p.add_argument("--allele-freq-null-penalty", type=float, default=0.0)

    def aligned_input(p):
        p.add_argument("-b", "--bam")
        p.add_argument("-c", "--gene-coord-fasta")
        p.add_argument("--bam-mode", choices=("alignment", "no-alignment"), default="alignment")
        p.add_argument("--abnormal-unmapped", action="store_true")
        p.add_argument("--mate-id-suffix-len", type=int, default=-1)

    p = sub.add_parser("build", help="reference tables from a database and gene annotation")
    p.add_argument("-d", "--dat", required=True)
    p.add_argument("-g", "--gtf", required=True)
    p.add_argument("--output-dir", "--od", required=True)
    p.add_argument("--prefix", required=True)
    p = sub.add_parser("extract", help="candidate reads")
    reads(p)
    aligned_input(p)
    p.add_argument("-i", "--input", nargs="+")
    p.add_argument("-f", "--ref-seq-fasta", required=True)
    p.add_argument("-o", "--prefix", default="toassemble")
    for name in ("genotype", "run"):
        p = sub.add_parser(name, help="alleles of each gene" if name == "genotype" else "extract, genotype and analyze at once")
        reads(p)
        calling(p)
        if name == "run":
            aligned_input(p)
        p.add_argument("-f", "--ref-seq-fasta", required=True)
        p.add_argument("-o", "--prefix", default="sample")
    p = sub.add_parser("analyze", help="novel variants")
    reads(p)
    p.add_argument("-f", "--ref-seq-fasta", required=True)
    p.add_argument("-a", "--allele-file", required=True)
    p.add_argument("-o", "--prefix", default="sample")
    p.add_argument("-n", "--max-alleles-per-read", type=int, default=2000)
    p.add_argument("--max-variant-group", "--varMaxGroup", type=int, default=8)
    p = sub.add_parser("combine", help="matrix of many samples")
    p.add_argument("-l", "--input-list", required=True)
    p.add_argument("-n", "--num-alleles", type=int, default=2)
    p.add_argument("-q", "--min-quality", type=float, default=0.0)
    p.add_argument("--total-quality", type=float, default=30.0)
    p = sub.add_parser("copy-number", help="copies of each allele")
    p.add_argument("-g", "--genotype", required=True)
    p.add_argument("--nomissing", default="")
    p.add_argument("--upper-quantile", type=float, default=0.3)
    p.add_argument("--lower-quantile", type=float, default=0.0)
    p.add_argument("--adjust-var", type=float, default=1.0)
    p.add_argument("-q", "--min-quality", type=int, default=0)
    return top


def fragments(spark, a):
    """The reads that the arguments name; ValueError unless they are single or paired, not both."""
    given = getattr(a, "input", None)
    if given:
        if a.read1 or a.read2 or a.single_end:
            raise ValueError("-i stands alone")
        return pipeline.load_fragments(spark, *given)
    if a.single_end:
        if a.read1 or a.read2:
            raise ValueError("give -u or -1 and -2, not both")
        return pipeline.load_fragments(spark, a.single_end, interleaved=False)
    if not a.read1 or not a.read2:
        raise ValueError("give -u, or both -1 and -2")
    return pipeline.load_fragments(spark, a.read1, a.read2)


def settings(a, spark=None, panel=None) -> pipeline.Settings:
    get = lambda k, d: getattr(a, k, d)
    freq = None
    if get("allele_freq", None):
        freq = pipeline.priors(pipeline.described(panel), tables.read_frequencies(spark, a.allele_freq))
    options = genotype.Options(get("filter_frac", 0.15), get("filter_cov", 1.0), get("cross_gene_rate", 0.04), prior_weight=get("allele_freq_weight", 2.0), null_penalty=get("allele_freq_null_penalty", 0.0), frequency=freq)
    return pipeline.Settings(a.similarity, get("max_alleles_per_read", 2000), options, get("max_variant_group", 8), get("prefilter_frac", 0.0))


def write_candidates(found, prefix: str) -> None:
    paired = "seq2" in found.columns
    for k in (1, 2) if paired else (1,):
        fastx.write_text(fastx.fastq_text(found, "name", f"seq{k}", f"qual{k}"), f"{prefix}_{k}.fq" if paired else f"{prefix}.fq")


def extracted(spark, a, panel, s):
    if a.bam:
        genes = None
        if a.bam_mode == "alignment":
            if not a.gene_coord_fasta:
                raise ValueError("the alignment mode needs -c")
            rows = fastx.read_fasta(spark, a.gene_coord_fasta)
            f = F.split("comment", " ")
            bad = F.size(f) != 4
            genes = rows.select("name", F.when(bad, F.raise_error(F.concat(F.lit("not a coordinate header: "), "name"))).otherwise(f[0]).alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))
        found = pipeline.extract_alignments(spark, a.bam, panel, genes, s, a.bam_mode == "no-alignment", a.abnormal_unmapped, None if a.mate_id_suffix_len < 0 else a.mate_id_suffix_len)
        return found.select(F.xxhash64("qname").alias("read_id"), F.col("qname").alias("name"), "seq1", "qual1", "seq2", "qual2", F.lit("sample").alias("sample"))
    return pipeline.candidate_reads(fragments(spark, a), panel, s)


def write_calls(run, prefix: str, metrics: bool) -> None:
    fastx.write_text(tables.genotype_lines(run.calls()), f"{prefix}_genotype.tsv")
    fastx.write_text(tables.allele_lines(run.chosen()), f"{prefix}_allele.tsv")
    own = run.aligned_fragments()
    paired = own.where("seq2 is not null").limit(1).count() > 0
    for k in (1, 2) if paired else (1,):
        text = own.select("read_id", F.concat(F.lit(">"), F.coalesce("name", F.col("read_id").cast("string")), F.lit("\n"), f"seq{k}").alias("value"))
        fastx.write_text(text, f"{prefix}_aligned_{k}.fa" if paired else f"{prefix}_aligned.fa")
    if metrics:
        own = run.metrics().drop("sample")
        line = F.concat_ws("\t", *(F.format_string("%.6f", c) if t == "double" else F.col(c).cast("string") for c, t in own.dtypes))
        top = own.sparkSession.createDataFrame([("0", "\t".join(own.columns))], "read_id string, value string")
        fastx.write_text(top.unionByName(own.select(F.concat(F.lit("1"), "gene", F.col("allele_rank").cast("string")).alias("read_id"), line.alias("value"))), f"{prefix}_metrics.tsv")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lociframe").getOrCreate()
    common.ship(spark)
    if a.command == "build":
        out = pipeline.build_reference(spark, a.dat, a.gtf)
        for kind in ("dna", "rna"):
            fastx.write_text(tables.panel_lines(out[f"{kind}_seq"]), f"{a.output_dir}/{a.prefix}_{kind}_seq.fa")
            fastx.write_text(tables.coordinate_lines(out[f"{kind}_coord"]), f"{a.output_dir}/{a.prefix}_{kind}_coord.fa")
    elif a.command == "extract":
        panel = fastx.read_panel(spark, a.ref_seq_fasta)
        write_candidates(extracted(spark, a, panel, settings(a)), a.prefix)
    elif a.command in ("genotype", "run"):
        panel = common.stored(fastx.read_panel(spark, a.ref_seq_fasta), "panel")
        s = settings(a, spark, panel)
        reads = common.stored(extracted(spark, a, panel, s), "candidates") if a.command == "run" else fragments(spark, a)
        run = pipeline.Run(reads, panel, s)
        write_calls(run, a.prefix, a.emit_metrics)
        if a.command == "run":
            found = pipeline.analyze(run.aligned_fragments(), panel, run.chosen(), s)
            variants.variant_lines(found).coalesce(1).write.mode("overwrite").text(f"{a.prefix}_allele.vcf")
    elif a.command == "analyze":
        names = fastx.numbered(spark, a.allele_file).select(F.regexp_extract("line", r"^(\S+)", 1).alias("name")).where("name <> ''")
        panel = common.stored(fastx.read_panel(spark, a.ref_seq_fasta, names), "panel")
        found = pipeline.analyze(fragments(spark, a), panel, names, settings(a))
        variants.variant_lines(found).coalesce(1).write.mode("overwrite").text(f"{a.prefix}_allele.vcf")
    elif a.command == "combine":
        paths = [r.value.strip() for r in spark.read.text(a.input_list).collect() if r.value.strip()]
        wide = pipeline.combine_files(spark, paths, a.num_alleles, a.min_quality, a.total_quality)
        for r in tables.matrix_lines(wide).orderBy("read_id").toLocalIterator():
            print(r.value)
    else:
        own = pipeline.copy_number_file(spark, a.genotype, [g for g in a.nomissing.split(",") if g], a.lower_quantile, a.upper_quantile, a.adjust_var, a.min_quality)
        for r in own.orderBy("line").toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
