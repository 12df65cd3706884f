"""The engine's commands as functions from DataFrames to DataFrames: extract, genotype, analyze, run, combine, copy number, build."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import maths
from ..functions import sequence as S
from ..operators import assign, cohort, common, extract, frequency, genotype, kmer, mapping, refbuild, variants
from ..sources import aligned, fastx, formats, tables

#: k-mer lengths of the panel's index and of the similarity between genes
INDEX_K, PROFILE_K = 11, 31


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    max_alleles: int = 2000
    options: genotype.Options = field(default_factory=genotype.Options)
    max_group: int = 8
    #: share of the similarity that an overlap's anchors must reach before it is aligned; 0 aligns all
    prefilter: float = 0.0

    def __post_init__(self):
        maths.check_range("prefilter", self.prefilter, 0, 1)
        maths.check_range("similarity", self.similarity, 0, 1)
        maths.check_range("filter fraction", self.options.filter_frac, 0, 1)
        maths.check_range("filter coverage", self.options.filter_cov, 0, 1e9)
        maths.check_range("cross-gene rate", self.options.cross_gene_rate, 0, 1)
        maths.check_range("prior weight", self.options.prior_weight, 0, 1e9)
        maths.check_range("null penalty", self.options.null_penalty, 0, 16)
        if self.max_alleles < 0 or self.max_group < -1:
            raise ValueError("limits can't be negative")


def described(panel: DataFrame) -> DataFrame:
    """The panel (seq_idx, name, exons, seq, weight) with gene, major, exonic, null, consensus and corrected length."""
    name = F.col("name")
    fields = name.contains(":")
    own = panel.withColumns(
        {
            "gene": S.gene(name), "major": F.when(fields, S.major_allele(name)).otherwise(S.major_allele(name, digits=3)), "exonic": F.when(fields, S.major_allele(name)).otherwise(S.major_allele(name, digits=5)),
            "null": S.null_expression(name), "consensus": F.length("seq"), "effective": S.effective_length(F.col("seq")),
        }
    )
    fixed = assign.length_mode(own.select("seq_idx", "gene", F.col("effective").alias("length"))).select("seq_idx", F.col("fixed").alias("length"))
    return common.stored(own.join(fixed, "seq_idx").withColumn("missing", F.lit(0)), "panel")


def gene_similarity(panel: DataFrame, k: int = PROFILE_K) -> dict[tuple[str, str], float]:
    """(gene, other) -> share of the gene's k-mers that the other has, over the genes' representative sequences."""
    own = panel.join(assign.representative(panel), ["gene", "seq_idx"], "left_semi")
    names = {r.seq_idx: r.gene for r in own.select("seq_idx", "gene").collect()}
    out = {}
    for r in kmer.similarity(kmer.profiles(own, k)).collect():  # pairs of genes
        out[names[r.a], names[r.b]], out[names[r.b], names[r.a]] = r.a_in_b, r.b_in_a
    return out


def required_hits(fragments: DataFrame, aligned_input: bool = False, head: int = 1000) -> int:
    """The bases that hits must cover, from the mean length of the first reads."""
    mean = fragments.orderBy("read_id").limit(head).agg(F.avg(F.length("seq1"))).first()[0] or 0
    return maths.hit_length(mean, "seq2" in fragments.columns, aligned_input)


def candidate_reads(fragments: DataFrame, panel: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return extract.candidates(fragments, panel, settings.similarity)


class Run:
    """One call of many samples: fragments (sample, read_id, seq1, seq2 or null) against a panel.

    Placements and pileups are written to the shared folder, as calls, chosen alleles, metrics and variants all read them;
    each is made when it is first asked for.
    """

    def __init__(self, fragments: DataFrame, panel: DataFrame, settings: Settings = Settings()):
        self.fragments, self.settings = fragments if "seq2" in fragments.columns else fragments.withColumn("seq2", F.lit(None).cast("string")), settings
        self.panel = described(panel)
        self.hit_length = max(27, INDEX_K)
        self._stats = None

    @cached_property
    def _near(self) -> tuple[DataFrame, int]:
        """Fragments that may have a placement, and the longest first mate of all: one pass over the fragments for all results."""
        seen = Observation()
        own = self.fragments.observe(seen, F.max(F.length("seq1")).alias("longest"))
        near = common.stored(mapping.near_panel(own, self.panel, self.hit_length, INDEX_K), "near")
        return near, int(seen.get["longest"] or 0)

    @cached_property
    def options(self) -> genotype.Options:
        return replace(self.settings.options, read_length=self._near[1])

    @cached_property
    def hits(self) -> DataFrame:
        s = self.settings
        return common.stored(mapping.fragment_assignments(self._near[0], self.panel, self.hit_length, INDEX_K, s.similarity, s.max_alleles, s.prefilter), "hits")

    @cached_property
    def similar(self) -> dict[tuple[str, str], float]:
        return gene_similarity(self.panel)

    def coverage(self) -> DataFrame:
        """(sample, seq_idx, cov_min, cov_p10, cov_median, frac_covered, missing) over exon bases."""
        if self._stats is None:
            mates = self._near[0].select("sample", F.explode(F.array("seq1", "seq2")).alias("seq")).where("seq is not null")
            # each distinct sequence is aligned once, whatever its sample
            piled = common.stored(mapping.sample_pileup(mates, self.panel, self.hit_length, INDEX_K, self.settings.similarity), "pileup")
            cells = mapping.exon_cells_by_sample(piled, self.panel)
            key = F.concat_ws("\x01", "sample", F.col("seq_idx").cast("string"))
            own = assign.coverage_stats(cells.select(key.alias("seq_idx"), "depth"))
            parts = F.split("seq_idx", "\x01")
            self._stats = common.stored(own.withColumns({"sample": parts[0], "seq_idx": parts[1].cast("long")}), "coverage")
        return self._stats

    def _called(self, output: str) -> DataFrame:
        missing = self.coverage().select("sample", "seq_idx", "missing")
        return genotype.genotype(self.hits, self.panel, self.options, self.similar, missing, output)

    def calls(self) -> DataFrame:
        return self._called("calls")

    def chosen(self) -> DataFrame:
        return self._called("chosen")

    def metrics(self) -> DataFrame:
        """The nineteen columns of the metrics table, after sample."""
        stats = self.coverage().select("sample", "seq_idx", "cov_min", "cov_p10", "cov_median", F.col("frac_covered").alias("frac_bases_covered"))
        own = self._called("metrics").join(stats, ["sample", "seq_idx"], "left")
        return own.select(
            "sample", "gene", "allele_rank", "allele", "abundance", "balance_ratio", "cov_min", "cov_p10", "cov_median", "frac_bases_covered", "missing_cov", "gt_quality", "runnerup_abundance", "q_gap", "q_min",
            "locus_gq_min", "ec_set_size", "identifiability", "ec_ambiguity_entropy", "series_set",
        )

    def aligned_fragments(self) -> DataFrame:
        """Fragments with a placement."""
        return self.fragments.join(self.hits.select("sample", "read_id").distinct(), ["sample", "read_id"], "left_semi")


def analyze(fragments: DataFrame, panel: DataFrame, chosen: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Novel variants of one sample's aligned fragments against its chosen alleles (name, quality)."""
    own = panel.join(chosen.select("name").distinct(), "name", "left_semi")
    run = Run(fragments, own, settings)
    abundance = {r.seq_idx: r.ec_abundance for r in run.panel.select("seq_idx").join(class_abundance(run), "seq_idx").collect()}
    frags = run.fragments.select(F.col("read_id").alias("frag"), "seq1", "seq2")
    return variants.call_variants(frags, run.panel, abundance, run.hit_length, settings.max_group, INDEX_K, settings.similarity)


def class_abundance(run: Run) -> DataFrame:
    """(seq_idx, ec_abundance) of a run's alleles after EM, for all alleles of the panel."""
    chosen = run._called("chosen").select("seq_idx", "ec_abundance")
    return run.panel.select("seq_idx").join(chosen, "seq_idx", "left").select("seq_idx", F.coalesce("ec_abundance", F.lit(1e-6)).alias("ec_abundance"))


def priors(majors_of: DataFrame, table: DataFrame) -> dict[str, float]:
    """Frequencies of the panel's major alleles, for Options.frequency."""
    return frequency.major_frequencies([r.major for r in majors_of.select("major").distinct().collect()], table)


# file level


def load_fragments(spark: SparkSession, first: str, second: str | None = None, sample: str = "sample", interleaved: bool | None = None) -> DataFrame:
    """Fragments of FASTQ or FASTA files: single, paired, or interleaved (found by the first two names if None)."""
    kind = formats.kind(spark, first)
    if kind not in ("fastq", "fasta"):
        raise ValueError(f"{first} is {kind}; reads are FASTQ or FASTA")
    read = fastx.read_fastq if kind == "fastq" else fastx.read_any
    a = read(spark, first)
    if second is not None:
        if interleaved:
            raise ValueError("an interleaved file has no second one")
        out = fastx.pairs(a, read(spark, second))
    elif interleaved or (interleaved is None and fastx.looks_interleaved(a)):
        out = fastx.interleaved(a)
    else:
        out = a.withColumnsRenamed({"seq": "seq1", "qual": "qual1"}).select("read_id", "name", "seq1", "qual1")
    return out.withColumn("sample", F.lit(sample))


def extract_alignments(spark: SparkSession, path: str, panel: DataFrame, genes: DataFrame, settings: Settings = Settings(), no_alignment: bool = False, abnormal: bool = False, suffix: int | None = None) -> DataFrame:
    """Candidate fragments of a SAM or BAM file; genes (gene, chrom, start, end) come with the alignment mode."""
    kind = formats.kind(spark, path)
    if kind == "cram":
        raise ValueError("CRAM needs a decoder that is not available here; convert it to BAM")
    if kind not in ("sam", "bam"):
        raise ValueError(f"{path} is {kind}; aligned reads are SAM or BAM")
    header, records = aligned.read_sam(spark, path) if kind == "sam" else aligned.read_bam(spark, path)
    if suffix is not None:
        records = records.withColumn("qname", S.without_mate(F.col("qname"), suffix))
    records = common.stored(records, "records")
    sample = extract.read_length_sample(records).first()
    mean = (sample.bases or 0) / max(1, sample.reads or 0)
    stats = extract.library_stats(records).first()
    hits = maths.hit_length(mean, bool(stats and stats.paired), True)
    k = max(9, maths.infer_kmer_length(panel.agg(F.sum(F.length("seq"))).first()[0] or 0))
    if no_alignment:
        return extract.without_alignments(records, panel, settings.similarity, hits, k)
    names = aligned.sequences(header)
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "chrom string, tid int")
    wanted = genes.where("start >= 0").select(F.col("chrom").alias("name")).distinct()
    place = extract.resolve_chromosomes(wanted, known).join(known, "chrom").select("name", "tid")
    spans = genes.where("start >= 0").join(place, F.col("chrom") == F.col("name")).select(F.col("tid").alias("chrom"), F.col("start").cast("long").alias("g_start"), F.col("end").cast("long").alias("g_end"))
    return extract.from_alignments(records, spans, panel, settings.similarity, hits, k, abnormal, alternative(known, records))


def alternative(known: DataFrame, records: DataFrame) -> Column:
    """Whether a record lies on an alternative contig; as many numbers as the header has such names."""
    ids = [r.tid for r in known.where(S.alternative_contig(F.col("chrom"))).collect()]
    return records["tid"].isin(ids) if ids else F.lit(False)


def combine_files(spark: SparkSession, paths: list[str], per_gene: int = 2, min_quality: float = 0, min_total: float = 30) -> DataFrame:
    """The cohort matrix of genotype files."""
    calls = common.stored(tables.read_calls(spark, paths), "calls")
    return cohort.matrix(calls, per_gene, min_quality, min_total)


def copy_number_file(spark: SparkSession, path: str, nomissing: list[str], low: float = 0.0, high: float = 0.3, adjust_var: float = 1.0, min_quality: float = 0) -> DataFrame:
    """Copy-number lines of a genotype file."""
    calls = common.stored(tables.read_copies(spark, path), "calls")
    fit = cohort.one_copy(calls, nomissing, low, high, adjust_var, min_quality)
    return cohort.copy_rows(calls, cohort.copy_numbers(calls, fit, min_quality), min_quality)


def build_reference(spark: SparkSession, database: str, gtf: str) -> dict[str, DataFrame]:
    """dna_seq, dna_coord, rna_seq and rna_coord of a database and gene annotation."""
    return refbuild.build_all(common.stored(tables.read_database(spark, database), "database"), tables.read_gtf(spark, gtf))
