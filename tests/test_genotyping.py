"""Kernels, the caller, reference building, files and the whole path from reads to calls."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lociframe import cli
from lociframe.functions import maths
from lociframe.functions import sequence as S
from lociframe.operators import align, assign, cohort, common, components, extract, frequency, genotype, kmer, mapping, refbuild, variants
from lociframe.plans import pipeline
from lociframe.sources import aligned, fastx, formats, tables
from lociframe.streaming.candidates import candidate_stream


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def column(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


# functions


def test_sequence_functions(spark):
    one = lambda f, s: column(spark, f(F.col("s")), s=s)
    assert [one(S.effective_length, s) for s in ("ACGT", "ACNNNNGT", "NNAC", "ACNNGTNN")] == [4, 5, 2, 6]
    assert one(S.reverse_complement, "ACGTNX") == "NNACGT"
    assert one(S.kmer_code, "ACGT") == 0b00011011 and one(S.kmer_code, "ACNT") is None
    assert one(lambda c: S.kmers(c, 3), "ACGTA") == ["ACG", "CGT", "GTA"] and one(lambda c: S.kmers(c, 3), "AC") == []
    assert one(S.low_complexity, "ACGTACGTA") is True and one(S.low_complexity, "ACGT" * 10) is False and one(S.low_complexity, "AAAC" * 10) is True
    assert one(S.low_complexity_span, "A" * 20 + "C" * 3) is True and one(S.low_complexity_span, "ACGT" * 5) is False
    assert [one(S.null_expression, s) for s in ("HLA-A*01:01N", "HLA-A*01:01", "A01N")] == [True, False, False]
    assert one(S.major_allele, "HLA-A*01:02:03:04") == "HLA-A*01:02:03" and one(lambda c: S.major_allele(c, digits=3), "KIR2DL1*0010101") == "KIR2DL1*001"
    assert [one(S.without_mate, s) for s in ("r/1", "r/2", "r/3", "r")] == ["r", "r", "r/3", "r"] and one(lambda c: S.without_mate(c, 2), "read") == "re"
    spans = lambda t, n: [tuple(x) for x in column(spark, S.exons(F.col("t"), F.col("n")), t=t, n=n)]
    assert spans("2 3 5 9 12", 20) == [(3, 5), (9, 12)] and spans("", 20) == [(0, 19)] and spans("7", 20) == []
    seg = lambda c: [tuple(x) for x in column(spark, S.cigar_segments(F.col("p"), F.col("c")), p=100, c=c)]
    assert seg("10M5N10M") == [(100, 109), (115, 124)] and seg("3S10M2I3D4M2H") == [(100, 116)] and seg("*") == []
    assert [column(spark, S.clamped_substring(F.col("s"), F.col("a"), F.col("n")), s="ABCDEF", a=a, n=n) for a, n in ((1, 3), (4, 9), (0, -2), (9, 1))] == ["BCD", "EF", "ABCD", ""]


def test_maths(spark):
    from statistics import NormalDist

    for z in (-9.0, -3.0, -0.5, 0.0, 1.0, 1.28, 1.5, 3.0, 6.9, 8.0):
        want = 1 - NormalDist().cdf(z) if z < 5 else None
        assert maths.normal_tail_value(z) == pytest.approx(column(spark, maths.normal_tail(F.col("z")), z=z), abs=1e-15)
        if want is not None:
            assert maths.normal_tail_value(z) == pytest.approx(want, abs=1e-7)
    assert [column(spark, maths.discriminative_phred(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((10.0, 0.0), (9.0, 1.0), (1.0, 99.0))] == [60, 10, 0]
    assert [column(spark, maths.python_float(F.col("x")), x=x) for x in (50.0, 0.5, 1e7, 12345678.0)] == ["50.0", "0.5", "10000000.0", "12345678.0"]
    assert maths.hit_length(100, True) == 27 and maths.hit_length(200, False) == 40 and maths.hit_length(50, False, True) == 17
    assert maths.infer_kmer_length(4**5) == 7
    with pytest.raises(ValueError):
        maths.check_range("x", float("nan"), 0, 1)


def test_drand48():
    r = maths.Rand48(17)
    first = r.next()
    assert first == ((0x5DEECE66D * ((17 << 16) | 0x330E) + 0xB) % 2**48) / 2**48 and len(maths.Rand48(17).bases(50)) == 50


# kernels


def plain_score(a, b):
    """Best score of a global alignment with affine gaps, without a band; gaps at the start cost an opening a base."""
    low = -(10**9)
    n, m = len(a), len(b)
    best = [[low] * (n + 1) for _ in range(m + 1)]
    ins, dele = [[low] * (n + 1) for _ in range(m + 1)], [[low] * (n + 1) for _ in range(m + 1)]
    best[0][0] = 0
    for i in range(m + 1):
        for j in range(n + 1):
            if i:
                ins[i][j] = max(ins[i - 1][j] - 1, best[i - 1][j] - 5)
            if j:
                dele[i][j] = max(dele[i][j - 1] - 1, best[i][j - 1] - 5)
            if i and j:
                best[i][j] = best[i - 1][j - 1] + (2 if align.same(a[j - 1], b[i - 1]) else -2)
            best[i][j] = max(best[i][j], ins[i][j], dele[i][j]) if i or j else 0
    return best[m][n]


def ops_score(ops, a, b):
    score, i, j, before = 0, 0, 0, None
    for op in ops:
        if op in (align.EQ, align.SUB):
            assert align.same(a[j], b[i]) == (op == align.EQ)
            score += 2 if op == align.EQ else -2
            i, j = i + 1, j + 1
        else:
            score -= 1 if op == before else 5
            i, j = (i + 1, j) if op == align.INS else (i, j + 1)
        before = op
    assert (i, j) == (len(b), len(a))
    return score


def test_affine_alignment():
    assert align.align("", "ACG") == () and align.align("A", "C") == (align.SUB,) and align.align("ACGN", "ACGT") == (align.EQ,) * 4
    assert align.align("ACGTACGTAA", "ACGTCGTAA") == (0, 0, 0, 0, 3, 0, 0, 0, 0, 0)
    r = random.Random(1)
    for _ in range(200):
        a = bases(r, r.randint(8, 30))
        b = list(a)
        k = r.randrange(3, len(b) - 2)
        if r.random() < 0.5:
            b[k:k] = bases(r, r.randint(1, 4))
        else:
            del b[k : k + r.randint(1, 3)]
        b = "".join(b)
        ops = align.align(a, b)
        if ops and ops[0] < 2 and ops[-1] < 2:  # inner gaps, for which border costs play no part
            assert ops_score(ops, a, b) >= plain_score(a, b) - 4


@pytest.mark.parametrize(
    "allele, read, band, want",
    [
        # fixed values: expected operations of single cases
        ("ACGTACGTACGTACGT", "ACGTACCGTACGTACGTACGT", 5, "022222000000000000000"),
        ("ACGTACCGTACGTACGTACGT", "ACGTACGTACGTACGT", 5, "033333000000000000000"),
        ("ACGTACGTTTACGTACGTACGGGTACGT", "ACGAACGTACGTACGCACGTACGT", 5, "0001000330000000010033000000"),
        ("ACGTNACGTACGT", "ACGTAACGTNCGT", 5, "0000000000000"),
        ("ACGTACGTAACGTACGTACGTACGT", "ACGTACGTACGTACGTACGTACGT", 2, "0000000030000000000000000"),
        ("AAAAAAAAAAAAAAAA", "AAAAAAAAAAAAAAAAA", 1, "02000000000000000"),
        ("ACGTACGT", "ACGTACGTACGTACGTACGT", 5, "02222222222220000000"),
        ("ACGTACGTACGTACGTACGT", "ACGTACGT", 5, "03333333333330000000"),
        ("GGGGGGGGG", "G", 5, "033333333"),
        ("AC", "AG", 5, "01"),
    ],
)
def test_alignment_cases(allele, read, band, want):
    got = "".join(map(str, align.align(allele, read, band)))
    assert got == want


def columns_of(seq, **other):
    own = [tuple(10 * (c == b) for b in "ACGT") for c in seq]
    for at, counts in other.items():
        own[int(at[1:])] = counts
    return own


@pytest.mark.parametrize(
    "columns, read, want",
    # fixed values: a column is matched by any base with over a third of it, and by all if empty
    [
        (columns_of("ACGTACGTACGTACGT"), "ACGTACGTACGTACGT", "=" * 16),
        (columns_of("ACGTACGTACGTACGT"), "ACGTAAGTACGTACGT", "=====X=========="),
        (columns_of("ACGTACGTACGTACGTACGT"), "ACGTACGTAACGTACGTACGT", "========I============"),
        (columns_of("ACGTACGT", _2=(0, 0, 5, 5)), "ACTTACGT", "=" * 8),
        (columns_of("ACGTACGT", _4=(0, 0, 0, 0)), "ACGTTCGT", "=" * 8),
        (columns_of("ACG"), "N" * 50, "=" + "I" * 47 + "=="),
        ([(0, 0, 0, 10), (0,) * 4, (0,) * 4, (0, 0, 0, 10), (0, 0, 10, 0), (5, 5, 0, 0), (0,) * 4, (0, 0, 0, 10), (0, 10, 0, 0), (0, 0, 5, 5), (5, 5, 0, 0), (0,) * 4, (0, 0, 5, 5), (0, 10, 0, 0)], "CGC", "=" + "D" * 10 + "==="),
    ],
)
def test_alignment_to_columns(columns, read, want):
    assert "".join("=XID"[o] for o in align.align_to_columns(columns, read)) == want


def test_repeats_are_passed_over_as_in_the_kernel(spark, monkeypatch):
    rng = random.Random(5)
    unit = "".join(rng.choice("ACGT") for _ in range(40))
    panel = ["".join(rng.choice("ACGT") for _ in range(60)) + unit + "".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    reads = [panel[0], panel[3][30:120], align.revcomp(panel[5])[20:130], unit]
    monkeypatch.setattr(align, "REPEAT", 6)
    index = align.Index(panel, 9)
    want = sorted((i, strand, seq, a, b) for i, r in enumerate(reads) for (strand, seq), pairs in index.hits(r).items() for a, b in pairs)
    alleles = spark.createDataFrame(list(enumerate(panel)), "seq_idx long, seq string")
    found = kmer.hits(spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"), kmer.postings(alleles, 9), 9, repeats=6)
    got = sorted((r.read_id, r.strand, r.seq_idx, r.read_offset, r.offset) for r in found.collect())
    assert got == want


def test_panel_index_has_the_relational_postings(spark):
    rng = random.Random(8)
    panel = ["", "ACGT", "A" * 30, "ACGTN" * 8, "acgt" * 5] + [bases(rng, 80) for _ in range(5)]
    alleles = spark.createDataFrame(list(enumerate(panel)), "seq_idx long, seq string")
    want = sorted((r.kmer, r.seq_idx, r.offset) for r in kmer.postings(alleles, 5).collect())
    index = align.Index(panel, 5)
    got = {(s[o : o + 5], i, at) for s in panel for o, (a, b) in enumerate(index.found(s)) for i, at in zip(index._seq[a:b].tolist(), index._at[a:b].tolist(), strict=True)}
    assert sorted(got) == want
    assert align.Index([], 5).hits("ACGTACGT") == {} and align.index_of(panel, 5) is align.index_of(panel, 5)
    with pytest.raises(ValueError):
        align.Index(panel, 32)


def test_panels_are_counted_before_they_are_sent(spark):
    alleles = spark.createDataFrame([(1, "ACGT"), (0, "AC")], "seq_idx long, seq string")
    assert common.shared_panel(alleles, 8).value == ([0, 1], ["AC", "ACGT"])
    assert common.shared_panel(alleles.where("seq_idx > 5")).value == ([], [])
    with pytest.raises(ValueError, match="above"):
        common.shared_panel(alleles, 7)
    with pytest.raises(ValueError, match="more than 1 rows"):
        common.collected(alleles, 1)


def test_increasing_run():
    r = random.Random(2)
    for _ in range(200):
        pairs = sorted({(r.randrange(12), r.randrange(12)) for _ in range(r.randint(1, 10))}, key=lambda p: (p[1], p[0]))
        got = align.increasing(pairs)
        best = [1] * len(pairs)
        for i in range(len(pairs)):
            best[i] = 1 + max((best[j] for j in range(i) if pairs[j][0] < pairs[i][0]), default=0)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False)) and len(got) <= max(best)
    assert align.covered([0, 3, 20], 11) == 14 + 11


def test_overlaps_and_fragments():
    r = random.Random(3)
    ref = [bases(r, 400) for _ in range(3)]
    ref.append(ref[0][:200] + ("A" if ref[0][200] != "A" else "C") + ref[0][201:])
    index = align.Index(ref, 11)
    read = ref[0][120:220]
    for seq in (read, align.revcomp(read)):
        assert align.is_candidate(index, seq, 27, 0.8)
        found, cells = align.assign(index, seq, 27, 0.8)
        assert [(o.seq_idx, o.match, o.seq_start, o.seq_end) for o in found] == [(0, 200, 120, 219), (3, 198, 120, 219)]
        assert sum(i == 0 for i, _, _ in cells) == 100 and sum(i == 3 for i, _, _ in cells) == 99
    assert not align.is_candidate(index, bases(r, 100), 27, 0.8) and align.assign(index, "ACGT", 27, 0.8) == ([], [])
    assign_ = lambda s: align.assign(index, s, 27, 0.8)[0]
    pair = align.fragments(assign_(ref[0][100:180]), assign_(align.revcomp(ref[0][190:270])), ref, 27)
    assert [(f.seq_idx, f.start, f.end, f.match, f.similarity, f.paired) for f in pair] == [(0, 100, 269, 320, 1.0, True)]
    assert align.fragments(assign_(ref[1][100:180]), [], ref, 27) == []  # the mate had room
    assert align.fragments(assign_(ref[1][300:400]), [], ref, 27) != []  # the mate may have left the allele
    noisy = "".join(("C" if c == "A" else "A") if i % 20 == 10 else c for i, c in enumerate(read))
    assert align.assign(index, noisy, 27, 0.8)[0] and align.assign(index, noisy, 27, 0.8, prefilter=0.5)[0] and not align.assign(index, noisy, 27, 0.8, prefilter=0.99)[0]
    over = assign_(ref[2][350:400] + bases(r, 30))
    assert over and over[0].right_clip == 30


@pytest.mark.parametrize(("k", "hit_length", "most"), [(11, 27, 512), (11, 11, 512), (5, 27, 512), (5, 9, 40), (15, 30, 512)])
def test_reads_without_a_chain_are_known_without_the_kernel(k, hit_length, most):
    r = random.Random(k * hit_length)
    panel = ["", "ACG", "A" * 60, "ACGTN" * 8] + [bases(r, 150) for _ in range(8)]
    index = align.Index(panel, k)
    reads = ["", "ACGT", "N" * 40, "A" * 50, "acgt" * 9, "\u00e9" * 30, bases(r, 300_000)] + [bases(r, 60) for _ in range(150)]
    for _ in range(150):  # pieces of alleles, with changes, losses and other text around them
        own = panel[r.randrange(4, 12)]
        a, n = r.randrange(120), r.randrange(k, 60)
        piece = list(bases(r, r.randrange(30)) + own[a : a + n] + bases(r, r.randrange(30)))
        for _ in range(r.randrange(4)):
            piece[r.randrange(len(piece))] = r.choice(["A", "N", "", "CG"])
        reads.append("".join(piece) if r.random() < 0.5 else align.revcomp("".join(piece)))
    got = index.may_chain(reads, hit_length, most)
    chained = []
    for s in reads:
        buckets = index.hits(s) if len(s) >= k else {}
        chained.append(any(True for key in buckets for _ in align.chain(*key, buckets[key], k, hit_length)))
    assert any(chained) and not any(c and not g for c, g in zip(chained, got.tolist(), strict=True))
    assert k < 11 or not got[7:157].any()  # unrelated reads
    assert index.may_chain([], hit_length).tolist() == [] and not align.Index([], k).may_chain(reads, hit_length).any()


def test_only_fragments_that_may_chain_reach_the_kernel(spark):
    import pyarrow as pa

    r = random.Random(5)
    panel = [bases(r, 300) for _ in range(3)]
    rows = [("s", i, bases(r, 60), bases(r, 60) if i % 2 else None) for i in range(300)] + [("s", 300, panel[1][:60], None), ("s", 301, bases(r, 60), align.revcomp(panel[2][90:150])), ("s", 302, None, None)]
    frags = spark.createDataFrame(rows, "sample string, read_id long, seq1 string, seq2 string")
    batch = pa.RecordBatch.from_pylist([{"read_id": i, "seq1": a, "seq2": b} for _, i, a, b in rows])
    assert mapping.candidates(align.Index(panel, 11), batch, 27).column("read_id").to_pylist() == [300, 301]
    alleles = spark.createDataFrame([(i, f"G*0{i}", [{"s": 0, "e": len(s) - 1}], s, 1) for i, s in enumerate(panel)], "seq_idx long, name string, exons array<struct<s:int,e:int>>, seq string, weight int")
    run = pipeline.Run(frags, alleles)
    assert {"hits", "_near", "similar"}.isdisjoint(vars(run))  # nothing is mapped before it is asked for
    assert run._near[0].count() == 2 and run.options.read_length == 60
    assert {(x.read_id, x.seq_idx) for x in run.hits.collect()} >= {(300, 1)}
    assert {x.seq_idx: x.cov_min for x in run.coverage().collect()} == {0: 0, 1: 0, 2: 0} and run.coverage().agg(F.max("frac_covered")).first()[0] == 0.2
    none = pipeline.Run(frags.where("read_id < 0"), alleles)
    assert none.calls().count() == 0 and none.options.read_length == 0


def test_fragments_are_the_pieces_of_their_sequences(spark, tmp_path):
    from lociframe.plans import build_queries

    texts = ["", None, "Ab c", "q" * 129, "the end " * 40, "wx yz!" * 400]
    spark.createDataFrame([(0, "b d " * 80)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    swap = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGT" * 6 + "AC")
    want = set()
    for source, step, text in [(0, 10, "b d " * 80)] + [(2 * i + 1, 55, t or "") for i, t in enumerate(texts)]:
        seq = "".join(c for c in text.lower() if c.isalpha()).translate(swap)
        for k in range(max(0, -((130 - len(seq)) // step)) + 1 if seq else 0):
            p = seq[k * step : k * step + 130]
            want.add((f"S{source % 4}", source * 1_000_000 + k, p[:60] if len(p) == 130 else p, align.revcomp(p[70:]) if len(p) == 130 else None))
    got = [tuple(x) for x in build_queries._fragments(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_whitelist_keeps_the_weights_of_all(spark):
    r = random.Random(6)
    ref = [bases(r, 300) for _ in range(2)]
    ref.append(ref[0][:250] + ("A" if ref[0][250] != "A" else "C") + ref[0][251:])  # alike where the reads are
    alleles = spark.createDataFrame(list(enumerate(ref)), "seq_idx long, seq string")
    frags = spark.createDataFrame([("s", i, s[100:200], None) for i, s in enumerate(ref)], "sample string, read_id long, seq1 string, seq2 string")
    rows = lambda only: sorted(tuple(x) for x in mapping.fragment_assignments(frags, alleles, 27, whitelist=only).collect())
    every = rows(None)
    assert {(x[1], x[2]) for x in every} == {(0, 0), (0, 2), (1, 1), (2, 0), (2, 2)}
    assert rows(alleles.where("seq_idx > 0")) == [x for x in every if x[2] > 0] and rows(alleles.where("seq_idx > 9")) == []


def test_kmer_gate_agrees_with_the_kernel(spark):
    r = random.Random(5)
    ref = [bases(r, 300) for _ in range(4)]
    reads = [ref[i % 4][k : k + 80] if i % 3 else bases(r, 80) for i, k in enumerate(r.randrange(220) for _ in range(30))]
    index = align.Index(ref, 11)
    alleles = spark.createDataFrame(list(enumerate(ref)), "seq_idx long, seq string")
    got = {x.read_id: (x.strand, x.seq_idx) for x in kmer.gate(kmer.hits(spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"), kmer.postings(alleles, 11), 11), 11, 27).collect()}
    want = {}
    for i, s in enumerate(reads):
        buckets = index.hits(s)
        if buckets:
            b = min(buckets, key=lambda b: (-len(buckets[b]), b[0], b[1]))
            if 11 * len(buckets[b]) >= 27:
                want[i] = b
    assert got == want


# the caller


def sample(reads, n=2, genes=None, options=genotype.Options()):
    genes = genes or ["A"] * n
    found = [genotype.Allele(f"{g}*{i:03d}", g, f"{g}*{i:03d}", 72, exonic=f"{g}*{i:03d}") for i, g in enumerate(genes)]
    hit = lambda q: genotype.Hit(0, 10, 1.0, q, 1.0)
    return genotype.Sample(found, genotype.coalesce([{a: hit(q) for a, q in r.items()} for r in reads]), options).call()


def test_em_scenarios():
    s = sample([{0: 1.0}] * 5 + [{1: 1.0}] * 5)
    assert s.alleles[0].abundance == pytest.approx(s.alleles[1].abundance) and len(s.classes) == 2 and s.types(0) == 2
    s = sample([{0: 1.0}] * 8)
    assert s.alleles[1].abundance == 0 and s.describe(0)[0] == 1 and s.describe(0)[2] == ".\t0\t-1"
    s = sample([{0: 1.0}] * 10 + [{1: 1.0}] * 2 + [{0: 1.0, 1: 1.0}] * 4)
    assert s.alleles[0].abundance > s.alleles[1].abundance > 0
    s = sample([{0: 1.0, 1: 1.0}] * 6)
    assert len(s.classes) == 1 and s.alleles[0].abundance == s.alleles[1].abundance and s.class_entropy(0) == pytest.approx(0.693147, abs=1e-6)
    s = sample([{0: 1.0}] * 5 + [{1: 1.0}] * 5 + [{2: 1.0}] * 7 + [{3: 1.0}] * 3, 4, ["A", "A", "B", "B"])
    assert s.alleles[2].abundance > s.alleles[3].abundance > 0 and s.genes == ["A", "B"]
    quals = [0.5, 1.0, 2.0]
    reads = [{a: quals[i % 3]} for a in range(3) for i in range(15)]
    reads += [{a: quals[i % 3], b: quals[i % 3]} for a, b in ((0, 1), (0, 2), (1, 2)) for i in range(8)] + [{0: q, 1: q, 2: q} for q in quals * 2]
    s = sample(reads, 3)
    assert all(a.abundance > 0 for a in s.alleles)


def test_three_types_keep_the_pair_that_explains_most():
    s = sample([{0: 1.0}] * 30 + [{1: 1.0}] * 28 + [{2: 1.0}] * 9, 3)
    ranks = {a: r for a, r in s.selected[0]}
    assert {ranks[0], ranks[1]} == {0, 1} and ranks.get(2, 2) == 2 and s.representatives(0) == sorted([0, 1], key=lambda a: ranks[a])


def test_priors():
    reads = [{0: 1.0}] * 30 + [{1: 1.0}] * 6 + [{0: 1.0, 1: 1.0}] * 10
    base = sample(reads)
    assert base.types(0) == 2
    rare = genotype.Options(frequency={"A*000": 0.9, "A*001": 1e-9}, prior_weight=16.0)
    assert sample(reads, options=rare).types(0) == 1
    equal = genotype.Options(frequency={"A*000": 0.2, "A*001": 0.2}, prior_weight=16.0)
    assert sample(reads, options=equal).types(0) == 2
    unknown = genotype.Options(frequency={"A*000": 0.9}, prior_weight=16.0)
    assert sample(reads, options=unknown).types(0) == 2


def test_phred():
    assert [genotype.phred(a, b) for a, b in ((10, 0), (90, 10), (1, 99), (1, 1e-9))] == [60, 10, 0, 60]


# files


FASTQ = "@r1/1 x\nACGT\n+\nIIII\n@r2/1\nACGTA\n+r2\n@@II+\n"


def test_parse_fastx():
    assert list(fastx.parse(FASTQ.split("\n"))) == [("r1/1", "x", "ACGT", "IIII"), ("r2/1", "", "ACGTA", "@@II+")]
    assert list(fastx.parse("@a\r\nAC\r\nGT\r\n+\r\nII\r\nII\r\n\r\n".split("\n"))) == [("a", "", "ACGT", "IIII")]
    assert list(fastx.parse(">a b c\nAC\n\nGT\n>d\n".split("\n"))) == [("a", "b c", "ACGT", None), ("d", "", "", None)]
    with pytest.raises(ValueError):
        list(fastx.parse("@a\nACGT\n+\nIII".split("\n")))


def test_read_fastq(spark, tmp_path):
    n = 500
    text = lambda k: "".join(f"@r{i}/{k}\n{'ACGT' * (i % 5 + 1)}\n+\n{'I@+J' * (i % 5 + 1)}\n" for i in range(n))
    (tmp_path / "a.fq").write_text(text(1))
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text(2))
    a = fastx.read_fastq(spark, str(tmp_path / "a.fq"))
    rows = sorted((r.read_id, r.name, r.seq, r.qual) for r in a.collect())
    assert rows == [(i, f"r{i}", "ACGT" * (i % 5 + 1), "I@+J" * (i % 5 + 1)) for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert sorted((r.read_id, r.name, r.seq, r.qual) for r in fastx.read_fastq(spark, str(tmp_path / "a.fq")).collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    b = fastx.read_fastq(spark, str(tmp_path / "b.fq.gz"))
    both = fastx.pairs(a, b).collect()
    assert len(both) == n and all(r.seq1 == r.seq2 for r in both)
    with pytest.raises(Exception, match="mates differ"):
        fastx.pairs(a, b.where("read_id < 499")).collect()
    assert not fastx.looks_interleaved(a)
    (tmp_path / "c.fq").write_text("".join(f"@r{i // 2}/{i % 2 + 1}\nACGT\n+\nIIII\n" for i in range(20)))
    c = fastx.read_fastq(spark, str(tmp_path / "c.fq"))
    assert fastx.looks_interleaved(c) and fastx.interleaved(c).count() == 10
    (tmp_path / "d.fq").write_text("@r\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastx.read_fastq(spark, str(tmp_path / "d.fq")).collect()
    assert [formats.kind(spark, str(tmp_path / x)) for x in ("a.fq", "b.fq.gz")] == ["fastq", "fastq"]


def test_sniff():
    assert [formats.sniff(x) for x in (b"CRAM..", b"@HD\tVN", b"@r1\nAC", b">a\n", gzip.compress(b"BAM\x01abc"), gzip.compress(b"@r 1"), b"@AB")] == ["cram", "sam", "fastq", "fasta", "bam", "fastq", "fastq"]
    with pytest.raises(ValueError):
        formats.sniff(b"xyz")


def test_read_panel(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(">A*001 1 0 3\nAC\nGT\n>A*002\nACGT\n>B*001 2 0 1 3 4\nACGTA\n>C*001\n\n")
    rows = {r.name: r for r in fastx.read_panel(spark, str(tmp_path / "ref.fa")).collect()}
    assert {k: (r.seq_idx, r.seq, r.weight, [tuple(x) for x in r.exons]) for k, r in rows.items()} == {"A*001": (0, "ACGT", 2, [(0, 3)]), "B*001": (1, "ACGTA", 1, [(0, 1), (3, 4)])}
    only = fastx.read_panel(spark, str(tmp_path / "ref.fa"), spark.createDataFrame([("B*001",)], "name string"))
    assert [r.name for r in only.collect()] == ["B*001"]


def blocked(data, size):
    """data as a chain of blocks of `size` bytes, cut without regard to records, with the empty block at the end."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += aligned.BLOCK + struct.pack("<H", len(aligned.BLOCK) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam_bytes(header, refs, records, pack=gzip.compress):
    out = b"BAM\x01" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", len(refs))
    for name in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", 1000)
    for name, flags, tid, pos, cigar, seq, qual in records:
        ops = [(n, op) for n, op in cigar]
        packed = bytes((aligned.BASES.index(seq[i]) << 4) | (aligned.BASES.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 0, 0, len(ops), flags, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | aligned.OPS.index(op)) for n, op in ops) + packed + bytes(ord(q) - 33 for q in qual)
        out += struct.pack("<i", len(body)) + body
    return pack(out)


def test_sam_and_bam_agree(spark, tmp_path):
    head = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:1000\n"
    recs = [("q1", 99, 0, 10, [(4, "M")], "ACGT", "IIJJ"), ("q1", 147, 0, 50, [(2, "M"), (3, "N"), (2, "M")], "GGTA", "ABCD"), ("q2", 4, -1, -1, [], "ACGNA", "IIIII")]
    names = ["chr1", "chr2"]
    (tmp_path / "x.bam").write_bytes(bam_bytes(head, names, recs))
    sam = head + "".join(f"{n}\t{f}\t{names[t] if t >= 0 else '*'}\t{p + 1}\t0\t{''.join(f'{k}{o}' for k, o in c) or '*'}\t*\t0\t0\t{s}\t{q}\n" for n, f, t, p, c, s, q in recs)
    (tmp_path / "x.sam").write_text(sam)
    h1, a = aligned.read_sam(spark, str(tmp_path / "x.sam"))
    h2, b = aligned.read_bam(spark, str(tmp_path / "x.bam"))
    row = lambda df: sorted((r.qname, r.flags, r.tid, r.pos, r.cigar, r.seq, r.qual) for r in df.collect())
    assert row(a) == row(b) and aligned.sort_order(h1) == aligned.sort_order(h2) == "coordinate" and aligned.sequences(h2) == names
    assert ("q1", 147, 0, 50, "2M3N2M", "TACC", "DCBA") in row(a)


def test_bam_is_read_in_splits(spark, tmp_path):
    r = random.Random(4)
    recs = []
    for i in range(900):
        n = r.choice([0, 1, 50, 151, 151, 151] + [9000] * (i % 97 == 0))
        seq = bases(r, n)
        recs.append((f"read.{i}", 4 if i % 5 == 0 else 16, -1 if i % 5 == 0 else i % 2, i - 1, [(n, "M")] if i % 5 else [], seq, "".join(chr(33 + r.randrange(40)) for _ in seq)))
    head = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:1000\n"
    names = ["chr1", "chr2"]
    place = tmp_path / "bams"
    place.mkdir()
    (place / "a.bam").write_bytes(bam_bytes(head, names, recs[:700], lambda d: blocked(d, 1500)))
    (place / "b.bam").write_bytes(bam_bytes(head, names, recs[700:], lambda d: blocked(d, 60_000)))
    (place / "c.bam").write_bytes(bam_bytes(head, names, [], lambda d: blocked(d, 100)))
    (tmp_path / "whole.bam").write_bytes(bam_bytes(head, names, recs))
    listed = lambda df: [tuple(x) for x in df.orderBy("rec").collect()]
    want = listed(aligned.read_bam(spark, str(tmp_path / "whole.bam"))[1])
    assert [x[0] for x in want] == list(range(900)) and [x[1] for x in want] == [x[0] for x in recs]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("2000", "7001", "128MB"):  # a split may be smaller than a record
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            h, df = aligned.read_bam(spark, str(place))
            assert h == head and listed(df) == want
            assert "binaryFile" not in df._jdf.queryExecution().toString()
        # a file whose end is missing, and one with a damaged block
        whole = (place / "a.bam").read_bytes()
        for name, data in (("cut", whole[:-40]), ("bent", whole[:3000] + bytes([whole[3000] ^ 255]) + whole[3001:])):
            (tmp_path / f"{name}.bam").write_bytes(data)
            with pytest.raises(Exception):  # noqa: B017
                aligned.read_bam(spark, str(tmp_path / f"{name}.bam"))[1].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_database_and_gtf(spark, tmp_path):
    entry = "ID   X\nFT   CDS\nFT                   /allele=\"{}\"\nFT   exon            {}\nFT   exon            {}\n{}SQ   Sequence\n     acgtac gtacgt 12\n     acgt 16\n//\n"
    (tmp_path / "x.dat").write_text(entry.format("A*01:01", "2..4", "8..10", "") + entry.format("A*01:02", "2..4", "8..10", "FT                   /pseudo\n") + entry.format("A*01:03", "2..4", "8..10", "FT                   /partial\n"))
    rows = {r.name: ([tuple(e) for e in r.exons], r.partial, r.seq) for r in tables.read_database(spark, str(tmp_path / "x.dat")).collect()}
    assert rows == {"A*01:01": ([(1, 3), (7, 9)], False, "acgtacgtacgtacgt"), "A*01:02": ([(1, 3)], False, "acgtacgtacgtacgt"), "A*01:03": ([(1, 3), (7, 9)], True, "acgtacgtacgtacgt")}
    line = '{}\tsrc\t{}\t{}\t{}\t.\t{}\t.\tgene_id "x"; gene_name "{}";\n'
    (tmp_path / "x.gtf").write_text("#c\n" + line.format("chr6", "gene", 10, 20, "+", "HFE") + line.format("19", "gene", 5, 9, "-", "K") + line.format("19", "gene", 6, 9, "-", "K") + line.format("19", "exon", 1, 2, "-", "Z"))
    got = {r.gene: (r.chrom, r.start, r.end, r.strand) for r in tables.read_gtf(spark, str(tmp_path / "x.gtf")).collect()}
    assert got == {"HLA-HFE": ("chr6", 10, 20, "+"), "K": ("chr19", 5, 9, "-")}


def test_genotype_files(spark, tmp_path):
    (tmp_path / "S1_genotype.tsv").write_text("G\t2\tG*1,G*2\t50.5\t30\tG*3\tx\t20\t\nH\t0\t.\t0\t-1\t.\t0\t-1\t\nbad\n\t1\ta\t1\t1\n")
    rows = tables.read_calls(spark, str(tmp_path / "S1_genotype.tsv")).collect()
    assert sorted((r["sample"], r.gene, r.slot, r.alleles, r.abundance, r.quality) for r in rows) == [("S1", "G", 1, ["G*1", "G*2"], 50.5, 30.0), ("S1", "G", 2, ["G*3"], 0.0, 20.0)]
    copies = tables.read_copies(spark, str(tmp_path / "S1_genotype.tsv")).collect()
    assert [(r.gene, r.slot, r.allele, r.quality) for r in copies] == [("G", 1, "G*1,G*2", 30)]
    (tmp_path / "f.tsv").write_text("allele\tfreq\tcount\nHLA-A*01:01\t0\t3\nA*01:02\t0\t1\nA*02:01\t0\t4\n")
    t = tables.read_frequencies(spark, str(tmp_path / "f.tsv"))
    f = frequency.major_frequencies(["HLA-A*01:01", "A*01", "A*09:01:01", "Z*01"], t)
    assert f == {"HLA-A*01:01": pytest.approx(3.5 / 9.5), "A*01": pytest.approx(4.5 / 9.5), "A*09:01:01": pytest.approx(0.5 / 9.5)}
    (tmp_path / "g.tsv").write_text("A*01\t0\t3\nA*02\t0\t-1\n")
    with pytest.raises(Exception, match="not a count"):
        tables.read_frequencies(spark, str(tmp_path / "g.tsv")).collect()


# cohorts


def call_rows(spark, rows):
    return spark.createDataFrame([(s, g, k, i, a.split(","), float(x), q) for i, (s, g, k, a, x, q) in enumerate(rows)], "sample string, gene string, slot int, ord long, alleles array<string>, abundance double, quality int")


def test_cohort(spark):
    c = call_rows(spark, [("s1", "G", 1, "a,b", 10, 40), ("s1", "G", 2, "c", 5, 20), ("s2", "G", 1, "b", 7, 25), ("s2", "G", 2, "d", 2.5, 0), ("s3", "G", 1, "z,a", 3, 9)])
    reps = cohort.representatives(c, 2, 0, 20)
    assert {(r.allele, r.total) for r in reps.collect()} == {("a", 40), ("b", 25)}
    wide = {r["sample"]: r.asDict() for r in cohort.matrix(c, 2, 0, 20).collect()}
    assert wide["s1"] == {"sample": "s1", "a": "10.0", "b": "0", "inconsistency": "c_5.0_20"} and wide["s3"]["a"] == "3.0" and wide["s2"]["b"] == "7.0"


def test_copy_numbers(spark):
    rows = [("s", "A", 1, "A*1", 100, 9, 1), ("s", "A", 2, "A*2", 121, 9, 2), ("s", "B", 1, "B*1", 400, 9, 3), ("s", "C", 1, "C*1", 90, 0, 4)]
    c = spark.createDataFrame([(s, g, k, a, float(x), q, o) for s, g, k, a, x, q, o in rows], "sample string, gene string, slot int, allele string, abundance double, quality int, ord long")
    fit = cohort.one_copy(c, ["A"])
    assert (fit.first().mean, round(fit.first().var, 6)) == (10.5, 0.25)
    got = {r.allele: r.copy for r in cohort.copy_numbers(c, fit).collect()}
    assert got == {"A*1": 1, "A*2": 1, "B*1": 2}
    assert {r.line.split("\t")[0]: r.line for r in cohort.copy_rows(c, cohort.copy_numbers(c, fit)).collect()}["C"] == "C\t0\t.\t-1\t0\t.\t-1\t0"
    with pytest.raises(Exception, match="one-copy"):
        cohort.copy_numbers(c, cohort.one_copy(c, ["B"])).collect()
    with pytest.raises(ValueError):
        cohort.one_copy(c, [], 0.5, 0.2)


def test_intervals(spark):
    p = spark.createDataFrame([(i, 0, s, e) for i, (s, e) in enumerate([(0, 10), (10, 20), (11, 12), (5000, 5001), (90, 3000), (21, 30)])], "rec long, chrom int, start long, end long")
    g = spark.createDataFrame([(0, 10, 20), (0, 2500, 2600), (1, 0, 9999)], "chrom int, g_start long, g_end long")
    want = {r.rec for r in p.collect() if any(r.chrom == x.chrom and r.start <= x.g_end and r.end > x.g_start for x in g.collect())}
    assert {r.rec for r in assign.overlapping(p, g).collect()} == want == {1, 2, 4}


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# reference building


def test_build_reference(spark):
    r = random.Random(9)
    gene = bases(r, 3000).lower()
    raw = [
        (0, "A*01:01", [(60, 159), (700, 799)], False, gene),
        (1, "A*01:02", [(60, 159), (700, 799)], False, gene[:720] + "a" + gene[721:]),
        (2, "A*01:03", [(0, 99), (100, 199)], True, gene[60:160] + gene[700:800]),
        (3, "B*01:01", [(20, 119)], False, gene[1000:1150]),
    ]
    df = spark.createDataFrame([(o, n, [{"s": s, "e": e} for s, e in x], p, q) for o, n, x, p, q in raw], "ord long, name string, exons array<struct<s:int,e:int>>, partial boolean, seq string")
    rna = {x.name: x for x in refbuild.build(df, False).collect()}
    assert rna["A*01:01"].seq == (gene[10:160] + gene[700:850]).upper() and [tuple(e) for e in rna["A*01:01"].exons] == [(50, 149), (150, 249)]
    assert [x.name for x in sorted(rna.values(), key=lambda x: x.seq_idx)] == ["A*01:01", "A*01:02", "B*01:01", "A*01:03"]  # the partial one is as long as the others
    dna = {x.name: x for x in refbuild.build(df, True).collect()}
    assert dna["A*01:01"].seq == (gene[10:360] + "N" + gene[500:850]).upper() and [tuple(e) for e in dna["A*01:01"].exons] == [(50, 149), (551, 650)]
    for s, e in dna["A*01:01"].exons:
        assert dna["A*01:01"].seq[s : e + 1].lower() in gene
    assert dna["A*01:03"].seq == dna["A*01:01"].seq and dna["A*01:03"].exons == dna["A*01:01"].exons  # with the usual intron and flanks
    flank = maths.Rand48(17).bases(50)
    assert dna["B*01:01"].seq[50:150] == gene[1020:1120].upper() and dna["B*01:01"].seq[:30] == (flank[:31] + gene[1000:1019].upper())[:30]
    coords = spark.createDataFrame([("A", "chr6", 5, 9, "-")], "gene string, chrom string, start long, end long, strand string")
    lines = {x.value.split("\n")[0] for x in tables.coordinate_lines(refbuild.annotate(refbuild.build(df, False), coords)).collect()}
    assert ">A*01:01 chr6 5 9 -" in lines and ">B*01:01 chr19 -1 -1 +" in lines
    assert refbuild.mode([9, 10, 10, 9]) == 9


# from reads to calls


@pytest.fixture(scope="module")
def study():
    """Two genes with four alleles that differ at some bases, and paired reads of a heterozygote with one new base."""
    r = random.Random(21)
    panel = []
    for g in "AB":
        base = bases(r, 900)
        for k in range(4):
            seq = list(base)
            for _ in range(12 * (k > 0)):
                i = r.randrange(60, 840)
                seq[i] = r.choice([b for b in "ACGT" if b != seq[i]])
            panel.append((f"{g}*0{k}:01:01", "".join(seq)))
    truth = {"A": ["A*00:01:01", "A*02:01:01"], "B": ["B*03:01:01"]}
    text = dict(panel)
    novel = list(text["B*03:01:01"])
    novel[450] = next(b for b in "ACGT" if all(b != s[450] for n, s in panel if n[0] == "B"))
    text["B*03:01:01"] = "".join(novel)
    first, second = [], []
    for g, names in truth.items():
        for name in names:
            for _ in range(260 // len(names)):
                a = r.randrange(0, 900 - 300)
                x, y = text[name][a : a + 100], align.revcomp(text[name][a + 200 : a + 300])
                first.append(x if r.random() < 0.5 else y)
                second.append(y if first[-1] is x else x)
    for _ in range(60):
        first.append(bases(r, 100))
        second.append(bases(r, 100))
    return panel, truth, first, second, novel[450]


def test_run_from_files(spark, tmp_path, study, capsys):
    panel, truth, first, second, base = study
    (tmp_path / "ref.fa").write_text("".join(f">{n} 1 0 {len(s) - 1}\n{s}\n" for n, s in panel))
    for k, reads in ((1, first), (2, second)):
        (tmp_path / f"r{k}.fq").write_text("".join(f"@q{i}/{k}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    out = str(tmp_path / "S1")
    cli.main(["run", "-f", str(tmp_path / "ref.fa"), "-1", str(tmp_path / "r1.fq"), "-2", str(tmp_path / "r2.fq"), "-o", out, "--emit-metrics"], spark)
    lines = [x.value.split("\t") for x in spark.read.text(f"{out}_genotype.tsv").collect()]
    got = {x[0]: {a for a in (x[2], x[5]) if a != "."} for x in lines}
    assert got == {g: set(n) for g, n in truth.items()} and all(len(x) == 9 for x in lines)
    alleles = {x.value.split(" ")[0] for x in spark.read.text(f"{out}_allele.tsv").collect()}
    assert alleles >= {n for names in truth.values() for n in names}
    metrics = [x.value.split("\t") for x in spark.read.text(f"{out}_metrics.tsv").orderBy("value").collect()]
    assert all(len(x) == 19 for x in metrics) and sum(x[0] == "gene" for x in metrics) == 1
    vcf = [x.value.split(" ") for x in spark.read.text(f"{out}_allele.vcf").collect()]
    assert [(x[0], x[1], x[4], x[6]) for x in vcf] == [("B*03:01:01", "451", base, "PASS")] and len(vcf[0]) == 12
    names = "".join(x.value for x in spark.read.text(f"{out}_aligned_1.fa").where("value like '>%'").collect())
    assert names.count(">") >= 480
    (tmp_path / "list.txt").write_text(f"{out}_genotype.tsv\n")
    capsys.readouterr()
    cli.main(["extract", "-f", str(tmp_path / "ref.fa"), "-1", str(tmp_path / "r1.fq"), "-2", str(tmp_path / "r2.fq"), "-o", str(tmp_path / "c")], spark)
    kept = spark.read.text(str(tmp_path / "c_1.fq")).where("value like '@q%'").count()
    assert 500 <= kept <= 530
    with pytest.raises(ValueError):
        cli.main(["genotype", "-f", str(tmp_path / "ref.fa"), "-1", "x"], spark)


def test_partitioning_does_not_matter(spark, study):
    panel, truth, first, second, _ = study
    p = spark.createDataFrame([(i, n, [{"s": 0, "e": len(s) - 1}], s, 1) for i, (n, s) in enumerate(panel)], "seq_idx long, name string, exons array<struct<s:int,e:int>>, seq string, weight long")
    frags = spark.createDataFrame([("S", i, a, b) for i, (a, b) in enumerate(zip(first, second, strict=True))], "sample string, read_id long, seq1 string, seq2 string")
    two = frags.withColumn("sample", F.lit("T")).unionByName(frags)
    rows = {}
    for n in (1, 7):
        run = pipeline.Run(two.repartition(n), p)
        for r in run.calls().collect():
            rows.setdefault(r.gene, set()).add((r.allele1, round(r.abundance1, 6), r.quality1, r.allele2, round(r.abundance2, 6), r.quality2, r.secondary))
    assert all(len(x) == 1 for x in rows.values())  # both samples, both partitionings


def test_variant_lines_need_no_run_of_the_unchanged_fragments(spark, tmp_path, monkeypatch):
    from lociframe.plans import build_queries

    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcd") for _ in range(n))
    spark.createDataFrame([(i, text(260)) for i in range(2)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, text(700)) for i in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(mapping, "fragment_assignments", lambda *a, **b: pytest.fail("placements that no result reads"))
    # every hundredth base is another one, and five fragments or more cover it
    assert sorted(x.value.split(" ")[1] for x in build_queries.variant_lines(spark, str(tmp_path)).collect()) == ["100", "100", "200", "200"]


def test_a_run_reads_its_fragments_once(spark, study):
    panel, truth, first, second, _ = study
    p = spark.createDataFrame([(i, n, [{"s": 0, "e": len(s) - 1}], s, 1) for i, (n, s) in enumerate(panel)], "seq_idx long, name string, exons array<struct<s:int,e:int>>, seq string, weight long")
    frags = spark.createDataFrame([("S", i, a, b) for i, (a, b) in enumerate(zip(first, second, strict=True))], "sample string, read_id long, seq1 string, seq2 string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    run = pipeline.Run(frags.mapInArrow(counted, frags.schema), p)
    got = {x.gene: {a for a in (x.allele1, x.allele2) if a != "."} for x in run.calls().collect()}
    assert got == {g: set(n) for g, n in truth.items()} and run.metrics().count() == 3 and run.chosen().count() == 3
    assert read.value == len(first)


def test_candidate_stream(spark, tmp_path, study):
    panel, _, first, _, _ = study
    reads = spark.createDataFrame([(s,) for s in first], "seq1 string")
    reads.write.parquet(str(tmp_path / "in"))
    p = spark.createDataFrame(list(enumerate(s for _, s in panel)), "seq_idx long, seq string")
    stream = candidate_stream(spark.readStream.schema("seq1 string").parquet(str(tmp_path / "in")), p, 27, 11)
    q = stream.writeStream.format("memory").queryName("candidates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("candidates").count() == candidate_stream(reads, p, 27, 11).count() >= 500


def test_alignment_modes(spark, study):
    """Reads with and without alignments, against the reads alone."""
    panel, _, first, second, _ = study
    rows = []
    for i, (a, b) in enumerate(zip(first, second, strict=True)):
        rows += [(2 * i, f"q{i}", 77, -1, -1, "*", a, "I" * len(a)), (2 * i + 1, f"q{i}", 141, -1, -1, "*", b, "I" * len(b))]
    rows += [(9000, "t", 99, 0, 500, "100M", first[0], "I" * 100), (9001, "t", 147, 0, 700, "100M", second[0], "I" * 100), (9002, "u", 99, 0, 5000, "100M", first[0], "I" * 100), (9003, "u", 147, 0, 5200, "100M", second[0], "I" * 100)]
    rec = spark.createDataFrame(rows, "rec long, qname string, flags int, tid int, pos long, cigar string, seq string, qual string")
    p = spark.createDataFrame(list(enumerate(s for _, s in panel)), "seq_idx long, seq string")
    alone = {r.read_id for r in extract.candidates(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(first, second, strict=True))], "read_id long, seq1 string, seq2 string"), p, k=11, hit_length=27).collect()}
    got = {r.qname for r in extract.without_alignments(rec.where("rec < 9000"), p, hit_length=27, k=11).collect()}
    assert got == {f"q{i}" for i in alone}
    genes = spark.createDataFrame([(0, 550, 560)], "chrom int, g_start long, g_end long")
    near = {r.qname for r in extract.from_alignments(rec, genes, p, hit_length=27, k=11).collect()}
    assert "t" in near and "u" not in near and {f"q{i}" for i in alone} - near == set()


def test_variant_groups(spark):
    out = variants.solve_groups(variants.demo_groups(spark.createDataFrame([(i, i % 7, float(i % 5)) for i in range(200)], "event_id long, user_id long, value double"))).collect()
    assert out and all(r.ref != r.alt and r.qual in (0, 60) for r in out)


def test_stored_tables_are_shared(spark):
    df = common.stored(spark.range(10), "t")
    assert df.count() == 10 and common.small(df).count() == 10
    common.dropped(df)


@pytest.mark.parametrize("name", ["kmer_count", "equivalence_classes", "em_fixed_rounds", "combine_matrix", "copynumber_rows", "variant_components", "cigar_segments", "interval_semi_join", "freq_prefix_match", "genotype_quality", "fastq_wrapped_scan", "interleaved_file", "panel_scan_listed", "sam_scan", "database_scan", "gtf_scan", "copy_file_scan", "frequency_scan", "exact_overlaps", "exact_fragments"])
def test_queries_agree_with_duckdb(spark, name):
    import glob
    import os

    import duckdb

    from lociframe import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    mine = catalog.queries()[name](spark, sf).toPandas()
    theirs = con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    norm = lambda d: sorted(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert norm(mine) == norm(theirs)
