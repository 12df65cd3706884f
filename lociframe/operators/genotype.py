"""Calling a sample's alleles from its coalesced read groups: abundances, selection, pair search, qualities, text.

A sample's read groups and alleles are few (coalescing collapses reads with equal assignments), so a sample is one task
of applyInPandas and samples run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.maths import normal_tail_value
from . import common


@dataclass(frozen=True)
class Options:
    filter_frac: float = 0.15
    filter_cov: float = 1.0
    cross_gene_rate: float = 0.04
    read_length: int = 150
    min_alpha: float = 0.0
    prior_weight: float = 2.0
    null_penalty: float = 0.0
    #: major allele -> frequency, or None without a table
    frequency: dict | None = None


@dataclass
class Allele:
    name: str
    gene: str
    major: str
    length: int
    weight: int = 1
    missing: int = 0
    consensus: int = 0
    null: bool = False
    exonic: str = ""
    abundance: float = 0.0
    ec_abundance: float = 0.0
    ec: int = -1
    quality: int = -1
    phred: int = 60
    rank: int = -1


@dataclass
class Hit:
    """A read group's assignment to one allele."""

    start: int
    end: int
    weight: float
    qual: float
    adjust: float


def coalesce(reads: list[dict[int, Hit]]) -> list[dict[int, Hit]]:
    """Reads with equal alleles and qualities as one group, in order of first appearance; weights add up.

    Of assignments with quality 1 the smallest start and the smallest end stay.
    """
    groups: dict = {}
    for r in reads:
        if not r:
            continue
        r = dict(sorted(r.items()))
        key = tuple((a, h.qual) for a, h in r.items())
        if key not in groups:
            groups[key] = {a: Hit(h.start, h.end, np.float32(h.weight), h.qual, np.float32(h.adjust)) for a, h in r.items()}
            continue
        for a, h in r.items():
            g = groups[key][a]
            if h.qual == 1:
                g.start, g.end = min(g.start, h.start), min(g.end, h.end)
            g.weight = np.float32(g.weight + np.float32(h.weight))
            g.adjust = np.float32(g.adjust + np.float32(h.adjust))
    return list(groups.values())


def fingerprint(groups: list[int], n_groups: int) -> int:
    """Rolling number of an allele's read groups; classes are numbered by it, downwards."""
    code = 0
    for g in groups:
        code = (code * n_groups + g) % 1_000_003
    return code


class Sample:
    """One sample's state from read groups to calls. Gene and allele numbers follow the order of the reference."""

    def __init__(self, alleles: list[Allele], groups: list[dict[int, Hit]], options: Options = Options(), similarity=None):
        self.alleles, self.groups, self.o = alleles, groups, options
        self.genes = list(dict.fromkeys(a.gene for a in alleles))
        self.gene_of = [self.genes.index(a.gene) for a in alleles]
        self.similarity = np.zeros((len(self.genes),) * 2) if similarity is None else similarity
        self.groups_of: list[list[int]] = [[] for _ in alleles]
        for g, hits in enumerate(groups):
            for a in hits:
                self.groups_of[a].append(g)
        self.best_of = [np.array([g for g in own if groups[g][a].qual == 1], int) for a, own in enumerate(self.groups_of)]
        first = [next(iter(g.values())) for g in groups]
        self.first_weight = np.array([float(h.weight) for h in first])
        self.adjust = np.array([float(h.adjust) for h in first])
        self.selected: list[list[list[int]]] = [[] for _ in self.genes]
        self.classes: list[list[int]] = []

    # equivalence classes

    def group_alleles(self) -> None:
        """Alleles with the same read groups and qualities, ordered by fingerprint (large first), then allele; of each class the members with most quality stay."""
        n = len(self.groups)
        order = sorted((a for a in range(len(self.alleles)) if self.groups_of[a]), key=lambda a: (-fingerprint(self.groups_of[a], n), a))
        seen: dict = {}
        for a in order:
            key = tuple((g, self.groups[g][a].qual) for g in self.groups_of[a])
            if key not in seen:
                seen[key] = len(self.classes)
                self.classes.append([])
            self.alleles[a].ec = seen[key]
            self.classes[seen[key]].append(a)
        total = [sum(float(self.groups[g][a].qual) for g in own) for a, own in enumerate(self.groups_of)]
        self.classes = [[a for a in ec if total[a] == max(total[b] for b in ec)] for ec in self.classes]

    # abundances

    def quantify(self, rounds: int = 1000, every: int = 10) -> int:
        """Squared-extrapolation EM over classes; returns the number of rounds.

        Every tenth round, classes are seeded anew with the abundance (per kilobase) of their first member, and with 0
        where its major allele is far below its gene's largest.
        """
        n = len(self.classes)
        if not n:
            self._spread(np.zeros(0), np.zeros(0))
            return 0
        length = np.array([min(self.alleles[a].length for a in ec) for ec in self.classes], float)
        pairs = sorted({(g, self.alleles[a].ec) for g, hits in enumerate(self.groups) for a in hits})
        row, col = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        count = np.array([max(float(h.weight) for h in hits.values()) for hits in self.groups])

        def step(x):
            total = np.bincount(row, weights=x[col], minlength=len(self.groups))
            total[total == 0] = 1
            reads = np.bincount(col, weights=count[row] * (x[col] / total[row]), minlength=n)
            rate = reads / length
            return rate / rate.sum(), reads

        now = np.array([float(sum(self.alleles[a].weight for a in ec)) for ec in self.classes])
        t = done = 0
        while t < rounds:
            done += 1
            one, _ = step(now)
            two, _ = step(one)
            bend = two - 2 * one + now
            square = (bend * bend).sum()
            alpha = -1.0 if square == 0 else -math.sqrt(((one - now) ** 2).sum()) / math.sqrt(square)
            if self.o.min_alpha < 0:
                alpha = max(alpha, self.o.min_alpha)
            new, reads = step(now - 2 * alpha * (one - now) + alpha * alpha * bend)
            change = np.abs(new - now).sum()
            now = new
            if change < 1e-5 and t < rounds - 2:
                t = rounds - 2  # one more round, and the last
            if t > 0 and t % every == 0:
                self._spread(reads, length)
                low = {a for a, x in enumerate(self.alleles) if self.major_abundance[x.major] < 0.5 * self.o.filter_frac * self.gene_max[x.gene]}
                for a in low:
                    self.alleles[a].abundance = self.alleles[a].ec_abundance = 0.0
                now = np.array([self.alleles[ec[0]].ec_abundance for ec in self.classes])
            t += 1
        self._spread(reads, length)
        return done

    def _spread(self, reads, length) -> None:
        """Class read counts to reads per kilobase of alleles, major alleles and genes."""
        for a in self.alleles:
            a.abundance = a.ec_abundance = 0.0
        for ec, r, n in zip(self.classes, reads, length, strict=True):
            for a in ec:
                self.alleles[a].ec_abundance = float(r / n * 1000)
                self.alleles[a].abundance = float(r / n * 1000) / len(ec)
        self.major_abundance = {a.major: 0.0 for a in self.alleles}
        for a in self.alleles:
            self.major_abundance[a.major] += a.abundance
        self.gene_max = {a.gene: 0.0 for a in self.alleles}
        for a in self.alleles:
            self.gene_max[a.gene] = max(self.gene_max[a.gene], self.major_abundance[a.major])

    def drop_unlikely(self, cutoff: float = 0.05) -> None:
        """Members of a class whose reads span too little of them, given how many reads there are."""
        for i, ec in enumerate(self.classes):
            chance = []
            for a in ec:
                hits = [self.groups[g][a] for g in self.groups_of[ec[0]] if a in self.groups[g]]
                size = self.alleles[a].consensus or self.alleles[a].length
                low, high = min([size, *(h.start for h in hits)]), max([-1, *(h.end for h in hits)])
                share = min(high - low + 1, size) / size
                with np.errstate(invalid="ignore"):
                    chance.append(float(np.power(share, self.alleles[a].ec_abundance)))
            most = max([-1.0, *(c for c in chance if c == c)])
            self.classes[i] = [a for a, c in zip(ec, chance, strict=True) if c == most or c / most >= cutoff]

    # selection

    def types(self, gene: int) -> int:
        return max((r for _, r in self.selected[gene]), default=-1) + 1

    def _weak(self, a: Allele) -> bool:
        low = self.o.filter_frac * self.gene_max[a.gene]
        major = self.major_abundance[a.major]
        return a.ec_abundance < low and (3 * a.ec_abundance >= major or major < 3 * low)

    def _rank_of_major(self, gene: int, major: str) -> int:
        return next((r for a, r in self.selected[gene] if self.alleles[a].major == major), -1)

    def select(self) -> None:
        """Greedy choice: classes by abundance, alleles into their gene's list with the rank of their major allele."""
        covered = np.zeros(len(self.groups), bool)
        rejected: list[int] = []
        for ec in sorted((e for e in range(len(self.classes))), key=lambda e: (-self.alleles[self.classes[e][0]].ec_abundance, e)):
            members = self.classes[ec]
            if self.alleles[members[0]].ec_abundance <= 1e-6:
                break
            best = self.best_of[members[0]]
            # both sums in order of the groups, as their equality decides
            own = sum((self.first_weight[g] for g in best), 0.0)
            already = sum((self.first_weight[g] for g in best if covered[g]), 0.0)
            take = []
            for a in members:
                x, gene = self.alleles[a], self.gene_of[a]
                chosen, top = self.selected[gene], self.gene_max[x.gene]
                explained = already == own and (x.ec_abundance < 0.25 * top or not chosen or x.ec_abundance < 0.5 * self.alleles[chosen[-1][0]].ec_abundance)
                if self._weak(x) or explained:
                    rejected.append(a)
                else:
                    take.append(a)
            genes = {self.gene_of[a] for a in take}
            if genes:
                covered[best] = True
            new_rank: dict[int, int] = {}
            for a in take:
                x, gene = self.alleles[a], self.gene_of[a]
                rank = self._rank_of_major(gene, x.major)
                if rank < 0:
                    rank = new_rank.setdefault(gene, self.types(gene))
                x.quality = 0 if len(genes) > 1 or self._weak(x) else 60
                x.rank = rank
                self.selected[gene].append([a, rank])
        for a in rejected:
            gene = self.gene_of[a]
            rank = self._rank_of_major(gene, self.alleles[a].major)
            if rank >= 0:
                self.selected[gene].append([a, rank])

    def _distinct(self, gene: int, ranks) -> list[int]:
        """Chosen alleles of these ranks, the first of each class."""
        seen, out = set(), []
        for a, r in self.selected[gene]:
            if r in ranks and self.alleles[a].ec not in seen:
                seen.add(self.alleles[a].ec)
                out.append(a)
        return out

    def _cover(self, gene: int, by: int, coverage) -> None:
        for a in self._distinct(gene, (0, 1)):
            coverage[self.best_of[a]] += by

    def _missing(self, gene: int, rank: int) -> int:
        return min((self.alleles[a].missing for a, r in self.selected[gene] if r == rank), default=-1)

    def _missing_weights(self, gene: int) -> dict[int, float]:
        """Largest abundance of a rank by its number of uncovered bases."""
        out: dict[int, float] = {}
        for rank in range(self.types(gene)):
            total = sum(self.alleles[a].abundance for a, r in self.selected[gene] if r == rank)
            key = self._missing(gene, rank)
            out[key] = max(out.get(key, 0.0), total)
        return out

    def pair_score(self, gene: int, j: int, k: int, coverage, weights: dict[int, float], n_types: int) -> float:
        """Adjusted weight of the reads that only this pair of ranks explains, less what its uncovered bases cost."""
        reads = np.zeros(len(self.groups), bool)
        last = None
        for rank in {j, k}:
            for a in self._distinct(gene, (rank,)):
                reads[self.best_of[a]] = True
                if rank == j:
                    last = a
        out = float(self.adjust[reads & (coverage == 0)].sum())
        mj, mk = self._missing(gene, j), self._missing(gene, k)
        if n_types > 3 or mj >= 10 or mk >= 10:
            wj, wk = weights.get(mj, 0.0), weights.get(mk, 0.0)
            if n_types <= 3:
                wj, wk = (math.log10(w) if w >= 1 else w for w in (wj, wk))
            scale = self.o.read_length / 150
            out += self.alleles[last if last is not None else self.selected[gene][0][0]].weight - mj * wj * scale - (0 if j == k else mk * wk * scale)
        return out

    def prior_active(self, majors: list[str]) -> bool:
        """Priors hold where every candidate's frequency is known and two of them differ."""
        if not self.o.frequency or not self.o.prior_weight:
            return False
        f = [self.o.frequency.get(m) for m in majors]
        return bool(f) and None not in f and len(set(f)) > 1

    def log_prior(self, a: str, b: str, same: bool) -> float:
        f = self.o.frequency
        return 2 * math.log(f[a]) if same else math.log(2) + math.log(f[a]) + math.log(f[b])

    def search_pairs(self, sweeps: int = 1000) -> None:
        """For genes with more than two types: the pair of ranks that explains most becomes 0 and 1, until nothing changes."""
        coverage = np.zeros(len(self.groups), int)
        for g in range(len(self.genes)):
            self._cover(g, 1, coverage)
        weights = [self._missing_weights(g) for g in range(len(self.genes))]
        for _ in range(sweeps):
            changed = False
            for g in range(len(self.genes)):
                n = self.types(g)
                if n <= 2:
                    continue
                first = {r: self.alleles[a] for a, r in reversed(self.selected[g])}
                prior = self.prior_active([first[r].major for r in sorted(first)])
                nulls = self.o.null_penalty > 0 and any(x.null for x in first.values())
                self._cover(g, -1, coverage)
                total = {r: sum(self.alleles[a].abundance for a, q in self.selected[g] if q == r) for r in range(n)}
                best = None
                for j in range(min(2, n - 1)):
                    for k in range(j if prior or nulls else j + 1, n):
                        value = self.pair_score(g, j, k, coverage, weights[g], n)
                        if j in first and k in first:
                            if prior:
                                value += self.o.prior_weight * self.log_prior(first[j].major, first[k].major, j == k)
                            value -= self._null_cost(first[j].null, first[k].null, j == k)
                        key = (value, total[j] * total[k])
                        if best is None or key > best[0]:
                            best = (key, j, k)
                _, j, k = best
                if j == k:
                    changed = True
                    self.selected[g] = [[a, 0] for a, r in self.selected[g] if r == j]
                elif (j, k) != (0, 1):
                    changed = True
                    place = {r: i for i, r in enumerate([j, k, *(r for r in range(n) if r not in (j, k))])}
                    for x in self.selected[g]:
                        x[1] = place[x[1]]
                for a, r in self.selected[g]:
                    self.alleles[a].rank = r
                self._cover(g, 1, coverage)
            if not changed:
                break

    def _null_cost(self, a: bool, b: bool, same: bool) -> float:
        return min(16.0, max(0.0, self.o.null_penalty)) * (2 * a if same else a + b)

    def reconcile_zygosity(self) -> None:
        """Drops the second of exactly two types where the priors prefer one and coverage does not make up for it."""
        if (not self.o.frequency or not self.o.prior_weight) and not self.o.null_penalty:
            return
        for g in range(len(self.genes)):
            if self.types(g) != 2:
                continue
            first = {r: self.alleles[a] for a, r in reversed(self.selected[g])}
            if 0 not in first or 1 not in first:
                continue
            a, b = first[0], first[1]
            prior = self.prior_active([a.major, b.major])
            if not prior and not (self.o.null_penalty > 0 and (a.null or b.null)):
                continue
            coverage = np.zeros(len(self.groups), int)
            for other in range(len(self.genes)):
                if other != g:
                    self._cover(other, 1, coverage)
            w = self._missing_weights(g)
            gain = self.pair_score(g, 0, 1, coverage, w, 2) - self.pair_score(g, 0, 0, coverage, w, 2)
            prefer = self._null_cost(a.null, b.null, False) - self._null_cost(a.null, a.null, True)
            if prior:
                prefer -= self.o.prior_weight * (self.log_prior(a.major, b.major, False) - self.log_prior(a.major, a.major, True))
            if prefer > 0 and gain <= prefer:
                self.selected[g] = [x for x in self.selected[g] if x[1] != 1]

    # qualities

    def rank_abundance(self, gene: int) -> list[float]:
        out = [0.0] * self.types(gene)
        for a, r in self.selected[gene]:
            out[r] += self.alleles[a].abundance
        return out

    def score_quality(self, cross_allele: float = 0.01) -> None:
        """Quality of each rank against noise from the gene's other ranks and from similar genes."""
        by_rank = [self.rank_abundance(g) for g in range(len(self.genes))]
        whole = [sum(x) for x in by_rank]
        for g in range(len(self.genes)):
            noise = self.o.cross_gene_rate * sum(self.similarity[h][g] * whole[h] for h in range(len(self.genes)) if h != g)
            quality = []
            for x in by_rank[g]:
                tail = normal_tail_value(2 * (math.sqrt(x) - math.sqrt((whole[g] - x) * cross_allele + noise))) if x else 1.0
                q = 60.0 if tail <= 0 else min(60.0, max(0.0, -math.log10(tail)))
                quality.append(0 if x < self.o.filter_cov else int(q))
            second = by_rank[g][2] if len(by_rank[g]) > 2 else 0.0
            for a, r in self.selected[g]:
                x = self.alleles[a]
                if x.quality > 0:
                    x.quality = quality[r]
                if r <= 1:
                    x.phred = phred(x.abundance, second)

    def call(self) -> "Sample":
        """All steps in order."""
        self.group_alleles()
        self.quantify()
        self.drop_unlikely()
        self.select()
        self.search_pairs()
        self.reconcile_zygosity()
        self.score_quality()
        return self

    # text

    def describe(self, gene: int) -> tuple[int, str, str, str]:
        """Number of alleles, the two slots (names, abundance, quality; tab-separated) and the further ranks."""
        used: set[str] = set()
        slots, more, n, first_quality = [], [], 0, -1
        for rank in range(max(2, self.types(gene))):
            if rank == 1 and first_quality == 0:
                used = set()
            names, total, quality = [], 0.0, -1
            for a, r in self.selected[gene]:
                if r != rank:
                    continue
                x = self.alleles[a]
                total += x.abundance
                if x.major not in used:
                    used.add(x.major)
                    names.append(x.major)
                    quality = x.quality
                    if rank <= 1:
                        n = rank + 1
            if rank <= 1:
                slots.append(f"{','.join(names)}\t{total:.6f}\t{quality}" if quality >= 0 else ",".join(names) + ".\t0\t-1")
                first_quality = quality if rank == 0 else first_quality
            elif names:
                more.append(",".join(names) + (f";{total:.6f};{quality}" if quality >= 0 else ""))
        return n, slots[0], slots[1], "|".join(more)

    def representatives(self, gene: int) -> list[int]:
        """At most two alleles: per rank 0 and 1 the most abundant confident one; for a single rank also its best of another class and exon sequence."""
        order = lambda a: (-self.alleles[a].ec_abundance, a)
        own = {}
        for rank in (0, 1):
            found = [a for a, r in self.selected[gene] if r == rank and self.alleles[a].quality >= 1]
            if found:
                own[rank] = min(found, key=order)
        if 0 in own and 1 not in own:
            head = self.alleles[own[0]]
            rest = [a for a, r in self.selected[gene] if r == 0 and self.alleles[a].ec != head.ec and self.alleles[a].exonic != head.exonic]
            if rest:
                own[1] = min(rest, key=order)
        return [own[r] for r in sorted(own)]

    def class_entropy(self, a: int) -> float:
        x = np.array([self.alleles[b].ec_abundance for b in self.classes[self.alleles[a].ec]])
        x = x[x > 0]
        return float(-(x / x.sum() * np.log(x / x.sum())).sum()) if len(x) else 0.0


def phred(best: float, second: float) -> int:
    """-10 log10 of the runner-up's share, from 0 to 60; 60 without a runner-up."""
    if second <= 0:
        return 60
    return int(min(60.0, max(0.0, -10 * math.log10(second / (best + second)))))


CALLS = "sample string, gene string, num_alleles int, allele1 string, abundance1 double, quality1 int, allele2 string, abundance2 double, quality2 int, secondary string"
CHOSEN = "sample string, gene string, seq_idx long, name string, quality int, abundance double, ec_abundance double"
METRICS = (
    "sample string, gene string, allele_rank int, seq_idx long, allele string, abundance double, balance_ratio double, missing_cov int, gt_quality int, runnerup_abundance double, "
    "q_gap int, q_min int, locus_gq_min int, ec_set_size int, identifiability double, ec_ambiguity_entropy double, series_set string"
)


def call_rows(s: Sample, sample: str) -> list[tuple]:
    """One row per gene in the order of CALLS."""
    out = []
    for g, gene in enumerate(s.genes):
        n, a, b, more = s.describe(g)
        x, y = a.split("\t"), b.split("\t")
        out.append((sample, gene, n, x[0], float(x[1]), int(x[2]), y[0], float(y[1]), int(y[2]), more))
    return out


def chosen_rows(s: Sample, sample: str, ids: list[int]) -> list[tuple]:
    """The representative alleles in the order of CHOSEN."""
    return [(sample, gene, ids[a], s.alleles[a].name, s.alleles[a].quality, s.alleles[a].abundance, s.alleles[a].ec_abundance) for g, gene in enumerate(s.genes) for a in s.representatives(g)]


def metric_rows(s: Sample, sample: str, ids: list[int]) -> list[tuple]:
    """Per gene and rank 0 and 1 the most abundant allele's figures, in the order of METRICS."""
    out = []
    for g, gene in enumerate(s.genes):
        total = [*s.rank_abundance(g), 0.0, 0.0, 0.0]
        two = s.types(g) > 1
        high, low = max(total[:2]), min(total[:2])
        balance = low / high if two and high > 0 else 1.0
        best = {}
        for rank in (0, 1):
            own = [a for a, r in s.selected[g] if r == rank]
            if own:
                best[rank] = min(own, key=lambda a: (-s.alleles[a].ec_abundance, a))
        locus = min((s.alleles[a].quality for a in best.values()), default=-1)
        for rank, a in best.items():
            x, members = s.alleles[a], s.classes[s.alleles[a].ec]
            out.append(
                (sample, gene, rank, ids[a], x.name, x.abundance, balance, x.missing, x.quality, total[2], x.phred, min(x.quality, x.phred), locus,
                 len(members), 1 / len(members), s.class_entropy(a), ";".join(s.alleles[m].major for m in members))
            )
    return out


def read_groups(read_hits: DataFrame) -> DataFrame:
    """(sample, read_id, seq_idx, qual, start, end, weight, adjust): reads with the same alleles and qualities as one group, known by its first read."""
    from pyspark.sql import functions as F

    per_read = read_hits.groupBy("sample", "read_id").agg(F.sort_array(F.collect_list(F.struct("seq_idx", "qual", "start", "end", "weight", "adjust"))).alias("hits"))
    key = F.transform("hits", lambda h: F.struct(h["seq_idx"].alias("seq_idx"), h["qual"].alias("qual")))
    rows = per_read.withColumn("key", key).select("sample", "read_id", "key", F.posexplode("hits").alias("k", "h"))
    best = F.col("h.qual") == 1
    groups = rows.groupBy("sample", "key", "k").agg(
        F.min("read_id").alias("read_id"), F.min_by(F.struct("h.start", "h.end"), "read_id").alias("first"),
        F.min(F.when(best, F.col("h.start"))).alias("start"), F.min(F.when(best, F.col("h.end"))).alias("end"),
        F.sum("h.weight").alias("weight"), F.sum("h.adjust").alias("adjust"),
    )
    at = F.col("key")[F.col("k")]
    return groups.select(
        "sample", "read_id", at["seq_idx"].alias("seq_idx"), at["qual"].cast("double").alias("qual"), F.coalesce("start", "first.start").alias("start"), F.coalesce("end", "first.end").alias("end"), "weight", "adjust"
    )


def genotype(read_hits: DataFrame, alleles: DataFrame, options: Options = Options(), similarity: dict | None = None, missing: DataFrame | None = None, output: str = "calls") -> DataFrame:
    """Calls, representative alleles (chosen) or metrics per sample, from read_hits (sample, read_id, seq_idx, start, end, weight, qual, adjust).

    alleles (seq_idx, name, gene, major, length, weight, missing, consensus, null, exonic) is the reference panel, which
    every worker holds; similarity maps pairs of genes to the share of the first one's k-mers that the second has;
    missing (sample, seq_idx, missing) replaces the panel's numbers of uncovered bases. Reads are first collapsed to
    groups per sample in a distributed aggregation; a sample's groups, few by then, meet in one task.
    """
    from pyspark.sql import functions as F

    common.ship(read_hits.sparkSession)
    panel = common.collected(alleles.select("seq_idx", "name", "gene", "major", "length", "weight", "missing", "consensus", "null", "exonic").orderBy("seq_idx"))
    shared = read_hits.sparkSession.sparkContext.broadcast((panel, similarity or {}))
    schema = {"calls": CALLS, "chosen": CHOSEN, "metrics": METRICS}[output]
    groups = read_groups(read_hits)
    if missing is not None:
        per_sample = missing.groupBy(F.col("sample").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("seq_idx", "missing"))).alias("uncovered"))
        groups = groups.join(per_sample, F.col("sample") == F.col("s"), "left").drop("s")
    else:
        groups = groups.withColumn("uncovered", F.lit(None).cast("map<bigint,int>"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, alike = shared.value
        ids = [int(x) for x in own["seq_idx"]]
        place = {s: i for i, s in enumerate(ids)}
        bare = dict(pdf["uncovered"].iloc[0]) if pdf["uncovered"].iloc[0] is not None else {}
        found = [Allele(r.name, r.gene, r.major, int(r.length), int(r.weight), int(bare.get(r.seq_idx, r.missing)), int(r.consensus), bool(r.null), r.exonic) for r in own.itertuples(index=False)]
        groups: dict[int, dict[int, Hit]] = {}
        for r in pdf.sort_values(["read_id", "seq_idx"]).itertuples(index=False):
            groups.setdefault(r.read_id, {})[place[r.seq_idx]] = Hit(int(r.start), int(r.end), np.float32(r.weight), float(r.qual), np.float32(r.adjust))
        names = list(dict.fromkeys(own["gene"]))
        matrix = np.array([[1.0 if a == b else alike.get((a, b), 0.0) for b in names] for a in names])
        s = Sample(found, list(groups.values()), options, matrix).call()
        name = pdf["sample"].iloc[0]
        rows = call_rows(s, name) if output == "calls" else chosen_rows(s, name, ids) if output == "chosen" else metric_rows(s, name, ids)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return groups.groupBy("sample").applyInPandas(run, schema)
