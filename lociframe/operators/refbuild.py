"""Building the reference panel from a database of raw alleles.

A gene's alleles are one group of applyInPandas. What crosses genes, the seeded random flanks of genes without a real
one, is drawn on the driver in the order in which the panel meets those genes.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.maths import Rand48
from . import common

UTR, INTRON = 50, 200


def mode(values):
    """The commonest value; of equals the largest as text. None without values."""
    count = Counter(values)
    return max(count, key=lambda v: (count[v], str(v))) if count else None


def cut(seq: str, start: int, length: int) -> str:
    """Substring with both ends moved into the sequence."""
    a = min(max(start, 0), len(seq))
    return seq[a : max(a, min(max(start + max(length, 0), 0), len(seq)))]


class Body:
    """One allele on its way into the panel: text, exon places in it, and what its flanks lack."""

    def __init__(self, name: str, ord_: int, exons: list[tuple[int, int]], partial: bool, seq: str, dna: bool):
        self.name, self.ord, self.true, self.partial = name, ord_, exons, partial
        self.size = 2 * UTR + sum(e - s + 1 for s, e in exons)
        begin = exons[0][0] - UTR
        self.lack5, self.lack3 = max(0, -begin), 0
        self.real5 = seq[max(0, begin) : exons[0][0]].upper()
        # a short flank leaves off its last base
        self.short5 = (exons[0][0] - 1, seq[: max(0, exons[0][0] - 1)].upper()) if self.lack5 else None
        text, self.exons = self.real5, []
        if dna:
            self.partial |= any(b[0] <= a[1] + 1 for a, b in zip(exons, exons[1:], strict=False))
            text += self._blocks(seq)
        else:
            at = UTR
            for s, e in exons:
                text += cut(seq, s, e - s + 1).upper()
                self.exons.append([at, at + e - s])
                at += e - s + 1
        after = exons[-1][1] + 1
        self.real3, self.short3 = None, None
        if after > len(seq):
            self.partial = True
        else:
            flank = seq[after : after + UTR].upper()
            text += flank
            if after + UTR - 1 >= len(seq):
                self.lack3, self.short3 = after + UTR - len(seq), flank
            else:
                self.real3 = flank
        self.text = text

    def _blocks(self, seq: str) -> str:
        """Exons with 200 bases of intron on both sides; neighbours whose introns meet share a block, others are parted by N."""
        blocks: list[list[tuple[int, int]]] = []
        for s, e in self.true:
            if blocks and min(blocks[-1][-1][1] + INTRON, len(seq) - 1) >= s - INTRON:
                blocks[-1].append((s, e))
            else:
                blocks.append([(s, e)])
        out, at = "", UTR
        for i, own in enumerate(blocks):
            first, last = own[0][0], own[-1][1]
            begin, end = first, last
            if i:
                out += "N"
                begin = max(0, first - INTRON)
                at += 1 + INTRON
            if i < len(blocks) - 1:
                end = min(last + INTRON, len(seq) - 1)
            out += cut(seq, begin, end - begin + 1).upper()
            self.exons += [[at + s - first, at + e - first] for s, e in own]
            at += last - first + 1 + INTRON
        return out

    def last_exon(self) -> int:
        return self.exons[-1][1] - self.exons[-1][0] + 1


def rescued(bodies: list[Body], dna: bool) -> list[Body]:
    """Full alleles in order, then partial ones that are as long as their gene's full ones (and have as many exons)."""
    full = [b for b in bodies if not b.partial]
    size = mode(b.size for b in full)
    if size is None:
        return full
    n_exons = mode(len(b.exons) for b in full)
    back = [b for b in bodies if b.partial and b.size >= size and (not dna or len(b.exons) == n_exons)]
    if dna:
        introns = defaultdict(list)
        for b in full:
            if len(b.exons) == n_exons:
                for i, (x, y) in enumerate(zip(b.exons, b.exons[1:], strict=False)):
                    introns[i].append(cut(b.text, x[1] + 1, y[0] - x[1] - 1))
        usual = {i: mode(v) for i, v in introns.items()}
        for b in back:
            splice(b, usual)
    return full + back


def splice(b: Body, introns: dict[int, str]) -> None:
    """Put the usual intron where two exons of a partial allele touch."""
    places = [[s - b.lack5, e - b.lack5] for s, e in b.exons]
    moved = 0
    for i in range(1, len(places)):
        if places[i][0] + moved == places[i - 1][1] + 1 and i - 1 in introns:
            at = places[i - 1][1] + 1
            b.text = b.text[:at] + introns[i - 1] + b.text[at:]
            moved += len(introns[i - 1])
        places[i] = [places[i][0] + moved, places[i][1] + moved]
    b.exons = [[s + b.lack5, e + b.lack5] for s, e in places]


def flank(bodies: list[Body], five: bool):
    """A gene's real flank, the first seen; else the longest short one, to be laid over random bases; and whether these are needed."""
    whole = [b.real5 if five else b.real3 for b in bodies if (not b.lack5 if five else b.real3 is not None)]
    if whole:
        return whole[0], False
    best = ""
    for b in bodies:
        if five and b.short5 and (not best or b.short5[0] > len(best)):
            best = b.short5[1]
        if not five and b.short3 and (not best or len(b.short3) > len(best)):
            best = b.short3
    return best, True


def overlay(random: str, real: str, five: bool) -> str:
    """Real bases over the end of the random ones that touches the exons."""
    if len(real) >= len(random):
        return real
    return random[: len(random) - len(real)] + real if five else real + random[len(real) :]


def trim_exonized(own: list[Body], full: list[Body]) -> None:
    """Exons longer than usual whose neighbouring intron is as much shorter: the surplus goes."""
    n_exons = mode(len(b.exons) for b in full)
    shaped = [b for b in full if len(b.exons) == n_exons]
    exon = {i: mode(b.exons[i][1] - b.exons[i][0] + 1 for b in shaped) for i in range(n_exons or 0)}
    gap = lambda b, i: b.true[i + 1][0] - b.true[i][1] - 1
    intron = {i: mode(gap(b, i) for b in shaped) for i in range((n_exons or 0) - 1)}
    # lengths are taken before any allele is changed
    for b in own:
        if len(b.exons) != n_exons:
            continue
        for i in range(n_exons - 1):
            extra = b.exons[i][1] - b.exons[i][0] + 1 - exon[i]
            if extra <= 0:
                continue
            n_right = b.exons[i][1] + 1 + INTRON
            n_left = b.exons[i][0] - 1 - INTRON
            probe = b.exons[i - 1][1] - 1 - INTRON if i else -1
            if intron[i] == gap(b, i) + extra and n_right < len(b.text) and b.text[n_right] == "N":
                b.text = b.text[: n_right - extra] + b.text[n_right:]
                if extra > INTRON:
                    b.exons[i][1] -= extra - INTRON
            elif i and intron[i - 1] == gap(b, i - 1) + extra and n_left >= 0 and 0 <= probe < len(b.text) and b.text[probe] == "N":
                b.text = b.text[: n_left + 1] + b.text[n_left + extra + 1 :]
                b.exons[i][0] += INTRON if extra > INTRON else -extra
                b.exons[i][1] -= extra
            else:
                continue
            for x in b.exons[i + 1 :]:
                x[0] -= extra
                x[1] -= extra


def bodies_of(pdf: pd.DataFrame, dna: bool) -> list[Body]:
    rows = pdf.sort_values("ord").itertuples(index=False)
    return [Body(r.name, r.ord, [(int(x["s"]), int(x["e"])) for x in r.exons], bool(r.partial), r.seq, dna) for r in rows if len(r.exons)]


def finish(bodies: list[Body], dna: bool, five: str, three: str) -> list[Body]:
    """The gene's panel alleles with padded flanks, fixed exons and trimmed tails."""
    full = [b for b in bodies if not b.partial]
    own = rescued(bodies, dna)
    last = mode(b.true[-1][1] - b.true[-1][0] + 1 for b in bodies)
    for b in own:
        b.text = (five[: b.lack5] if b.lack5 else "") + b.text + (three[-b.lack3 :] if b.lack3 else "")
    if dna and full:
        trim_exonized(own, full)
    usual = mode(len(b.text) for b in own)
    for b in own:
        surplus = b.last_exon() - last
        if len(b.text) > usual and surplus > 0:
            b.text = b.text[: len(b.text) - surplus]
    return own


PANEL = "name string, ord long, late int, exons array<struct<s:int,e:int>>, seq string"


def build(raw: DataFrame, dna: bool) -> DataFrame:
    """The panel (seq_idx, name, exons, seq) of raw alleles (ord, name, exons as 0-based closed structs s and e, partial, seq).

    Full alleles come in the order of ord, rescued partial ones after them.
    """
    common.ship(raw.sparkSession)
    own = raw.withColumn("gene", S.gene(F.col("name")))

    def needs(pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = bodies_of(pdf, dna)
        kept = rescued(bodies, dna)
        first = min(((b.partial, b.ord) for b in kept), default=None)
        (five, rand5), (three, rand3) = flank(bodies, True), flank(bodies, False)
        if first is None:
            return pd.DataFrame(columns=["gene", "late", "ord", "five", "rand5", "three", "rand3"])
        return pd.DataFrame([(pdf["gene"].iloc[0], int(first[0]), first[1], five, rand5, three, rand3)], columns=["gene", "late", "ord", "five", "rand5", "three", "rand3"])

    # one row per gene
    rows = own.groupBy("gene").applyInPandas(needs, "gene string, late int, ord long, five string, rand5 boolean, three string, rand3 boolean").orderBy("late", "ord").collect()
    random, flanks = Rand48(17), {}
    for r in rows:
        five = overlay(random.bases(UTR), r.five, True) if r.rand5 else r.five
        three = overlay(random.bases(UTR), r.three, False) if r.rand3 else r.three
        flanks[r.gene] = (five, three)

    def panel(pdf: pd.DataFrame) -> pd.DataFrame:
        five, three = flanks.get(pdf["gene"].iloc[0], ("", ""))
        out = [(b.name, b.ord, int(b.partial), [{"s": s, "e": e} for s, e in b.exons], b.text) for b in finish(bodies_of(pdf, dna), dna, five, three) if b.text]
        return pd.DataFrame(out, columns=["name", "ord", "late", "exons", "seq"])

    made = own.groupBy("gene").applyInPandas(panel, PANEL)
    from pyspark.sql import Window

    return made.select((F.row_number().over(Window.orderBy("late", "ord")) - 1).cast("long").alias("seq_idx"), "name", "exons", "seq")


def header(name, exons):
    """The panel's FASTA header: name, number of exons, their places."""
    return F.concat(F.lit(">"), F.concat_ws(" ", name, F.size(exons).cast("string"), F.concat_ws(" ", F.flatten(F.transform(exons, lambda x: F.array(x["s"].cast("string"), x["e"].cast("string")))))))


def annotate(panel: DataFrame, coords: DataFrame) -> DataFrame:
    """(name, chrom, start, end, strand, seq): the panel with its genes' places; `chr19 -1 -1 +` for unknown genes."""
    c = common.small(coords.select(F.col("gene").alias("g"), "chrom", "start", "end", "strand"))
    own = panel.join(c, S.gene(F.col("name")) == F.col("g"), "left")
    return own.select(*(["seq_idx"] if "seq_idx" in panel.columns else []), "name", F.coalesce("chrom", F.lit("chr19")).alias("chrom"), F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("strand", F.lit("+")).alias("strand"), "seq")


def build_all(raw: DataFrame, coords: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a reference: dna_seq, dna_coord, rna_seq, rna_coord."""
    out = {}
    for kind in ("dna", "rna"):
        panel = common.stored(build(raw, kind == "dna"), f"{kind}-panel")
        out[f"{kind}_seq"], out[f"{kind}_coord"] = panel, annotate(panel, coords)
    return out
