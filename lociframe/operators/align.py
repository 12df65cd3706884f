"""Alignment kernels: banded affine global alignment, hit chaining, scoring and extension of read-to-allele overlaps.

They work on one read at a time and are called from Arrow batches; results are remembered per worker for the pairs of
short stretches that recur across reads and alleles.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

MATCH, MISMATCH, OPEN, EXTEND = 2, -2, -4, -1
#: edit operations: an insertion is a read base that the allele lacks
EQ, SUB, INS, DEL = 0, 1, 2, 3
BAND, RADIUS, MIN_HITS, REPEAT = 5, 10, 3, 100
_SWAP = str.maketrans("ACGT", "TGCA")
_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = range(4)


def revcomp(seq: str) -> str:
    return "".join(c if c in "ACGTN" else "N" for c in seq).translate(_SWAP)[::-1]


def same(a: str, b: str) -> bool:
    """Equal letters, or either an N."""
    return a == b or a == "N" or b == "N"


@lru_cache(maxsize=200_000)
def align(allele: str, read: str, band: int = BAND) -> tuple[int, ...]:
    """Edit operations of a global alignment of two stretches; none if either is empty.

    Equal lengths with up to two mismatches stay on the diagonal. Otherwise affine gaps within a band that is widened by
    the difference in length; on the way back the diagonal is preferred, then a deletion, then an insertion.
    """
    n, m = len(allele), len(read)
    if not n or not m:
        return ()
    if n == m:
        flat = tuple(EQ if same(a, b) else SUB for a, b in zip(allele, read, strict=True))
        if (n == 1) or flat.count(SUB) <= 2:
            return flat
    left, right = band + max(0, m - n), band + max(0, n - m)
    low = (n + 1) * (m + 1) * OPEN
    # row i: read base i; borders cost an opening for every base, the gap states their own border costs
    border = lambda k: OPEN + k * OPEN if k else 0
    best = [[low] * (n + 2) for _ in range(m + 1)]
    ins = [[low] * (n + 2) for _ in range(m + 1)]
    dele = [[low] * (n + 2) for _ in range(m + 1)]
    for j in range(n + 1):
        best[0][j] = border(j)
        dele[0][j] = OPEN + j * EXTEND if j else 0
        ins[0][j] = border(m + 1) if j else 0
    for i in range(1, m + 1):
        best[i][0] = dele[i][0] = border(i)
        ins[i][0] = OPEN + i * EXTEND
    for i in range(1, m + 1):
        first, last = max(1, i - left), min(n, i + right)
        up_b, up_i, row_b, row_i, row_d, base = best[i - 1], ins[i - 1], best[i], ins[i], dele[i], read[i - 1]
        if first > 1:
            row_b[first - 1] = row_i[first - 1] = row_d[first - 1] = low
        for j in range(first, last + 1):
            row_i[j] = max(up_i[j] + EXTEND, up_b[j] + OPEN + EXTEND)
            row_d[j] = max(row_d[j - 1] + EXTEND, row_b[j - 1] + OPEN + EXTEND)
            row_b[j] = max(up_b[j - 1] + (MATCH if same(allele[j - 1], base) else MISMATCH), row_i[j], row_d[j])
    out, i, j, state = [], m, n, EQ
    while i or j:
        if state == EQ:
            step = None
            if i and j:
                hit = same(allele[j - 1], read[i - 1])
                if best[i - 1][j - 1] + (MATCH if hit else MISMATCH) == best[i][j]:
                    step = EQ if hit else SUB
            if step is not None:
                out.append(step)
                i, j = i - 1, j - 1
            else:
                state = DEL if dele[i][j] >= ins[i][j] else INS
        elif state == INS:
            out.append(INS)
            if i:
                opened = best[i - 1][j] + OPEN + EXTEND == ins[i][j]
                i -= 1
                state = EQ if opened else INS
            else:
                state = DEL
        else:
            out.append(DEL)
            if j:
                opened = best[i][j - 1] + OPEN + EXTEND == dele[i][j]
                j -= 1
                state = EQ if opened else DEL
            else:
                state = INS
    return tuple(out[::-1])


def edit_counts(ops) -> tuple[int, int, int]:
    """Matches, mismatches and gap bases."""
    c = Counter(ops)
    return c[EQ], c[SUB], c[INS] + c[DEL]


def column_matches(counts: tuple[int, int, int, int], base: str) -> bool:
    """Whether a base fits a pileup column: an empty one, an N, or a base with over a third of it."""
    total = sum(counts)
    return total == 0 or base == "N" or total < 3 * counts["ACGT".index(base)]


def align_to_columns(columns: list[tuple[int, int, int, int]], read: str, gap: int = -4, band: int = BAND) -> tuple[int, ...]:
    """Edit operations against pileup columns with a linear gap cost, within a band as in align(); none if either is empty.

    Equal lengths with up to two mismatches stay on the diagonal. A border costs an opening besides its gaps, so the gap
    base next to the corner can't be told from a match and is written as one. The way back prefers the diagonal, then an
    insertion, then a deletion.
    """
    n, m = len(columns), len(read)
    if not n or not m:
        return ()
    fits = lambda i, j: column_matches(columns[j - 1], read[i - 1])
    if n == m:
        flat = tuple(EQ if fits(i, i) else SUB for i in range(1, n + 1))
        if n == 1 or flat.count(SUB) <= 2:
            return flat
    left, right = band + max(0, m - n), band + max(0, n - m)
    score = {(0, 0): 0} | {(i, 0): gap * (i + 1) for i in range(1, m + 1)} | {(0, j): gap * (j + 1) for j in range(1, n + 1)}
    low = (n + 1) * (m + 1) * gap
    steps = lambda i, j: ((score.get((i - 1, j - 1), low) + (MATCH if fits(i, j) else MISMATCH), EQ if fits(i, j) else SUB), (score.get((i - 1, j), low) + gap, INS), (score.get((i, j - 1), low) + gap, DEL))
    taken = {}
    for i in range(1, m + 1):
        for j in range(max(1, i - left), min(n, i + right) + 1):
            score[i, j], taken[i, j] = max(steps(i, j), key=lambda x: x[0])  # the first of equals
    out, i, j = [], m, n
    while i and j:
        step = taken[i, j]
        out.append(step)
        i, j = i - (step != DEL), j - (step != INS)
    out += [INS if i else DEL] * (i + j - 1) + [EQ] * (i + j > 0)
    return tuple(out[::-1])


@dataclass(frozen=True)
class Overlap:
    """A read's stretch on an allele; closed ranges, match counts two for each base."""

    seq_idx: int
    read_start: int
    read_end: int
    seq_start: int
    seq_end: int
    strand: int
    match: int
    similarity: float = 0.0
    relaxed: int = 0
    left_clip: int = 0
    right_clip: int = 0

    def order(self) -> tuple:
        """Sort key, better first: matches, similarity, span; then allele, strand and places."""
        return (-self.match, -self.similarity, self.read_start - self.read_end, self.seq_idx, self.strand, self.read_start, self.read_end, self.seq_start, self.seq_end)


class Index:
    """K-mer postings of the reference panel, for the workers: sorted arrays, 24 bytes a base at most, and a filter of 4 MB."""

    def __init__(self, seqs: list[str], k: int):
        if not 0 < k < 32:
            raise ValueError("k is 1 to 31")
        self.seqs, self.k = seqs, k
        # one letter between two sequences keeps windows within one
        words, valid = encoded("N".join(seqs), k)
        first = np.cumsum([0, *(len(s) + 1 for s in seqs)])[:-1]
        alike = np.zeros(len(words), bool)
        alike[1:] = valid[1:] & valid[:-1] & (words[1:] == words[:-1])
        at = first[first < len(words)]
        second = at[at + 1 < len(words)] + 1
        alike[second] = False  # the second window always counts, a first one of A alone never
        alike[at] = words[at] == 0
        where = np.flatnonzero(valid & ~alike)
        where = where[np.argsort(words[where], kind="stable")]
        self._words, self._starts = np.unique(words[where], return_index=True)
        self._ends = np.append(self._starts[1:], len(where))
        own = np.searchsorted(first, where, side="right") - 1
        self._seq, self._at = own.astype(np.int32), (where - first[own]).astype(np.int32) if len(where) else where.astype(np.int32)
        # 4 MB: bit 0 where a word may be in the panel, bit 1 where its reverse complement may
        self._maybe = np.zeros(1 << 22, np.uint8)
        self._maybe[_slots(self._words)] |= 1
        self._maybe[_slots(complements(self._words, k))] |= 2

    def found(self, seq: str) -> list[tuple[int, int]]:
        """The stretch of postings of every window of seq, empty for windows that the panel lacks."""
        words, valid = encoded(seq, self.k)
        if not len(self._words):
            return [(0, 0)] * len(words)
        i = np.minimum(np.searchsorted(self._words, words), len(self._words) - 1)
        met = valid & (self._words[i] == words)
        return list(zip(np.where(met, self._starts[i], 0).tolist(), np.where(met, self._ends[i], 0).tolist(), strict=True))

    def may_chain(self, reads: list[str], hit_length: int, most: int = 512) -> np.ndarray:
        """Whether chain() may yield anything for each read: False only where it can't, so the others alone need the kernel.

        All windows are looked up at once, repeats too. A read passes if hits on neighbouring diagonals of an allele are
        enough and far enough apart; one with more than `most` hits passes unseen.
        """
        out = np.zeros(len(reads), bool)
        begin, size = 0, 0
        for i, read in enumerate(reads):
            if size + len(read) > 1 << 18 and i > begin:
                out[begin:i] = self._may_chain(reads[begin:i], hit_length, most)
                begin, size = i, 0
            size += len(read) + 1
        out[begin:] = self._may_chain(reads[begin:], hit_length, most)
        return out

    def _may_chain(self, reads: list[str], hit_length: int, most: int) -> np.ndarray:
        out, k = np.zeros(len(reads), bool), self.k
        words, valid = encoded("N".join(reads), k)
        if not len(words) or not len(self._words):
            return out
        maybe = self._maybe[_slots(words)] * valid
        sizes = np.fromiter(map(len, reads), np.int64, len(reads))
        first = np.cumsum(sizes + 1) - sizes - 1
        at = np.flatnonzero(maybe)
        own = np.searchsorted(first, at, side="right") - 1
        # anchors have read offsets of their own
        at = at[np.bincount(own, minlength=len(reads))[own] * k >= hit_length]
        forward, backward = at[maybe[at] & 1 > 0], at[maybe[at] & 2 > 0]
        at, strand = np.concatenate([forward, backward]), np.repeat([0, 1], [len(forward), len(backward)])
        word = np.concatenate([words[forward], complements(words[backward], k)])
        i = np.minimum(np.searchsorted(self._words, word), len(self._words) - 1)
        met = self._words[i] == word
        at, strand, i = at[met], strand[met], i[met]
        own = np.searchsorted(first, at, side="right") - 1
        offset = np.where(strand == 0, at - first[own], first[own] + sizes[own] - k - at)
        n = self._ends[i] - self._starts[i]
        out |= np.bincount(own, weights=n, minlength=len(reads)) > most
        left = ~out[own]
        own, strand, offset, i, n = own[left], strand[left], offset[left], i[left], n[left]
        if not len(n):
            return out
        post = np.repeat(self._starts[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own, offset, place = np.repeat(own, n), np.repeat(offset, n), self._at[post].astype(np.int64)
        key, diagonal = (own * 2 + np.repeat(strand, n)) * len(self.seqs) + self._seq[post], offset - place
        order = np.lexsort((diagonal, key))
        key, diagonal, own, offset, place = key[order], diagonal[order], own[order], offset[order], place[order]
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(diagonal) > RADIUS)]))
        hits = np.diff(np.append(begins, len(key)))
        span = lambda x: np.maximum.reduceat(x, begins) - np.minimum.reduceat(x, begins) + k
        out[own[begins[(hits >= MIN_HITS) & (hits * k >= hit_length) & (span(offset) >= hit_length) & (span(place) >= hit_length)]]] = True
        return out

    def hits(self, read: str) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(strand, allele) -> [(read offset, allele offset)], strand -1 in the reverse complement's coordinates.

        A window equal to the one before is not looked up. Repeats (postings of 100 and more) are passed over unless at
        the read's ends, but at most k // 2 in a row; a passed-over window is not remembered as the one before.
        """
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        k, last = self.k, len(read) - self.k
        for strand, seq in ((1, read), (-1, revcomp(read))):
            before, skipped = "A" * k, 0
            for o, (start, end) in enumerate(self.found(seq)):
                w = seq[o : o + k]
                if o and w == before:
                    continue
                if end - start >= REPEAT and 0 < o < last and skipped < k // 2:
                    skipped += 1
                    continue
                skipped, before = 0, w
                if end > start:
                    for i, at in zip(self._seq[start:end].tolist(), self._at[start:end].tolist(), strict=True):
                        out[strand, i].append((o, at))
        return out


def encoded(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of k letters as a number of two bits a letter, and whether it has letters of ACGT only."""
    codes = _CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = max(0, len(codes) - k + 1)
    words, have, step, width, bad = np.zeros(n, np.int64), 0, (codes & 3).astype(np.int64), 1, np.concatenate([[0], np.cumsum(codes > 3)])
    # windows of 1, 2, 4 ... letters; those in k's binary form make up its windows
    while True:
        if k & width:
            words = words << 2 * width | step[have : have + n]
            have += width
        if have == k:
            return words, bad[k : k + n] == bad[:n]
        step, width = step[:-width] << 2 * width | step[width:], 2 * width


def complements(words: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of windows that encoded() numbers."""
    out, rest = np.zeros_like(words), words.copy()
    for _ in range(k):
        out = out << 2 | 3 - (rest & 3)
        rest >>= 2
    return out


def _slots(words: np.ndarray) -> np.ndarray:
    """A number below 2^22 for each word; the word itself for windows of up to 11."""
    return (words ^ words >> 22 ^ words >> 44) & (1 << 22) - 1


_last: list[Index] = []


def index_of(seqs: list[str], k: int) -> Index:
    """The index of these very sequences (a broadcast's value), built once per worker process rather than once a task."""
    if not _last or _last[0].seqs is not seqs or _last[0].k != k:
        _last[:] = [Index(seqs, k)]
    return _last[0]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by allele, then read offset) with growing read offsets; of equal allele offsets the first stays."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (a, _) in enumerate(pairs):
        k = bisect_left(tails, a)
        if k < len(tails) and tails[k] == a:
            continue
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(a)
            ends.append(i)
        else:
            tails[k], ends[k] = a, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    out.reverse()
    return [p for i, p in enumerate(out) if not i or p[1] != out[i - 1][1]]


def covered(offsets: list[int], k: int) -> int:
    """Bases under windows of k at these increasing offsets."""
    total = 0
    for i, o in enumerate(offsets):
        total += k if i == 0 or o > offsets[i - 1] + k - 1 else o - offsets[i - 1]
    return total


def chain(strand: int, seq_idx: int, hits: list[tuple[int, int]], k: int, hit_length: int, radius: int = RADIUS):
    """(overlap, anchors) for each run of neighbouring diagonals that carries enough."""
    if len(hits) < MIN_HITS:
        return
    own = sorted(hits, key=lambda p: (p[0] - p[1], p[0], p[1]))
    begin = 0
    for end in range(1, len(own) + 1):
        if end < len(own) and (own[end][0] - own[end][1]) - (own[end - 1][0] - own[end - 1][1]) <= radius:
            continue
        run, begin = own[begin:end], end
        if len(run) < MIN_HITS or len(run) * k < hit_length:
            continue
        count = Counter(a - b for a, b in run)
        main = max(count, key=lambda d: (count[d], -d))  # the commonest diagonal, the first of equals
        near: dict[int, int] = {}
        for a, b in run:
            near[a] = min(near.get(a, 1 << 60), abs(a - b - main))
        kept = sorted((p for p in run if abs(p[0] - p[1] - main) == near[p[0]]), key=lambda p: (p[1], p[0]))
        line = increasing(kept)
        if len(line) * k < hit_length:
            continue
        on_read = covered([a for a, _ in line], k)
        if on_read < hit_length or covered([b for _, b in line], k) < hit_length:
            continue
        yield Overlap(seq_idx, line[0][0], line[-1][0] + k - 1, line[0][1], line[-1][1] + k - 1, strand, 2 * on_read), line


def is_candidate(index: Index, read: str, hit_length: int, similarity: float) -> bool:
    """Whether the bucket (strand, allele) with most hits covers the read well enough."""
    buckets = index.hits(read) if len(read) >= index.k else {}
    if not buckets:
        return False
    strand, seq = min(buckets, key=lambda b: (-len(buckets[b]), b[0], b[1]))
    if index.k * len(buckets[strand, seq]) < hit_length:
        return False
    allowed = int(len(read) * (1.0 - similarity)) * index.k
    return any(len(read) - o.match // 2 <= allowed for o, _ in chain(strand, seq, buckets[strand, seq], index.k, hit_length))


def read_low_complexity(read: str) -> bool:
    n = [read.count(b) for b in "ACGT"]
    return max(n) >= len(read) // 2 or read.count("N") >= len(read) // 10 or sum(c <= 2 for c in n) >= 2


def span_low_complexity(span: str) -> bool:
    low = [c for c in (span.count(b) for b in "ACGT") if c <= 2]
    return 7 * sum(low) < len(span) and len(low) >= 2


def overlaps(index: Index, read: str, hit_length: int, similarity: float, prefilter: float = 0.0) -> list[Overlap]:
    """Overlaps of the read's better strand, scored along their anchors; those below the similarity are left out."""
    k = index.k
    if len(read) < k:
        return []
    buckets = index.hits(read)
    found = [x for key in sorted(buckets) for x in chain(*key, buckets[key], k, hit_length)]
    if not found:
        return []
    strand = min(found, key=lambda x: x[0].order())[0].strand
    seq = read if strand == 1 else revcomp(read)
    out = []
    for o, line in found:
        if o.strand != strand:
            continue
        span = o.read_end - o.read_start + o.seq_end - o.seq_start + 2
        if prefilter > 0 and o.match / span < prefilter:
            continue  # its similarity stays 0
        allele = index.seqs[o.seq_idx]
        match = 2 * k
        for (a0, b0), (a, b) in zip(line, line[1:], strict=False):
            over_read, over_seq = a0 + k > a, b0 + k > b
            if over_read and (b - a == b0 - a0):
                match += 2 * (a - a0)
            elif over_read or over_seq:
                match += 2 * (min(a - a0, b - b0) if over_read and over_seq else a - a0 if over_read else b - b0)
            else:
                match += 2 * k + 2 * edit_counts(align(allele[b0 + k : b], seq[a0 + k : a]))[0]
        s = 0.0 if span_low_complexity(seq[o.read_start : o.read_end + 1]) else match / span
        if s >= similarity:
            out.append(replace(o, match=match, similarity=s))
    return out


def extend(read: str, allele: str, o: Overlap, similarity: float) -> Overlap | None:
    """The overlap carried to the read's ends, up to the allele's ends or an N; what lies beyond is clipped and counts as matching."""
    left = min(o.read_start, o.seq_start)
    left_clip = max(0, o.read_start - o.seq_start)
    gap = allele.rfind("N", o.seq_start - left, o.seq_start)
    if gap >= 0:
        room = o.seq_start - gap - 1
        left_clip, left = left - room, room
    right = min(len(read) - 1 - o.read_end, len(allele) - 1 - o.seq_end)
    right_clip = max(0, len(read) - 1 - o.read_end - (len(allele) - 1 - o.seq_end))
    gap = allele.find("N", o.seq_end + 1, o.seq_end + 1 + right)
    if gap >= 0:
        room = gap - o.seq_end - 1
        right_clip, right = right - room, room
    match = o.match
    match += 2 * edit_counts(align(allele[o.seq_start - left : o.seq_start], read[o.read_start - left : o.read_start]))[0]
    match += 2 * edit_counts(align(allele[o.seq_end + 1 : o.seq_end + 1 + right], read[o.read_end + 1 : o.read_end + 1 + right]))[0]
    span = o.read_end - o.read_start + o.seq_end - o.seq_start + 2 + 2 * left + 2 * right
    clip = 2 * (left_clip + right_clip)
    s = (match + clip) / (span + clip)
    if s < similarity:
        return None
    return replace(
        o, read_start=o.read_start - left, read_end=o.read_end + right, seq_start=o.seq_start - left, seq_end=o.seq_end + right, match=match + clip, similarity=s, relaxed=match, left_clip=left_clip, right_clip=right_clip
    )


def crosses(allele: str, start: int, end: int) -> bool:
    """Whether a closed range touches an N or leaves the allele."""
    return start < 0 or end >= len(allele) or "N" in allele[start : end + 1]


def assign(index: Index, read: str, hit_length: int, similarity: float, prefilter: float = 0.0) -> tuple[list[Overlap], list[tuple[int, int, str]]]:
    """Extended overlaps of a read, and the pileup cells (allele, position, base) of its near-best ones.

    Better overlaps go first; after the first that can't be extended only as good ones, or nearly perfect ones that need
    clipping, are tried. With more than a thousand, those within 0.1 of the best's similarity stay. `prefilter` leaves
    out overlaps whose anchors alone reach less than that similarity.
    """
    found = sorted(overlaps(index, read, hit_length, similarity, prefilter), key=Overlap.order)
    if not found:
        return [], []
    seq = read if found[0].strand == 1 else revcomp(read)
    out: list[Overlap] = []
    strict, good = False, -1
    for o in found:
        allele = index.seqs[o.seq_idx]
        if crosses(allele, o.seq_start, o.seq_end):
            continue
        clipped = crosses(allele, o.seq_start - o.read_start, o.seq_end + len(seq) - o.read_end - 1)
        if strict and o.match < good and not (clipped and o.similarity >= 0.95):
            continue
        longer = extend(seq, allele, o, similarity)
        if longer is None:
            strict = True
        else:
            out.append(longer)
            if not strict:
                good = max(good, o.match)
    cells = []
    if out:
        best = min(out, key=Overlap.order)
        for i, o in enumerate(out):
            if o.match < best.match - 10:
                out[i] = replace(o, relaxed=0)
                continue
            out[i] = replace(o, relaxed=o.match)
            cells += matched_cells(index.seqs[o.seq_idx], seq, o)
    if len(out) > 1000:
        out.sort(key=Overlap.order)
        out = [o for i, o in enumerate(out) if not i or o.similarity >= out[0].similarity - 0.1]
    return out, cells


def columns(allele: str, seq: str, o: Overlap):
    """(operation, allele position, read position) along an overlap's alignment."""
    at, on = o.seq_start, o.read_start
    for op in align(allele[o.seq_start : o.seq_end + 1], seq[o.read_start : o.read_end + 1]):
        yield op, at, on
        at += op != INS
        on += op != DEL


def matched_cells(allele: str, seq: str, o: Overlap) -> list[tuple[int, int, str]]:
    return [(o.seq_idx, at, seq[on]) for op, at, on in columns(allele, seq, o) if op == EQ and seq[on] in "ACGT"]


@dataclass(frozen=True)
class Fragment:
    """A fragment's place on one allele, from one or both mates."""

    seq_idx: int
    start: int
    end: int
    match: int
    similarity: float
    paired: bool
    first: Overlap
    second: Overlap | None
    from_second: bool = False


def fragments(first: list[Overlap], second: list[Overlap] | None, seqs: list[str], hit_length: int, near_end: int = 100) -> list[Fragment]:
    """Best fragment placements: mates on the same allele, opposite strands and in order; ties of the best stay.

    With overlaps of one mate alone, these count only if all are perfect, long and near the end the other mate may have
    left by. A mate that does better alone where its partner has no room, or much better, takes the fragment away.
    """
    made: list[Fragment] = []
    if second is None:
        made = [Fragment(o.seq_idx, o.seq_start, o.seq_end, o.match, o.similarity, False, o, None) for o in first]
    elif not first or not second:
        for own, flag in ((first, False), (second, True)):
            made += [Fragment(o.seq_idx, o.seq_start, o.seq_end, o.match, o.similarity, False, o, None, flag) for o in own]
    else:
        by = defaultdict(list)
        for o in second:
            by[o.seq_idx].append(o)
        for o in first:
            for p in by[o.seq_idx]:
                if p.strand != o.strand and (p.seq_start - o.seq_start) * o.strand > 0:
                    both = o.match + p.match
                    size = sum(x.read_end - x.read_start + x.seq_end - x.seq_start + 2 + 2 * (x.left_clip + x.right_clip) for x in (o, p))
                    start, end = (o.seq_start, p.seq_end) if o.strand == 1 else (p.seq_start, o.seq_end)
                    made.append(Fragment(o.seq_idx, start, end, both, both / size, True, o, p))
    best_of: dict[int, Fragment] = {}
    for f in made:
        old = best_of.get(f.seq_idx)
        if old is None or _fragment_order(f) < _fragment_order(old):
            best_of[f.seq_idx] = f
    if not best_of:
        return []
    top = max((f.match, f.similarity) for f in best_of.values())
    out = [f for f in best_of.values() if (f.match, f.similarity) == top]
    if second is None:
        return out
    if not out[0].paired:
        for f in out:
            o, size = f.first, len(seqs[f.seq_idx])
            span = f.end - f.start + 1 + o.read_end - o.read_start + 1
            inside = f.end + near_end < size if o.strand == 1 else f.start - near_end >= 0
            if f.similarity < 1 or crosses(seqs[f.seq_idx], f.start, f.end) or span < 3 * hit_length or inside:
                return []
        return out
    a, b = out[0].first, out[0].second
    for own, mine, other in ((first, a, b), (second, b, a)):
        for o in own:
            tie = o.match == mine.match and o.similarity > mine.similarity and o.seq_idx not in best_of
            if (o.match > mine.match or tie) and (_no_room(o, mine, other, seqs[o.seq_idx]) or o.similarity > other.similarity + 0.1):
                return []
    return out


def _fragment_order(f: Fragment) -> tuple:
    return (-f.match, -f.similarity, f.start - f.end, f.start, f.end)


def _no_room(o: Overlap, mine: Overlap, other: Overlap, allele: str) -> bool:
    """Whether the partner, as far away as in the chosen pair, would leave the allele or cross an N."""
    if o.strand == 1:
        end = o.seq_end + other.seq_end - mine.seq_end
        return len(allele) - 1 < end or crosses(allele, o.seq_end, end + 1)
    start = o.seq_start - (mine.seq_start - other.seq_start)
    return start < 0 or crosses(allele, start - 1, o.seq_start)
