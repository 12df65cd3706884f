"""SentencePiece encoding and decoding as shortest paths through weighted finite-state transducers.

The model file compiles into transducers: the normaliser (character map, white-space rules, the dummy prefix and the
escape of spaces), the pieces (a trie with failure transitions whose accepting paths write a piece's id), byte fallback
(a character that is no piece writes its UTF-8 bytes' ids), and the model's order (which piece may follow which). An input
is composed with them: the arcs of the composition are the pieces and fallback characters that the input has between two
positions. The path of least weight in the tropical semiring (weights add along a path, the smallest sum wins) is the
encoding.

For unigram models an arc weighs the negated score of its piece and any piece may follow any other. For BPE models the
order weighs 0 or infinity: two pieces may follow one another only if merging their joint text by the model's ranks gives
just these two. A sequence whose neighbours all agree like that is the one that merging makes, so one finite path is
left. (Sums of scores can't serve as weights there: the merge result isn't the sequence of the best sum.)

A text is cut where no piece can reach over, which compiling finds out from the pieces: before spaces and, in the usual
models, before punctuation. So it is a chain of short inputs, and workers remember the results of a bounded number.
"""

from __future__ import annotations

import math
import re
import struct
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .wordpiece import VOCABULARY

SPACE = "▁"


def fields(data: bytes):
    """(number, value) of every field of a serialised protocol buffer."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {5: 4, 1: 8}[kind]
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0]
            i += n


class Normalizer:
    """The normaliser's transducer: rewrites the longest matching prefix by the character map, then treats spaces."""

    def __init__(self, spec: bytes):
        f = dict(fields(spec))
        self.dummy_prefix, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        blob = f.get(2, b"")
        self.units: tuple[int, ...] = ()
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units, self.written = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]

    def rewrite(self, text: str) -> str:
        """The character map, a double-array trie over UTF-8 bytes whose leaves point to zero-ended strings."""
        if not self.units:
            return text
        data, out, i, units = text.encode("utf-8", "replace"), [], 0, self.units
        while i < len(data):
            node, best, k = 0, None, i
            node ^= self._offset(units[0])
            while k < len(data):
                node ^= data[k]
                if node >= len(units) or units[node] & 0x800000FF != data[k]:
                    break
                leaf = units[node] >> 8 & 1
                node ^= self._offset(units[node])
                k += 1
                if leaf:
                    best = (k, units[node] & 0x7FFFFFFF)
            if best:
                out.append(self.written[best[1] : self.written.index(b"\0", best[1])])
                i = best[0]
            else:
                k = i + 1
                while k < len(data) and data[k] & 0xC0 == 0x80:
                    k += 1
                out.append(data[i:k])
                i = k
        return b"".join(out).decode("utf-8", "replace")

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class Memo:
    """Results by input in two generations of at most `size` each: what was used since the last change outlives the next."""

    def __init__(self, size: int = 200_000):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, inputs: set[str]) -> list[str]:
        """Those of the inputs that the new generation lacks, after a change of generations if they don't fit in."""
        out = [x for x in inputs if x not in self.new]
        if len(self.new) + len(out) > self.size:
            self.new, self.old = {}, self.new
            out = list(inputs)
        return out


class Transducer:
    """A compiled model: encode() gives ids, decode() a text."""

    def __init__(self, model: bytes):
        self.model = model
        pieces, trainer, normalizer = [], b"", b""
        for n, v in fields(model):
            if n == 1:
                f = dict(fields(v))
                pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, 1)))
            elif n == 2:
                trainer = v
            elif n == 3:
                normalizer = v
        own = dict(fields(trainer))
        self.bpe, self.normalize = own.get(3, 1) == 2, Normalizer(normalizer)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4)]
        self.id = {p: i for p, _, i in usable}
        self.score = {p: s for p, s, _ in usable}
        low = min(self.score.values(), default=0.0)
        self.fallback = 10.0 - low if not self.bpe else 0.0
        #: weight of a piece's arc, and the least weight that any arc adds to a path
        self.weight = {i: 0.0 if self.bpe else -s for _, s, i in usable}
        self.least = min([self.fallback, *self.weight.values()])
        self.inputs = self._inputs()
        self.name = [p for p, _, _ in pieces]
        self.text = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            self.text[i] = bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode()
        # the pieces' transducer: its failure transitions list the pieces that end at each character
        self.arcs = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.arcs.add_word(p, (i, len(p)))
        if self.id:
            self.arcs.make_automaton()
        self.plain = frozenset(p for p in self.id if len(p) == 1)
        self.orders: dict[int, float] = {}

    def _inputs(self) -> re.Pattern:
        """Cuts a normalised text where no piece can reach over.

        That is before spaces that follow another character, around a line's end if no longer piece has one, and before
        marks: characters that no piece has after a letter, a digit or another character that is no mark.
        """
        longer = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return re.compile(r"(?s).+")
        solo = "" if any("\n" in p for p in longer) else "\n"
        marks = {c for p in longer for c in p if not c.isalpha() and c not in "0123456789\n" + SPACE}
        while bad := {b for p in longer for a, b in zip(p, p[1:], strict=False) if b in marks and a not in marks and a != SPACE}:
            marks -= bad
        m = "".join(map(re.escape, sorted(marks)))
        rest = f"[^{SPACE}{solo}{m}]"
        with_marks = f"|{SPACE}*[{m}]+{rest}*" if m else ""
        return re.compile(f"{solo or '(?!)'}{with_marks}|{SPACE}*{rest}+|{SPACE}+")

    def __reduce__(self):
        return Transducer, (self.model,)

    def merged(self, text: str) -> list[str]:
        """Merging by rank: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def order(self, before: int, after: int) -> float:
        """Weight of one output after another (-1: the start) in a BPE model; a fallback character is numbered from the last piece on."""
        n = len(self.name)
        parts = [self.name[x] if x < n else chr(x - n) for x in (before, after) if x >= 0]
        return 0.0 if self.merged("".join(parts)) == parts else math.inf

    def compose(self, text: str):
        """Arcs (last character, (output, size)) of the input's composition with pieces and fallback, by where they end."""
        arcs = self.arcs.iter(text) if self.id else ()
        bare = [(i, (len(self.name) + ord(c), 1)) for i, c in enumerate(text) if c not in self.plain] if not self.plain.issuperset(text) else []
        return sorted(chain(arcs, bare), key=lambda x: x[0]) if bare else arcs

    def path(self, text: str) -> list[int]:
        """Outputs of the composition's shortest path. A state is a character with the output that ends there.

        In a unigram model the states of a character differ in nothing that follows, so the cheapest stands for all. In a
        BPE model a single one has a finite weight.
        """
        n, inf, bpe, rising = len(text), math.inf, self.bpe, self.least >= 0
        weight, fallback, orders, outputs = self.weight.get, self.fallback, self.orders, len(self.name) + 0x110000
        known = orders.get
        # by the last character; the state before the first one comes last, which is index -1
        cost, last, size = [inf] * n + [0.0], [-1] * (n + 1), [0] * n
        for end, (out, length) in self.compose(text):
            begin = end - length
            c = cost[begin]
            if c >= cost[end] and rising:  # no weight is below 0
                continue
            if bpe:
                key = last[begin] * outputs + out
                w = known(key)
                if w is None:
                    if len(orders) > 500_000:
                        orders.clear()
                    w = orders[key] = self.order(last[begin], out)
                c += w
            else:
                c += weight(out, fallback)
            if c < cost[end]:
                cost[end], last[end], size[end] = c, out, length
        found, k = [], n - 1
        while k >= 0:
            found.append(last[k])
            k -= size[k]
        return found[::-1]

    def encode_input(self, text: str) -> tuple[int, ...]:
        found, n = self.path(text), len(self.name)
        if max(found, default=0) < n:
            return tuple(found)
        out = []
        for x in found:
            if x < n:
                out.append(x)
            elif self.byte:
                out.extend(self.byte[b] for b in chr(x - n).encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str, memo: "Memo | None" = None) -> list[int]:
        """Ids of a text; memo remembers the results of inputs of up to 64 characters."""
        return self.encode_normal(self.normalize(text), memo)

    def encode_normal(self, text: str, memo: "Memo | None" = None) -> list[int]:
        """Ids of a text that is normalised already."""
        memo = Memo() if memo is None else memo
        inputs = self.inputs.findall(text)
        kinds = set(inputs)
        new = memo.missing(kinds)
        known, old = memo.new, memo.old
        for x in new:
            ids = old.get(x)
            known[x] = self.encode_input(x) if ids is None else ids
        out = list(chain.from_iterable(map(known.__getitem__, inputs)))
        for x in new:
            if len(x) > 64:
                del known[x]
        return out

    def decode_bytes(self, ids) -> bytes:
        """UTF-8 of the decoded text, without the dummy prefix."""
        out = b"".join(map(self.text.__getitem__, ids))
        return out[1:] if self.normalize.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def load(path: str = VOCABULARY) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


#: of this process: the compiled model and its memo, by the model's bytes
_compiled: dict = {}


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row of docs: doc_id, n_ids, ids, decoded_bytes, round_trip.

    ids are the encoding of the whole text, decoded_bytes the length of its decoding; round_trip tells whether that is the
    normalised text again. Null and empty texts have no ids and a round trip of 0 bytes; repeated rows are encoded alike.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the model file

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from lociframe.llm import sentencepiece_fst as own

        if shared.value not in own._compiled:
            own._compiled.clear()
            own._compiled[shared.value] = (own.Transducer(shared.value), own.Memo())
        t, memo = own._compiled[shared.value]
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                ids, size, back, same = [], [], [], []
                for raw in part.column("text").to_pylist():
                    normal = t.normalize(raw.decode("utf-8", "replace"))
                    x = t.encode_normal(normal, memo)
                    again = t.decode_bytes(x)
                    plain = normal.replace(SPACE, " ")
                    ids.append(np.array(x, np.int32))
                    size.append(len(x))
                    back.append(len(again))
                    same.append(again == (plain[1:] if t.normalize.dummy_prefix else plain).encode("utf-8", "replace"))
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids))), pa.array(back, pa.int64()), pa.array(same)],
                    ["doc_id", "n_ids", "ids", "decoded_bytes", "round_trip"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", C.as_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids long, ids array<int>, decoded_bytes long, round_trip boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, text. Null ids give a null text; an id outside the model is an error."""
    with open(path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        t = Transducer(shared.value)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
