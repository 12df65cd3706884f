"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with two roots: one for pieces that begin a word, one for those that continue it. Where a
node has no child for the next character, its failure link leads to the node that greedy longest matching would be in
after popping the longest pieces of what was read; the number of popped pieces is stored with the link. So a word takes
one pass, and its token count is a sum of stored numbers: no piece is ever built.
"""

from __future__ import annotations

import os
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: default place of the public vocabularies; callers may give another file
VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"


def pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin and that continue a word, of a sentencepiece model: those with a leading U+2581, and the others.

    Control, unknown and byte pieces, the bare U+2581 and pieces with it elsewhere are not word pieces.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    head, tail = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        p = sp.id_to_piece(i)
        body = p.removeprefix("▁")
        if body and "▁" not in body:
            (head if body != p else tail).append(body)
    return head, tail


@dataclass
class Automaton:
    """Children, failure links (-1: none) and popped-piece counts of the trie; nodes 0 and 1 are the two roots."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])
    fail: list[int] = field(default_factory=list)
    pops: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, head: list[str], tail: list[str]) -> "Automaton":
        a = cls()
        terminal = [False, False]
        for root, words in ((0, head), (1, tail)):
            for w in words:
                node = root
                for ch in w:
                    nxt = a.children[node].get(ch)
                    if nxt is None:
                        nxt = a.children[node][ch] = len(a.children)
                        a.children.append({})
                        terminal.append(False)
                    node = nxt
                terminal[node] = True
        a.fail, a.pops = [-1] * len(a.children), [0] * len(a.children)
        queue = deque([0, 1])
        while queue:  # breadth first: the links of shorter strings are known
            u = queue.popleft()
            for ch, v in a.children[u].items():
                queue.append(v)
                if terminal[v]:
                    a.fail[v], a.pops[v] = 1, 1
                    continue
                z, popped = a.fail[u], a.pops[u]
                while z >= 0 and ch not in a.children[z]:
                    popped += a.pops[z]
                    z = a.fail[z]
                if z >= 0:
                    a.fail[v], a.pops[v] = a.children[z][ch], popped
        return a

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of a word; -1 if it can't be split (then it is one unknown token)."""
        children, fail, pops = self.children, self.fail, self.pops
        u, n = 0, 0
        for ch in word:
            while ch not in children[u]:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = children[u][ch]
        while u != 1:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return -1
        return n


def count_tokens(docs: DataFrame, path: str = VOCABULARY, memo_size: int = 200_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of anything but ASCII white space; a word that the vocabulary can't spell is one unknown token. Null
    and empty texts have none; repeated rows count alike. Workers remember the counts of memo_size words at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces(path))  # as large as the vocabulary file

    def run(batches):
        import pyarrow as pa

        automaton, memo = Automaton.build(*shared.value), {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = text.split()
                new = set(words).difference(memo)
                if len(memo) + len(new) > memo_size:
                    memo = {}
                    new = set(words)
                for w in new:
                    memo[w] = automaton.count(w.decode("utf-8", "replace"))
                own = list(map(memo.__getitem__, words))
                unknown = own.count(-1)
                out.append((len(words), sum(own) + 2 * unknown, unknown))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", C.as_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
