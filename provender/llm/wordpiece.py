"""Token counts by a linear longest-match automaton: a trie with failure links and counts of the pieces they pop."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.llm.bpe import blocks

SPACE = "\u2581"


def load_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """(starts, rest) of a piece model's file: pieces with the mark of a word's start, without it, and the others. The bare
    mark is the empty start. A piece for a single byte goes on a word anywhere; control pieces and runs of marks match nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    starts, rest = set(), set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            rest.add(bytes([int(piece[3:5], 16)]))
        elif not (model.is_control(i) or model.is_unknown(i) or SPACE in piece[1:]):
            starts.add(piece[1:].encode()) if piece[0] == SPACE else rest.add(piece.encode())
    return starts, rest


class LongestMatch:
    """Counts the pieces of the greedy longest match without building them, in time linear in the word.

    ``starts`` are the pieces that may begin a word, ``rest`` those that may go on (the same set if not given). An empty
    start is a token that takes nothing of the word and is used where no other start fits. A node's
    failure link leads to what is left to match after the longest pieces of its string are popped; ``pops`` counts them.
    """

    ROOT, MORE = 0, 1

    def __init__(self, starts, rest=None):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        ends: set[int] = set()
        nodes = 2
        for root, vocabulary in ((self.ROOT, starts), (self.MORE, starts if rest is None else rest)):
            for piece in vocabulary:
                u = root
                for c in piece:
                    key = u << 8 | c
                    if (v := self.step.get(key)) is None:
                        v = self.step[key] = nodes
                        nodes += 1
                    u = v
                if piece:
                    ends.add(u)
        kids: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.step.items():
            kids.setdefault(key >> 8, []).append((key & 255, v))
        self.fail, self.pops = [-1] * nodes, [0] * nodes
        if b"" in starts:
            self.fail[self.ROOT], self.pops[self.ROOT] = self.MORE, 1
        todo = deque([self.ROOT, self.MORE])
        while todo:
            u = todo.popleft()
            for c, v in kids.get(u, ()):
                todo.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = self.MORE, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and (z << 8 | c) not in self.step:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.step[z << 8 | c], popped

    def count(self, word: bytes) -> int:
        """How many pieces the word has, or -1 if the greedy match gets stuck (one unknown token)."""
        step, fail, pops = self.step, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := step.get(u << 8 | c)) is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = v
        while u > self.MORE:
            if fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: int = 400_000) -> DataFrame:
    """(doc_id, n_words long, n_tokens long, n_unknown long) for each row of docs.

    Words are what spaces (x20, x09-x0D) part in the whole text, as UTF-8 bytes; each is cut by the greedy longest match over
    the pieces, from those that start a word on to those that go on. A word that gets stuck counts as one token and as
    unknown (a vocabulary that has all 256 bytes knows none). A word of any length takes time in its length only. The
    vocabulary (a file of under 1 MB) is read on the driver and sent once; the counts of up to ``keep`` words are kept in each
    task. Nothing is shuffled. Null and empty texts have no words; repeated rows stay; an empty table gives none; other
    columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary_path))
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        auto, known = LongestMatch(*sent.value), {}
        for b in blocks(batches):
            words = [t.encode().split() if t else [] for t in b.column(1).to_pylist()]
            every = set().union(*words)
            if len(known) + len(every) > keep:
                known = {}
            for w in every.difference(known):
                known[w] = auto.count(w)
            counts = [list(map(known.__getitem__, w)) for w in words]
            unknown = [c.count(-1) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in ([len(c) for c in counts], [sum(c) + 2 * u for c, u in zip(counts, unknown)], unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return taken.mapInArrow(run, f"doc_id {taken.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
