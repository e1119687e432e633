"""Benchmark decontamination by pigeonhole edit matching: exact pieces first, Myers' bit-parallel distance then."""

from __future__ import annotations

import math

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import settle

_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str | None) -> str:
    """Lower case; each run of ASCII characters that aren't letters or digits is one space, none at the ends."""
    return b" ".join((text or "").lower().encode().translate(_FOLD).split()).decode()


def masks(pattern: str) -> dict[str, int]:
    """For each character the places where the pattern has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(peq: dict[str, int], m: int, text: str) -> int:
    """Myers: the least edit distance between the pattern (m characters) and any substring of text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | full & ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph <<= 1
        pv = full & (mh << 1 | ~(xv | ph))
        mv = ph & xv
    return best


def pieces(length: int, budget: int) -> list[list[tuple[int, int, int]]]:
    """budget + 1 pieces of a text, each as its chain of spans (start, end, budget) from the piece up to the whole.

    With k = k1 + k2 + 1, at most k errors in a span leave at most k1 in its first part or at most k2 in its second,
    so some chain holds at every level: its piece is there without an error.
    """

    def cut(lo, hi, k, above):
        chain = [(lo, hi, k), *above]
        if k == 0:
            return [chain]
        k1 = (k - 1) // 2
        k2 = k - 1 - k1
        mid = lo + (hi - lo) * (k1 + 1) // (k + 1)
        return cut(lo, mid, k1, chain) + cut(mid, hi, k2, chain)

    return cut(0, length, budget, [])


class Matcher:
    """Finds which of a block of benchmark items a text has, within each item's error budget."""

    def __init__(self, items: list[tuple], error_rate: float):
        self.items, self.at = [], {}
        self.auto = ahocorasick.Automaton()
        for item_id, text in items:
            t = fold(text)
            if not t:
                continue
            k = int(len(t) * error_rate)
            peqs: dict[tuple[int, int, int], dict[str, int]] = {}
            n = len(self.items)
            self.items.append((item_id, len(t), k, masks(t)))
            for chain in pieces(len(t), k):
                lo, hi, _ = chain[0]
                for span in chain[1:]:
                    peqs.setdefault(span, masks(t[span[0] : span[1]]))
                self.at.setdefault(t[lo:hi], []).append((n, lo, [(*span, peqs[span]) for span in chain[1:]]))
        for p, where in self.at.items():
            self.auto.add_word(p, (len(p), where))
        if self.at:
            self.auto.make_automaton()

    def find(self, text: str | None, first: bool = False) -> list[tuple]:
        """(item_id, distance, budget, item length) of each item within its budget; the distance is the least over the whole
        text. With ``first`` one item is enough."""
        if not self.at:
            return []
        t, found = fold(text), {}
        for end, (size, where) in self.auto.iter(t):
            start = end + 1 - size
            for n, lo, chain in where:
                if n in found:
                    continue
                for a, b, k, peq in chain:
                    left = start - (lo - a) - k
                    if distance(peq, b - a, t[left if left > 0 else 0 : start + (b - lo) + k]) > k:
                        break
                else:
                    found[n] = distance(self.items[n][3], self.items[n][1], t)
                    if first:
                        return [self.items[n][:3]]
        return [(self.items[n][0], d, self.items[n][2], self.items[n][1]) for n, d in found.items()]


_matchers: dict = {}


def _matcher(sent) -> Matcher:
    """The block's matcher, built once in each worker."""
    key = hash((tuple(sent.value[0]), sent.value[1]))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(*sent.value)
    return _matchers[key]


def _blocks(benchmark: DataFrame, error_rate: float, block_chars: int) -> list:
    """The benchmark's items as broadcasts of about block_chars characters each."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.sparkSession.sparkContext.broadcast(([tuple(r) for r in items.where(part == k).collect()], error_rate)) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", error_rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, distance, budget, item_chars): a row for each document row and benchmark item that it has.

    Texts are folded (lower case, punctuation and spaces as one space) on both sides. An item of n characters may be
    found with up to n * error_rate edits anywhere in a whole text. Items go out in blocks of about block_chars
    characters, so what is broadcast is bounded whatever the benchmark's size; the documents are never shuffled.
    Null or empty items, and items of punctuation only, match nothing; null texts have nothing. Repeated rows and equal
    items each count. Empty tables give no rows.
    """
    blocks = _blocks(benchmark, error_rate, block_chars)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema["item_id"].dataType
    kind, item_kind = taken.schema["doc_id"].dataType.simpleString(), item_type.simpleString()
    out = None
    for sent in blocks:

        def run(batches, sent=sent):
            find = _matcher(sent).find
            for b in batches:
                rows = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) for m in find(t)]
                cols = list(zip(*rows)) or [[]] * 5
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64() if item_type.simpleString() == "bigint" else None), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["doc_id", "item_id", "distance", "budget", "item_chars"])

        part = taken.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance int, budget int, item_chars int")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", error_rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """The pipeline's stage: documents that have no benchmark item, with all columns. Each row is judged by its own text, so
    null and repeated ids are no matter; a null text stays."""

    def clean(sent):
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            matcher = _matcher(sent)
            return pd.Series([not matcher.find(t, first=True) for t in texts], dtype=bool)

        return run(F.col(text_col).cast("string"))

    blocks, out = _blocks(benchmark, error_rate, block_chars), docs
    for sent in blocks:
        out = out.where(clean(sent))
        if len(blocks) > 1:  # a worker then holds one block's automaton at a time
            out = settle(out)
    return out
