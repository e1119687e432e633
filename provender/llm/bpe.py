"""Byte-level BPE: the merges are replayed over all distinct words of a block at once, in rank order."""

from __future__ import annotations

import array
import base64
import collections
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import give_back


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Encodes many distinct words together.

    The words lie one after another in one array of tokens with links to the next and the previous place. An inverted
    index leads from a merge's rank to the places of that pair. Merges are taken by rank over all words at once, and
    each updates only the two neighbours of its places. A merge can bring up a pair of lower rank (ranks belong to byte
    strings, whatever their halves); the heap then takes that one first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        cuts = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array(sorted(cuts), np.int64).reshape(-1, 2)
        self.keys, self.merged = np.append(pairs[:, 0], -2), np.append(pairs[:, 1], -1)  # every way to make a token of two
        self.keys[-1] = np.iinfo(np.int64).max
        self.byte = np.array([ranks[bytes([c])] for c in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 for those that don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each word has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)  # a word that is a token is that token
        lengths = np.where(whole >= 0, 0, np.array([len(w) for w in words], np.int64))
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        n = len(owner)
        tok = np.append(self.byte[np.frombuffer(b"".join(w for w, k in zip(words, whole.tolist()) if k < 0), np.uint8)], np.int32(-1))  # place n stands for beyond the word
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
        nxt[:n][last] = n
        prv[:n][np.append(True, last[:-1])[:n]] = n
        ranks = self.rank(tok[:n], tok[nxt[:n]])
        places = np.flatnonzero(ranks >= 0).astype(np.int32)
        places = places[np.argsort(ranks[places], kind="stable")]
        starts = np.flatnonzero(np.diff(ranks[places], prepend=-1))
        index = dict(zip(ranks[places[starts]].tolist(), np.split(places, starts[1:])))
        del ranks, places
        later: dict[int, list[int]] = {}
        heap = list(index)
        heapq.heapify(heap)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            at = [x for x in (index.pop(r, None), later.pop(r, None)) if x is not None]
            if not at:
                continue
            p = np.unique(np.concatenate(at)) if len(at) > 1 or type(at[0]) is list else at[0]
            p = p[self.rank(tok[p], tok[nxt[p]]) == r]  # others have lost a half since
            if len(p) > 1 and (nxt[p[:-1]] == p[1:]).any():  # overlapping places, as in aaa: from the left
                kept, gone = [], -1
                for x, y in zip(p.tolist(), nxt[p].tolist()):
                    if x != gone:
                        kept.append(x)
                        gone = y
                p = np.array(kept, np.int64)
            if not len(p):
                continue
            half = nxt[p]
            after = nxt[half]
            tok[p], tok[half] = r, -1
            nxt[p], prv[after] = after, p
            before = prv[p]
            q = self.rank(np.concatenate([tok[p], np.where(before < n, tok[before], -1)]), np.concatenate([tok[after], tok[p]]))
            new = np.concatenate([p, before])
            up = q >= 0
            q, new = q[up], new[up]
            if len(p) > 1 and len(q) and int(q.min()) < r:
                # the lower pair comes before the word's other places of this rank: such a word, if it had several, goes alone
                several = owner[p][1:][np.diff(owner[p]) == 0]
                odd.update(np.intersect1d(owner[new[q < r]], several).tolist())
            for k, x in zip(q.tolist(), new.tolist()):
                if k in later:
                    later[k].append(x)
                else:
                    later[k] = [x]
                    heapq.heappush(heap, k)
        alive = tok[:n] >= 0
        ids, count = tok[:n][alive], np.bincount(owner[alive], minlength=len(words))
        if odd or (whole >= 0).any():
            single = np.flatnonzero(whole >= 0)
            ids = np.insert(ids, (np.cumsum(count) - count)[single], whole[single])
            count[single] = 1
            ends = np.cumsum(count)
            for k in sorted(odd, reverse=True):
                alone = self.one(words[k])
                ids = np.concatenate([ids[: ends[k] - count[k]], alone, ids[ends[k] :]])
                count[k] = len(alone)
        return ids.astype("<u4"), count

    def one(self, word: bytes) -> list[int]:
        """A word by itself, merge by merge."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                return [self.ranks[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``which`` names, one after another."""
    n = lengths[which]
    total = np.cumsum(n)
    return flat[np.repeat(starts[which] - total + n, n) + np.arange(total[-1] if len(total) else 0)]


class Encoder:
    """Texts to ids. Words keep their ids from block to block, up to ``keep`` words; then the table starts anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 300_000):
        self.replay, self.find, self.keep = Replay(ranks), regex.compile(pattern).findall, keep
        size = max(ranks.values()) + 1
        self.byte_n = np.zeros(size, np.int64)
        for b, i in ranks.items():
            self.byte_n[i] = len(b)
        self.byte_at = np.cumsum(self.byte_n) - self.byte_n
        self.bytes = np.frombuffer(b"".join(b for b, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = collections.defaultdict(itertools.count().__next__)
        self.ids, self.n = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > self.keep:
            self.clear()
        number = self.number.__getitem__
        words = [array.array("I", map(number, self.find(t))) if t else None for t in texts]
        new = list(itertools.islice(self.number, len(self.n), None))
        ids, n = self.replay.encode([w.encode() for w in new])
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        at = np.cumsum(self.n) - self.n
        return [spread(self.ids, at, self.n, np.frombuffer(w, np.uint32)) if w else np.zeros(0, "<u4") for w in words]

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.bytes, self.byte_at, self.byte_n, ids).tobytes()


_encoders: dict = {}


def blocks(batches, chars: int = 3_000_000):
    """Slices of the batches' rows whose texts (column 1) have about so many bytes; a longer text is alone."""
    for b in batches:
        start = total = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
            if total and total + n > chars:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < b.num_rows:
            yield b.slice(start)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, passed: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256
    and, if asked, ids (array<int>). ``passed`` names further columns of docs to carry.

    The vocabulary (a fixed file of under 1 MB) is read on the driver and sent once. Each task replays the merges block by
    block over the distinct words of some 3 MB of text, so memory doesn't follow the corpus and nothing is shuffled.
    Null texts are empty texts: no tokens, the hashes of nothing. Repeated rows stay; an empty table gives none.
    """
    spark, passed = docs.sparkSession, passed or []
    sent = spark.sparkContext.broadcast(load_ranks(ranks_path))
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(passed)))
    types = {f.name: f.dataType.simpleString() for f in taken.schema}
    names = [c for c in passed]

    def run(batches):
        if (key := (ranks_path, pattern)) not in _encoders:  # kept by the worker for its next tasks
            _encoders.clear()
            _encoders[key] = Encoder(sent.value, pattern)
        enc = _encoders[key]
        give_back()
        for b in blocks(batches):
            found = enc.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in found], pa.string())]
            out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.array(np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32))))
                out.append("ids")
            yield pa.RecordBatch.from_arrays(cols + b.columns[2:], names=out + names)

    schema = f"doc_id {types['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + "".join(f", `{c}` {types[f'_p{i}']}" for i, c in enumerate(names))
    return taken.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with a column ``text``: the ids' bytes joined and read as UTF-8 (what isn't UTF-8 becomes U+FFFD). Null ids give null."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast({i: b for b, i in load_ranks(ranks_path).items()})
    inner = encoded.select("*", F.col(ids_col).alias("_ids"))

    def run(batches):
        for b in batches:
            texts = [None if ids is None else b"".join(map(sent.value.__getitem__, ids)).decode("utf-8", "replace") for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", text string"
    return inner.mapInArrow(run, schema)
