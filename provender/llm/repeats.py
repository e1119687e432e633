"""Exact long repeats across documents through run-length compressed indexes.

1. Each document's anchors (minimisers of 20-byte strings in every 50-byte window) meet by hash; those of two documents
   or more are candidates. Equal 50-byte strings have equal anchors at equal offsets, so none is missed.
2. The windows around each candidate anchor that have it, once per block of documents, go to the anchor's shard.
3. A shard's distinct contexts become a run-length Burrows-Wheeler transform. All contexts stream through it from right
   to left; where a match reaches 50 bytes they learn the smallest document that has that string. An anchor of very many
   contexts is cut by the bytes beside it first.
4. The answers join the anchors' places, and each document loses the bytes that are covered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import settle

SIZE, GRAM = 50, 20
SPAN = SIZE - GRAM + 1  # the 20-byte strings in a window
LEFT = SIZE - GRAM  # an anchor's windows begin at most so many bytes before it


def _powers():
    out = [0x9E3779B97F4A7C15]
    for _ in range(4):
        out.append(out[-1] * out[-1] % 2**64)
    return [np.uint64(p) for p in out]


_P = _powers()


def _slide(f, a: np.ndarray, n: int) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    w = 1
    while 2 * w <= n:
        a, w = f(a[:-w], a[w:]), 2 * w
    return f(a[: len(a) - (n - w)], a[n - w :]) if n > w else a


def anchors(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another (bytes, and where each begins): places and hashes of the 20-byte strings that are
    the smallest, ties included, of some 50-byte window within a text; and the smallest hash of each window, 0 for windows
    that cross a border."""
    if len(text) < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h1 = text.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _P[0] + h1[1:]
    h4 = h2[:-2] * _P[1] + h2[2:]
    h8 = h4[:-4] * _P[2] + h4[4:]
    h16 = h8[:-8] * _P[3] + h8[8:]
    h = h16[:-4] * _P[2] + h4[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    low = _slide(np.minimum, h, SPAN)
    for b in starts[1:].tolist():
        low[max(0, b - SIZE + 1) : b] = 0
    edge = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, low, edge]), SPAN) == h)
    return at, h[at], low


def windows(at: np.ndarray, hashes: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last window whose smallest 20-byte string is the anchor; those between are so as well."""
    start = at[:, None] - np.arange(SPAN)
    own = (start >= 0) & (start < len(low)) & (low[np.clip(start, 0, len(low) - 1)] == hashes[:, None])
    return at - (SPAN - 1) + own[:, ::-1].argmax(1), at - own.argmax(1)


def chunks(column: pa.Array, most: int = 200_000):
    """(first row, bytes, where each text begins) of runs of rows of about ``most`` bytes, which stay in the processor's cache."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row]
        row = end


class RunIndex:
    """A run-length Burrows-Wheeler transform of contexts, each ended by a mark of its own (mark k sorts as k, before all bytes).

    Kept: the runs' starts and where their heads map to, and the borders between suffixes that agree in fewer than
    ``SIZE`` bytes, with the smallest document between two borders. These borders take the place of text places sampled at
    the runs' ends: all that is asked of a matching statistic is whether it reaches ``SIZE`` and in which document first.
    """

    def __init__(self, contexts: list[bytes], docs: np.ndarray):
        n = len(contexts)
        self.lengths = np.array([len(c) for c in contexts], np.int64)
        ends = np.cumsum(self.lengths + 1) - 1
        text = np.empty(int(ends[-1]) + 1, np.int64)
        marks = np.zeros(len(text), bool)
        marks[ends] = True
        text[marks] = np.arange(n)
        text[~marks] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + n
        total, symbols = len(text), n + 256
        per, bits = (4, 16) if symbols < 1 << 16 else (2, 31)
        key = np.zeros(total, np.uint64)
        for i in range(per):
            key = (key << np.uint64(bits)) | np.append(text[i:], np.zeros(min(i, total), np.int64)).astype(np.uint64)
        ranks, depth = {}, per
        while True:  # prefix doubling; marks differ, so it ends within the longest context
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(total, np.int64)
            steps = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
            rank[order] = steps
            ranks[depth] = rank
            if steps[-1] == total - 1 and depth >= SIZE // 2:
                break
            key = rank.astype(np.uint64) * np.uint64(total + 1) + np.append(rank[depth:] + 1, np.zeros(min(depth, total), np.int64)).astype(np.uint64)
            depth *= 2
        # two suffixes agree in SIZE bytes if they do at the largest depth up to SIZE, from both ends
        d = max(k for k in ranks if k <= SIZE)
        half = ranks[d]
        tail = np.append(half[SIZE - d :], -1 - np.arange(min(SIZE - d, total)))
        long = np.ones(total, bool)
        long[max(0, total - SIZE) :] = False
        a, b = order[:-1], order[1:]
        agree = (half[a] == half[b]) & (tail[a] == tail[b]) & long[a] & long[b]
        borders = np.append(0, np.flatnonzero(~agree) + 1)
        owner = np.cumsum(marks) - marks
        self.borders = borders
        self.lowest = np.minimum.reduceat(docs[owner[order]], borders)
        before = text[order - 1]  # the transform; the text is read as a circle
        heads = np.append(0, np.flatnonzero(before[1:] != before[:-1]) + 1)
        sizes = np.diff(np.append(heads, total))
        by = np.lexsort((heads, before[heads]))
        target = np.empty(len(heads), np.int64)
        target[by] = np.cumsum(sizes[by]) - sizes[by]
        self.heads, self.target = heads, target
        self.n = n

    def back(self, j: np.ndarray) -> np.ndarray:
        """From suffixes to those one byte longer."""
        run = np.searchsorted(self.heads, j, side="right") - 1
        return self.target[run] + j - self.heads[run]

    def stream(self) -> np.ndarray:
        """For each context and offset the smallest document that has the 50 bytes from there on; the largest number where
        fewer are left. All contexts step together from their marks to their beginnings."""
        most = int(self.lengths.max(initial=0))
        out = np.full((self.n, max(most - SIZE + 1, 0)), np.iinfo(np.int64).max)
        j, live = np.arange(self.n), np.arange(self.n)
        for t in range(1, most + 1):
            keep = self.lengths[live] >= t
            live, j = live[keep], self.back(j[keep])
            if t >= SIZE:
                out[live, self.lengths[live] - t] = self.lowest[np.searchsorted(self.borders, j, side="right") - 1]
        return out


def _maybe(contexts: list[bytes], lefts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Contexts that may share 50 bytes with another of their anchor: they must share 15 more on the left or on the right."""
    side = LEFT // 2
    keep = np.zeros(len(contexts), bool)
    for part in ([c[x - side : x + GRAM] if x >= side else None for c, x in zip(contexts, lefts.tolist())], [c[x : x + GRAM + side] if len(c) >= x + GRAM + side else None for c, x in zip(contexts, lefts.tolist())]):
        at = np.flatnonzero([p is not None for p in part])
        if len(at):
            h = np.fromiter((xxhash.xxh3_64_intdigest(part[i]) for i in at.tolist()), np.uint64, len(at))
            _, inverse, count = np.unique(h ^ (group[at] * _P[0]), return_inverse=True, return_counts=True)
            keep[at[count[inverse] > 1]] = True
    return keep


def _split(contexts: list[bytes], lefts: np.ndarray, members: np.ndarray, low: np.ndarray, high: np.ndarray, most: int):
    """Cuts one anchor's contexts into lists of at most ``most`` so that any two with a common 50-byte string meet in some list.

    A string with t bytes before the anchor has 30 - t after it. Contexts that share one with t from t0 to t1 agree in t0
    bytes on the left and 30 - t1 on the right: those are the groups, and the range of t is halved for groups that are
    still too large. At a single t a group has one string in common; it needs no index and comes out as (members, t).
    """
    todo, lists, common = [(members, 0, LEFT)], [], []
    while todo:
        own, t0, t1 = todo.pop()
        if t0 == t1:
            common.append((own, t0))
            continue
        mid, batch, n = (t0 + t1) // 2, [], 0
        for a, b in ((t0, mid), (mid + 1, t1)):
            after = LEFT - b
            fit = np.array([i for i in own.tolist() if lefts[i] >= a and len(contexts[i]) - lefts[i] - GRAM >= after], np.int64)
            if not len(fit):
                continue
            keys = np.fromiter((xxhash.xxh3_64_intdigest(contexts[i][lefts[i] - a : lefts[i] + GRAM + after]) for i in fit.tolist()), np.uint64, len(fit))
            order = np.argsort(keys, kind="stable")
            for part in np.split(fit[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part) > most:
                    todo.append((part, a, b))
                elif len(part) > 1 or low[part[0]] < high[part[0]]:
                    if n + len(part) > most:
                        lists.append(np.unique(np.concatenate(batch)))
                        batch, n = [], 0
                    batch.append(part)
                    n += len(part)
        if batch:
            lists.append(np.unique(np.concatenate(batch)))
    return lists, common


def shard_answers(contexts: list[bytes], lefts: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 20_000):
    """Arrays (context, from, to, document): from those offsets to the anchor the 50-byte strings of a context first occur in
    that document, smaller than some document of the context."""
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
    alone = count[inverse] == 1
    # a context that is its anchor's only one shares all its strings with its own copies and with nothing else
    i = np.flatnonzero(alone & (low < high))
    out = [np.stack([i, -lefts[i], lengths[i] - SIZE - lefts[i], low[i]])]
    order = np.argsort(group, kind="stable")
    may = np.zeros(len(group), bool)
    rest = np.flatnonzero(~alone)
    may[rest] = _maybe([contexts[i] for i in rest.tolist()], lefts[rest], group[rest]) | (low < high)[rest]
    order = order[may[order]]
    cut = np.flatnonzero(np.diff(group[order]) != 0) + 1
    jobs, start = [], 0
    while start < len(order):
        k = np.searchsorted(cut, start + most)  # whole anchors, about ``most`` contexts together
        end = len(order) if k >= len(cut) else max(int(cut[k]), start + 1)
        part = order[start:end]
        start = end
        edges = [0, *(np.flatnonzero(np.diff(group[part])) + 1).tolist(), len(part)]
        large = [part[x:y] for x, y in zip(edges, edges[1:]) if y - x > most]
        rest = [part[x:y] for x, y in zip(edges, edges[1:]) if y - x <= most]
        if rest:
            jobs.append(np.concatenate(rest))
        for own in large:
            lists, common = _split(contexts, lefts, own, low, high, most)
            jobs += lists
            for same, t in common:
                good = same[low[same].min() < high[same]]
                out.append(np.stack([good, np.full(len(good), -t), np.full(len(good), -t), np.full(len(good), low[same].min())]))
    for part in jobs:
        found = RunIndex([contexts[i] for i in part.tolist()], low[part]).stream()
        if not found.shape[1]:
            continue
        begins = np.ones(found.shape, bool)
        begins[:, 1:] = found[:, 1:] != found[:, :-1]
        row, a = np.nonzero(begins)  # stretches of one answer, row by row
        b = np.append(a[1:], 0)
        b[np.append(row[1:] != row[:-1], True)] = found.shape[1]
        first, i = found[row, a], part[row]
        good = first < high[i]
        out.append(np.stack([i, a - lefts[i], b - 1 - lefts[i], first])[:, good])
    return np.concatenate(out, axis=1)


def keys_of(contexts: list[bytes], lefts: list[int]) -> np.ndarray:
    """128-bit keys of contexts with their anchors' places, as two numbers each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, contexts, lefts)), np.int64).reshape(-1, 2)


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _candidates(docs: DataFrame, tasks: int, buckets: int, parts: int) -> DataFrame:
    """(part, hashes blob): the anchors of each part's documents that two documents or more have."""

    def folded(h, part, low, high):
        """One entry for each anchor and part, with its smallest and largest document."""
        order = np.lexsort((part, h))
        h, part = h[order], part[order]
        starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))) if len(h) else np.zeros(0, np.int64)
        if not len(starts):
            return h, part, low, high
        return h[starts], part[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)

    def spot(batches):
        for b in batches:
            ids, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            every = b.column(0).to_numpy(zero_copy_only=False)
            for row, text, starts in chunks(b.column(1)):
                at, h, _ = anchors(text, starts)
                d = every[row + np.searchsorted(starts, at, side="right") - 1]
                new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)  # periodic texts repeat one anchor
                hs.append(h[new])
                ids.append(d[new])
            h, d = np.concatenate(hs), np.concatenate(ids)
            h, part, low, high = folded(h, np.mod(d, parts), d, d)
            at = (h // np.uint64(2) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            cols, edges = [x[order] for x in (h, part.astype(np.int32), low, high)], np.searchsorted(at[order], np.arange(buckets + 1)).tolist()
            rows = [(k, *(_blob(c[x:y]) for c in cols)) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 4))], names=["bucket", "h", "part", "low", "high"])

    def meet(batches):
        kinds, kept, n = (np.uint64, np.int32, np.int64, np.int64), [], 0
        none = tuple(np.zeros(0, k) for k in kinds)
        held = none
        for b in batches:  # folded as they come: an anchor never takes more than an entry for each part
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                kept.append([np.frombuffer(x, k) for x, k in zip(row, kinds)])
                n += len(kept[-1][0])
            if n > max(4_000_000, len(held[0])):
                held, kept, n = folded(*(np.concatenate(x) for x in zip(held, *kept))), [], 0
        h, part, low, high = folded(*(np.concatenate(x) for x in zip(held, *kept)))
        if not len(h):
            return
        starts = np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)
        several = np.minimum.reduceat(low, starts) != np.maximum.reduceat(high, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(h))))
        h, part = h[keep], part[keep]
        order = np.argsort(part, kind="stable")
        h, part = h[order], part[order]
        for k in np.unique(part).tolist():
            x, y = np.searchsorted(part, [k, k + 1])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_blob(h[x:y])], pa.binary())], names=["part", "h"])

    spots = docs.select("doc_id", "raw").mapInArrow(spot, "bucket long, h binary, part binary, low binary, high binary")
    return spots.repartition(tasks, "bucket").mapInArrow(meet, "part long, h binary")


_CONTEXTS = "shard long, lens binary, lefts binary, ctx binary, hs binary, low binary, high binary, doc_id long, th long, k1 array<long>, k2 array<long>, at array<int>"


def _contexts(docs: DataFrame, candidates: DataFrame, tasks: int, shards: int, parts: int) -> DataFrame:
    """Two kinds of rows: packed distinct contexts for a shard, and each document's places with their contexts' 128-bit keys."""
    none = lambda t: F.lit(None).cast(t)
    left = candidates.select("part", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("long").alias("th"), F.lit(b"").alias("raw"), "h")
    right = docs.select(F.pmod("doc_id", F.lit(parts)).cast("long").alias("part"), F.lit(1).alias("kind"), "doc_id", "th", "raw", none("binary").alias("h"))

    def emit(seen: dict, places: list):
        entries = list(seen.values())
        h = np.array([e[0] for e in entries], np.uint64)
        low, high = (np.array([e[i] for e in entries], np.int64) for i in (1, 2))
        lefts = np.array([e[3] for e in entries], np.int32)
        to = (h // np.uint64(2) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((h, to))
        edges = np.searchsorted(to[order], np.arange(shards + 1)).tolist()
        rows = []
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            if y > x:
                o = order[x:y]
                own = [entries[i][4] for i in o.tolist()]
                rows.append((k, _blob(np.array([len(c) for c in own], np.int32)), _blob(lefts[o]), b"".join(own), _blob(h[o]), _blob(low[o]), _blob(high[o]), None, None, None, None, None))
        rows += [(None,) * 7 + p for p in places]
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _CONTEXTS.split(", ")])

    def run(batches):
        hashes: dict[int, list[np.ndarray]] = {}  # of the part, and of those that share its task
        ready: dict[int, np.ndarray] = {}
        for b in batches:
            seen: dict[bytes, list] = {}
            places = []
            of, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in np.flatnonzero(kinds == 0).tolist():
                hashes.setdefault(int(of[i]), []).append(np.frombuffer(b.column(5)[i].as_buffer(), np.uint64))
            ids, ths = b.column(2).to_pylist(), b.column(3).to_pylist()
            edges = np.append(0, np.flatnonzero(np.diff(of)) + 1).tolist() if len(of) else []
            for x, y in zip(edges, [*edges[1:], len(of)]):
                part = int(of[x])
                if part not in ready:
                    if not (kinds[x:y] == 1).any():
                        continue
                    ready = {part: np.unique(np.concatenate([*hashes.pop(part, []), np.zeros(1, np.uint64)]))}
                shared = ready[part]
                for row, text, starts in chunks(b.column(4).slice(x, y - x)):
                    at, h, low = anchors(text, starts)
                    mine = shared[np.clip(np.searchsorted(shared, h), 0, len(shared) - 1)] == h
                    at, h = at[mine], h[mine]
                    if not len(at):
                        continue
                    first, last = windows(at, h, low)
                    whose = np.searchsorted(starts, at, side="right") - 1
                    raw, leads = text.tobytes(), (at - first).tolist()
                    cs = [raw[lo:hi] for lo, hi in zip(first.tolist(), (last + SIZE).tolist())]
                    digests = list(map(xxhash.xxh3_128_digest, cs, leads))
                    docs_ = [ids[x + row + w] for w in whose.tolist()]
                    for key, c, lead, hash_, doc in zip(digests, cs, leads, h.tolist(), docs_):
                        entry = seen.get(key)
                        if entry is None:
                            seen[key] = [hash_, doc, doc, lead, c]
                        elif doc < entry[1]:
                            entry[1] = doc
                        elif doc > entry[2]:
                            entry[2] = doc
                    keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    cut = np.append(0, np.flatnonzero(np.diff(whose)) + 1).tolist()
                    for lo, hi in zip(cut, [*cut[1:], len(at)]):
                        w = int(whose[lo])
                        places.append((ids[x + row + w], ths[x + row + w], keys[lo:hi, 0], keys[lo:hi, 1], (at[lo:hi] - starts[w]).astype(np.int32)))
            yield emit(seen, places)

    return left.unionByName(right).repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(run, _CONTEXTS)


def _answers(contexts: DataFrame, tasks: int) -> DataFrame:
    """(k1, k2, a, b, first): the 50-byte strings from a to b before or after the anchor are first in document ``first``."""

    def run(batches):
        seen: dict[tuple[int, bytes], int] = {}
        hs, low, high = [], [], []
        for b in batches:
            for lens, lefts, ctx, h, lo, hi in zip(*(b.column(i).to_pylist() for i in range(1, 7))):
                at = 0
                for n, lead, g, x, y in zip(np.frombuffer(lens, np.int32).tolist(), np.frombuffer(lefts, np.int32).tolist(), np.frombuffer(h, np.uint64).tolist(), np.frombuffer(lo, np.int64).tolist(), np.frombuffer(hi, np.int64).tolist()):
                    key = (lead, ctx[at : at + n])
                    at += n
                    i = seen.setdefault(key, len(hs))
                    if i == len(hs):
                        hs.append(g)
                        low.append(x)
                        high.append(y)
                    else:
                        low[i], high[i] = min(low[i], x), max(high[i], y)
        if not seen:
            return
        ctx, lefts = [k[1] for k in seen], [k[0] for k in seen]
        seen.clear()
        i, a, b, first = shard_answers(ctx, np.array(lefts, np.int64), np.array(hs, np.uint64), np.array(low, np.int64), np.array(high, np.int64))
        which, at = np.unique(i, return_inverse=True)
        keys = keys_of([ctx[k] for k in which.tolist()], [lefts[k] for k in which.tolist()])
        for lo in range(0, len(i), 200_000):
            p = slice(lo, lo + 200_000)
            cols = [keys[at[p], 0], keys[at[p], 1], a[p].astype(np.int32), b[p].astype(np.int32), first[p]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "a", "b", "first"])

    return contexts.where("shard is not null").select("shard", "lens", "lefts", "ctx", "hs", "low", "high").repartition(tasks, "shard").mapInArrow(run, "k1 long, k2 long, a int, b int, first long")


def mark(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, spans): each row of docs with its UTF-8 bytes and the byte ranges (a, b) covered by 50-byte strings
    that start in a document of smaller doc_id as well; ranges may touch or overlap. Null texts are empty; a null id is
    neither judged nor a source; rows of one id don't count against each other. Repeated rows stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))
    known = base.where("doc_id is not null")
    # tasks follow the input's partitions; each takes several of the keys, so that their sizes even out. A prime number of
    # parts spreads ids of any stride
    n = max(16, 2 * base.rdd.getNumPartitions())
    shards = 8 * n
    parts = next(p for p in range(shards | 1, 2 * shards + 3, 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2)))
    candidates = settle(_candidates(known, n, shards, parts))
    contexts = settle(_contexts(known, candidates, n, shards, parts))
    answers = settle(_answers(contexts, n))
    places = contexts.where("doc_id is not null").select("doc_id", "th", F.explode(F.arrays_zip("k1", "k2", "at")).alias("p")).select("doc_id", "th", "p.*")
    hits = places.join(answers, ["k1", "k2"]).where("first < doc_id").select("doc_id", "th", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + SIZE).alias("b"))
    spans = settle(hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    return base.join(spans, ["doc_id", "th"], "left").select("doc_id", "raw", "spans")


def _cut(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, how many bytes go, and in how many runs."""
    if not len(a):
        return raw, 0, 0
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    a, b = a[new], np.append(b[:-1][new[1:]], b[-1])
    left = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
    return left, len(raw) - len(left), len(a)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): a row for each row of docs; kept are the remaining bytes
    (they may cut a character in two). See mark() for the rules. An empty table gives no rows."""

    def run(batches):
        for b in batches:
            raws, spans = b.column(1).to_pylist(), b.column(2)
            if isinstance(spans, pa.ChunkedArray):
                spans = spans.combine_chunks()
            at, flat = spans.offsets.to_numpy().tolist(), spans.values
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cut = [_cut(r, lo[x:y], hi[x:y]) for r, x, y in zip(raws, at, at[1:])]
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in ([len(r) for r in raws], [c[1] for c in cut], [c[2] for c in cut])), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()), pa.array([c[0] for c in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return mark(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The same in DuckDB's SQL, over all 50-byte strings: for small tables.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
hit AS (SELECT w.rid, w.i FROM w JOIN m USING (s) WHERE f < doc_id),
edge AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
isle AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM edge),
span AS (SELECT rid, k, min(i) AS a, max(i) + 50 AS b FROM isle GROUP BY rid, k),
piece AS (SELECT rid, k, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY k), 0) AS before FROM span),
kept AS (SELECT p.rid, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a) AS gone, count(*) AS n FROM piece p JOIN d USING (rid) GROUP BY p.rid)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
