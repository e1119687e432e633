"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees of shards, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.llm.jaccard import WORDS, near_copies
from provender.llm.shared import components, settle


def fingerprint(text: str | None, words: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes. No words: 0."""
    # bytes.lower and bytes.split know A-Z and the six ASCII spaces only, as the shingles want
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(words)))] if len(w) > words else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text takes 4 MB at a time
        total += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long, a row for each row of docs. No shuffle."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).astype(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values: a child hangs from its parent by their Hamming distance. Nodes are the values' places;
    the first of each set of values that go down one edge stands at its end, and the others go on from there."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.kids: dict[int, list[tuple[int, int]]] = {}
        todo = [np.arange(len(values))]
        while todo:
            members = todo.pop()
            if len(members) < 2:
                continue
            node, rest = int(members[0]), members[1:]
            edge = np.bitwise_count(values[rest] ^ values[node])
            order = np.argsort(edge, kind="stable")
            for group in np.split(rest[order], np.flatnonzero(np.diff(edge[order])) + 1):
                self.kids.setdefault(node, []).append((int((values[group[0]] ^ values[node]).bit_count()), int(group[0])))
                todo.append(group)

    def near(self, asking: np.ndarray, radius: int):
        """(place, those of the values asked for that lie within radius of it), over edges from d - radius to d + radius only. All that
        ask walk together, so an edge is looked at once however many follow it."""
        todo = [(0, np.arange(len(asking)))] if len(self.values) and len(asking) else []
        while todo:
            node, who = todo.pop()
            d = np.bitwise_count(asking[who] ^ self.values[node]).astype(np.int16)
            found = who[d <= radius]
            if len(found):
                yield node, found
            for edge, kid in self.kids.get(node, ()):
                below = who[np.abs(d - np.int16(edge)) <= radius]
                if len(below):
                    todo.append((kid, below))


def shard_links(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the shard's components: (rep, the component's smallest rep), never all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    for i, found in BKTree(fps).near(fps, radius):
        for j in found.tolist():
            join(i, j)
    roots = [find(i) for i in range(len(fps))]
    low: dict[int, int] = {}
    for r, rep in zip(roots, reps.tolist()):
        low[r] = min(rep, low.get(r, rep))
    return [(rep, low[r]) for r, rep in zip(roots, reps.tolist()) if rep != low[r]]


def _bands(bits: int, radius: int) -> list[tuple[int, int]]:
    """radius + 1 bands (shift, width) over the lowest bits."""
    n = radius + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _band_keys(fp, radius: int):
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1).cast("long")) * F.lit(radius + 1) + F.lit(i) for i, (a, w) in enumerate(_bands(64, radius))))


def links(reps: DataFrame, *, radius: int = 4, shard_rows: int = 50_000) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints (fp, rep) within ``radius`` bits.

    Two fingerprints within radius bits agree on one of radius + 1 bands at least, so each band value is a shard and
    every link lies inside some shard. A shard of more than shard_rows is cut again in the same way, by other bands of the same
    bits, as often as there are different ones (four times: what is left then agrees in some 40 of 64 bits), which is exact
    as well. Each shard gets a BK-tree where it lies; no tree and no fingerprint goes to the driver.
    """
    banded = reps.select("fp", "rep", F.explode(_band_keys(F.col("fp"), radius)).alias("shard"), F.lit(-1).cast("long").alias("sub"))
    for width in (2, 1, 4, 8):
        hot = settle(banded.groupBy("shard", "sub").count().where(F.col("count") > shard_rows).select("shard", "sub", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        # bit i belongs to band (i div width) mod (radius + 1): one of them agrees, whatever the shard agrees on already
        stripes = [sum(1 << i for i in range(64) if i // width % (radius + 1) == k) for k in range(radius + 1)]
        stripes = [s - (1 << 64) if s >> 63 else s for s in stripes]
        keys = F.array(*(F.xxhash64(F.col("sub"), F.col("fp").bitwiseAND(F.lit(s).cast("long")), F.lit(k)) for k, s in enumerate(stripes)))
        banded = settle(banded.join(hot, ["shard", "sub"], "left").select("fp", "rep", "shard", F.explode(F.when(F.col("hot"), keys).otherwise(F.array(F.col("sub")))).alias("sub")))

    def run(batches):
        kept: list[np.ndarray] = [np.empty((0, 4), np.int64)]

        def out(rows):
            edge = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            found = []
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)]):
                if hi - lo > 1:
                    found += shard_links(rows[lo:hi, 2].astype(np.uint64), rows[lo:hi, 3], radius)
            a = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            last = rows[-1]
            start = len(rows) - int(np.argmax(((rows[:, 0] != last[0]) | (rows[:, 1] != last[1]))[::-1])) if (rows[:, :2] != last[:2]).any() else 0
            if start:
                yield out(np.concatenate([*kept, rows[:start]]))
                kept = [rows[start:]]
            elif len(kept[-1]) and (kept[-1][-1, :2] != last[:2]).any():
                yield out(np.concatenate(kept))
                kept = [rows]
            else:
                kept.append(rows)
        if sum(map(len, kept)):
            yield out(np.concatenate(kept))

    dealt = banded.select("shard", "sub", "fp", "rep").repartition("shard", "sub").sortWithinPartitions("shard", "sub")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, shard_rows: int = 50_000) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs.

    Words are what spaces (x20, x09-x0D) part in the text with A-Z in lower case. Null and empty texts have the
    fingerprint 0 and link like any other. Rows of equal fingerprint are one node, so copies, however many, make no
    pairs. A repeated row comes out repeated; a null id takes part, but can't name a component. Other columns of docs
    are not looked at. An empty table gives an empty result.
    """
    fps = settle(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    reps = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = components(links(reps.where("rep is not null"), radius=radius, shard_rows=shard_rows))
    of = reps.join(comps, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def likely_copies(docs: DataFrame, *, words: int = WORDS, radius: int = 4) -> DataFrame:
    """Spanning links (a, b) between the ids of docs (doc_id, text) whose fingerprints are within ``radius`` bits, or equal."""
    fps = settle(fingerprints(docs, words=words).where("doc_id is not null"))
    reps = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    same = fps.join(reps, "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return settle(links(reps, radius=radius).unionByName(same))


def keep_first(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each group the document of the smallest id stays, with its columns. Rows that share that id
    all stay, and so do rows without an id, which can't be told from each other.

    Fingerprints of five-word shingles name the likely copies, and their whole sets of shingles judge each link (similarity 0.8). At 0.8
    fingerprints are some 10 bits apart, which no bands reach, so the exact join (jaccard.near_copies) adds the links
    that they miss."""
    near = near_copies(docs, first_links=likely_copies(docs.select("doc_id", "text")))
    kept = docs.join(near.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
