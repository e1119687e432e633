"""Exact top-k inner products by MaxScore over shards of integer vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>). Vectors that are null, or hold nulls, NaN or infinities, are left out."""
    x = F.col(vector_col)
    fit = x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(e.cast("double")))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as longs, or as Python's whole numbers, which have no end, where longs are too small."""
    if np.abs(x).max(initial=0) < 2**62 / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


class Shard:
    """A block of vectors with an inverted index. A term is (dimension, sign); its postings are the vectors with a component
    of that sign. Only postings of the query's own sign add to a score, all others take away or add nothing."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # equal scores then come out by id
        self.ids, self.x = ids[order], x[order]
        most = max(1, int(np.abs(x).max(initial=0)) * max(1, x.shape[1]))
        self.limit, self.end = 2**53 // most, 2**62 // most  # doubles are exact for queries below the first, and faster; longs below the second
        self.doubles = self.x.astype(np.float64) if self.limit else None
        self.most = np.maximum(self.x.max(0, initial=0), 0)
        self.least = np.minimum(self.x.min(0, initial=0), 0)
        self.postings = [(np.flatnonzero(c > 0), np.flatnonzero(c < 0)) for c in self.x.T]

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best, without the query itself; ties to the smaller id."""
        x, top = self.x, int(np.abs(q).max(initial=0))
        if top < self.limit:
            x, q = self.doubles, q.astype(np.float64)
        elif top >= self.end:
            x, q = x.astype(object), q.astype(object)
        most, least = self.most.astype(q.dtype), self.least.astype(q.dtype)
        gain = np.maximum(q * most, q * least)  # the most that each term can add
        terms = np.argsort(-gain, kind="stable")
        after = np.append(np.cumsum(gain[terms][::-1])[::-1], 0)  # what the terms from here on can add together
        own = self.ids != query_id
        # a first threshold: whole scores of the best of the strongest term's postings
        lead = terms[0] if len(terms) else 0
        first = self.postings[lead][int(q[lead] < 0)] if len(terms) else np.zeros(0, np.int64)
        first = first[own[first]]
        if len(first) > 4 * k:
            strong = -np.abs(x[first, lead])
            first = first[(np.argsort(strong) if x.dtype == object else np.argpartition(strong, 4 * k))[: 4 * k]]
        seed = np.sort(x[first] @ q)[::-1] if len(first) else np.zeros(0, np.int64)
        floor = int(seed[k - 1]) if len(seed) >= k else None
        # the non-essential terms can't lift a vector over the threshold by themselves
        essential = len(terms) if floor is None else int(np.searchsorted(-after, -floor, side="right"))
        essential = min(max(essential, 1), len(terms))
        if floor is None or floor <= 0:
            rows = np.flatnonzero(own)
        else:
            hit = np.zeros(len(self.ids), bool)
            for t in terms[:essential]:
                hit[self.postings[t][int(q[t] < 0)]] = True
            rows = np.flatnonzero(hit & own)
        head = terms[:essential]
        score = x[np.ix_(rows, head)] @ q[head]
        for lo in range(essential, len(terms), 8):  # probe the rest while competitive
            if floor is not None:
                live = score + after[lo] >= floor
                rows, score = rows[live], score[live]
            part = terms[lo : lo + 8]
            score = score + x[np.ix_(rows, part)] @ q[part]
        best = np.argsort(-score, kind="stable")[:k]  # rows are in the order of ids
        return list(zip(map(int, score[best].tolist()), self.ids[rows][best].tolist()))


def _packed(rows: DataFrame, keys: list[str], ids: str, v: str, most: int) -> DataFrame:
    """Rows of up to ``most`` vectors of one dimension packed as binary: no group is ever larger than that."""

    def run(batches):
        for b in batches:
            cols = {n: c for n, c in zip(b.schema.names, b.columns)}
            lengths = np.diff(cols[v].offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            tags = np.stack([lengths, *(cols[k].to_numpy(zero_copy_only=False) for k in keys)], axis=1)
            flat, starts = cols[v].flatten().to_numpy(), np.append(0, np.cumsum(lengths))
            out = []
            for tag in np.unique(tags, axis=0):
                at = np.flatnonzero((tags == tag).all(1))
                for lo in range(0, len(at), most):
                    part = at[lo : lo + most]
                    x = np.stack([flat[starts[i] : starts[i + 1]] for i in part]) if tag[0] else np.zeros((len(part), 0))
                    out.append((*tag.tolist(), cols[ids].to_numpy()[part].astype(np.int64).tobytes(), x.astype(np.float64).tobytes()))
            names = ["dim", *keys, "ids", "x"]
            kinds = [pa.int32()] + [pa.int64()] * len(keys) + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "dim int, " + "".join(f"{k} long, " for k in keys) + "ids binary, x binary")


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = 2048, broadcast_bytes: int = 8_000_000) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each query the k other vectors of the highest integer inner product,
    ties to the smaller vec_id; fewer if there are fewer.

    ``queries`` says which of the usable rows (column vec_id) ask. Queries lie in blocks of at most query_block; every
    block meets every shard of vectors once, each shard gives its k best, and the shards' lists are merged by a window
    over (shards x k) rows a query. Components may be as large as doubles get: products that longs can't hold are computed
    in whole numbers without end, and a score that a long can't hold is reported as the largest or smallest long, in its
    right rank. The blocks are broadcast if their counted size is under broadcast_bytes; else both
    sides are dealt out by block and salt. A repeated id is several candidates, of which none is a query's own; a repeated
    query row asks once. Vectors only meet those of their own dimension. An empty table gives no rows.
    """
    rows = usable(vectors, id_col=id_col, vector_col=vector_col)
    asking = rows.where(queries).dropDuplicates(["vec_id"])
    count, dims = asking.agg(F.count("*"), F.max(F.size("v"))).first()
    n = max(1, math.ceil(count / query_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")
    dealt = asking.withColumn("block", block).repartition(n, "block").sortWithinPartitions("block")
    q = _packed(dealt, ["block"], "vec_id", "v", query_block).withColumnsRenamed({"ids": "q_ids", "x": "q_x"})
    shards = _packed(rows, [], "vec_id", "v", 16_384)
    if count * (dims or 0) * 8 <= broadcast_bytes:
        pairs = shards.join(F.broadcast(q), "dim")
    else:
        salts = 64
        pairs = shards.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).join(q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["dim", "salt"]).drop("salt")

    def run(batches):
        last, shard = None, None
        for b in batches:
            for dim, ids, x, q_ids, q_x in zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "x", "q_ids", "q_x"))):
                if last != (ids, dim):
                    last, i = (ids, dim), np.frombuffer(ids, np.int64)
                    shard = Shard(i, whole(np.frombuffer(x, np.float64).reshape(len(i), dim), scale))
                qi = np.frombuffer(q_ids, np.int64)
                found = [(a, v, s) for a, y in zip(qi.tolist(), whole(np.frombuffer(q_x, np.float64).reshape(len(qi), dim), scale)) for s, v in shard.top(a, y, k)]
                cols = list(zip(*found)) or [[]] * 3
                # scores beyond longs are cut to fit, and their order among each other is kept beside
                cut = [min(max(s, -(2**63)), 2**63 - 1) for s in cols[2]]
                over = ["b" if s == c else f"c{s:0700d}" if s > 0 else f"a{s + 10**700:0700d}" for s, c in zip(cols[2], cut)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cut, pa.int64()), pa.array(over, pa.string())], names=["query_id", "vec_id", "score", "over"])

    best = pairs.select("dim", "ids", "x", "q_ids", "q_x").mapInArrow(run, "query_id long, vec_id long, score long, over string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
