"""Deleted interpolation: a word's maximum-likelihood estimates after two, one and no words before it are mixed, with weights by how
often the words before it were seen, learned by expectation-maximisation on counts of documents that the estimates leave out.

The corpus' counts are never in one place. Documents are read once into blocks of tokens; a block asks the shards that keys are
dealt to for the counts of its distinct words, pairs and triples (``tally``), and is scored with the answers alone."""

from __future__ import annotations

import collections

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import discard, give_back, settle

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = b""  # the token after a text's last word; no word is empty
_START = np.uint64(0x9E3779B97F4A7C15)
#: What a document's counts are for: the estimates, the weights of the mixture, or nothing.
ESTIMATES, WEIGHTS, HELD_OUT = 0, 1, 2
#: How finely ratios of estimates are told apart when weights are learned: steps of a quarter of a power of two.
_STEPS, _UNSEEN = 4, -10_000


def pack(x: np.ndarray) -> bytes:
    """Eight-byte integers as compressed planes of bytes, as many as the largest needs: the upper planes of small or sorted numbers
    are long runs."""
    x = np.ascontiguousarray(x).view(np.uint64)
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T[:n].tobytes())


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view(kind)


def _rows(batches):
    """Rows as dictionaries, one at a time: each may hold megabytes."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of 64 bits for b after a. Keys of n different runs collide with a chance of about n^2 / 2^65; a collision adds two
    counts and no more, as words themselves are told apart exactly."""
    with np.errstate(over="ignore"):
        k = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F)
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return k ^ (k >> np.uint64(32))


def _batch(schema: pa.Schema, *rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


def blocks(docs: DataFrame, use: Column, *, id_col: str, text_col: str, tokens: int) -> DataFrame:
    """Documents in blocks of ``tokens`` tokens or one document: ids, uses, sizes, the distinct words, and tokens as places among
    these. Written down, so that a block stays the same however often it is read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), use.cast("int").alias("use"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    rows = rows if kind in ("bigint", "int") else rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(ids)), ("uses", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0

        def new():
            vocab: dict[bytes, int] = collections.defaultdict()
            vocab.default_factory = vocab.__len__
            vocab[END]
            return vocab, [], [], [], [], 0

        def out():
            words = b"\n".join(vocab)
            stream = np.concatenate([np.array(x, np.int64) for x in found])
            return _batch(schema, {"block": (task << 24) + made, "ids": who, "uses": pack(np.array(uses, np.int64)), "sizes": pack(np.array(sizes, np.int64)), "words": words, "tokens": pack(stream)})

        vocab, who, uses, sizes, found, n = new()
        for b in batches:
            for i, u, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                here = list(map(vocab.__getitem__, text.as_buffer().to_pybytes().translate(_LOWER).split()))
                here.append(0)
                who.append(i)
                uses.append(u)
                sizes.append(len(here))
                found.append(np.array(here, np.int64))
                n += len(here)
                if n >= tokens:
                    yield out()
                    vocab, who, uses, sizes, found, n = new()
                    made += 1
        if n:
            yield out()
        give_back()

    name = {pa.int64(): "long", pa.int32(): "int"}.get(ids, "string")
    return settle(rows.mapInArrow(run, f"block long, ids array<{name}>, uses binary, sizes binary, words binary, tokens binary"))


def after(x: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """x of the token before; ``first`` where a document starts."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = first
    return out


class Block:
    """A block's tokens and what they follow."""

    def __init__(self, row: dict):
        self.words = row["words"].split(b"\n")
        self.tokens, self.sizes, self.uses = unpack(row["tokens"]), unpack(row["sizes"]), unpack(row["uses"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.use = np.repeat(self.uses, self.sizes)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, the words' places in the order of these)."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        return own, np.argsort(own, kind="stable")

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys in order of their shards, the place among them of each token's key) of words, pairs or triples."""
        own, by = self.hashes()
        if order == 1:
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            return own[by], place[self.tokens]
        stream = own[self.tokens]
        pairs = _mix(after(stream, self.starts, _START), stream)
        if order == 2:
            return np.unique(pairs, return_inverse=True)
        return np.unique(_mix(after(pairs, self.starts, _mix(np.array([_START]), np.array([_START]))[0]), stream), return_inverse=True)


_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("base", pa.binary()), ("extra", pa.binary())])


def tally(of: DataFrame, order: int, shards: int) -> DataFrame:
    """The answers (block, shard, base, extra) to every block: how often each of its distinct keys occurs in the documents of the
    estimates, and in those of the weights. Row -1 - shard has the shard's own statistics of words instead.

    A block sends each shard its part of the keys, sorted, with its own counts; the shard adds them up and answers each block in
    the order that it asked. What moves is some six bytes a distinct key and block.
    """
    ask = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("base", pa.binary()), ("extra", pa.binary())])

    def asked(batches):
        for row in _rows(batches):
            block = Block(row)
            keys, place = block.keys(order)
            counts = [np.bincount(place[block.use == u], minlength=len(keys)).astype(np.int64) for u in (ESTIMATES, WEIGHTS)]
            cuts = np.searchsorted(keys >> np.uint64(32), np.array([(s << 32) // shards for s in range(shards)], np.uint64)).tolist() + [len(keys)]
            names = [block.words[i] for i in block.hashes()[1].tolist()] if order == 1 else []
            for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    yield _batch(ask, {"shard": s, "block": row["block"], "keys": b"\n".join(names[lo:hi]) if order == 1 else pack(keys[lo:hi]), "base": pack(counts[0][lo:hi]), "extra": pack(counts[1][lo:hi])})
        give_back()

    def answered(batches):
        rows = [(s, k, keys, unpack(base), unpack(extra)) for b in batches for s, k, keys, base, extra in zip(*(c.to_pylist() for c in b.columns))]
        if not rows:
            return
        if order == 1:
            names = pa.chunked_array([pa.array(r[2].split(b"\n"), pa.large_binary()) for r in rows]).combine_chunks()
            codes = names.dictionary_encode().indices.to_numpy()
        else:
            codes = np.unique(np.concatenate([unpack(r[2], np.uint64) for r in rows]), return_inverse=True)[1]
        base, extra = (np.rint(np.bincount(codes, np.concatenate([r[i] for r in rows]))).astype(np.int64) for i in (3, 4))
        at = 0
        for s, k, _, own, _ in rows:
            mine = codes[at : at + len(own)]
            at += len(own)
            yield _batch(_ANSWER, {"block": k, "shard": s, "base": pack(base[mine]), "extra": pack(extra[mine])})
        if order == 1:
            # [known types, tokens, tokens of the estimates], and how much the documents of the weights hold of words of each count
            cell = np.where(base > 0, np.rint(np.log2(np.maximum(base, 1)) * 16), -1).astype(np.int64)
            seen, where = np.unique(cell, return_inverse=True)
            weight = np.rint(np.bincount(where, extra)).astype(np.int64)
            head = [np.count_nonzero(base + extra), (base + extra).sum(), base.sum()]
            yield _batch(_ANSWER, {"block": -1 - rows[0][0], "shard": rows[0][0], "base": pack(np.array([*head, *seen], np.int64)), "extra": pack(np.array([0, 0, 0, *weight], np.int64))})
        give_back()

    sent = of.select("block", "ids", "uses", "sizes", "words", "tokens").mapInArrow(asked, "shard int, block long, keys binary, base binary, extra binary")
    return settle(sent.repartitionById(shards, F.col("shard")).mapInArrow(answered, "block long, shard int, base binary, extra binary"))


_COUNTS = [f"{c}{k}" for k in (1, 2, 3) for c in ("base", "extra")]


def counted(of: DataFrame, answers: list[DataFrame], shards: int) -> DataFrame:
    """Every block with the counts of its words by place, and of its tokens' pairs and triples by token."""
    kind = of.schema["ids"].dataType.simpleString()
    own = ["ids", "uses", "sizes", "words", "tokens"]
    rows = of.withColumn("order", F.lit(0)).withColumn("shard", F.lit(-1))
    for k, a in enumerate(answers, 1):
        rows = rows.unionByName(a.where("block >= 0").withColumn("order", F.lit(k)), allowMissingColumns=True)
    rows = rows.select("block", "order", "shard", *own, "base", "extra")
    ids = {"array<bigint>": pa.int64(), "array<int>": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("ids", pa.list_(ids)), ("uses", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), *((c, pa.binary()) for c in _COUNTS)])

    def run(batches):
        block, row, parts = None, None, {}

        def out():
            made = {c: row[c] for c in ("ids", "uses", "sizes", "tokens")}
            for k in (1, 2, 3):
                base, extra = (np.concatenate([unpack(x[i]) for x in parts[k]]) for i in (0, 1))
                if k == 1:  # in order of the shards; by place again
                    by = block.hashes()[1]
                    for c, x in (("base1", base), ("extra1", extra)):
                        back = np.empty_like(x)
                        back[by] = x
                        made[c] = pack(back)
                else:
                    place = block.keys(k)[1]
                    made |= {f"base{k}": pack(base[place]), f"extra{k}": pack(extra[place])}
            return _batch(schema, made)

        for r in _rows(batches):
            if r["order"] == 0:
                if row is not None:
                    yield out()
                block, row, parts = Block(r), r, {1: [], 2: [], 3: []}
            else:
                parts[r["order"]].append((r["base"], r["extra"]))
        if row is not None:
            yield out()
        give_back()

    dealt = rows.repartition(shards, "block").sortWithinPartitions("block", "order", "shard")
    return settle(dealt.mapInArrow(run, f"ids {kind}, uses binary, sizes binary, tokens binary, {', '.join(f'{c} binary' for c in _COUNTS)}"))


def learned(x: np.ndarray, n: np.ndarray, free: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of a mixture by expectation-maximisation: x[i, k] is what component k gives event i, which occurs n[i] times. One
    event more for each free component keeps every weight above zero."""
    w = free / free.sum()
    for _ in range(rounds):
        share = x * w
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        new = (share.sum(0) + free) / (share.sum() + free.sum())
        done = np.abs(new - w).max() < 1e-7
        w = new
        if done:
            break
    return w


def _magnitude(n: np.ndarray) -> np.ndarray:
    """floor(log2(n)) of positive numbers."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


class Counts:
    """What a counted block says of the tokens of some of its documents; without those of the weights for ``estimates``."""

    def __init__(self, start: tuple[int, int], sizes, uses, c1, c2, c3):
        self.sizes, self.uses, self.c1, self.c2, self.c3 = sizes, uses, c1, c2, c3
        self.starts = np.cumsum(sizes) - sizes
        self.h2, self.h3 = after(c1, self.starts, sum(start)), after(c2, self.starts, sum(start))

    @classmethod
    def of(cls, row: dict, start: tuple[int, int], estimates: bool, some: int = 1 << 17):
        """(first document, counts) of documents of about ``some`` tokens at a time: a block's arrays are as long as its tokens,
        and what is made of them shouldn't be."""
        get = lambda k: unpack(row[f"base{k}"]) if estimates else unpack(row[f"base{k}"]) + unpack(row[f"extra{k}"])
        sizes, uses, tokens, words, c2, c3 = unpack(row["sizes"]), unpack(row["uses"]), unpack(row["tokens"]), get(1), get(2), get(3)
        ends = np.cumsum(sizes)
        lo = at = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, at + some, side="right")))
            here = slice(at, int(ends[hi - 1]))
            yield lo, cls(start[:1] if estimates else start, sizes[lo:hi], uses[lo:hi], words[tokens[here]], c2[here], c3[here])
            lo, at = hi, int(ends[hi - 1])

    def bucket(self) -> np.ndarray:
        """By magnitude: 64 and more by how often both words before were seen, else by how often the last was; -1 if neither."""
        out = np.full(len(self.c1), -1)
        out[self.h2 > 0] = _magnitude(self.h2[self.h2 > 0])
        out[self.h3 > 0] = _magnitude(self.h3[self.h3 > 0]) + 64
        return out


class Model:
    """Sizes of the corpus and weights of the mixture: some hundred numbers, however large the corpus is."""

    def __init__(self, types: int, total: int, total_base: int, unigram: float, start: tuple[int, int]):
        self.types, self.total, self.total_base, self.unigram, self.start = types, total, total_base, unigram, start
        self.weights = np.zeros((128, 3))

    def one(self, c1: np.ndarray, total: int) -> np.ndarray:
        return self.unigram * c1 / max(total, 1) + (1 - self.unigram) / (self.types + 1)

    def fill(self, found: dict[int, np.ndarray]) -> None:
        """Weights of a bucket without events are those of the nearest one below of its kind, else equal."""
        for lo, free in ((0, np.array([0.0, 0.5, 0.5])), (64, np.full(3, 1 / 3))):
            last = free
            for b in range(lo, lo + 64):
                last = self.weights[b] = found.get(b, last)

    def logs(self, c: Counts) -> np.ndarray:
        """log10 of each token's probability."""
        p1 = self.one(c.c1, self.total)
        p2, p3 = c.c2 / np.maximum(c.h2, 1), c.c3 / np.maximum(c.h3, 1)
        b = c.bucket()
        w = np.where((b < 0)[:, None], [0.0, 0.0, 1.0], self.weights[b])
        return np.log10(w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * p1)


def fit(of: DataFrame, words: DataFrame, start: tuple[int, int]) -> Model:
    """The mixture's weights. Events of the documents of the weights are counted by bucket and by the ratios of the three estimates, a
    finite grid, and each bucket's weights are learned where its cells meet."""
    stats = words.where("block < 0").select("base", "extra").collect()
    heads = np.sum([unpack(r.base)[:3] for r in stats], axis=0) if stats else np.zeros(3, np.int64)
    cells: dict[int, int] = collections.Counter()
    for r in stats:
        for cell, n in zip(unpack(r.base)[3:].tolist(), unpack(r.extra)[3:].tolist()):
            cells[cell] += n
    types, total, total_base = map(int, heads)
    seen = np.array(sorted(cells), np.int64)
    x = np.where(seen >= 0, 2.0 ** (seen / 16) * (types + 1) / max(total_base, 1), 0.0)
    w = learned(np.stack([x, np.ones(len(x))], 1), np.array([cells[c] for c in seen.tolist()], np.float64), np.ones(2))
    model = Model(types, total, total_base, float(w[0]), start)

    def events(batches):
        sums: dict[int, int] = collections.Counter()
        for _, c in (x for row in _rows(batches) for x in Counts.of(row, start, True)):
            bucket, p1 = c.bucket(), model.one(c.c1, total_base)
            at = np.flatnonzero((np.repeat(c.uses, c.sizes) == WEIGHTS) & (bucket >= 0))
            ratio = lambda n, h: np.where(n[at] > 0, np.rint(_STEPS * np.log2(np.maximum(n[at], 1) / np.maximum(h[at], 1) / p1[at])), _UNSEEN).astype(np.int64) - _UNSEEN
            cell = (bucket[at] << 40) + (np.where(bucket[at] >= 64, ratio(c.c3, c.h3), 0) << 20) + ratio(c.c2, c.h2)
            for key, n in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
                sums[key] += n
        keys = np.array(list(sums), np.int64)
        cols = [keys >> 40, (keys >> 20 & 0xFFFFF) + _UNSEEN, (keys & 0xFFFFF) + _UNSEEN]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(list(sums.values()), pa.int64())], names=["bucket", "r3", "r2", "n"])
        give_back()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["r3", "r2"])
        given = lambda r: np.where(r == _UNSEEN, 0.0, 2.0 ** (np.clip(r, -4000, 4000) / _STEPS))
        bucket = int(g["bucket"].iloc[0])
        w = learned(np.stack([given(g["r3"].to_numpy()), given(g["r2"].to_numpy()), np.ones(len(g))], 1), g["n"].to_numpy(np.float64), np.array([float(bucket >= 64), 1.0, 1.0]))
        return pd.DataFrame({"bucket": [bucket], "w3": w[:1], "w2": w[1:2], "w1": w[2:]})

    counts = of.mapInArrow(events, "bucket long, r3 long, r2 long, n long").groupBy("bucket", "r3", "r2").agg(F.sum("n").alias("n"))
    found = counts.groupBy("bucket").applyInPandas(one, "bucket long, w3 double, w2 double, w1 double").collect()
    model.fill({r.bucket: np.array([r.w3, r.w2, r.w1]) for r in found})
    return model


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, weights: int = 2, tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; scores are sums of log10.

    Documents whose crc32 of the id modulo ``folds`` is ``held_out`` teach nothing; those where it is ``weights`` teach the mixture's
    weights first, with counts that leave them out, and then count with the rest. Words are what spaces (x20, x09-x0D) part in
    the text with A-Z in lower case; each text ends with one more token. Base is a unigram model smoothed by a half.

    Every count covers all documents: nothing is pruned. Words are counted exactly, pairs and triples by keys of 64 bits.
    Documents are read once; a block of them holds ``tokens`` tokens or one document, and its tasks some 100 bytes a token. At most
    a row for each block and shard moves, so there should be fewer shards (spark.sql.shuffle.partitions) than a block has keys.

    A null text is an empty one: one token. A null id counts as training and comes out null; repeated rows are scored and
    counted each. Ids other than integers come out as strings. An empty table gives no rows; without training documents all
    counts are 0 and both models are uniform. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    use = F.when(fold == held_out, HELD_OUT).when(fold == weights, WEIGHTS).otherwise(ESTIMATES)
    of = blocks(docs, use, id_col=id_col, text_col=text_col, tokens=tokens)
    uses = docs.groupBy(use.alias("use")).agg(F.count("*").alias("n")).collect()
    start = tuple(sum(r.n for r in uses if r.use == u) for u in (ESTIMATES, WEIGHTS))
    answers = [tally(of, k, shards) for k in (1, 2, 3)]
    full = counted(of, answers, shards)
    model = fit(full, answers[0], start)
    discard(of, *answers)
    kind = of.schema["ids"].dataType.elementType.simpleString()
    ids = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches):
        for row, lo, c in ((row, *x) for row in _rows(batches) for x in Counts.of(row, start, False)):
            add = lambda x: np.add.reduceat(x, c.starts)
            base = np.log10((c.c1 + 0.5) / (model.total + 0.5 * (model.types + 1)))
            cols = [pa.array(row["ids"][lo : lo + len(c.sizes)], ids), pa.array(c.uses == HELD_OUT), pa.array(c.sizes), pa.array(add((c.c1 > 0).astype(np.int64))), pa.array(np.full(len(c.sizes), model.total, np.int64)), pa.array(add(base)), pa.array(add(model.logs(c)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        give_back()

    return full.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
