"""Importance resampling towards a target: hashed n-gram counts of corpus and target weigh documents, and noise that depends on
the id alone turns the weights into a draw without replacement. Identical texts are weighed once."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import give_back, settle
from provender.operators.numbering import numbered

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)  # digits, letters, and all bytes of characters beyond ASCII
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_SHORT = 64  # words up to here go through tables, longer ones one by one
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (_STEP >> np.uint32(1))
_SPACE = np.uint32(zlib.crc32(b" "))
_EIGHT, _LOW = np.uint32(8), np.uint32(255)


def _step(crc: np.ndarray) -> np.ndarray:
    """What a zero byte does to the register."""
    return _STEP[crc & _LOW] ^ (crc >> _EIGHT)


def _shift_tables(steps: int) -> np.ndarray:
    """[n][k][b]: byte b at place k of the register after n zero bytes. The register is linear, so four of them make any shift."""
    out = np.zeros((steps + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (_EIGHT * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(steps):
        out[n + 1] = _step(out[n])
    return out


_SHIFT = _shift_tables(_SHORT)


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    crc, by = crc.copy(), by.copy()
    while len(far := np.flatnonzero(by > _SHORT)):
        crc[far] = _shifted(crc[far], np.full(len(far), _SHORT))
        by[far] -= _SHORT
    parts = (crc >> _EIGHT * np.uint32(k) & _LOW for k in range(4))
    out = np.zeros(len(crc), np.uint32)
    for k, part in enumerate(parts):
        out ^= _SHIFT[by, k, part]
    return out


def _word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    at, n = starts[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-n, -_SHORT))
    for j in range(int(n[long]) if long < len(n) else 0):
        here = slice(long, int(np.searchsorted(-n, -j)))
        crc[here] = _STEP[(crc[here] ^ data[at[here] + j]) & _LOW] ^ (crc[here] >> _EIGHT)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + n[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(data: np.ndarray, bounds: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature). data: the UTF-8 bytes of all texts, one after another;
    bounds: where each begins, and the end.

    A word's crc32 is computed once; that of a run follows from its last word's by shifting what comes before.
    """
    data = _LOWER[data]
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    sizes = np.flatnonzero(word & (~after | edge[1:])) + 1 - starts
    of = np.searchsorted(bounds, starts, side="right") - 1
    one = _word_crcs(data, starts, sizes)
    texts, found, run = [of], [one % np.uint32(buckets)], one
    for k in range(1, longest):
        same = of[k:] == of[:-k]  # a run's words are of one text
        run = _shifted((_step(run[:-1]) ^ _SPACE), sizes[k:]) ^ one[k:]
        texts.append(of[k:][same])
        found.append((run % np.uint32(buckets))[same])
    return np.bincount(of, minlength=len(bounds) - 1), np.concatenate(texts), np.concatenate(found).astype(np.int64)


def _blocks(batch: pa.RecordBatch, size: int = 2 << 20):
    """The texts of a batch in blocks of some ``size`` bytes: (first row, bytes, bounds). A text is never cut."""
    text = batch.column(0).cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1)
        yield lo, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of the texts (text, n: how often it occurs) fall into each bucket; ``buckets`` numbers come to the driver."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            times = b.column(1).to_numpy().astype(np.float64)
            for lo, data, bounds in _blocks(b):
                _, of, found = features(data, bounds, buckets, longest)
                sums += np.bincount(found, times[lo + of], buckets).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])
        give_back()

    rows = texts.select("text", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by which a feature of the bucket speaks for the target, rounded down; both sides smoothed by one."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + k)) / ((a + 1) * (t + k)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(texts: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(key, n_words, n_features, weight) of texts (text, key)."""

    def run(batches):
        for b in batches:
            words, n, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, data, bounds in _blocks(b):
                here = slice(lo, lo + len(bounds) - 1)
                words[here], of, found = features(data, bounds, len(gain), longest)
                n[here] = np.bincount(of, minlength=len(bounds) - 1)
                weight[here] = np.rint(np.bincount(of, gain[found].astype(np.float64), len(bounds) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(words), pa.array(n), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])
        give_back()

    return texts.select("text", "key").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def _distinct(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id alone; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null where a document isn't drawn.

    Features are runs of one to ``longest`` words, hashed into buckets; a text's weight sums its features' gains, and the
    ``percent`` of documents of ``least_words`` words and more that have the highest scores are drawn, ties to the smaller id.
    Texts are grouped whole, with partial groups before the shuffle; a text is weighed once and counts as often as it occurs.
    Weights go back to documents by SHA-256, and scores are ranked by ranges, so no group of copies comes to one task; the
    bucket counts (``buckets`` numbers) are all that the driver holds.

    A null text is empty: no features, weight 0. A null id has no score and can't be drawn. Rows that share an id are
    scored each by its own text, and tie if these are equal. A text is never cut; a task needs some 100 bytes for each byte
    of its longest text beyond 2 MB. An empty table gives no rows, an empty target gains of 0 or more alike for all buckets of one
    count. Other columns aren't looked at.
    """
    texts = settle(_distinct(docs, text_col))
    gain = gains(bucket_counts(texts, buckets, longest), bucket_counts(_distinct(target, text_col), buckets, longest))
    weights = settle(weigh(texts.select("text", _key(F.col("text")).alias("key")), gain, longest))
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key")).join(weights, "key").drop("key")
    rows = rows.withColumn("score", F.col("weight") + noise("doc_id", seed))
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ranked = numbered(rows.withColumn("_may", may), [F.desc("_may"), F.desc_nulls_last("score"), F.asc("doc_id")], "rank")
    drawn = percent * ranked.where("_may").count() // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_may") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents with their columns; rows that share an id go or stay together."""
    chosen = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs[how.get("id_col", "doc_id")] == chosen["_drawn"], "left_semi")


#: The same in SQL; crc32 as a fold over the bytes of each distinct run.
SQL = """
WITH steps AS (SELECT list(list_reduce(list_transform(range(8), lambda k: CAST(k AS BIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT false AS goal, doc_id AS id, text FROM documents UNION ALL SELECT true, row_number() OVER (), text FROM benchmark),
w AS (SELECT goal, id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
g AS MATERIALIZED (SELECT goal, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w),
h AS MATERIALIZED (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM g)),
crc AS (SELECT g, xor(4294967295::BIGINT, list_reduce(list_transform(range(1, length(x), 2), lambda i: (strpos('123456789ABCDEF', x[i]) * 16 + strpos('123456789ABCDEF', x[i + 1]))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 10000 AS bucket FROM h, steps),
f AS MATERIALIZED (SELECT goal, r, bucket FROM g JOIN crc USING (g)),
n AS (SELECT bucket, count(*) FILTER (NOT goal) AS s, count(*) FILTER (goal) AS t FROM f GROUP BY bucket), sums AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM n),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n, sums),
d AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE NOT goal GROUP BY r),
scored AS (SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (r) WHERE NOT goal),
s AS (SELECT doc_id, words >= 20 AND doc_id IS NOT NULL AS may, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND row_number() OVER (ORDER BY may DESC, score DESC, doc_id) <= 5 * count(*) FILTER (may) OVER () // 100 THEN row_number() OVER (ORDER BY may DESC, score DESC, doc_id) END AS rank FROM s"""
