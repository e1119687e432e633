"""Repeats against plain dictionaries of all 50-byte strings, and the run index against sorted suffixes."""

import hashlib
import random

import numpy as np

from provender.llm import repeats


def plain(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(n=90, seed=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    texts = []
    for _ in range(n):
        t = " ".join(word() for _ in range(rnd.randrange(0, 60)))
        for _ in range(rnd.randrange(0, 3)):
            if texts:
                o = rnd.choice(texts)
                a = rnd.randrange(len(o) + 1)
                t += o[a : a + rnd.choice([20, 46, 49, 50, 51, 52, 80, 200])] + word()
        texts.append(t)
    rows = [(rnd.randrange(10_000), t) for t in texts]
    return rows + [(20_000, "ab" * 300), (20_001, "ab" * 200), (5, "x" * 49), (6, "x" * 49), (7, "x" * 50), (8, "x" * 51), (9, None), (10, ""), (None, texts[3] * 3), rows[0], (rows[1][0], rows[2][1]), (30_000, texts[5] + "\x00" * 60), (30_001, "\x00" * 55)]


key = lambda r: tuple((x is None, x) for x in r)


def test_equals_plain_dictionaries(spark):
    rows = made()
    df = spark.createDataFrame([(t, d, "clash", 1) for d, t in rows], "text string, doc_id long, raw string, n_bytes int").repartition(3)
    got = sorted((tuple(r)[:5] for r in repeats.remove_repeats(df).collect()), key=key)
    assert got == sorted(plain(rows), key=key)
    assert sum(r[2] for r in got) > 3000


def test_long_texts_and_many_copies(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long), (2, long[:30_000] + "!" + long[30_000:]), *((10 + i, long[100:400]) for i in range(60))]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans, got[2].kept) == (60_000, 2, b"!")
    assert all(got[10 + i].n_removed == 300 for i in range(60))


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_cover_every_window():
    rnd = random.Random(4)
    for alphabet in ("ab", "abcdefghij", "a"):
        t = "".join(rnd.choice(alphabet) for _ in range(700)).encode()
        starts = np.array([0, 300, 310])
        places, hashes, low = repeats.anchors(np.frombuffer(t, np.uint8), starts)
        for x, y in ((0, 300), (310, 700)):
            at = set(places.tolist())
            assert all(any(i <= a <= i + 30 for a in at) for i in range(x, y - 49))
        first, last = repeats.windows(places, hashes, low)
        assert ((first <= last) & (last <= places) & (places <= first + 30)).all()
        covered = {w for a, b in zip(first.tolist(), last.tolist()) for w in range(a, b + 1)}
        assert covered == set(range(251)) | set(range(310, 651))


def test_run_index_steps_through_sorted_suffixes():
    rnd = random.Random(9)
    contexts = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(40, 90))) for _ in range(40)})
    docs = np.array([rnd.randrange(100) for _ in contexts])
    index = repeats.RunIndex(contexts, docs)
    got = index.stream()
    for c, row in zip(contexts, got):
        for i, value in enumerate(row.tolist()):
            w = c[i : i + 50]
            want = min((d for o, d in zip(contexts, docs.tolist()) if w in o), default=None) if len(w) == 50 else np.iinfo(np.int64).max
            assert value == want
    assert len(index.heads) == len(index.target) < sum(map(len, contexts)) + len(contexts)


def test_an_anchor_of_very_many_contexts_is_cut(spark):
    """Contexts around one anchor, most with a common footer, in lists of at most 10: every answer of the plain search is there."""
    rnd = random.Random(5)
    anchor, foot = bytes(rnd.choice(b"xyz") for _ in range(20)), [bytes(rnd.choice(b"uvw") for _ in range(30)) for _ in range(2)]
    some = lambda n: bytes(rnd.choice(b"ab") for _ in range(n))
    contexts, lefts = [], []
    for _ in range(400):
        left, right = rnd.randrange(31), rnd.randrange(31)
        o, p = rnd.choice([0, 5, 12, 30]), rnd.choice([0, 3, 18, 30])
        c = (some(30) + foot[0][:o])[-left:] if left else b""
        contexts.append(c + anchor + (foot[1][:p] + some(30))[:right])
        lefts.append(left)
    pairs = list(dict.fromkeys(zip(contexts, lefts)))
    contexts, lefts = [c for c, _ in pairs], np.array([x for _, x in pairs])
    low = np.array([rnd.randrange(1000) for _ in contexts])
    high = low + np.array([rnd.choice([0, 0, 7]) for _ in contexts])
    first = {}
    for c, d in zip(contexts, low.tolist()):
        for i in range(len(c) - 49):
            first[c[i : i + 50]] = min(d, first.get(c[i : i + 50], d))
    want = {(k, i - lefts[k], first[c[i : i + 50]]) for k, c in enumerate(contexts) for i in range(len(c) - 49) if first[c[i : i + 50]] < high[k]}
    got = repeats.shard_answers(contexts, lefts, np.zeros(len(contexts), np.uint64), low, high, most=10)
    found = {}
    for k, a, b, d in got.T.tolist():
        for i in range(a, b + 1):
            found[k, i] = min(d, found.get((k, i), d))
    assert {(k, i, d) for (k, i), d in found.items()} == {(k, int(i), d) for k, i, d in want} and len(want) > 500


def test_a_footer_in_every_document(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(40, 200)))
    footer = "This notice of sixty bytes ends each and every single page.."
    rows = [(i, text() + footer + text()[: rnd.randrange(20)]) for i in range(3_000)]
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted(plain(rows)) and sum(r[2] >= 60 for r in got) == 2_999


def test_settled_frames_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from provender.llm.shared import CLEAN, settle

    before = spark.conf.get(CLEAN, None)
    out = settle(spark.range(10_000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    assert out.count() == 10 and spark.conf.get(CLEAN, None) == before
