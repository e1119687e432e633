"""Deleted interpolation against a version with plain dictionaries over the whole corpus."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from provender.llm import interpolation as m
from provender.llm.shared import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    """rows: (doc_id, text). The same model from counters of tuples; only the learning of the weights is shared."""
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    docs = []
    for i, text in rows:
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        docs.append((i, fold(i), ["<s>", "<s>", *(w for w in re.split("[\x20\x09-\x0d]+", low) if w), "</s>"]))

    def counts(keep):
        c = [collections.Counter() for _ in range(4)]
        for _, f, t in docs:
            if keep(f):
                c[1]["<s>"] += 1
                c[2]["<s>", "<s>"] += 1
                for k in range(2, len(t)):
                    c[1][t[k]] += 1
                    c[2][t[k - 1], t[k]] += 1
                    c[3][t[k - 2], t[k - 1], t[k]] += 1
        return c

    base, every = counts(lambda f: f not in (1, 2)), counts(lambda f: f != 1)
    types = len([w for w in every[1] if w != "<s>"])
    total, total_base = (sum(n for w, n in c[1].items() if w != "<s>") for c in (every, base))
    cells = collections.Counter()
    for _, f, t in docs:
        if f == 2:
            for w in t[2:]:
                n = base[1][w]
                cells[round(math.log2(n) * 16) if n else -1] += 1
    seen = sorted(cells)
    x = np.array([2.0 ** (k / 16) * (types + 1) / max(total_base, 1) if k >= 0 else 0.0 for k in seen])
    one = m.learned(np.stack([x, np.ones(len(x))], 1), np.array([float(cells[k]) for k in seen]), np.ones(2))[0]

    def parts(c, n, t, k):
        a, b = c[2][t[k - 2], t[k - 1]], c[1][t[k - 1]]
        p1 = one * c[1][t[k]] / max(n, 1) + (1 - one) / (types + 1)
        p2 = c[2][t[k - 1], t[k]] / b if b else 0.0
        p3 = c[3][t[k - 2], t[k - 1], t[k]] / a if a else 0.0
        bucket = 64 + a.bit_length() - 1 if a else b.bit_length() - 1 if b else -1
        return bucket, p3, p2, p1

    events = collections.defaultdict(collections.Counter)
    grid = lambda p, q: round(4 * math.log2(p / q)) if p else None
    for _, f, t in docs:
        if f == 2:
            for k in range(2, len(t)):
                bucket, p3, p2, p1 = parts(base, total_base, t, k)
                if bucket >= 0:
                    events[bucket][grid(p3, p1), grid(p2, p1)] += 1
    weights = {}
    for lo, last in ((0, (0.0, 0.5, 0.5)), (64, (1 / 3, 1 / 3, 1 / 3))):
        for b in range(lo, lo + 64):
            if b in events:
                keys = sorted(events[b], key=lambda q: tuple(-1e9 if v is None else v for v in q))
                v = lambda q: 0.0 if q is None else 2.0 ** (q / 4)
                last = m.learned(np.array([[v(a), v(c), 1.0] for a, c in keys]), np.array([float(events[b][q]) for q in keys]), np.array([float(b >= 64), 1.0, 1.0]))
            weights[b] = last
    out = []
    for i, f, t in docs:
        base_score = score = 0.0
        known = 0
        for k in range(2, len(t)):
            bucket, p3, p2, p1 = parts(every, total, t, k)
            w = weights[bucket] if bucket >= 0 else (0, 0, 1)
            score += math.log10(w[0] * p3 + w[1] * p2 + w[2] * p1)
            base_score += math.log10((every[1][t[k]] + 0.5) / (total + 0.5 * (types + 1)))
            known += every[1][t[k]] > 0
        out.append((i, f == 1, len(t) - 2, known, total, base_score, score))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, str(r[0]), r[2:5], round(r[5], 6), round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9), (g, w)


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_whole_table_and_small_blocks(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows)
    compare(m.score(docs).collect(), want)
    got = m.score(docs, tokens=2000).collect()
    compare(got, want)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nulls_empties_ties_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    words = ["a", "B", "b", "é", "ß", "\x85x", "the", "x" * 3000]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30])))) for i in range(60)]
    rows += [(3, "a b"), (3, "a b"), (None, "a b the"), (61, None), (62, ""), (63, "\t \n\x0b"), (64, "a\x0bb\x0cc\rd"), (65, "a b " * 4000)]
    docs = frame(spark, [(*r, 1, "x") for r in rows], ", score int, block string")
    compare(m.score(docs).collect(), plain(rows))
    compare(m.score(docs.drop("score", "block"), tokens=1).collect(), plain(rows))


def test_nothing_to_learn_from(spark):
    assert m.score(frame(spark, [])).count() == 0
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "a b") for i in only]
    compare(m.score(frame(spark, rows)).collect(), plain(rows))


def test_ids_of_other_types(spark):
    rows = m.score(spark.createDataFrame([("k", "a b"), ("l", "a")], "doc_id string, text string")).collect()
    assert sorted(r.doc_id for r in rows) == ["k", "l"]


def test_planes():
    for x in ([], [0], [1, 255, 256], [2**62, 5], [-1, 3]):
        assert m.unpack(m.pack(np.array(x, np.int64))).tolist() == x
