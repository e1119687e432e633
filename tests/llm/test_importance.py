"""Importance resampling against a plain version."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from provender.llm import importance as m
from provender.llm.shared import table
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_features(text, buckets=10_000, longest=3):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[j : j + k])) % buckets for k in range(1, longest + 1) for j in range(len(words) - k + 1)]


def plain(docs, target):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, x in docs:
        np.add.at(s, plain_features(x)[1], 1)
    for x in target:
        np.add.at(t, plain_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for i, x in docs:
        n, f = plain_features(x)
        w = sum(gain[k] for k in f)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, None if h is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_features_are_those_of_crc32():
    rng = random.Random(1)
    for trial in range(100):
        texts = ["".join(rng.choice("abZ é1 .ß" + "x" * rng.choice([0, 3, 40])) for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(rng.randint(1, 6))]
        if trial % 10 == 0:
            texts.append("q" * rng.randint(60, 700) + " a b " + "z" * 200)
        raw = [t.encode() for t in texts]
        n, of, found = m.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 10_000, 3)
        want = [plain_features(t) for t in texts]
        assert n.tolist() == [w[0] for w in want]
        assert sorted(zip(of.tolist(), found.tolist())) == sorted((i, f) for i, w in enumerate(want) for f in w[1])


def test_query_against_sql(spark):
    assert compare(spark, SF, lambda s, d: m.resample(table(s, d, "documents"), table(s, d, "benchmark")), m.SQL) > 0


def test_nulls_copies_ties_long_texts_and_clashing_columns(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé9") for _ in range(rng.randint(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rng.choice([3, 19, 20, 60])))) for i in range(300)]
    copy = " ".join(word() for _ in range(40))
    docs += [(1000 + i, copy) for i in range(200)]  # one text holds much of the table
    docs += [(5000, None), (5001, ""), (5002, "!!!"), (None, copy), (None, None), (5003, "word " * 30_000), (5004, "y" * 50_000), (7, copy), (7, copy)]
    target = [copy[:50], "a b c", None, "", "A B c"]
    df = spark.createDataFrame([(*d, 0, 1.5, "k") for d in docs], "doc_id long, text string, rank int, weight double, key string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in m.resample(df, goal).collect()), key=key)
    assert got == sorted(plain(docs, target), key=key)
    drawn = {r[0] for r in got if r[4] is not None}
    out = m.draw(df, goal)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == drawn


@pytest.mark.parametrize("docs", [[], [(1, "a b")], [(i, "same text " * 12) for i in range(40)]])
def test_empty_tables_and_ties(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert sorted((tuple(r) for r in m.resample(df, none).collect()), key=key) == sorted(plain(docs, []), key=key)
