"""The audit of filters against a version that applies every order to every document."""

import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from provender.llm import filter_audit as m
from provender.llm.shared import table
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def fails(doc_id, text, docs):
    t = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))}
    out["E"] = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
    return out


def plain(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    judged = [(part or "", fails(i, x, docs), i in good and i is not None, i in toxic and i is not None) for i, x, part in docs]
    out = []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shap = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                every = [j for j in own if j[1][f]]
                left = [j for j in left if not j[1][f]]
                shap[f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(sum(j[1].values()) == 1 for j in every), sum(j[2] for j in gone), sum(j[3] for j in gone), f])
    return sorted((*r[:9], shap[r[9]]) for r in out for shap in [{f: sum(x[4] for x in out if x[0] == r[0] and x[9] == f) for f in r[9]}])


def test_query_against_sql(spark):
    assert compare(spark, SF, lambda s, d: m.audit(table(s, d, "documents"), table(s, d, "labels")), m.SQL) > 0


def test_nulls_copies_repeats_and_clashing_columns(spark):
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a", "A B", "x # y", long, long + " |", "dup dup dup dup", long.upper(), "w " * 300]
    docs = [(i, rng.choice(texts), rng.choice(["p", "q", None])) for i in range(40)]
    docs += [(3, long, "p"), (3, long, "p"), (None, long, "q"), (None, None, None), (90, "z" * 100_000, "p")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(2, 1, 0), (None, 1, 1), (777, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, n int, mask int")
    known = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, part int")
    got = sorted(tuple(r) for r in m.audit(df, known).collect())
    assert got == plain(docs, labels)


def test_empty_table_and_other_filters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert m.audit(docs, labels).count() == 0
    two = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "ab", "s")], docs.schema)
    rows = m.audit(two, labels, {"X": F.contains("text", F.lit("a")), "Y": F.contains("text", F.lit("b"))}, copies=None).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows} == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (0, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (0, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        m.audit(two, labels, {}, copies=None)
