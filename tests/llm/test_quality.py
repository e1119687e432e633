"""The rule ensemble: held-out accuracy, the compiled column against the model, and what it may look at."""

import random
import zlib

import numpy as np

from provender.llm import quality


def rows(n=1500, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(1, 9)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(5, 80))]
        good = rnd.random() < 0.8
        if not good:
            w = rnd.choice([[x + "###" for x in w], [w[0]] * len(w), [x.upper() + "!!" for x in w], " | ".join(w).split(" ")])
        out.append((i, " ".join(w) + ".", int(good)))
    return out


def frames(spark, made):
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t, _ in made], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame([(d, q) for d, _, q in made], "doc_id long, quality int")


def test_held_out_accuracy_and_compiled_column(spark):
    made = rows()
    docs, labels = frames(spark, made)
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == len(made)
    held = [(d, q) for d, _, q in made if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in made)
    assert np.mean([got[d].predicted == q for d, q in held]) > 0.95
    plain = model.score(np.array([quality.stats_of(t) for _, t, _ in made]))
    assert all(abs(got[d].score - s) < 1e-9 and got[d].predicted == (s >= 0.3) for (d, _, _), s in zip(made, plain.tolist()))
    assert 0 < len(model.rules) < 80
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def test_held_out_labels_are_never_seen(spark):
    made = rows(400)
    docs, labels = frames(spark, made)
    flipped = [(d, t, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, t, q in made]
    assert quality.train(docs, labels) == quality.train(docs, frames(spark, flipped)[1])


def test_nulls_long_texts_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000), (3, "word " * 100_000), (None, "a b"), (4, "\n \n")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).collect() == []
    assert quality.stats_of(None) == quality.stats_of(" \n") == (0.0,) * len(quality.STATS)


def test_the_bound_holds_for_repeated_ids_and_labels(spark):
    docs = spark.createDataFrame([(1, f"word number {i}") for i in range(3_000)] + [(i, "a b") for i in range(2, 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(1, 90) for q in (0, 1, None)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    try:
        quality.fit = lambda x, y, **how: seen.append(len(y)) or real(x, y, **how)
        quality.train(docs, labels, max_rows=20)
    finally:
        quality.fit = real
    assert seen == [20]


def test_columns_of_the_users_own_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 2.5, "r"), (2, None, None, None, None)], "doc_id long, text string, _stats string, score double, `_row` string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).schema == docs.schema
    assert {(r.doc_id, r["_stats"], r["_row"]) for r in quality.keep_good(docs, labels).collect()} == {(1, "s", "r"), (2, None, None)}
    assert quality.score(docs, labels).columns == ["doc_id", "text", "_stats", "_row", "held_out", "score", "predicted"]


def test_first_split_is_the_best_and_the_weights_are_the_lasso_optimum():
    """Gains by plain loops over all cut points, and the optimality conditions of the penalised loss."""
    made = rows(600, 5)
    x, y = np.array([quality.stats_of(t) for _, t, _ in made]), np.array([q for *_, q in made], float)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    cuts = [np.unique(np.quantile(c, np.linspace(0.005, 0.995, 100))) for c in x.T]
    paths = []
    quality._tree(x, cuts, g, h, 1, (), paths, None)

    def gain(j, c):
        side = x[:, j] <= c
        if min(side.sum(), (~side).sum()) < 20:
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (side, ~side))

    best = max(gain(j, c) for j in range(x.shape[1]) for c in cuts[j])
    (name, _, cut), = paths[0]
    assert abs(gain(quality.STATS.index(name), cut) - best) < 1e-9
    penalty = 2e-3
    model = quality.fit(x, y, penalty=penalty, steps=20_000, trees=6)
    r = model.score(x) - y
    assert model.rules and abs(r.mean()) < 1e-5
    for rule, w in model.rules:
        assert abs((rule.holds(x) * r).mean() + penalty * np.sign(w)) < 1e-5
