"""SimHash against fingerprints bit by bit and components over all pairs."""

import random
import re

import numpy as np
import xxhash

from provender.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, fps, radius=4):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return [low[find(i)] for i in range(len(rows))]


def corpus(n=260, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéZ") for _ in range(rnd.randrange(1, 8))) for _ in range(90)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 300))))
    return texts + ["", " \t\n", "One", "one", "É é", "a b c", "a b c d", "\x1c x", "x " * 20_000]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, doc_id long, fp string, shard int")
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df, **how).collect())
    fps = [plain_fingerprint(t) for t, *_ in rows]
    comps = plain_components([d for _, d, *_ in rows], fps)
    assert got == sorted((d, f, c) for (_, d, *_), f, c in zip(rows, fps, comps))
    return comps


def test_matches_all_pairs_with_ties_nulls_and_clashing_columns(spark):
    texts = corpus()
    rows = [(t, 1000 - 3 * i, "clash", i) for i, t in enumerate([*texts, None, texts[0], texts[0]])]
    rows.append(rows[0])
    comps = check(spark, rows)
    assert len(set(comps)) < len(rows)


def test_hot_shards_are_cut_again_exactly(spark):
    rows = [(t, i, None, 0) for i, t in enumerate(corpus(120, 8))]
    check(spark, rows, shard_rows=1)


def test_every_value_hangs_from_its_parent_by_its_distance():
    fps = np.unique(np.random.default_rng(4).integers(0, 2**20, 300, dtype=np.uint64))
    tree = simhash.BKTree(fps)
    children = [kid for kids in tree.kids.values() for _, kid in kids]
    assert sorted(children) == list(range(1, len(fps)))
    for node, kids in tree.kids.items():
        assert len({e for e, _ in kids}) == len(kids) and all(int(fps[node] ^ fps[k]).bit_count() == e for e, k in kids)
    found = {(i, j) for i, js in tree.near(fps, 3) for j in js.tolist()}
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_large_shard_walk_equals_brute_force():
    rnd = np.random.default_rng(3)
    fps = np.unique(rnd.integers(0, 2**10, 400, dtype=np.uint64) * np.uint64(2**40 + 1))
    reps = rnd.permutation(len(fps)) + 10
    low = plain_components(reps.tolist(), fps.tolist())
    got = dict(simhash.shard_links(fps, reps, 4))
    assert [got.get(r, r) for r in reps.tolist()] == low
    small = dict(simhash.shard_links(fps[:150], reps[:150], 4))
    assert [small.get(r, r) for r in reps[:150].tolist()] == plain_components(reps[:150].tolist(), fps[:150].tolist())


def test_long_chain_is_one_component(spark):
    from provender.llm.shared import components

    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    for few in (500_000, 0):  # by one task, and by large and small stars
        got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}
        assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_empty_table_and_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A b c d e f", "y"), (3, "z", "z"), (None, "z", "n")], "doc_id long, text string, lang string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def test_stage_takes_its_first_links_from_fingerprints(spark, monkeypatch):
    rnd = random.Random(5)
    base = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, "something else here that is not alike at all"), (4, base), (None, base)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.likely_copies(docs).collect()) == [(1, 2), (1, 4)]
    asked = []
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or whole(*a, **k))
    assert sorted(r.doc_id or 0 for r in simhash.keep_first(docs).collect()) == [0, 1, 3] and asked
