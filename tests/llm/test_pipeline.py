"""The pipeline's rows against a brute-force version in plain Python, stage by stage on what the stage before left."""

import random

import corpus_pipeline
import numpy as np
from provender.llm import decontaminate, quality
from tests.llm.test_bpe import TIKTOKEN
from tests.llm.test_decontaminate import plain_distance
from tests.llm.test_jaccard import plain_components, plain_set
from tests.llm.test_pii import plain as plain_pii


def corpus():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(5)]
    docs = []
    for i in range(260):
        w = [word() for _ in range(rnd.randrange(12, 60))]
        kind = rnd.random()
        good = 1
        if kind < 0.2:
            w, good = [x + "###" for x in w], 0
        elif kind < 0.3 and docs:
            w = rnd.choice(docs)[1].split(" ")
            good = int("###" not in w[0])
        elif kind < 0.36 and docs:  # near copies: similar enough, or just not
            w = rnd.choice(docs)[1].split(" ")
            good = int("###" not in w[0])
            for at in (len(w) // 2,) if rnd.random() < 0.6 else range(0, len(w), 6):
                w[at] = word() + "###" * (not good)
        elif kind < 0.44:
            w[5:5] = rnd.choice(items)[1].split(" ")
        elif kind < 0.54:
            w.insert(3, rnd.choice(["jo.x@mail.example.com", "+1 (386) 555-3733", "10.0.0.7", "4111 1111 1111 1111"]))
        docs.append((i, " ".join(w), good))
    return docs, items


def write(spark, path):
    docs, items = corpus()
    spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t)) for d, t, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, _, q in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_equals_brute_force(spark, tmp_path):
    docs, items = write(spark, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    model = quality.train(table("documents"), table("labels"))
    left = [(d, t) for d, t, _ in docs if model.score(np.array([quality.stats_of(t)]))[0] >= 0.3]
    assert len(docs) * 0.6 < len(left) < len(docs)
    sets = [plain_set(t) for _, t in left]
    comps = plain_components([d for d, _ in left], sets)
    apart = {d for (d, _), c in zip(left, comps) if d != c}
    assert apart and any(plain_set(t) not in [sets[k] for k in range(i)] for i, (d, t) in enumerate(left) if d in apart)  # not only copies go
    left = [(d, t) for (d, t), c in zip(left, comps) if d == c]
    folded = [decontaminate.fold(t) for _, t in items]
    left = [(d, t) for d, t in left if not any(plain_distance(p, decontaminate.fold(t)) <= len(p) // 10 for p in folded)]
    want = {}
    for d, t in left:
        spans = sorted((a, b, k) for k, s in plain_pii(t).items() for a, b in s)
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += t[at:a] + f"<{k}>"
            at = max(at, b)
        want[d] = TIKTOKEN.encode_ordinary(out + t[at:])
    assert set(got) == set(want) and len(want) > 50
    plain_ids = {d: r.ids for d, r in got.items()}
    same = sum(plain_ids[d] == ids for d, ids in want.items())
    assert same == len(want)
    assert all(r.n_tokens == len(r.ids) and r.source == f"src{d % 3}" for d, r in got.items())


def test_stages_are_in_order_and_keep_columns(spark, tmp_path):
    write(spark, str(tmp_path))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
