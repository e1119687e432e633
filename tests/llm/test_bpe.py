"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken

from provender.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice("aabbcdé 12\n\t'sxﬀ😀z") for _ in range(rnd.randrange(300))) for _ in range(400)]
    return made + ["a" * 5000, " " * 77, "", "ab" * 300, "don't  stop\r\n\r\n", "<|endoftext|>", "x" * 200_001 + " y", made[3], made[3]]


def expected(text):
    ids = TIKTOKEN.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_equals_tiktoken_with_nulls_ties_and_clashing_columns(spark):
    rows = [(i // 2, t, "clash", 1) for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = sorted(tuple(r) for r in bpe.encode(df, PATH, P.PATTERN).collect())
    assert got == sorted((d, *expected(t)) for d, t, *_ in rows)


def test_ranks_that_fall_within_a_word():
    # "abc" has a lower rank than "ab", which its first half needs: ranks belong to strings, not to halves
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 280, b"ca": 290, b"cab": 270, b"aba": 310}
    t = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    ids, n = bpe.Replay(ranks).encode([w.encode() for w in words])
    assert [x.tolist() for x in bpe.np.split(ids, bpe.np.cumsum(n)[:-1])] == [t.encode_ordinary(w) for w in words]


def test_the_kept_words_are_bounded():
    enc = bpe.Encoder(RANKS, P.PATTERN, keep=10)
    for t in texts()[:40]:
        (ids,) = enc.encode([t])
        assert ids.tolist() == TIKTOKEN.encode_ordinary(t) and enc.decode(ids) == t.encode()


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Grüße, 12 mal!"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN, keep_ids=True, passed=["text"]).drop("text"), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "Grüße, 12 mal!"), (2, "")]
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []
