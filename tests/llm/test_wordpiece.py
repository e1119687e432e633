"""The automaton against the plain greedy longest match, and against a library's word pieces."""

import random

import public_tokenizers as P
from tokenizers.models import WordPiece

from provender.llm import wordpiece

PATH = P.path("piece_bpe_32k.model")
STARTS, REST = wordpiece.load_pieces(PATH)
LONGEST = max(map(len, STARTS | REST))


def greedy(word, starts, rest, longest=100):
    n, at, pieces = 0, 0, starts
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        if not size and not (at == 0 and pieces is starts and b"" in starts):
            return -1
        n, at, pieces = n + 1, at + size, rest
    return n


def test_any_vocabulary_with_starts_and_rest():
    rnd = random.Random(6)
    string = lambda most: bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, most)))
    for turn in range(80):
        starts, rest = {string(6) for _ in range(12)} | ({b""} if turn % 2 else set()), {string(6) for _ in range(8)}
        auto = wordpiece.LongestMatch(starts, rest)
        for _ in range(300):
            w = string(14)
            assert auto.count(w) == greedy(w, starts, rest)
    assert wordpiece.LongestMatch([]).count(b"a") == -1 and wordpiece.LongestMatch([b"a"]).count(b"") == 0


def test_starts_and_rest_of_the_vocabulary():
    assert b"the" in STARTS and b"" in STARTS and len(STARTS) > 15_000 and len(REST) > 15_000
    assert all(bytes([c]) in REST for c in range(256)) and not any(wordpiece.SPACE.encode() in p for p in STARTS | REST)


def test_equals_a_librarys_word_pieces():
    """Words of letters that all start some piece, so that none needs the empty start or single bytes."""
    vocab = {p.decode(): i for i, p in enumerate(sorted(p for p in STARTS if p.isalpha()))}
    vocab |= {"##" + p.decode(): len(vocab) + i for i, p in enumerate(sorted(p for p in REST if p.isalpha()))} | {"[UNK]": 90_000}
    library = WordPiece(vocab=vocab, unk_token="[UNK]", max_input_chars_per_word=1000)
    auto, rnd = wordpiece.LongestMatch(STARTS, REST), random.Random(3)
    for _ in range(3_000):
        w = "".join(rnd.choice("aeionrtsthldcumfgpwybvk") for _ in range(rnd.randrange(1, 25)))
        tokens = library.tokenize(w)
        assert tokens[0].value != "[UNK]" and auto.count(w.encode()) == len(tokens)


def test_counts_of_texts(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aetn ö\u00a0ßx1.\n語😀\x0b") for _ in range(rnd.randrange(200))) for _ in range(60)] + [None, "", " \n", "y" * 100_000, "same", "same"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "the end", 5)]
    want = []
    for i, t, _ in rows:
        words = (t or "").encode().split()
        want.append((i, len(words), sum(greedy(w, STARTS, REST, LONGEST) for w in words), 0))
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in wordpiece.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), PATH).collect()), key=key)
    assert got == sorted(want, key=key)
    assert wordpiece.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
