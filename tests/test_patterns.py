"""Literals of patterns, and dictionaries through the automaton against trying every pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provender.functions.cores import cores, folded
from provender.operators import classify, patterns, weights


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("BOLT|GEAR", ["bolt", "gear"]), ("R[IO]NG", ["ng"]), (r"(?i)\bmilks?\b", ["milk"]), (r"(?i)\b(?:berrys?|berries)\b", ["berries", "berry"]), (r"a?b*c", ["c"]), ("x+yz", ["yz"]),
        (r"\d+ oz", [" oz"]), ("[abc]", None), (".*", None), ("a|.", None), (r"(?:ab|cd)e", ["ab", "cd"]), ("(ab|c?)", None), (r"\$5\.00", ["$5.00"]), (r"(?=look)at", ["at"]), (r"a{2}bc", ["bc"]), (r"a{0,2}", None),
        (r"\p{L}x", None), ("(?x) a b", None), ("ab(", None), ("", None), ("É", ["É"]), (r"[]x]yy", ["yy"]), (r"\bice cream\b", ["ice cream"]),
    ],
)
def test_cores(pattern, want):
    assert cores(pattern) == want


def test_every_match_holds_a_core():
    rng = random.Random(4)
    atoms = ["a", "b", "AB", "[ab]", ".", r"\b", r"\d", "(a|bc)", "(?:ab|b?)", "c{2}", "c{0,1}", r"\.", "(?=a)"]
    for _ in range(3000):
        p = "".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "+?"]) if rng.random() < 0.9 else "|" for _ in range(rng.randint(1, 5)))
        try:
            compiled = re.compile("(?i)" + p)
        except re.error:
            continue
        found = cores("(?i)" + p)
        if found is None:
            continue
        for _ in range(10):
            t = "".join(rng.choice("aAbBcC1.") for _ in range(rng.randint(0, 8)))
            if compiled.search(t):
                assert any(c in folded(t) for c in found), (p, t, found)


def dictionary(rng, n=465):
    syllables = ["mil", "ber", "ap", "oat", "ri", "ce", "to", "ma", "ry", "bu", "no", "el"]
    words = set()
    while len(words) < n:
        words.add(" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 1, 1, 2]))))
    return [(i, w.title() if i % 2 else w, f"c{i % 57}") for i, w in enumerate(sorted(words))]


def test_keywords_of_full_size_against_every_pattern(spark):
    rng = random.Random(5)
    words = dictionary(rng)
    names = [" ".join(rng.choice([rng.choice(words)[1], rng.choice(words)[1] + "s", rng.choice(words)[1][:-1] + "ies", "x", "12/5"]) for _ in range(rng.randint(1, 4))).upper() for _ in range(300)] + ["", "milé"]
    kw = spark.createDataFrame(words, "ord int, keyword string, category string")
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.name: (r.keyword, r.category) for r in classify.keyword_match(df, kw).collect()}

    def pattern(k):
        if k[-1] == "y" and k[-2] not in "aeiouAEIOU":
            return rf"(?i)\b(?:{k}s?|{k[:-1]}ies)\b"
        return rf"(?i)\b{k}e?s?\b" if k[-1] in "oO" else rf"(?i)\b{k}s?\b"

    compiled = [(re.compile(pattern(k)), o, k, c) for o, k, c in words]
    want = {}
    for n in set(names):
        hits = [(-len(k), m.start(), o, k, c) for p, o, k, c in compiled if (m := p.search(n))]
        if hits:
            want[n] = min(hits)[3:]
    assert got == want and len(want) > 200


def test_first_match_in_blocks_and_without_literals(spark):
    rows = [(1, "[0-9]{3}", 1.0), (2, "bolt|gear", 2.0), (3, "B.LT", 3.0), (4, ".*", 9.0)]
    d = spark.createDataFrame(rows, "ord int, pattern string, value double")
    names = spark.createDataFrame([("a BOLT",), ("belt",), ("100 gears",), ("none",), (None,)], "name string")
    assert {r.name: r.value for r in weights.first_match_join(names, d).collect()} == {"a BOLT": 2.0, "belt": 3.0, "100 gears": 1.0, "none": 9.0}
    want = sorted((r.name, r.ord) for r in patterns.matches(names, d.withColumn("p", F.concat(F.lit("(?i)"), "pattern")), "name", "p").collect())
    met = patterns.candidates(names, d, "name", "pattern", block_patterns=1).join(d, "ord").where("regexp_like(name, concat('(?i)', pattern))")
    assert sorted((r.name, r.ord) for r in met.collect()) == want
    assert patterns.matches(names, d.limit(0), "name", "pattern").count() == 0


def test_no_nested_loop(spark):
    kw = spark.createDataFrame([(1, "Milk", "M")], "ord int, keyword string, category string")
    names = spark.createDataFrame([("MILK",)], "name string")
    for df in (classify.keyword_match(names, kw), weights.first_match_join(names, kw.selectExpr("ord", "keyword as pattern", "1.0D as value"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_aliases_in_order(spark):
    aliases = spark.createDataFrame([(1, "A", "x", 2), (1, "B", "y", 1), (1, "A", "z", 3), (2, "A", "x", 1), (3, "C", "q", 1)], "id long, campus string, raw_name string, ord int")
    lookup = spark.createDataFrame([("A", "x", "Milk"), ("B", "y", "milk"), ("A", "z", "Beef"), ("C", "q", None)], "campus string, raw_name string, value string")
    known = spark.createDataFrame([("Milk", "Dairy"), ("Beef", "Meat"), (None, "none")], "value string, category string")
    assert sorted((r.id, r.value, r.category) for r in classify.alias_category(aliases, lookup, known).collect()) == [(1, "Milk", "Dairy"), (2, "Milk", "Dairy")]
