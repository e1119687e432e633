"""Scalar functions: properties against plain versions, and the named examples."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provender.functions import gates, similarity, text


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_lcs_and_ratios(a, b):
    assert similarity.lcs(a, b) == plain_lcs(a, b)
    assert 0 <= similarity.sort_ratio(a, b) <= 100 and abs(similarity.sort_ratio(a, b) - similarity.sort_ratio(b, a)) < 1e-9
    assert 0 <= similarity.set_ratio(a, b) <= 100
    if a.split() and set(a.split()) <= set(b.split()):
        assert similarity.set_ratio(a, b) == 100


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_named_scores(spark):
    a, b = "ONION, RED JUMBO 25-LB", "ONION, RED JUMBO 5-LB"
    p = [values(spark, lambda c: text.process(text.clean_name(c)), [x])[0] for x in (a, b)]
    assert round(similarity.sort_ratio(*p), 2) == 97.56
    x, y = values(spark, gates.signature, [a, b])
    assert x != y
    assert round(similarity.sort_ratio("organic whole milk gallon", "organic whole milk half gallon"), 2) == 90.91


def test_pack_sizes(spark):
    got = values(spark, text.pack_size_lb, ["4/5 LB", "5 2 LB", "8-10#", "20 LB", "6#AVG", "10 POUND", "12", "3 OZ", "2 KG", None, "10 CT"])
    assert got == [20.0, 10.0, 9.0, 20.0, 6.0, 10.0, None, None, 4.40924, None, None]


def test_shapes(spark):
    got = values(spark, text.name_weight, ["CHICKEN 4/10# AVG", "Pocky 12/10/1.45 oz", "BEEF 5LB", "MUSHROOM #1", "X"])
    assert [(r.value, r.shape) for r in got] == [(40.0, "chain"), (12 * 10 * 1.45 / 16, "chain"), (5.0, "bare"), (None, "none"), (None, "none")]
    got = values(spark, text.gallons, ["MILK 12 1/2 GALLONS", "JUICE 4/1-GAL", "NON-FAT 6/.5GAL", "MILK 5 Gal Disp", "APPLE GALA 3", "PICO DE GALLO 2"])
    assert [(r.value, r.shape) for r in got] == [(12.5, "chain"), (4.0, "chain"), (3.0, "chain"), (5.0, "bare"), (None, "none"), (None, "none")]
    got = values(spark, text.name_count, ["ROMAINE 12/3-CT", "APPLE 64-88 CT", "LEMON 108-CT", "ORANGE (88)", "X"])
    assert [(r.value, r.shape) for r in got] == [(36.0, "chain"), (76.0, "range"), (108.0, "bare"), (88.0, "paren"), (None, "none")]


def test_cleaning(spark):
    assert values(spark, text.normal_vendor, ["Sysco Corporation", " SYSCO ", "Sysco, Inc.", "", None, "A.  B"]) == ["sysco", "sysco", "sysco", None, None, "a b"]
    assert values(spark, text.clean_name, ["BRENTLEY S PIE (FRESH) 10# (SUS)", "‘A’ PEEL CT"]) == ["BRENTLEYS PIE FRESH 10 LB", "'A' PEELED COUNT"]
    assert values(spark, text.normal_brand, ["- Amy`s  Foods", "-", " ", None]) == ["Amy's Foods", None, None, None]
    assert values(spark, text.currency, ["$1,234.50", " ", "abc", "1d", "-5", None]) == [1234.5, None, None, None, -5.0, None]


def test_keyword_patterns(spark):
    for word, name, hit in (("Berry", "MIXED BERRIES", True), ("Tomato", "TOMATOES", True), ("Grape", "GRAPES RED", True), ("Pea", "PEANUT", False), ("Egg (hen)", "EGG (HEN)", False)):
        assert bool(re.search(values(spark, text.keyword_pattern, [word])[0], name)) is hit


def test_gates_word_groups(spark):
    a = values(spark, gates.signature, ["FRYER OR FOWL", "PEAR *OR*", "MILK GAL", "MILK HGL", "GALA APPLE", "TEA DECAF", "POTATO A", "PLUM A", "X (H)", "X"])
    assert a[0] == a[9] and a[1] != a[0] and a[2] != a[3] and a[4] == a[9] and a[5] != a[9] and a[6] != a[9] and a[7] == a[9] and a[8] != a[9]
