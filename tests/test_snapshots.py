"""Versions of several tables: whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from provender.operators import resolve
from provender.sources import snapshots


def files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names)


def test_versions_and_tables_that_stay(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshots.versions(spark, root) == []
    assert snapshots.commit(spark, root, {"a": spark.range(3), "b": spark.range(5)}) == 1
    assert snapshots.commit(spark, root, {"a": snapshots.read(spark, root, "a").where("id > 0")}) == 2
    assert [snapshots.read(spark, root, t).count() for t in ("a", "b")] == [2, 5]
    assert snapshots.read(spark, root, "a", version=1).count() == 3
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "a", version=7)


def test_a_failed_write_and_a_dry_run_leave_the_old_version(spark, tmp_path):
    root = str(tmp_path / "s")
    snapshots.commit(spark, root, {"a": spark.range(3), "b": spark.range(5)})
    bad = spark.range(4).withColumn("x", F.expr("assert_true(id < 2)"))
    with pytest.raises(Exception):
        snapshots.commit(spark, root, {"a": spark.range(9), "b": bad})
    assert snapshots.versions(spark, root) == [1]
    assert [snapshots.read(spark, root, t).count() for t in ("a", "b")] == [3, 5]
    before = files(root)
    assert snapshots.commit(spark, root, {"a": spark.range(9)}, dry_run=True) == {"a": 9}
    assert files(root) == before


def test_a_second_writer_of_one_version_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    snapshots.commit(spark, root, {"a": spark.range(3)})
    monkeypatch.setattr(snapshots, "versions", lambda *_: [])
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"a": spark.range(4)})
    monkeypatch.undo()
    assert snapshots.versions(spark, root) == [1] and snapshots.read(spark, root, "a").count() == 3


CERTS = [(1, "USDA Organic (incl. CCOF)", "N/A", "AASHE STARS;Practice Greenhealth")]


def tables(spark):
    products = [
        (1, "Item", "c", "Academic", None, "Y", 0, "Y", 2020, 2020), (2, "Item", "c", "Academic", "Made Up Claim XYZ", "Y", 1, "N", 2019, 2021),
        (3, "Kept text", "c", "Academic", "Organic", "NA", 0, "NA", 2020, 2020), (4, "Kept text", "c", "Academic", "Made Up Claim XYZ", "Y", 1, "N", 2020, 2020),
        (5, "No text", "c", "Health", None, "N", 0, "N", 2020, 2020), (6, "No text", "c", "Health", None, "Y", 0, "Y", 2020, 2020),
        (7, "Late claim", "c", "Academic", None, "NA", 0, "NA", 2020, 2020), (8, "Late claim", "c", "Academic", "Organic", "NA", 0, "NA", 2020, 2020), (9, "Late claim", "c", "Academic", None, "Y", 0, "Y", 2020, 2020),
        (10, "Alone", None, "Academic", "", "NA", 0, "NA", 2020, 2020),
    ]
    bought = [(1, "A", 2020, "v", None, 10.0, None, "unresolved", 1), (2, "A", 2020, "v", "b", 5.0, 2.0, "computed_tier2", 2), (2, "A", 2021, "v", "b", 7.0, None, "unresolved", 3), (10, "B", 2020, None, None, 1.0, None, "unresolved", 4)]
    return {
        "products": spark.createDataFrame(products, "id long, name string, category string, campus_type string, certs string, sustainable_yn string, flag int, validated string, first_fy int, last_fy int"),
        "aliases": spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "z", 10)], "campus string, raw_name string, product_id long"),
        "purchases": spark.createDataFrame(bought, "product_id long, campus string, fiscal_year int, vendor string, brand string, total_price double, total_weight_lbs double, weight_source string, ord int"),
        "candidates": spark.createDataFrame([(1, 1, 2, "pending"), (2, 2, 10, "pending"), (3, 1, 2, "approved")], "candidate_id long, a long, b long, status string"),
    }


MERGES = [(2, 1), (4, 3), (6, 5), (8, 7), (9, 7)]


def test_a_merge_is_one_commit(spark, tmp_path):
    root = str(tmp_path / "s")
    snapshots.commit(spark, root, tables(spark))
    now = {t: snapshots.read(spark, root, t) for t in tables(spark)}
    merges = spark.createDataFrame(MERGES, "id long, keep long")
    certs = spark.createDataFrame(CERTS, "ord int, certification_name string, abbreviation string, frameworks string")
    snapshots.commit(spark, root, resolve.apply_merges(now, merges, certs, ["ord"]))
    rows = {r.id: r for r in snapshots.read(spark, root, "products").collect()}
    assert sorted(rows) == [1, 3, 5, 7, 10]
    claim = lambda i: (rows[i].certs, rows[i].sustainable_yn, rows[i].flag, rows[i].validated)
    assert claim(1) == ("Made Up Claim XYZ", "Y", 1, "N")  # another's text: judged anew
    assert claim(3) == ("Organic", "Y", 0, "NA")  # its own text: its own flag and validated claim
    assert claim(5) == (None, "N", 0, "N")
    assert claim(7) == ("Organic", "Y", 0, "NA")  # judged when the text came, before the later claim
    assert (rows[1].first_fy, rows[1].last_fy, rows[1].n_members) == (2019, 2021, 2)
    assert sorted(tuple(r) for r in snapshots.read(spark, root, "aliases").collect()) == [("A", "x", 1), ("A", "y", 1), ("B", "z", 10)]
    bought = {(r.product_id, r.campus, r.fiscal_year): r for r in snapshots.read(spark, root, "purchases").collect()}
    assert sorted(bought) == [(1, "A", 2020), (1, "A", 2021), (10, "B", 2020)]
    assert (bought[1, "A", 2020].total_price, bought[1, "A", 2020].total_weight_lbs, bought[1, "A", 2020].weight_source) == (15.0, 2.0, "computed_tier2")
    assert sorted((r.candidate_id, r.a, r.b) for r in snapshots.read(spark, root, "candidates").collect()) == [(2, 1, 10), (3, 1, 1)]
    assert snapshots.read(spark, root, "products", version=1).count() == 10


def test_bridge_of_campuses(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    aliases = spark.createDataFrame([(1, "Y"), (1, "X"), (1, "X"), (2, "Y"), (4, "X")], "product_id long, campus string")
    campuses = spark.createDataFrame([("X", "Academic"), ("Y", "Health")], "campus string, campus_type string")
    bought = spark.createDataFrame([(1, "X", "Second Inc", 2), (1, "X", "First, Inc.", 1), (1, "Y", "Other", 0)], "product_id long, campus string, vendor string, ord int")
    got = sorted((r.id, r.campus, r.campus_type, r.vendor_key) for r in resolve.campus_bridge(products, aliases, campuses, bought, ["ord"]).collect())
    assert got == [(1, "X", "Academic", "first"), (2, "Y", "Health", None)]
