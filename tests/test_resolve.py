"""Entity resolution, search, certification and streaming on small fixtures."""

from pyspark.sql import functions as F

from provender.operators import classify, resolve, search
from provender.sources import csv
from provender.streaming import incremental


def entities(spark, rows):
    return resolve.prepared(spark.createDataFrame(rows, "id long, name string, vendor_key string, campus string, campus_type string"))


def test_match_merges_reviews_and_leaves_null_vendors(spark):
    rows = [(1, "ORGANIC WHOLE MILK", "v", "A", "Academic"), (2, "WHOLE MILK ORGANIC (SUS)", "v", "A", "Academic"), (3, "ORGANIC WHOLE MILKS", "v", "A", "Academic"), (4, "ORGANIC WHOLE MILK 5 LB", "v", "A", "Academic"), (5, "ORGANIC WHOLE MILK", None, "A", "Academic"), (6, "ORGANIC WHOLE MILK", "w", "A", "Academic")]
    merges, review = resolve.match(entities(spark, rows), ["vendor_key"])
    assert [tuple(r) for r in merges.collect()] == [(2, 1)]
    assert [(r.a, r.b) for r in review.collect()] == [(1, 3)]
    known = spark.createDataFrame([(1, 3)], "a long, b long")
    assert resolve.match(entities(spark, rows), ["vendor_key"], known)[1].collect() == []


def test_sure_pairs_need_one_campus_type(spark):
    rows = [(1, "OATS ROLLED", "v", "A", "Academic"), (2, "OATS ROLLED", "v", "B", "Health"), (3, "OATS ROLLED", "v", "C", "Academic"), (4, "OATS ROLLED", "v", "B", "Health")]
    merges, review = resolve.match(entities(spark, rows), ["vendor_key"], apart=True, sure=F.col("type_a") == F.col("type_b"))
    assert [tuple(r) for r in merges.collect()] == [(3, 1)] and [(r.a, r.b) for r in review.collect()] == [(1, 2)]


def test_copies_that_do_not_merge_are_candidates_each(spark):
    rows = [(1, "OATS ROLLED", "v", "A", "Academic"), (2, "OATS ROLLED", "v", "B", "Health"), (3, "OATS ROLLED", "v", "A", "Academic"), (4, "OATS ROLLED", "v", "B", "Health")]
    df = entities(spark, rows).withColumns({"sustainable_yn": F.lit("Y"), "category": F.lit("c")})
    merges, review = resolve.match_cross(df)
    assert merges.collect() == [] and sorted((r.a, r.b) for r in review.collect()) == [(1, 2), (1, 4), (2, 3), (3, 4)]
    known = spark.createDataFrame([(1, 4)], "a long, b long")
    assert sorted((r.a, r.b) for r in resolve.match_cross(df, known)[1].collect()) == [(1, 2), (2, 3), (3, 4)]


def test_copies_of_one_campus_merge_across_only_through_another(spark):
    rows = [(1, "OATS ROLLED", "v", "A", "Academic"), (2, "OATS ROLLED", "v", "A", "Academic"), (3, "OATS ROLLED", "w", "A", "Academic"), (4, "OATS ROLLED", "w", "A", "Academic"), (5, "OATS ROLLED", "w", "B", "Academic")]
    merges, _ = resolve.match(entities(spark, rows), ["vendor_key"], apart=True, sure=F.col("type_a") == F.col("type_b"))
    assert sorted(tuple(r) for r in merges.collect()) == [(4, 3), (5, 3)]


def test_very_many_copies_stay_linear(spark):
    rows = spark.range(1, 100_001).select("id", F.lit("OATS ROLLED").alias("name"), F.lit("v").alias("vendor_key"), F.lit("A").alias("campus"), F.lit("Academic").alias("campus_type"), F.lit("Y").alias("sustainable_yn"), F.lit("c").alias("category"))
    merges, review = resolve.match_all(resolve.prepared(rows))
    assert merges.count() == 99_999 and merges.where("keep <> 1").count() == 0 and review.count() == 0


def test_rematch_stays_within_its_scope(spark):
    rows = [(1, "OATS ROLLED", "v", "A", "Academic"), (2, "OATS ROLLED", "v", "B", "Academic"), (3, "OATS ROLLED", "v", "C", "Health"), (9, "OATS ROLLED", "v", "A", "Academic")]
    df = entities(spark, rows).withColumn("sustainable_yn", F.lit("Y"))
    merges, review = resolve.rematch(df, spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert [tuple(r) for r in merges.collect()] == [(2, 1)] and [(r.a, r.b) for r in review.collect()] == [(1, 3)]


def test_brand_candidates_without_a_cross_join(spark):
    import itertools

    from provender.functions import similarity

    values = ["Sun Foods", "Sun Foods Inc", "Sunkist", "Sunkists", "Sunkits", "X", "X Farms", "Y", "O'Neil", "O Neil", "ab", "abc", "-", "Sunny Hill Farms", "Sunny Hill Farm", "Farms"]
    got = {(r.raw_brand, r.proposed_canonical) for r in search.brand_candidates(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    clean = lambda v: "".join(c if c.isalnum() or c == "_" else " " for c in v).strip().lower()
    want = set()
    for v in values:
        near = sorted((-similarity.set_ratio(clean(v), clean(y)), y) for y in values)[:5]
        for s, y in near:
            if y != v and -s >= 90:
                long, short = (y, v) if len(v) <= len(y) else (v, y)
                if short.lower() in long.lower():
                    want.add((long, short))
    assert got == want and len(want) >= 4
    for a, b in itertools.product(["", "a", "sun ab", "x" * 70, "the " * 40], repeat=2):
        assert similarity.lcs_many([a], [b])[0] == similarity.lcs(a, b)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)]
    for few in (500_000, 0):  # by one task, and by labels that fall along edges
        got = {r.id: r.root for r in resolve.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}}
    assert resolve.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_without_references(spark):
    c = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 4, 5)], "candidate_id long, a long, b long")
    kept, gone = resolve.without_references(c, spark.createDataFrame([(2,)], "id long"))
    assert [r.candidate_id for r in kept.collect()] == [3] and sorted(r.candidate_id for r in gone.collect()) == [1, 2]


def test_uploads_and_gates(spark):
    corpus = spark.createDataFrame([(1, "ONION RED JUMBO 5-LB", 10), (2, "ORGANIC WHOLE MILK HALF GALLON", 11), (3, "RICE BROWN", 12)], "ord long, name string, product_id long")
    ups = spark.createDataFrame([(1, "ONION RED JUMBO 25-LB"), (2, "ORGANIC WHOLE MILK GALLON"), (3, "BROWN RICE"), (4, "ZZZ")], "upload_id long, name string")
    got = {r.upload_id: (r.product_id, r.tier) for r in search.match_uploads(ups, corpus).collect()}
    assert got == {1: (None, "none"), 2: (11, "review"), 3: (12, "confident"), 4: (None, "none")}


def test_certifications(spark):
    certs = spark.createDataFrame([(1, "USDA Organic (incl. CCOF)", "USDA", "AASHE STARS; Practice Greenhealth"), (2, "Fair Trade Certifications", "FT", "AASHE STARS"), (3, "Fairtrade International", None, "Practice Greenhealth")], "ord int, certification_name string, abbreviation string, frameworks string")
    claims = spark.createDataFrame([("Organic", "Health"), ("Fair Trade", "Academic"), ("fair trade", "Health"), ("FT", "Health"), ("Organic; nonsense", "Academic"), (" ", "Health"), (None, "Health"), ("usda", "Academic")], "text string, campus_type string")
    got = {(r.text, r.campus_type): r.flag for r in classify.certification_flags(claims, certs).collect()}
    assert got == {("Organic", "Health"): 0, ("Fair Trade", "Academic"): 0, ("fair trade", "Health"): 0, ("FT", "Health"): 1, ("Organic; nonsense", "Academic"): 1, (" ", "Health"): 0, (None, "Health"): 0, ("usda", "Academic"): 0}


def test_keyword_ties(spark):
    words = spark.createDataFrame([(1, "Buffalo", "Beef"), (2, "Chicken", "Poultry"), (3, "APPLE", "Fruits"), (4, "Apple", "Apples")], "ord int, keyword string, category string")
    names = spark.createDataFrame([("CHICKEN BREAST BUFFALO BITES",), ("APPLES GALA",), (None,)], "name string")
    assert {r.name: r.category for r in classify.keyword_match(names, words).collect()} == {"CHICKEN BREAST BUFFALO BITES": "Poultry", "APPLES GALA": "Fruits"}


def test_reference_loaders(spark, tmp_path):
    (tmp_path / "c.csv").write_text("certification_name,abbreviation,frameworks,qualifier,needs_review\nA,N/A,X; Y,,True\nB,BB,X,,False\n")
    got = csv.load_certifications(csv.read_text_csv(spark, str(tmp_path / "c.csv"))).orderBy("ord").collect()
    assert [(r.certification_name, r.abbreviation, r.needs_review) for r in got] == [("A", None, 1), ("B", "BB", 0)]


def test_stream_in_parts_equals_batch(spark, tmp_path):
    rows = [("c", f"n{i % 5}", float(i), None if i % 3 else 1.5, "reported" if i % 2 else "computed_tier2") for i in range(40)]
    schema = "campus string, raw_name string, total_price double, total_weight_lbs double, weight_source string"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.run_available(incremental.raw_name_totals(incremental.purchase_stream(spark, src, schema), ["campus"]), out, ck)
    want = incremental.raw_name_totals(spark.createDataFrame(rows, schema), ["campus"])
    key = lambda r: r.raw_name
    assert sorted(spark.read.parquet(out).select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_uploads_against_all_rows_but_their_own(spark):
    """The registered query's way, against plain loops over all rows."""
    import random

    from provender.functions import similarity
    from provender.operators import resolve as r

    rnd = random.Random(9)
    words = ["MILK", "WHOLE", "RICE", "BROWN", "ONION", "RED", "5-LB", "25-LB", "ORGANIC", "JUMBO", "OATS"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(2, 7)))) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "product_id long, name string")
    ups = df.where("product_id % 20 = 0").select(F.col("product_id").alias("upload_id"), "name")
    got = {x.upload_id: (x.product_id, x.tier) for x in search.match_uploads(ups, df.withColumn("ord", F.col("product_id")), skip_own=True).collect()}
    gate = {x.id: str(x["_gate"]) for x in r.prepared(df.withColumnRenamed("product_id", "id")).collect()}
    clean = lambda v: "".join(c if c.isalnum() or c == "_" else " " for c in v).strip().lower()
    for i, name in rows:
        if i % 20 == 0:
            best = sorted((-similarity.sort_ratio(clean(name), clean(other)), j) for j, other in rows)[:11]
            hit = next(((j, -s) for s, j in best if j != i and -s >= 90 and gate[j] == gate[i]), None)
            assert got[i] == ((hit[0], "confident" if hit[1] >= 97 else "review") if hit else (None, "none"))


def test_a_name_is_prepared_once_and_by_several_tasks(spark):
    """Names of one file came to one task, and were prepared anew for each use."""
    rows = spark.range(1, 4001).selectExpr("id", "if(id = 9, null, concat('OATS ROLLED ', id % 200, ' LB')) as name").coalesce(1)
    made = resolve.prepared(rows)
    assert made.count() == 4000 and "rlike" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    plain = rows.select("id", resolve.text.sorted_tokens(resolve.text.process(resolve.text.clean_name(F.col("name")))).alias("_text"), resolve.gates.signature(F.col("name")).alias("_gate"))
    assert sorted(map(str, made.select("id", "_text", "_gate").collect())) == sorted(map(str, plain.collect()))


def test_only_nodes_are_put_together(spark, monkeypatch):
    """A row a copy went through the components; now a node of copies is one."""
    seen = []
    whole = resolve.components
    monkeypatch.setattr(resolve, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    names = "array('OATS ROLLED', 'ROLLED OATS', 'RICE')[id % 3]"
    rows = spark.range(3000).selectExpr("id", f"{names} as name", "'v' as vendor_key", "'A' as campus", "'Academic' as campus_type", "'Y' as sustainable_yn", "'c' as category")
    merges, _ = resolve.match_within(resolve.prepared(rows))
    assert seen == [0] and {(r.keep, r["count"]) for r in merges.groupBy("keep").count().collect()} == {(0, 1999), (2, 999)}


def test_campuses_that_buy_are_the_aliases(spark):
    products = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    campuses = spark.createDataFrame([("A", "Academic"), ("B", "Health")], "campus string, campus_type string")
    bought = spark.createDataFrame([(1, "B", "late", 1), (1, "A", None, 5), (1, "A", "ACME, Inc.", 6), (2, "B", "Foo  Corp.", 2), (2, "B", "Bar", 3)], "product_id long, campus string, vendor string, ord int")
    aliases = bought.select("product_id", "campus").distinct()
    got = [sorted(map(tuple, resolve.campus_bridge(products, a, campuses, bought, ["ord"]).select("id", "campus", "campus_type", "vendor_key").collect())) for a in (aliases, None)]
    assert got[0] == got[1] == [(1, "A", "Academic", None), (2, "B", "Health", "foo")]


def test_products_of_a_row_are_not_repeated(spark):
    """A row for each of twelve products came through the driver, as if the table was as small as that of the parts."""
    from provender.plans import matching

    products = spark.createDataFrame([(0, "x"), (1, "y")], "id long, name string")
    campuses = spark.createDataFrame([("A", "Academic"), ("B", "Health")], "campus string, campus_type string")
    bought = spark.createDataFrame([(3, "B", "v", 1), (5, "A", "w", 2), (5, "B", "v", 1), (14, "A", "u", 3), (30, "A", "u", 4)], "product_id long, campus string, vendor string, ord int")
    got = resolve.campus_bridge(products, None, campuses, bought, ["ord"], of=F.expr("id div 12"))
    assert sorted(map(tuple, got.select("id", "name", "campus", "vendor_key").collect())) == [(3, "x", "B", "v"), (5, "x", "A", "w"), (14, "y", "A", "u")]
    plan = matching.campus_bridge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
