"""Loaders over small exports in the layouts of the sources."""

import pytest
from pyspark.sql import functions as F

from provender.operators import ingest
from provender.operators.ingest import Dictionaries
from provender.sources import csv

D = Dictionaries(
    patterns={"gal_density": [("MILK", 8.6), ("OIL", 7.7), ("SYRUP", 11.0)], "kikkasushi": [("SPRING ROLL", 0.4), ("ROLL", 0.5)], "benjerrys": [("PT ", 1.0)], "sysco_number10_can": [("TOMATO", 6.5)], "citybaking": [("BAGEL", 0.25)], "espostos": [("TAMALE", 0.3)]},
    titles={"bordenaves": [("Sweet Roll Dz", 0.1)], "bimbobakery": [("Bun", 0.2)], "sysco_cross_campus": [("MYSTERY BOX", 11.0)]},
    counts={"count_based_food": [("APPLE", 40.0, "case"), ("ROMAINE", 1.5, "multiply")], "sysco_ct_food": [("TORTILLA", 0.1, "multiply")], "ucr_count_food": [("BUN", 0.1, "multiply"), ("MELON", 38.0, "case")]},
)


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def berkeley(spark, rows):
    cols = ["Distributor", "Product Name or Description ", "Brand", "Pack size", " Extended Price ", " Quantity sold ", "AASHE?", "Certification", "Cert"]
    made = [dict(zip(["Distributor", "Product Name or Description ", "Pack size", " Quantity sold "], r)) | {" Extended Price ": "$1,000.50", "AASHE?": "Yes", "Certification": "x", "Cert": " Organic "} for r in rows]
    return [(r.total_weight_lbs, r.weight_source) for r in ingest.berkeley(frame(spark, made, cols), D).collect()]


def near(got, want):
    assert len(got) == len(want)
    for (w, s), (x, y) in zip(got, want):
        assert s == y and (w is None) == (x is None) and (w is None or w == pytest.approx(x)), (got, want)


def test_berkeley_rules_in_order(spark):
    rows = [("Any", "X", None, "12.000 LB"), ("Any", "X", None, "16 oz"), ("Any", "X", None, "2 kg"), ("Sysco", "X", "5 2 LB", "3"), ("Sysco", "X", "8-10#", "2"), ("Allen Brothers", "X", None, "1,200"), ("Peets", "COFFEE 6/5LB", None, "2"), ("Bordanaves", "Sweet Roll Dz", "dz", "10"), ("Ben & Jerry's", "BJ CUP 4oz", "12 units", "2"), ("Ben & Jerry's", "BJ PT Cherry", "8 units", "2"), ("Kikka Sushi", "SPRING ROLL", None, "10"), ("Bimbo Bakery", "Bun", "6Ct", "2"), ("Espostos", "TAMALE", None, "5"), ("City Baking", "BAGEL", "12", "2"), ("Sysco", "TOMATO DICED", "#10", "6"), ("Sysco", "OIL CORN", "5 GAL", "2"), ("Sysco", "OIL SOAP", "5 GAL", "2"), ("Daylight Foods", "MILK 4/1-GAL", None, "2"), ("Sysco", "ROMAINE HEART", "12 CT", "2"), ("Sysco", "TORTILLA", "1 CT", "2"), ("Sysco", "CHIP 2oz", "24 CT", "1"), ("Daylight Foods", "APPLE 64-88 CT", None, "2"), ("Nobody", "Y", None, "7")]
    want = [(12, "reported"), (1, "reported"), (4.40924, "reported"), (30, "computed_tier2"), (18, "computed_tier2"), (1200, "computed_tier2"), (60, "computed_tier2"), (12, "reference_table_tier3"), (6, "computed_tier2"), (16, "reference_table_tier3"), (4, "reference_table_tier3"), (2.4, "reference_table_tier3"), (1.5, "reference_table_tier3"), (6, "reference_table_tier3"), (39, "reference_table_tier3"), (77, "reference_table_tier3"), (None, "unresolved"), (68.8, "reference_table_tier3"), (36, "reference_table_tier3"), (None, "unresolved"), (3, "computed_tier2"), (80, "reference_table_tier3"), (None, "unresolved")]
    near(berkeley(spark, rows), want)


def test_berkeley_other_columns_and_price_fix(spark):
    cols = ["Distributor", "Product Name or Description ", "Brand", "Pack size", " Extended Price ", " Quantity sold ", "AASHE?", "Certification", "Cert"]
    rows = [dict(zip(cols, ["Kikka Sushi", " GARDEN VEGETABLE SALAD ROLL ", " ", None, " $93,779.78 ", "1", "No", "Vegan", "Fair Trade"])), dict(zip(cols, ["V", "NA", "B ", None, "", None, None, None, None]))]
    a, b = ingest.berkeley(frame(spark, rows, cols), D).collect()
    assert (a.raw_name, a.brand, a.total_price, a.sustainable_yn, a.sustainability_certifications) == ("GARDEN VEGETABLE SALAD ROLL", None, 9379.78, "N", "Fair Trade")
    assert (b.raw_name, b.brand, b.total_price, b.sustainable_yn, b.sustainability_certifications) == (None, "B", None, "NA", None)


def riverside(spark, rows):
    cols = ["Item", "Name", "Purchase Unit", "Units", " Total Spend ", "Vendor", "Sustainability"]
    made = [dict(zip(["Name", "Purchase Unit", "Units", " Total Spend ", "Vendor"], r)) | {"Item": "1", "Sustainability": None} for r in rows]
    return [(r.total_weight_lbs, r.weight_source) for r in ingest.riverside(frame(spark, made, cols), D).collect()]


def test_riverside_rules(spark):
    rows = [("X", "20#CS", "2", "1", "V"), ("X", "LB", "7", "1", "V"), ("X", "10 LB", "3", "1", "V"), ("CHICKEN 4/10# AVG", "CASE", "2", "1", "V"), ("BEEF 5LB", "4/CS", "2", "1", "V"), ("SAUCE 8 OZ", "EACH", "4", "1", "V"), ("SNACK 8 OZ", "24/CS", "2", "10", "V"), ("SNACK 8 OZ", "24/CS", "2", "1000", "V"), ("LE CHEF TART 8 OZ", "TRY", "1", "5", "V"), ("MILK WHOLE", "2/1GAL", "3", "1", "V"), ("OIL CORN 6/1GAL", "6/CS", "1", "1", "V"), ("SYRUP 4/750 ML", "CASE", "2", "1", "V"), ("SYRUP BIB 5 G", "EACH", "1", "1", "V"), ("SPICE 500G", "6/CS", "1", "1", "V"), ("TOMATO 6/#10", "CASE", "2", "1", "V"), ("MYSTERY BOX", "CASE", "2", "1", "Sysco"), ("BUN BRIOCHE 18CT", "12/CS", "1", "1", "V"), ("BUN PLAIN", "CS24", "1", "10", "V"), ("BUN PLAIN", "CS24", "1", "1000", "V"), ("MELON", "CASE", "2", "1", "V"), ("EGG LARGE 15DZ", "CASE", "94", "1", "V"), ("NOTHING", "CASE", "1", "1", "V"), ("X", "DOLR", "1", "1", "V"), ("GALA", "LB", None, "1", "V")]
    c, r3 = "computed_tier2", "reference_table_tier3"
    want = [(40, c), (7, "reported"), (30, c), (80, c), (40, c), (2, c), (24, c), (None, "unresolved"), (3, c), (8.6 * 6, r3), (7.7 * 6, r3), (11 * 3000 * 0.001 / 3.78541 * 2, r3), (55, r3), (500 * 6 * 0.00220462, c), (6.5 * 6 * 2, r3), (22, r3), (0.1 * 18 * 12, r3), (2.4, r3), (None, "unresolved"), (76, r3), (0.125 * 180 * 94, r3), (None, "unresolved"), (None, "reported")]
    near(riverside(spark, rows), want)


def test_davis_and_health(spark):
    cols = ["Name", "Distributor Name (delivering entity)", "Brand Name (if different from Column F)", "Total Spend", "Item Weight (e.g.5)", "Pack Size (e.g.4)", "Total Quantity Purchased", "Item UOM (e.g.LB)", "STARS Certification", "Sustainable Farming", "Sustainable Agriculture", "Humane Animal Care", "Sustainable Seafood", "Fair Trade / Labor"]
    rows = [["A", "V", "B", "10", "2", "5", "3", "CS", "No", None, None, None, None, None], ["B", "V", None, "1", "5", "5", "10", " lb ", None, "x", "Organic", "vegan", None, "FT"]]
    got = ingest.davis(frame(spark, [dict(zip(cols, r)) for r in rows], cols), D).collect()
    assert [(r.total_weight_lbs, r.weight_source, r.sustainable_yn, r.sustainability_certifications) for r in got] == [(30, "computed_tier2", "N", None), (10, "reported", "NA", "Organic, FT")]
    cols = ["weight_lb", " total_cost ", "Brand", "supplier", "Name", "env_type_cert"]
    got = ingest.davis_health(frame(spark, [dict(zip(cols, ["0", "1", "b", "s", "n", "C"])), dict(zip(cols, ["-2", "1", "b", "s", "n", " "]))], cols), D).collect()
    assert [(r.total_weight_lbs, r.weight_source, r.sustainable_yn) for r in got] == [(None, "unresolved", "Y"), (-2, "reported", "N")]


def test_junk_line_header_with_line_breaks_and_load_all(spark, tmp_path):
    head = 'STARS 3.0 Cert,Product Description,Cost,"Units\nPurchased",Units,"Unit\nType",Total units ordered,Label/Brand,Vendor'
    (tmp_path / "sc.csv").write_text(f'junk\n{head}\n✅,PROD APPLE GALA,$5,3,1,EA,9,L,V\n❌,PROD ROMAINE,$5,3,24,CT,48,,V\n,"NAPKIN, DINNER",1,,,LB,4,L,V\n,FLOUR,1,,,KG,"1,000",L,V\n')
    raw = csv.read_text_csv(spark, str(tmp_path / "sc.csv"), skip=1)
    food, other = ingest.load_all({"UCSC": raw}, D, {"UCSC": ("Santa Cruz", "Academic")})
    got = [(r.raw_name, r.total_weight_lbs, r.weight_source, r.sustainable_yn) for r in food.orderBy("ord").collect()]
    assert got == [("PROD APPLE GALA", 120.0, "reference_table_tier3", "Y"), ("PROD ROMAINE", 72.0, "reference_table_tier3", "N"), ("FLOUR", 2204.62, "reported", "NA")]
    assert [r.raw_name for r in other.collect()] == ["NAPKIN, DINNER"]
    csv.write_csv(other.select("campus", "raw_name"), str(tmp_path / "removed"), one_file=True)
    assert csv.read_text_csv(spark, str(tmp_path / "removed")).count() == 1


def test_dictionaries_from_files(spark, tmp_path):
    (tmp_path / "kikkasushi_weight_dictionary.csv").write_text("pattern,weight_group_key,assumed_each_weight_lb\nSPRING ROLL,a,0.4\nROLL,b,0.5\n")
    d = csv.load_dictionaries(spark, str(tmp_path), {"kikkasushi"})
    assert d.patterns == {"kikkasushi": [("SPRING ROLL", 0.4), ("ROLL", 0.5)]}
    assert spark.range(1).select(d.by_pattern("kikkasushi", F.lit("a spring rolls")).alias("w"), d.by_title("none", F.lit("x")).alias("t")).first() == (0.4, None)


def test_a_wide_header_below_junk_lines(spark, tmp_path):
    names = [f"col {i}" for i in range(80)]
    names[70] = "two\nlines"
    names[75] = ""
    head = ",".join(f'"{n}"' if "\n" in n else n for n in names)
    for part in ("a", "b"):
        (tmp_path / f"{part}.csv").write_text(f"junk,1\nmore junk\n{head}\n" + "".join(",".join(f"{part}{r}-{i}" for i in range(80)) + "\n" for r in range(3)))
    got = csv.read_text_csv(spark, str(tmp_path), skip=2)
    names[75] = "_c75"
    assert got.columns == [*names, "ord"] and got.count() == 6
    assert {r["col 79"] for r in got.collect()} == {f"{p}{r}-79" for p in "ab" for r in range(3)}


def test_optional_lookup_keywords_and_load_all(spark, tmp_path):
    (tmp_path / "sysco_cross_campus_case_weight_lookup.csv").write_text("title,assumed_each_weight_lb\nBeef Patty,3.5\n")
    d = csv.load_dictionaries(spark, str(tmp_path), {"sysco_cross_campus"})
    assert spark.range(1).select(d.by_title("sysco_cross_campus", F.lit("BEEF PATTY")).alias("w")).first().w == 3.5
    (tmp_path / "k.csv").write_text("keyword,category\n Milk ,Dairy\n,x\nOat,Grain\n")
    assert [tuple(r)[1:] for r in csv.load_keywords(csv.read_text_csv(spark, str(tmp_path / "k.csv"))).orderBy("ord").collect()] == [("Milk", "Dairy"), ("Oat", "Grain")]
    (tmp_path / "campuses.csv").write_text("Campus,Primary_standard,Campus_type,abbreviation\nA,S,Academic,AA\nB,S,Health,BB\n")
    (tmp_path / "certification_types.csv").write_text("certification_name,abbreviation,frameworks,qualifier,needs_review\nC,,F,,TRUE\n")
    (tmp_path / "simap_categories.csv").write_text("Meat type,Food Category,C_footprint_kg_C_per_kg_food,C footprint local (kg eCO2 / kg food),Nitrogen Content,Conventional virtual N factor (kg N loss / kg N food),Food waste\nBeef,Beef,1,2,3,4,5\n")
    (tmp_path / "food_groups.csv").write_text("simap_category,food_group\nBeef,Meat\nMilk,Dairy\n")
    want = {"campuses": 2, "certification_types": 1, "taxonomy": 1, "food_groups": 2}
    assert csv.load_all(spark, str(tmp_path), str(tmp_path / "out")) == want == csv.load_all(spark, str(tmp_path), str(tmp_path / "out"))


def test_a_folder_with_all_files_loads_the_shared_lookup_by_default(spark, tmp_path):
    each, piece = "pattern,assumed_each_weight_lb\nx,1\n", "pattern,reference_weight_lb,formula\nx,1,case\n"
    for name in ("benjerrys", "kikkasushi", "espostos", "citybaking"):
        (tmp_path / f"{name}_weight_dictionary.csv").write_text(each)
    (tmp_path / "sysco_number10_can_dictionary.csv").write_text(each)
    (tmp_path / "gal_density_dictionary.csv").write_text("pattern,density_lb_per_gal\nx,8.3\n")
    for name in ("bordenaves", "bimbobakery"):
        (tmp_path / f"{name}_weight_dictionary_by_title.csv").write_text("title,assumed_each_weight_lb\nBun,0.2\n")
    for name in ("count_based_food", "sysco_ct_food", "ucr_count_food"):
        (tmp_path / f"{name}_dictionary.csv").write_text(piece)
    assert "sysco_cross_campus" not in csv.load_dictionaries(spark, str(tmp_path)).titles
    (tmp_path / "sysco_cross_campus_case_weight_lookup.csv").write_text("title,assumed_each_weight_lb,human_confirmed\nSAUSAGE TURKEY PTY CKD 1.6OZ,10,True\n")
    d = csv.load_dictionaries(spark, str(tmp_path))
    row = "Item,Name,Purchase Unit,Units, Total Spend ,Vendor,VON,Sustainability,Sustainability Link,Plant-Based? Y/N,Cost Category\n1,SAUSAGE TURKEY PTY CKD 1.6OZ,CASE,\"651\",\"28512.30\",Sysco,123,,,,\n"
    (tmp_path / "r.csv").write_text(row)
    got = ingest.riverside(csv.read_text_csv(spark, str(tmp_path / "r.csv")), d).first()
    assert (got.total_weight_lbs, got.weight_source) == (6510.0, "reference_table_tier3")


def test_exports_of_parts_are_dealt_to_all_tasks(spark, tmp_path):
    """One file of parts was one task, with all cases and rules in it."""
    from provender.plans import loading

    spark.createDataFrame([(i, "old gear", i % 50) for i in range(100)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for query, n in ((loading.load_vendor_rules, 100), (loading.load_purchase_units, 96)):
        made = query(spark, str(tmp_path))
        assert made.count() == n and made.rdd.getNumPartitions() == 4
