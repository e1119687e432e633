"""Queries of the seven loaders. Exports in each layout are made from the parts, one worked case after the other by part key;
the SQL reads the same exports and states the rules, the words and the dictionaries' values by itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.operators import ingest
from provender.operators.ingest import Dictionaries
from provender.plans.base import query
from provender.sources.star import table

#: The dictionaries of these queries. Their values stand in the SQL once more.
BOOKS = Dictionaries(
    patterns={"gal_density": [("MILK", 8.6), ("OIL", 7.7), ("SYRUP", 11.0)], "kikkasushi": [("SPRING ROLL", 0.4), ("ROLL", 0.5)], "benjerrys": [("PT ", 1.0)], "sysco_number10_can": [("TOMATO", 6.5), ("CONE CAKE", 3.0)], "citybaking": [("BAGEL", 0.25)], "espostos": [("TAMALE", 0.3)]},
    titles={"bordenaves": [("Sweet Roll", 0.1), ("Dinner Roll 6-pk", 0.2)], "bimbobakery": [("Bun", 0.2)], "sysco_cross_campus": [("MYSTERY BOX", 11.0)]},
    counts={"count_based_food": [("APPLE", 40.0, "case"), ("ROMAINE", 1.5, "multiply")], "sysco_ct_food": [("TORTILLA", 0.1, "multiply")], "ucr_count_food": [("BUN", 0.1, "multiply"), ("MELON", 38.0, "case")]},
)


class Layout:
    """An export: (SQL name, header) of its columns, and cases, each a text a column where {b}, {s} and {k} stand for a part's
    name, its size and a number from 1 to 7. ``None`` is a missing cell."""

    def __init__(self, columns: list[tuple[str, str]], cases: list[tuple]):
        self.columns, self.cases = columns, cases

    def _pieces(self, text: str) -> list[tuple[bool, str]]:
        return [(i % 2 == 1, x) for i, x in enumerate(re.split(r"\{(\w)\}", text)) if x]

    def frame(self, spark: SparkSession, d: str) -> DataFrame:
        parts = {"b": F.upper("p_name"), "s": F.col("p_size").cast("string"), "k": (F.col("p_partkey") % 7 + 1).cast("string")}

        def cell(i: int) -> Column:
            out = F.lit(None).cast("string")
            for n, case in enumerate(self.cases):
                if case[i] is not None:
                    out = F.when(F.col("p_partkey") % len(self.cases) == n, F.concat(F.lit(""), *(parts[x] if named else F.lit(x) for named, x in self._pieces(case[i])))).otherwise(out)
            return out

        # few files are few tasks, and a row's cases cost as much as its rules
        part = table(spark, d, "part").select("p_partkey", "p_name", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return part.select(F.col("p_partkey").alias("ord"), *(cell(i).alias(header) for i, (_, header) in enumerate(self.columns)))

    def sql(self) -> str:
        parts = {"b": "upper(p_name)", "s": "p_size", "k": "(p_partkey % 7 + 1)"}

        def text(t):
            return "NULL" if t is None else "concat('', " + ", ".join(parts[x] if named else "'" + x.replace("'", "''") + "'" for named, x in self._pieces(t) or [(False, "")]) + ")"

        cells = [f"CAST(CASE p_partkey % {len(self.cases)} " + " ".join(f"WHEN {n} THEN {text(c[i])}" for n, c in enumerate(self.cases)) + f" END AS VARCHAR) AS {name}" for i, (name, _) in enumerate(self.columns)]
        return f"raw AS (SELECT p_partkey AS ord, {', '.join(cells)} FROM part)"


def _result(df: DataFrame) -> DataFrame:
    return df.withColumn("total_weight_lbs", F.round("total_weight_lbs", 6))


def _cascade(rules: list[tuple[str, str]], otherwise: str = "'unresolved'") -> str:
    """Two SQL columns: the weight and the tier of the first rule that gives one."""
    weights = ", ".join(f"({w})" for w, _ in rules)
    tiers = " ".join(f"WHEN ({w}) IS NOT NULL THEN '{t}'" for w, t in rules)
    return f"round(coalesce({weights}), 6) AS total_weight_lbs, CASE {tiers} ELSE {otherwise} END AS weight_source"


def _num(text: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '{pattern}', {group}), '') AS DOUBLE)"


def _plain(text: str) -> str:
    return f"CASE WHEN regexp_matches(trim(replace({text}, ',', '')), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN TRY_CAST(trim(replace({text}, ',', '')) AS DOUBLE) END"


def _money(text: str) -> str:
    return _plain(f"replace({text}, '$', '')")


def _present(text: str) -> str:
    """The cell unless it is missing or a word for missing; trimmed, blank as null."""
    return f"CASE WHEN {text} NOT IN ('NA', 'N/A', 'n/a', '') THEN nullif(trim({text}), '') END"


def _tags(columns: list[str]) -> str:
    kept = ", ".join(f"CASE WHEN lower(trim({c})) NOT IN ('', 'x', 'vegetarian', 'vegan', 'plant-based alternative proteins') THEN trim({c}) END" for c in columns)
    return f"nullif(concat_ws(', ', {kept}), '')"


N = "[0-9]+(?:[.][0-9]+)?"
PIECES = "list_product(list_transform(string_split({}, '/'), lambda v: CAST(trim(v) AS DOUBLE)))"

# the first layout: vendors with rules of their own
BERKELEY = Layout(
    [("vendor", "Distributor"), ("title", "Product Name or Description "), ("brand", "Brand"), ("pack", "Pack size"), ("price", " Extended Price "), ("sold", " Quantity sold "), ("listed", "AASHE?"), ("cert", "Certification"), ("cert2", "Cert")],
    [
        ("Any", "{b} LOOSE", " ", None, " $1,0{k}0.50 ", "{s}.500 LB", "Yes", "x", " Organic "),
        ("Any", "{b} BOX", "B{k} ", None, "{s}", "{s} oz", "No", "Vegan", "Fair Trade"),
        ("Any", "{b} SACK", None, None, "n/a", "{k} kg", None, "MSC", "Organic"),
        ("Any", "{b}", "B", "{s}", "-{k}", "{s} cases", "Maybe", None, None),
        ("Sysco", "{b}", "B", "{s}/{k} LB", "{s}.25", "{k}", "Yes", None, "vegetarian"),
        ("Sysco", "{b}", "B", "{k} 8 oz", "{s}.25", "3", "Yes", None, None),
        ("Pacific Seafood", "FISH {b}", "B", "5-{s}#", "{s}", "2", "Yes", "MSC", None),
        ("Bimbo Bakery", "{b}", "B", "{s}#AVG", "{s}", "{k}", "No", None, None),
        ("Allen Brothers", "BEEF {b}", "B", None, "{s}", "1,2{k}0", "No", None, None),
        ("Cream Co", "BEEF {b}", "B", "9 LB", "{s}", "-{s}", "No", None, None),
        ("Peets", "COFFEE {k}/5LB", "B", None, "{s}", "2", "No", None, None),
        ("JFC", "RICE {s}#", "B", None, "{s}", "{k}", "No", None, None),
        ("Daylight Foods", "BEANS 6/{s} OZ", "B", None, "{s}", "{k}", "No", None, None),
        ("Bordanaves", "Sweet Roll", "B", "dz", "{s}", "{s}", "No", None, None),
        ("Bordanaves", "Sweet Roll", "B", " EA ", "{s}", "{s}", "No", None, None),
        ("Bordanaves", "Dinner Roll 6-pk", "B", "pk", "{s}", "{s}", "No", None, None),
        ("Ben & Jerry's", "BJ CUP {k}oz", "B", "12 units", "{s}", "{s}", "No", None, None),
        ("Ben & Jerry's", "BJ PT Cherry", "B", "{k} units", "{s}", "2", "No", None, None),
        ("Kikka Sushi", "SPRING ROLL {b}", "B", None, "{s}", "{s}", "No", None, None),
        ("Kikka Sushi", "GARDEN VEGETABLE SALAD ROLL", "B", None, " $93,779.78 ", "{s}", "No", None, None),
        ("Bimbo Bakery", "Bun", "B", "{k}Ct", "{s}", "{s}", "No", None, None),
        ("Espostos", "TAMALE {b}", "B", None, "{s}", "{s}", "No", None, None),
        ("City Baking", "BAGEL {b}", "B", " {s} ", "{s}", "2", "No", None, None),
        ("City Baking", "BAGEL {b}", "B", "{s} x", "{s}", "2", "No", None, None),
        ("Sysco", "TOMATO {b}", "B", "#10", "{s}", "{s}", "No", None, None),
        ("Sysco", "OIL {b}", "B", "{k} GAL", "{s}", "{s}", "No", None, None),
        ("Sysco", "OIL SOAP {b}", "B", "{k} GAL", "{s}", "{s}", "No", None, None),
        ("Daylight Foods", "MILK {k}/1-GAL", "B", None, "{s}", "{s}", "No", None, None),
        ("Daylight Foods", "SYRUP 2 1/2 GALLON", "B", None, "{s}", "{s}", "No", None, None),
        ("Sysco", "CHIP {k}oz", "B", "24 CT", "{s}", "{s}", "No", None, None),
        ("Sysco", "ROMAINE {b}", "B", "{s} CT", "{s}", "{k}", "No", None, None),
        ("Sysco", "TORTILLA {b}", "B", "{k} ct", "{s}", "{s}", "No", None, None),
        ("Daylight Foods", "ROMAINE {s}-{k} CT", "B", None, "{s}", "2", "No", None, None),
        ("Daylight Foods", "APPLE 3/{s}-CT", "B", None, "{s}", "2", "No", None, None),
        (None, "NA", "B ", None, "", None, None, None, None),
    ],
)
UNIT_LB = "CASE WHEN upper({0}) IN ('', 'LB', 'LBS', 'POUND', 'POUNDS') THEN 1.0::DOUBLE WHEN upper({0}) = 'OZ' THEN 1.0::DOUBLE / 16 WHEN upper({0}) IN ('KG', 'KGS', 'KILO') THEN 2.20462::DOUBLE WHEN upper({0}) IN ('G', 'GM', 'GMS') THEN 0.00220462::DOUBLE END"
UNITS = "LBS?|POUNDS?|OZ|KGS?|KILO|GMS?|G"


def _pack_lb(p: str) -> str:
    two, span, one = (rf"(?i)^({N})\s*[/ ]\s*({N})\s*({UNITS})\s*(?:AVG?|AV)?$", rf"(?i)^({N})\s*-\s*({N})\s*#?\s*({UNITS})?\s*(?:AVG?|AV)?$", rf"(?i)^({N})\s*(#|{UNITS}|#\s*(?:{UNITS}))\s*(?:AVG?|AV)?$")
    unit = lambda pattern: UNIT_LB.format(f"replace(regexp_extract({p}, '{pattern}', {{0}}), '#', '')")
    value = f"CASE WHEN regexp_matches({p}, '{two}') THEN {_num(p, two, 1)} * {_num(p, two, 2)} * ({unit(two).format(3)}) WHEN regexp_matches({p}, '{span}') THEN ({_num(p, span, 1)} + {_num(p, span, 2)}) / 2 * ({unit(span).format(3)}) WHEN regexp_matches({p}, '{one}') THEN {_num(p, one, 1)} * ({unit(one).format(2)}) END"
    return f"(SELECT CASE WHEN v >= 1 THEN v END FROM (SELECT {value} AS v))"


CHAIN = rf"(?i)((?:{N}\s*/\s*)+{N})\s*-?\s*(LB\b|OZ\b|#)"
BARE = rf"(?i)({N})\s*-?\s*(?:LB\b|#)"
VOL = r"(?:[0-9]+(?:[.][0-9]+)?|[.][0-9]+)"
GAL_MIXED, GAL_CHAIN, GAL_BARE = (rf"(?i){x}\s*-?\s*GAL(?:LONS?)?\b" for x in (r"([0-9]+)[\s-]+([0-9]+)\s*/\s*([0-9]+)", rf"({VOL})\s*/\s*({VOL})", rf"({VOL})"))
CT_CHAIN, CT_RANGE, CT_BARE = (rf"(?i){x}\s*-?\s*CT\b" for x in (r"((?:[0-9]+\s*/\s*)+[0-9]+)", r"([0-9]+)\s*-\s*([0-9]+)", "([0-9]+)"))
#: Columns of what a name says: a weight and its shape, gallons and their shape, a count and its shape, ounces.
NAME_SQL = f"""
  CASE WHEN regexp_matches(title, '{CHAIN}') THEN 'chain' WHEN regexp_matches(title, '{BARE}') THEN 'bare' ELSE 'none' END AS shape,
  CASE WHEN regexp_matches(title, '{CHAIN}') THEN {PIECES.format(f"regexp_extract(title, '{CHAIN}', 1)")} / CASE WHEN upper(regexp_extract(title, '{CHAIN}', 2)) = 'OZ' THEN 16 ELSE 1 END ELSE {_num("title", BARE)} END AS named_lb,
  CASE WHEN regexp_matches(title, '{GAL_CHAIN}') THEN 'chain' WHEN regexp_matches(title, '{GAL_BARE}') THEN 'bare' END AS gal_shape,
  CASE WHEN regexp_matches(title, '{GAL_MIXED}') THEN {_num("title", GAL_MIXED, 1)} + {_num("title", GAL_MIXED, 2)} / {_num("title", GAL_MIXED, 3)} WHEN regexp_matches(title, '{GAL_CHAIN}') THEN {_num("title", GAL_CHAIN, 1)} * {_num("title", GAL_CHAIN, 2)} ELSE {_num("title", GAL_BARE)} END AS gal,
  CASE WHEN regexp_matches(title, '{CT_CHAIN}') THEN 'chain' WHEN regexp_matches(title, '{CT_BARE}') OR regexp_matches(title, '[(][0-9]+[)]') THEN 'one' ELSE 'none' END AS count_shape,
  CASE WHEN regexp_matches(title, '{CT_CHAIN}') THEN {PIECES.format(f"regexp_extract(title, '{CT_CHAIN}', 1)")} WHEN regexp_matches(title, '{CT_RANGE}') THEN ({_num("title", CT_RANGE, 1)} + {_num("title", CT_RANGE, 2)}) / 2 WHEN regexp_matches(title, '{CT_BARE}') THEN {_num("title", CT_BARE)} ELSE {_num("title", "[(]([0-9]+)[)]")} END AS named_count,
  {_num("title", f"(?i)({N})" + r"\s*oz\b")} / 16 AS ounces_lb,
  CASE WHEN NOT regexp_matches(title, '(?i)LINER|SANITIZER|CLEANER|CLEANING|\\bPUMP\\b|SOAP') THEN CASE WHEN title ILIKE '%MILK%' THEN 8.6::DOUBLE WHEN title ILIKE '%OIL%' THEN 7.7::DOUBLE WHEN title ILIKE '%SYRUP%' THEN 11.0::DOUBLE END END AS density,
  CASE WHEN title ILIKE '%TOMATO%' THEN 6.5::DOUBLE WHEN title ILIKE '%CONE CAKE%' THEN 3.0::DOUBLE END AS can_lb"""
_C, _T = "computed_tier2", "reference_table_tier3"
BERKELEY_RULES = [
    ("CASE sold_unit WHEN 'lb' THEN stated WHEN 'oz' THEN stated / 16 WHEN 'kg' THEN stated * 2.20462::DOUBLE END", "reported"),
    (f"CASE WHEN vendor IN ('Sysco', 'Pacific Seafood', 'Bimbo Bakery') THEN {_pack_lb('pack')} * qty END", _C),
    ("CASE WHEN vendor IN ('Allen Brothers', 'Cream Co') THEN qty END", _C),
    ("CASE WHEN vendor IN ('Daylight Foods', 'Peets', 'JFC') AND named_lb >= 1 THEN named_lb * qty END", _C),
    (f"CASE WHEN vendor = 'Bordanaves' THEN CASE title WHEN 'Sweet Roll' THEN 0.1::DOUBLE WHEN 'Dinner Roll 6-pk' THEN 0.2::DOUBLE END * CASE lower(pack) WHEN 'ea' THEN 1 WHEN 'dz' THEN 12 WHEN 'pk' THEN {_num('title', '(?i)([0-9]+)-pk')} END * qty END", _T),
    (f"CASE WHEN vendor LIKE 'Ben & Jerry%' THEN ounces_lb * {_num('pack', '(?i)([0-9]+) units')} * qty END", _C),
    (f"CASE WHEN vendor LIKE 'Ben & Jerry%' AND title LIKE '%PT %' THEN 1.0::DOUBLE * {_num('pack', '(?i)([0-9]+) units')} * qty END", _T),
    ("CASE WHEN vendor = 'Kikka Sushi' THEN CASE WHEN title ILIKE '%SPRING ROLL%' THEN 0.4::DOUBLE WHEN title ILIKE '%ROLL%' THEN 0.5::DOUBLE END * qty END", _T),
    ("CASE WHEN vendor = 'Bimbo Bakery' AND title = 'Bun' THEN 0.2::DOUBLE * pieces * qty END", _T),
    ("CASE WHEN vendor = 'Espostos' AND title ILIKE '%TAMALE%' THEN 0.3::DOUBLE * qty END", _T),
    ("CASE WHEN vendor = 'City Baking' AND title ILIKE '%BAGEL%' THEN 0.25::DOUBLE * TRY_CAST(pack AS INTEGER) * qty END", _T),
    ("CASE WHEN vendor = 'Sysco' AND pack = '#10' THEN can_lb * qty END", _T),
    (f"CASE WHEN vendor = 'Sysco' THEN density * {_num('pack', '(?i)([0-9.]+) GAL')} * qty END", _T),
    ("CASE WHEN vendor = 'Daylight Foods' THEN density * gal * qty END", _T),
    ("CASE WHEN vendor = 'Sysco' AND upper(pack) LIKE '%CT' THEN ounces_lb * pieces * qty END", _C),
    ("CASE WHEN vendor = 'Sysco' AND upper(pack) LIKE '%CT' AND pieces <> 1 THEN CASE WHEN title ILIKE '%APPLE%' THEN 40 WHEN title ILIKE '%ROMAINE%' THEN 1.5::DOUBLE * pieces WHEN title ILIKE '%TORTILLA%' THEN 0.1::DOUBLE * pieces END * qty END", _T),
    ("CASE WHEN vendor = 'Daylight Foods' THEN CASE WHEN title ILIKE '%APPLE%' THEN 40 WHEN title ILIKE '%ROMAINE%' THEN 1.5::DOUBLE * named_count END * qty END", _T),
]


@query(f"""WITH {BERKELEY.sql()}, cells AS (SELECT ord, {_present('vendor')} AS vendor, {_present('title')} AS title, {_present('brand')} AS brand, trim(pack) AS pack, price, listed, cert, cert2, sold FROM raw),
  said AS (SELECT *, {_plain('sold')} AS qty, {_num("replace(sold, ',', '')", '([0-9.]+) *([A-Za-z]+)')} AS stated, lower(regexp_extract(sold, '([0-9.]+) *([A-Za-z]+)', 2)) AS sold_unit, {_num('pack', '(?i)([0-9]+) *ct')} AS pieces, {NAME_SQL} FROM cells)
SELECT ord, title AS raw_name, vendor, brand, CASE WHEN vendor = 'Kikka Sushi' AND title = 'GARDEN VEGETABLE SALAD ROLL' THEN 9379.78::DOUBLE ELSE {_money('price')} END AS total_price, {_cascade(BERKELEY_RULES)},
  CASE trim(listed) WHEN 'Yes' THEN 'Y' WHEN 'No' THEN 'N' ELSE 'NA' END AS sustainable_yn, {_tags(['cert', 'cert2'])} AS sustainability_certifications, 'purchasing' AS purchase_type FROM said""")
def load_vendor_rules(spark, d):
    return _result(ingest.berkeley(BERKELEY.frame(spark, d), BOOKS))


DAVIS = Layout(
    [("title", "Name"), ("vendor", "Distributor Name (delivering entity)"), ("brand", "Brand Name (if different from Column F)"), ("price", "Total Spend"), ("each", "Item Weight (e.g.5)"), ("pack", "Pack Size (e.g.4)"), ("bought", "Total Quantity Purchased"), ("unit", "Item UOM (e.g.LB)"), ("stars", "STARS Certification"), ("c1", "Sustainable Farming"), ("c2", "Sustainable Agriculture"), ("c3", "Humane Animal Care"), ("c4", "Sustainable Seafood"), ("c5", "Fair Trade / Labor")],
    [
        ("{b}", "V{k}", "B", "$1,{k}00.50", "2.5", "{k}", "{s}", "CS", " No ", None, None, None, None, None),
        (" {b} ", "V", " ", "{s}", "5", "5", "1,0{k}0", " lb ", None, "x", "Organic", "vegan", None, "FT"),
        ("{b} BAG", None, "B{k}", "{s}.75", "0.{k}", "{s}", "{k}", None, "STARS", " Organic", None, "Certified Humane", "MSC ", None),
        ("{b}", "V", "B", "-{s}", None, "{k}", "{s}", "EA", "Yes", None, "X", "Vegetarian", None, None),
        ("{b}", "V", "B", "N/A", "n/a", "{k}", "{s}", "LB", "No", None, None, None, None, "Plant-Based Alternative Proteins"),
        (None, "V", "B", "bad", "{s}", "{k}", None, "LB", "Other", None, None, None, None, None),
    ],
)


@query(f"""WITH {DAVIS.sql()}, cells AS (SELECT *, upper(trim(coalesce(unit, ''))) = 'LB' AS pounds, {_plain('bought')} AS qty FROM raw)
SELECT ord, {_present('title')} AS raw_name, vendor, {_present('brand')} AS brand, {_money('price')} AS total_price, round(CASE WHEN pounds THEN qty ELSE ({_plain('each')}) * ({_plain('pack')}) * qty END, 6) AS total_weight_lbs,
  CASE WHEN pounds THEN 'reported' ELSE 'computed_tier2' END AS weight_source, CASE WHEN stars IS NULL THEN 'NA' WHEN trim(stars) = 'No' THEN 'N' ELSE 'Y' END AS sustainable_yn,
  {_tags(['c1', 'c2', 'c3', 'c4', 'c5'])} AS sustainability_certifications, 'purchasing' AS purchase_type FROM cells""")
def load_item_weights(spark, d):
    return _result(ingest.davis(DAVIS.frame(spark, d), BOOKS))


def _health(weight: str, price: str, name: str, vendor: str, brand: str, more: list[tuple[str, str]], cases: list[tuple]) -> Layout:
    return Layout([("lb", weight), ("price", price), ("title", name), ("vendor", vendor), ("brand", brand), *more], cases)


_REPORTED = f"round(nullif({_plain('lb')}, 0), 6) AS total_weight_lbs, CASE WHEN nullif({_plain('lb')}, 0) IS NULL THEN 'unresolved' ELSE 'reported' END AS weight_source"
DAVIS_HEALTH = _health("weight_lb", " total_cost ", "Name", "supplier", "Brand", [("cert", "env_type_cert")], [("0", " $1,{k}00 ", "{b}", "V", "b", "Organic"), ("-{k}", "{s}", " {b}", "V{k}", " ", " "), ("{s}.5", "n/a", "{b}", "V", None, None), ("N/A", "-{s}", "N/A", "V", "b", "MSC "), ("1,{k}00.25", "(12)", "{b}", None, "b", "vegan")])


@query(f"WITH {DAVIS_HEALTH.sql()} SELECT ord, {_present('title')} AS raw_name, vendor, {_present('brand')} AS brand, {_money('price')} AS total_price, {_REPORTED}, CASE WHEN {_present('cert')} IS NULL THEN 'N' ELSE 'Y' END AS sustainable_yn, {_present('cert')} AS sustainability_certifications, 'purchasing' AS purchase_type FROM raw")
def load_reported_by_certificate(spark, d):
    return _result(ingest.davis_health(DAVIS_HEALTH.frame(spark, d), BOOKS))


LA_HEALTH = _health("weight", "total_cost", "notes", "supplier", "brand", [("cert", "env_type_cert"), ("listed", "env_defined_type")], [("0.0", "$1,{k}00", "{b}", "V", "b", "Organic", "Sustainable"), ("-{k}", "{s}", " {b}", "V{k}", " ", " Vegan ", "Conventional"), ("{s}.5", "n/a", "{b}", "V", None, "x", "Other"), ("N/A", "-{s}", "N/A", "V", "b", "Vegetarian", None), ("1,{k}00.25", "12", "{b}", None, "b", "plant-based alternative proteins", " Sustainable ")])


@query(f"""WITH {LA_HEALTH.sql()} SELECT ord, {_present('title')} AS raw_name, vendor, {_present('brand')} AS brand, {_money('price')} AS total_price, {_REPORTED}, CASE trim(listed) WHEN 'Sustainable' THEN 'Y' WHEN 'Conventional' THEN 'N' ELSE 'NA' END AS sustainable_yn,
  CASE WHEN lower(trim(cert)) NOT IN ('vegetarian', 'vegan', 'plant-based alternative proteins') THEN {_present('cert')} END AS sustainability_certifications, 'purchasing' AS purchase_type FROM raw""")
def load_reported_without_diet_tags(spark, d):
    return _result(ingest.los_angeles_health(LA_HEALTH.frame(spark, d), BOOKS))


SD_HEALTH = _health("weight", "total_cost", "ProductName", "Distributor", "Supplier", [("cert", "Certification"), ("listed", "Sustainable?")], [("0", "$1,{k}00", "{b}", " V ", "b", "Organic", "Sustainable"), ("-{k}", "{s}", " {b}", "V{k}", " ", " Vegan ", "Conventional"), ("{s}.5", "n/a", "{b}", " ", None, None, "Other"), ("N/A", "-{s}", "N/A", "V", "b", " ", None)])


@query(f"WITH {SD_HEALTH.sql()} SELECT ord, {_present('title')} AS raw_name, {_present('vendor')} AS vendor, {_present('brand')} AS brand, {_money('price')} AS total_price, {_REPORTED}, CASE listed WHEN 'Sustainable' THEN 'Y' WHEN 'Conventional' THEN 'N' ELSE 'NA' END AS sustainable_yn, {_present('cert')} AS sustainability_certifications, 'purchasing' AS purchase_type FROM raw")
def load_reported_by_claim(spark, d):
    return _result(ingest.san_diego_health(SD_HEALTH.frame(spark, d), BOOKS))


SANTA_CRUZ = Layout(
    [("listed", "STARS 3.0 Cert"), ("title", "Product Description"), ("price", "Cost"), ("bought", "Units\nPurchased"), ("units", "Units"), ("unit", "Unit\nType"), ("total", "Total units ordered"), ("brand", "Label/Brand"), ("vendor", "Vendor")],
    [
        ("✅", "{b}", "$5", "3", "1", "LB", "1,{k}00", "L", "V"), ("❌", "{b}", "{s}", "3", "1", " lbs ", "{s}", " ", "V"), (None, "{b}", "{s}", "3", "1", "LB AVG", "{s}.5", "L", "V{k}"),
        ("?", "{b}", "-{s}", "3", "1", "OZ", "{s}", "L", None), ("✅", "{b}", "{s}", "3", "1", "G", "{s}00", "L", "V"), ("✅", "{b}", "{s}", "3", "1", "GM", "{s}00", "L", "V"), ("✅", "{b}", "{s}", "3", "1", "GR", "{s}00", "L", "V"), ("✅", "{b}", "n/a", "3", "1", "KG", "{s}", "L", "V"),
        (" ✅ ", "PROD APPLE {b}", "{s}", "{k}", "88", "EA", "9", "L", "V"), ("✅", "PROD ROMAINE {b}", "{s}", "{k}", "24", "CT", "{s}", "L", "V"), ("✅", "PROD ROMAINE {b}", "{s}", "{k}", "2{s}0", "CT", "{s}", "L", "V"), ("✅", "PROD ROMAINE approx wt {b}", "{s}", "{k}", "24", "EACH", "{s}", "L", "V"),
        ("✅", "ROMAINE {b}", "{s}", "{k}", "24", "CT", "{s}", "L", "V"), ("✅", "PROD ROMAINE {b}", "{s}", "{k}", "24", "BAG", "{s}", "L", "V"), ("✅", "PROD ROMAINE", "{s}", "{k}", "200", "DOZ", "{s}", "L", "V"), ("❌", "PROD APPLE", "{s}", None, "12", "LOAF", "{s}", "L", "V"),
    ],
)
SANTA_CRUZ_RULES = [
    ("CASE WHEN unit IN ('LB', 'LBS', 'LB AVG') THEN total WHEN unit = 'OZ' THEN total / 16 WHEN unit IN ('G', 'GM', 'GR') THEN total * 0.00220462::DOUBLE WHEN unit = 'KG' THEN total * 2.20462::DOUBLE END", "reported"),
    ("CASE WHEN title LIKE 'PROD %' AND unit IN ('CT', 'EA', 'EACH', 'PK', 'CN', 'CAN', 'DOZ', 'LOAF') THEN CASE WHEN title ILIKE '%APPLE%' THEN 40.0::DOUBLE * bought WHEN title ILIKE '%ROMAINE%' AND units <= 200 AND title NOT ILIKE '%APPROX WT%' THEN 1.5::DOUBLE * total END END", _T),
]


@query(f"""WITH {SANTA_CRUZ.sql()}, cells AS (SELECT ord, listed, {_present('title')} AS title, price, {_plain('bought')} AS bought, {_plain('units')} AS units, upper(trim(unit)) AS unit, {_plain('total')} AS total, brand, vendor FROM raw)
SELECT ord, title AS raw_name, vendor, {_present('brand')} AS brand, {_money('price')} AS total_price, {_cascade(SANTA_CRUZ_RULES)}, CASE trim(listed) WHEN '✅' THEN 'Y' WHEN '❌' THEN 'N' ELSE 'NA' END AS sustainable_yn, CAST(NULL AS VARCHAR) AS sustainability_certifications, 'purchasing' AS purchase_type FROM cells""")
def load_ordered_units(spark, d):
    return _result(ingest.santa_cruz(SANTA_CRUZ.frame(spark, d), BOOKS))


RIVERSIDE = Layout(
    [("item", "Item"), ("title", "Name"), ("unit", "Purchase Unit"), ("units", "Units"), ("price", " Total Spend "), ("vendor", "Vendor"), ("cert", "Sustainability")],
    [
        ("1", title, unit, units, price, vendor, cert)
        for title, unit, units, price, vendor, cert in [
            ("{b}", "20#CS", "{s}", "{s}", "V", "Organic"), ("{b}", "LB**", "{s}", "$1,{k}00", "V", " "), ("{b}", "LB", None, "1", "V", None), ("{b}", "{s} LB", "{k}", "1", "V", None),
            ("CHICKEN {k}/10# AVG", "CASE", "{s}", "1", "V", None), ("BEEF 2/{k}/5 LB", "CASE", "{s}", "1", "V", None), ("HERB {k}/2 OZ", "CASE", "{s}", "1", "V", None), ("BEEF {k}LB", "{s}/CS", "2", "1", "V", None), ("BEEF {s}#", "tub*", "2", "1", "V", None), ("BEEF {s}#", "PALLET", "2", "1", "V", None),
            ("SAUCE {s} OZ", "EACH", "{k}", "1", "V", None), ("SNACK {k} OZ", "24/CS", "{s}", "{s}.5", "V", None), ("SNACK {k} OZ", "24/CS", "2", "1{s}0", "V", None), ("LE CHEF TART 8 OZ", "TRY", "{s}", "{s}", "V", None), ("SNACK {k} OZ", "36CT*", "{s}", None, "V", None), ("CHIP 4 OZ", "{k}CT", "{s}", "9", "V", None),
            ("MILK {b}", "{k}/1GAL", "{s}", "1", "V", None), ("MILK {b}", "{k}GAL", "{s}", "1", "V", None), ("OIL {b}", "GAL", "{s}", "1", "V", None), ("OIL CLEANER {b}", "GAL", "{s}", "1", "V", None),
            ("OIL {k}/1GAL", "PALLET", "{s}", "1", "V", None), ("OIL {k} GAL", "6/CS", "{s}", "1", "V", None), ("SYRUP {k} 1/2 GALLON", "CASE", "{s}", "1", "V", None), ("MILK {k}GAL", "PALLET", "2", "1", "V", None),
            ("SYRUP {k}/750 ML", "CASE", "{s}", "1", "V", None), ("SYRUP {k}.5L", "6/CS", "{s}", "1", "V", None), ("SYRUP BIB {k} G", "EACH", "{s}", "1", "V", None), ("SPICE {s}0G", "{k}/CS", "2", "1", "V", None), ("SPICE {s}G", "EACH", "{k}", "1", "V", None), ("SPICE {k}/{s}0 G", "PALLET", "2", "1", "V", None),
            ("TOMATO {k}/#10", "CASE", "{s}", "1", "V", None), ("TOMATO #10", "{k}/CS", "{s}", "1", "V", None), ("TOMATO #10", "CASE", "{s}", "1", "V", None), ("CONE CAKE #10 36/20CT", "CASE", "{s}", "1", "V", None), ("Mystery Box", "CASE", "{s}", "1", "Sysco", None), ("Mystery Box", "CASE", "{s}", "1", "V", None),
            ("BUN {s}CT", "{k}/CS", "2", "1", "V", None), ("BUN 4/{s}-CT", "{k}/CS", "2", "1", "V", None), ("BUN {k}-{s} CT", "CASE", "2", "1", "V", None), ("BUN ({s})", "CASE", "2", "1", "V", None), ("BUN {b}", "{s}CT-CS", "{k}", "99999", "V", None), ("BUN {b}", "DOZ", "{s}", "99999", "V", None), ("TORTILLA {b}", "CS24", "{k}", "{s}", "V", None), ("BUN {b}", "24/CS", "{k}", "{s}00", "V", None), ("BUN LE CHEF", "TRAY", "{k}", "1", "V", None), ("BUN {b}", "LOAF", "{s}", "99999", "V", None), ("MELON {b}", "CASE", "{s}", "1", "V", None), ("BUN {b}", "24/CS", "{k}", None, "V", None),
            ("EGG LARGE {k}DZ", "CASE", "{s}", "1", "V", None), ("EGG 15/{k} DOZ", "CASE", "{s}", "1", "V", None), ("EGGS {s}CT", "{k}/CS", "2", "1", "V", None), ("{b}", "CASE", "{s}", "1", "V", None), ("{b}", "DOLR", "1", "1", "V", None), ("{b}", "DOLLR*", "1", "1", "V", None), ("{b}", None, "{k}", "1", "V", None),
        ]
    ] + [(None, "TOTAL", "LB", "{s}", "1", "V", None)],
)
LITERS = rf"(?i)({VOL})\s*-?\s*(L(?:TR|T)?|ML)\b"
LITER_PAIR = rf"(?i)({VOL})\s*/\s*({VOL})\s*-?\s*(L(?:TR|T)?|ML)\b"
GRAMS, GRAM_PAIR = rf"(?i)({N})\s*-?\s*G\b", rf"(?i)({N})\s*/\s*({N})\s*-?\s*G\b"
DOZENS, DOZEN_CHAIN = r"(?i)([0-9]+)\s*-?\s*(?:DZ|DOZ)\b", r"(?i)((?:[0-9]+\s*/\s*)+[0-9]+)\s*-?\s*(?:DZ|DOZ)\b"
BAG = rf"({N})\s*-?\s*G\b"
CEILING = "CASE WHEN {0} >= 1 AND coalesce(price / nullif({0} * units, 0) <= 20, true) THEN {0} * units END"
_COUNTED = "CASE WHEN count_shape = 'chain' THEN named_count ELSE named_count * coalesce(per_case, 1) END"
RIVERSIDE_RULES = [
    ("CASE WHEN unit = 'LB' THEN units END", "reported"),
    (f"{_num('unit', f'^({N})#')} * units", _C),
    (f"{_num('unit', f'^({N}) *LB$')} * units", _C),
    ("CASE WHEN shape = 'chain' AND named_lb >= 1 THEN named_lb * units END", _C),
    ("CASE WHEN shape = 'bare' AND named_lb * single >= 1 THEN named_lb * single * units END", _C),
    ("CASE WHEN unit = 'EACH' THEN ounces_lb * units END", _C),
    ("CASE WHEN shape = 'none' THEN " + CEILING.format("(ounces_lb * per_case)") + " END", _C),
    ("CASE WHEN shape = 'none' THEN " + CEILING.format("(ounces_lb * tray)") + " END", _C),
    ("density * unit_gal * units", _T),
    ("density * CASE gal_shape WHEN 'chain' THEN gal WHEN 'bare' THEN gal * single END * units", _T),
    ("density * liter_gal * units", _T),
    (f"CASE WHEN title ILIKE '%BIB%' THEN density * {_num('title', BAG)} * units END", _T),
    ("CASE WHEN density IS NOT NULL OR NOT regexp_matches(title, '(?i)LINER|SANITIZER|CLEANER|CLEANING|SOAP') THEN gram_lb * units END", _C),
    ("CASE WHEN title LIKE '%#10%' AND title NOT IN ('CONE CAKE #10 36/20CT', 'MEAD ENVELOPES WHITE #10 50CT') THEN can_lb * coalesce(per_case, " + _num("title", "([0-9]+)/#10") + ", 1) * units END", _T),
    ("CASE WHEN vendor = 'Sysco' AND upper(title) = 'MYSTERY BOX' THEN 11.0::DOUBLE * units END", _T),
    (f"""CASE WHEN title ILIKE '%TORTILLA%' OR title ILIKE '%BUN%' THEN CASE WHEN count_shape <> 'none' THEN 0.1::DOUBLE * ({_COUNTED}) * units WHEN sure IS NOT NULL THEN 0.1::DOUBLE * sure * units
        WHEN guess IS NOT NULL THEN CASE WHEN price / nullif(0.1::DOUBLE * guess * units, 0) <= 20 THEN 0.1::DOUBLE * guess * units END WHEN unit IN ('EACH', 'LOAF') THEN 0.1::DOUBLE * units END WHEN title ILIKE '%MELON%' THEN 38.0::DOUBLE * units END""", _T),
    (f"CASE WHEN title ILIKE '%EGG%' THEN coalesce(dozens * 12, CASE WHEN count_shape <> 'none' THEN {_COUNTED} END) * 0.125::DOUBLE * units END", _T),
]
UNIT_SQL = f"""CASE WHEN unit IN ('CASE', 'EACH', 'JAR', 'BAG', 'BOX', 'TUB', 'PAIL', 'BOTL', 'ROLL', 'TRY', 'TRAY') THEN 1 ELSE {_num('unit', f'^({N})/CS$')} END AS single, {_num('unit', f'^({N})/CS$')} AS per_case,
  CASE WHEN title ILIKE '%LE CHEF%' AND unit IN ('TRY', 'TRAY') THEN 6 ELSE {_num('unit', '^([0-9]+)CT$')} END AS tray, CASE WHEN unit = 'GAL' THEN 1 ELSE coalesce({_num('unit', f'^({N})/({N})GAL$', 1)} * {_num('unit', f'^({N})/({N})GAL$', 2)}, {_num('unit', f'^({N})GAL$')}) END AS unit_gal,
  CASE WHEN unit = 'DOZ' THEN 12 ELSE {_num('unit', '^([0-9]+)CT(?:-CS)?$')} END AS sure, coalesce({_num('unit', f'^({N})/CS$')}, {_num('unit', '^CS([0-9]+)$')}, CASE WHEN title ILIKE '%LE CHEF%' AND unit IN ('TRY', 'TRAY') THEN 6 END) AS guess"""
MORE_SQL = f"""CASE WHEN regexp_matches(title, '{LITER_PAIR}') THEN {_num('title', LITER_PAIR, 1)} * {_num('title', LITER_PAIR, 2)} * CASE WHEN upper(regexp_extract(title, '{LITER_PAIR}', 3)) = 'ML' THEN 0.001::DOUBLE ELSE 1 END
    ELSE {_num('title', LITERS)} * CASE WHEN upper(regexp_extract(title, '{LITERS}', 2)) = 'ML' THEN 0.001::DOUBLE ELSE 1 END * single END / 3.78541::DOUBLE AS liter_gal,
  CASE WHEN regexp_matches(title, '{GRAM_PAIR}') THEN CASE WHEN {_num('title', GRAM_PAIR, 1)} * {_num('title', GRAM_PAIR, 2)} * 0.00220462::DOUBLE >= 1 THEN {_num('title', GRAM_PAIR, 1)} * {_num('title', GRAM_PAIR, 2)} * 0.00220462::DOUBLE END
    WHEN unit = 'EACH' OR per_case = 1 OR {_num('title', GRAMS)} * 0.00220462::DOUBLE * per_case >= 1 THEN {_num('title', GRAMS)} * 0.00220462::DOUBLE * CASE WHEN unit = 'EACH' THEN 1 ELSE per_case END END AS gram_lb,
  coalesce(list_product(list_transform(string_split(nullif(regexp_extract(title, '{DOZEN_CHAIN}', 1), ''), '/'), lambda v: TRY_CAST(trim(v) AS DOUBLE))), {_num('title', DOZENS)}) AS dozens"""


@query(f"""WITH {RIVERSIDE.sql()}, cells AS (SELECT ord, {_present('title')} AS title, regexp_replace(upper(trim(unit)), '[*]+$', '') AS unit, {_plain('units')} AS units, {_money('price')} AS price, vendor, {_present('cert')} AS cert FROM raw
    WHERE item IS NOT NULL AND coalesce(unit NOT IN ('DOLR', 'DOLR*', 'DOLAR', 'DOLLR*', 'DLR'), true)), marked AS (SELECT *, {UNIT_SQL}, {NAME_SQL} FROM cells), said AS (SELECT *, {MORE_SQL} FROM marked)
SELECT ord, title AS raw_name, vendor, CAST(NULL AS VARCHAR) AS brand, price AS total_price, {_cascade(RIVERSIDE_RULES, "CASE WHEN unit = 'LB' THEN 'reported' ELSE 'unresolved' END")},
  CASE WHEN cert IS NULL THEN 'N' ELSE 'Y' END AS sustainable_yn, cert AS sustainability_certifications, 'purchasing' AS purchase_type FROM said""")
def load_purchase_units(spark, d):
    return _result(ingest.riverside(RIVERSIDE.frame(spark, d), BOOKS))
