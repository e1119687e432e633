"""Queries of the scalar layer: parsing, normalising, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from provender.functions import gates, text
from provender.plans.base import query
from provender.sources.star import PRODUCTS_SQL, products

P = f"WITH {PRODUCTS_SQL}\n"
_LIST = lambda e: f"list_reduce(list_transform(string_split({e}, '/'), lambda x: CAST(trim(x) AS DOUBLE)), lambda a, b: a * b)"
_NUM = r"\d+(?:\.\d+)?"
_VOL = r"(?:\d+(?:\.\d+)?|\.\d+)"
_UNIT = "LBS?|POUNDS?|OZ|KGS?|KILO|GMS?|G"
_D = lambda e: f"TRY_CAST(nullif({e}, '') AS DOUBLE)"


def _factor(e):
    return f"CASE upper({e}) WHEN '' THEN 1.0::DOUBLE WHEN 'OZ' THEN 0.0625::DOUBLE WHEN 'KG' THEN 2.20462::DOUBLE WHEN 'KGS' THEN 2.20462::DOUBLE WHEN 'KILO' THEN 2.20462::DOUBLE WHEN 'G' THEN 0.00220462::DOUBLE WHEN 'GM' THEN 0.00220462::DOUBLE WHEN 'GMS' THEN 0.00220462::DOUBLE ELSE 1.0::DOUBLE END"


@query(P + r"SELECT product_id, TRY_CAST(nullif(regexp_replace(trim(price_text), '[$,]', '', 'g'), '') AS DOUBLE) AS price FROM products")
def currency_parse(spark, d):
    return products(spark, d).select("product_id", text.currency(text.known(F.col("price_text"))).alias("price"))


_MULT, _RANGE, _BARE = rf"(?i)^({_NUM})\s*[/ ]\s*({_NUM})\s*({_UNIT})\s*(?:AVG?|AV)?$", rf"(?i)^({_NUM})\s*-\s*({_NUM})\s*#?\s*({_UNIT})?\s*(?:AVG?|AV)?$", rf"(?i)^({_NUM})\s*(#)?\s*({_UNIT})?\s*(?:AVG?|AV)?$"


@query(P + rf""", s AS (SELECT product_id, trim(pack) AS s FROM products), v AS (
  SELECT product_id, CASE
    WHEN regexp_matches(s, '{_MULT}') THEN CAST(regexp_extract(s, '{_MULT}', 1) AS DOUBLE) * CAST(regexp_extract(s, '{_MULT}', 2) AS DOUBLE) * {_factor(f"regexp_extract(s, '{_MULT}', 3)")}
    WHEN regexp_matches(s, '{_RANGE}') THEN (CAST(regexp_extract(s, '{_RANGE}', 1) AS DOUBLE) + CAST(regexp_extract(s, '{_RANGE}', 2) AS DOUBLE)) / 2 * {_factor(f"regexp_extract(s, '{_RANGE}', 3)")}
    WHEN regexp_matches(s, '{_BARE}') AND regexp_extract(s, '{_BARE}', 2) || regexp_extract(s, '{_BARE}', 3) <> '' THEN CAST(regexp_extract(s, '{_BARE}', 1) AS DOUBLE) * {_factor(f"regexp_extract(s, '{_BARE}', 3)")}
  END AS v FROM s) SELECT product_id, CASE WHEN v >= 1 THEN v END AS pack_lb FROM v""")
def pack_size_to_lb(spark, d):
    return products(spark, d).select("product_id", text.pack_size_lb(F.col("pack")).alias("pack_lb"))


_WC, _WB = rf"(?i)((?:{_NUM}\s*/\s*)+{_NUM})\s*-?\s*(?:(LB|OZ)\b|(#))", rf"(?i)({_NUM})\s*-?\s*(?:(LB)\b|(#))"


@query(P + rf"""SELECT product_id,
  CASE WHEN regexp_matches(name, '{_WC}') THEN {_LIST(f"regexp_extract(name, '{_WC}', 1)")} / CASE WHEN upper(regexp_extract(name, '{_WC}', 2)) = 'OZ' THEN 16.0::DOUBLE ELSE 1.0::DOUBLE END
       ELSE {_D(f"regexp_extract(name, '{_WB}', 1)")} END AS weight_lb,
  CASE WHEN regexp_matches(name, '{_WC}') THEN 'chain' WHEN regexp_matches(name, '{_WB}') THEN 'bare' ELSE 'none' END AS shape FROM products""")
def name_weight_shape(spark, d):
    w = text.name_weight(F.col("name"))
    return products(spark, d).select("product_id", w["value"].alias("weight_lb"), w["shape"].alias("shape"))


_CC, _CR, _CB, _CP = r"(?i)((?:\d+\s*/\s*)+\d+)\s*-?\s*CT\b", r"(?i)(\d+)\s*-\s*(\d+)\s*-?\s*CT\b", r"(?i)(\d+)\s*-?\s*CT\b", r"\((\d+)\)"


@query(P + rf"""SELECT product_id, CASE WHEN regexp_matches(name, '{_CC}') THEN {_LIST(f"regexp_extract(name, '{_CC}', 1)")}
    WHEN regexp_matches(name, '{_CR}') THEN (CAST(regexp_extract(name, '{_CR}', 1) AS DOUBLE) + CAST(regexp_extract(name, '{_CR}', 2) AS DOUBLE)) / 2
    WHEN regexp_matches(name, '{_CB}') THEN CAST(regexp_extract(name, '{_CB}', 1) AS DOUBLE) ELSE {_D(f"regexp_extract(name, '{_CP}', 1)")} END AS count,
  CASE WHEN regexp_matches(name, '{_CC}') THEN 'chain' WHEN regexp_matches(name, '{_CR}') THEN 'range' WHEN regexp_matches(name, '{_CB}') THEN 'bare' WHEN regexp_matches(name, '{_CP}') THEN 'paren' ELSE 'none' END AS shape FROM products""")
def count_shape(spark, d):
    c = text.name_count(F.col("name"))
    return products(spark, d).select("product_id", c["value"].alias("count"), c["shape"].alias("shape"))


_DC, _DB = r"(?i)((?:\d+\s*/\s*)+\d+)\s*-?\s*(?:DZ|DOZ)\b", r"(?i)(\d+)\s*-?\s*(?:DZ|DOZ)\b"


@query(P + rf"""SELECT product_id, coalesce({_LIST(f"nullif(regexp_extract(name, '{_DC}', 1), '')")}, {_D(f"regexp_extract(name, '{_DB}', 1)")}) * 12 AS pieces FROM products""")
def dozen_count(spark, d):
    return products(spark, d).select("product_id", text.dozen_count(F.col("name")).alias("pieces"))


_GM, _GC, _GB = r"(?i)(\d+)[\s-]+(\d+)\s*/\s*(\d+)\s*-?\s*GAL(?:LONS?)?\b", rf"(?i)({_VOL})\s*/\s*({_VOL})\s*-?\s*GAL(?:LONS?)?\b", rf"(?i)({_VOL})\s*-?\s*GAL(?:LONS?)?\b"


@query(P + rf"""SELECT product_id, CASE
    WHEN regexp_matches(name, '{_GM}') THEN CAST(regexp_extract(name, '{_GM}', 1) AS DOUBLE) + CAST(regexp_extract(name, '{_GM}', 2) AS DOUBLE) / CAST(regexp_extract(name, '{_GM}', 3) AS DOUBLE)
    WHEN regexp_matches(name, '{_GC}') THEN CAST(regexp_extract(name, '{_GC}', 1) AS DOUBLE) * CAST(regexp_extract(name, '{_GC}', 2) AS DOUBLE)
    ELSE {_D(f"regexp_extract(name, '{_GB}', 1)")} END AS gallons,
  CASE WHEN regexp_matches(name, '{_GM}') OR regexp_matches(name, '{_GC}') THEN 'chain' WHEN regexp_matches(name, '{_GB}') THEN 'bare' ELSE 'none' END AS shape FROM products""")
def gallon_shape(spark, d):
    g = text.gallons(F.col("name"))
    return products(spark, d).select("product_id", g["value"].alias("gallons"), g["shape"].alias("shape"))


_LC, _LB = rf"(?i)({_VOL})\s*/\s*({_VOL})\s*-?\s*(L(?:TR|T)?|ML)\b", rf"(?i)({_VOL})\s*-?\s*(L(?:TR|T)?|ML)\b"


@query(P + rf"""SELECT product_id, CASE
    WHEN regexp_matches(name, '{_LC}') THEN CAST(regexp_extract(name, '{_LC}', 1) AS DOUBLE) * CAST(regexp_extract(name, '{_LC}', 2) AS DOUBLE) * CASE WHEN upper(regexp_extract(name, '{_LC}', 3)) = 'ML' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END / 3.78541::DOUBLE
    ELSE {_D(f"regexp_extract(name, '{_LB}', 1)")} * CASE WHEN upper(regexp_extract(name, '{_LB}', 2)) = 'ML' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END / 3.78541::DOUBLE END AS gallons,
  CASE WHEN regexp_matches(name, '{_LC}') THEN 'chain' WHEN regexp_matches(name, '{_LB}') THEN 'bare' ELSE 'none' END AS shape FROM products""")
def liter_shape(spark, d):
    g = text.liters_as_gallons(F.col("name"))
    return products(spark, d).select("product_id", g["value"].alias("gallons"), g["shape"].alias("shape"))


_RC, _RB = rf"(?i)({_NUM})\s*/\s*({_NUM})\s*-?\s*G\b", rf"(?i)({_NUM})\s*-?\s*G\b"


@query(P + rf"""SELECT product_id, CASE WHEN regexp_matches(name, '{_RC}') THEN CAST(regexp_extract(name, '{_RC}', 1) AS DOUBLE) * CAST(regexp_extract(name, '{_RC}', 2) AS DOUBLE) * 0.00220462::DOUBLE
    ELSE {_D(f"regexp_extract(name, '{_RB}', 1)")} * 0.00220462::DOUBLE END AS pounds,
  CASE WHEN regexp_matches(name, '{_RC}') THEN 'chain' WHEN regexp_matches(name, '{_RB}') THEN 'bare' ELSE 'none' END AS shape FROM products""")
def gram_shape(spark, d):
    g = text.grams_as_pounds(F.col("name"))
    return products(spark, d).select("product_id", g["value"].alias("pounds"), g["shape"].alias("shape"))


@query(r"""WITH v AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) || ' Corp.' WHEN 1 THEN ' ' || s_name || '  Company' WHEN 2 THEN s_name || ', Inc' ELSE s_name END AS vendor FROM supplier)
SELECT s_suppkey, nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(vendor)), '[.,]', '', 'g'), '\s+', ' ', 'g')), '\b(?:corporation|corp|incorporated|inc|llc|lp|co|company)\.?\s*$', '')), '') AS vendor_key FROM v""")
def vendor_normalize(spark, d):
    key = F.col("s_suppkey") % 4
    vendor = F.when(key == 0, F.concat(F.upper("s_name"), F.lit(" Corp."))).when(key == 1, F.concat(F.lit(" "), F.col("s_name"), F.lit("  Company"))).when(key == 2, F.concat(F.col("s_name"), F.lit(", Inc"))).otherwise(F.col("s_name"))
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", text.normal_vendor(vendor).alias("vendor_key"))


_CLEAN = r"regexp_replace(name, '(?i)\s*\(SUS\)\s*$', '')"
_CLEAN = rf"regexp_replace({_CLEAN}, '^(\w+)\s+([Ss])\b', '\1\2')"
_CLEAN = rf"regexp_replace(regexp_replace({_CLEAN}, '[()]', '', 'g'), '(\d)\s*#', '\1 LB ', 'g')"
for _a, _b in text.SYNONYMS.items():
    _CLEAN = rf"regexp_replace({_CLEAN}, '(?i)\b{_a}\b', '{_b}', 'g')"
CLEAN_SQL = rf"trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'))"


@query(P + f"SELECT product_id, {CLEAN_SQL} AS cleaned FROM products")
def clean_for_matching(spark, d):
    return products(spark, d).select("product_id", text.clean_name(F.col("name")).alias("cleaned"))


def _sql_found(groups):
    return "concat_ws(',', " + ", ".join("CASE WHEN regexp_matches(name, '{}') THEN '{}' END".format(gates.alternatives(g).replace("\\ ", " ").replace("\\-", "-"), i) for i, g in enumerate(groups)) + ")"


_FLAG = lambda p: f"CASE WHEN regexp_matches(name, '{p}') THEN '1' ELSE '0' END"
SIGNATURE_SQL = rf"""concat_ws('|', array_to_string(list_sort(list_distinct(regexp_extract_all(name, '\d+(?:\.\d+)?(?:/\d+)?'))), ','), {_sql_found(gates.ORIGINS)},
  {_FLAG(r'(?i)\(H\)|\bHALAL\b')}, {_FLAG(r'(?i)\b(?:FZ|FRZ|FR)\b')},
  CASE WHEN regexp_matches(name, '(?i)\bPOTATO(?:ES)?\b') THEN array_to_string(list_sort(list_distinct(regexp_extract_all(name, '\b([AB])\b', 1))), ',') ELSE '' END,
  concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(name, '(?i)(?:^|[^A-Za-z])(?:{'|'.join(g)})(?:[^A-Za-z]|$)') THEN '{i}' END" for i, g in enumerate(gates.VOLUMES))}),
  {_FLAG(r'(?i)\bDECAF(?:FEINATED)?\b')}, {', '.join(_sql_found(g) for g in (gates.CONTAINERS, gates.DIETS, gates.COLOURS, gates.FRUITS, gates.QUALITIES, gates.CLAIMS))})"""


@query(P + f"SELECT product_id, {SIGNATURE_SQL} AS gate_signature FROM products")
def gate_signature(spark, d):
    return products(spark, d).select("product_id", gates.signature(F.col("name")).alias("gate_signature"))


@query(P + r"""SELECT product_id, nullif(trim(regexp_replace(regexp_replace(trim(brand), '^-+\s*', ''), '\s+', ' ', 'g')), '') AS brand_clean,
  regexp_replace(lower(nullif(trim(regexp_replace(trim(brand), '^-+\s*', '')), '')), '[^a-z0-9]', '', 'g') AS brand_key FROM products""")
def brand_normalize(spark, d):
    b = text.normal_brand(F.col("brand"))
    return products(spark, d).select("product_id", b.alias("brand_clean"), text.brand_key(b).alias("brand_key"))


@query(P + r"""SELECT product_id, array_to_string(list_filter([CASE WHEN lower(trim(certs)) NOT IN ('x', 'vegetarian', 'vegan') THEN nullif(trim(certs), '') END,
    CASE WHEN product_id % 3 = 0 THEN NULL WHEN product_id % 3 = 1 THEN 'Local' END], lambda x: x IS NOT NULL), ', ') AS joined
  FROM products WHERE certs IS NOT NULL OR product_id % 3 = 1""")
def combine_text_columns(spark, d):
    p = products(spark, d)
    tag = F.when(F.col("product_id") % 3 == 0, "Vegan").when(F.col("product_id") % 3 == 1, " Local ").otherwise("x")
    return p.select("product_id", text.join_tags([F.col("certs"), tag]).alias("joined")).where("joined is not null")
