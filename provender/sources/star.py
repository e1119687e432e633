"""The canonical procurement view over the driver's star schema, and the same view as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_FORMS = 12
#: So many orders go to every task (some 100 bytes each); of more, lines and orders are shuffled.
SMALL_ORDERS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(base: Column, size: Column, n: Column, key: Column) -> Column:
    """Names with quantities of every shape that the parsers know, chosen by key."""
    s, k = size.cast("string"), n.cast("string")
    forms = [
        F.concat(base, F.lit(" "), s, F.lit("/"), k, F.lit("-LB")),
        F.concat(base, F.lit(" RED "), s, F.lit("LB")),
        F.concat(base, F.lit(" 12/"), k, F.lit("-CT (SUS)")),
        F.concat(base, F.lit(" "), s, F.lit("-"), (size + 8).cast("string"), F.lit(" CT *CA*")),
        F.concat(base, F.lit(" ("), s, F.lit(")")),
        F.concat(base, F.lit(" "), s, F.lit("DZ")),
        F.concat(base, F.lit(" "), k, F.lit("/.5GAL")),
        F.concat(base, F.lit(" "), s, F.lit(" 1/2 GALLONS")),
        F.concat(base, F.lit(" FCY 6/"), s, F.lit(" OZ")),
        F.concat(base, F.lit(" 4/750 ML JAR")),
        F.concat(base, F.lit(" "), k, F.lit("/"), s, F.lit(" G FRZ")),
        F.concat(base, F.lit(" 2.5L DIET")),
    ]
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(key % NAME_FORMS == i, form).otherwise(out)
    return out


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, base, category, brand, size, n, name, pack, price_text, certs, sustainable_yn."""
    key, size, n = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7 + 1
    s, k, base = size.cast("string"), n.cast("string"), F.upper("p_name")
    pack = F.when(key % 8 == 0, F.concat(s, F.lit("/"), k, F.lit(" LB"))).when(key % 8 == 1, F.concat(k, F.lit(" "), s, F.lit(" oz"))).when(key % 8 == 2, F.concat(s, F.lit("-"), (size + 2).cast("string"), F.lit("#"))).when(key % 8 == 3, F.concat(s, F.lit("#AVG"))).when(key % 8 == 4, F.concat(s, F.lit(" POUND"))).when(key % 8 == 5, s).when(key % 8 == 6, F.concat(s, F.lit(" KG"))).otherwise(F.concat(F.lit(" "), s, F.lit(" CT ")))
    price = F.when(key % 5 == 0, F.concat(F.lit(" $1,"), F.lpad(s, 3, "0"), F.lit(".50 "))).when(key % 5 == 1, F.lit("")).when(key % 5 == 2, F.lit("n/a")).when(key % 5 == 3, F.concat(s, F.lit(".25"))).otherwise(F.concat(F.lit("-$"), s))
    certs = F.when(key % 6 == 0, F.lit("Organic")).when(key % 6 == 1, F.lit("Fair Trade; XX")).when(key % 6 == 2, F.lit("NAE")).when(key % 6 == 3, F.lit("Rainforest Alliance")).when(key % 6 == 4, F.lit("made up claim, organic"))
    yn = F.when(size % 3 == 0, "Y").when(size % 3 == 1, "N").otherwise("NA")
    brand = F.when(key % 4 == 0, F.concat(F.lit("- "), F.lower("p_brand"))).when(key % 4 == 1, F.col("p_brand")).when(key % 4 == 2, F.upper(F.regexp_replace("p_brand", "#", " "))).otherwise(F.when(key % 8 == 3, F.lit("-")).otherwise(F.concat(F.col("p_brand"), F.lit(" Organic Farms"))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), base.alias("base"), F.col("p_type").alias("category"), brand.alias("brand"), size.alias("size"), n.alias("n"), _name(base, size, n, key).alias("name"), pack.alias("pack"), price.alias("price_text"), certs.alias("certs"), yn.alias("sustainable_yn"))


PRODUCTS_SQL = """products AS (
  SELECT p_partkey AS product_id, upper(p_name) AS base, p_type AS category, p_size AS size, p_partkey % 7 + 1 AS n,
    CASE p_partkey % 4 WHEN 0 THEN '- ' || lower(p_brand) WHEN 1 THEN p_brand WHEN 2 THEN upper(replace(p_brand, '#', ' '))
      ELSE CASE WHEN p_partkey % 8 = 3 THEN '-' ELSE p_brand || ' Organic Farms' END END AS brand,
    upper(p_name) || CASE p_partkey % 12
      WHEN 0 THEN ' ' || p_size || '/' || (p_partkey % 7 + 1) || '-LB' WHEN 1 THEN ' RED ' || p_size || 'LB'
      WHEN 2 THEN ' 12/' || (p_partkey % 7 + 1) || '-CT (SUS)' WHEN 3 THEN ' ' || p_size || '-' || (p_size + 8) || ' CT *CA*'
      WHEN 4 THEN ' (' || p_size || ')' WHEN 5 THEN ' ' || p_size || 'DZ' WHEN 6 THEN ' ' || (p_partkey % 7 + 1) || '/.5GAL'
      WHEN 7 THEN ' ' || p_size || ' 1/2 GALLONS' WHEN 8 THEN ' FCY 6/' || p_size || ' OZ' WHEN 9 THEN ' 4/750 ML JAR'
      WHEN 10 THEN ' ' || (p_partkey % 7 + 1) || '/' || p_size || ' G FRZ' ELSE ' 2.5L DIET' END AS name,
    CASE p_partkey % 8 WHEN 0 THEN p_size || '/' || (p_partkey % 7 + 1) || ' LB' WHEN 1 THEN (p_partkey % 7 + 1) || ' ' || p_size || ' oz'
      WHEN 2 THEN p_size || '-' || (p_size + 2) || '#' WHEN 3 THEN p_size || '#AVG' WHEN 4 THEN p_size || ' POUND' WHEN 5 THEN CAST(p_size AS VARCHAR)
      WHEN 6 THEN p_size || ' KG' ELSE ' ' || p_size || ' CT ' END AS pack,
    CASE p_partkey % 5 WHEN 0 THEN ' $1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.50 ' WHEN 1 THEN '' WHEN 2 THEN 'n/a'
      WHEN 3 THEN p_size || '.25' ELSE '-$' || p_size END AS price_text,
    CASE p_partkey % 6 WHEN 0 THEN 'Organic' WHEN 1 THEN 'Fair Trade; XX' WHEN 2 THEN 'NAE' WHEN 3 THEN 'Rainforest Alliance' WHEN 4 THEN 'made up claim, organic' END AS certs,
    CASE p_size % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'NA' END AS sustainable_yn
  FROM part)"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a purchase line: ids (ok, ln, product_id, sk), campus, campus_type, fiscal_year, raw_name, vendor, brand,
    category, total_price (decimal), total_weight_lbs, weight_source, sustainable_yn, purchase_type."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    makers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # orders get their campus before the lines, several to an order, meet them: lines are shuffled by order and by part only
    bought = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_nationkey", "n_name", F.year(F.add_months("o_orderdate", 6)).alias("_year"))
    if orders.count() <= SMALL_ORDERS:  # the size of a join is no sum that Spark's own check could use
        bought = F.broadcast(bought)
    rows = line.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(makers, F.col("l_suppkey") == F.col("s_suppkey"))
    mix = F.col("l_orderkey") + F.col("l_linenumber")
    source = F.when(mix % 7 == 0, "unresolved").when(F.col("l_returnflag") == "R", "computed_tier2").when(F.col("l_returnflag") == "A", "reference_table_tier3").otherwise("reported")
    vendor = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.upper("s_name"), F.lit(" Corp."))).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit(" "), F.col("s_name"), F.lit("  Company"))).when((F.col("l_suppkey") + F.col("l_linenumber")) % 4 == 2, F.lit(None)).otherwise(F.col("s_name"))
    weight = F.when(mix % 7 != 0, F.col("l_quantity") * F.when(F.col("l_orderkey") % 997 == 0, 100000.0).otherwise(1.0))
    return rows.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("sk"),
        F.col("n_name").alias("campus"), F.when(F.col("n_nationkey") % 2 == 0, "Academic").otherwise("Health").alias("campus_type"),
        F.col("_year").alias("fiscal_year"), F.upper("p_name").alias("raw_name"), vendor.alias("vendor"), F.col("p_brand").alias("brand"),
        F.when(F.col("l_partkey") % 29 != 0, F.col("p_type")).alias("category"), F.col("l_extendedprice").cast("decimal(18,2)").alias("total_price"), weight.alias("total_weight_lbs"),
        source.alias("weight_source"), F.when(F.col("p_size") % 3 == 0, "Y").when(F.col("p_size") % 3 == 1, "N").otherwise("NA").alias("sustainable_yn"),
        F.when(F.col("l_linenumber") % 2 == 0, "service").otherwise("purchasing").alias("purchase_type"),
    )


PURCHASES_SQL = """purchases AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS product_id, l_suppkey AS sk, n_name AS campus,
    CASE WHEN n_nationkey % 2 = 0 THEN 'Academic' ELSE 'Health' END AS campus_type, CAST(year(o_orderdate + INTERVAL 6 MONTH) AS INTEGER) AS fiscal_year,
    upper(p_name) AS raw_name, CASE WHEN l_suppkey % 4 = 0 THEN upper(s_name) || ' Corp.' WHEN l_suppkey % 4 = 1 THEN ' ' || s_name || '  Company'
      WHEN (l_suppkey + l_linenumber) % 4 = 2 THEN NULL ELSE s_name END AS vendor, p_brand AS brand,
    CASE WHEN l_partkey % 29 <> 0 THEN p_type END AS category, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_price,
    CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_quantity * CASE WHEN l_orderkey % 997 = 0 THEN 100000.0::DOUBLE ELSE 1.0::DOUBLE END END AS total_weight_lbs,
    CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'unresolved' WHEN l_returnflag = 'R' THEN 'computed_tier2' WHEN l_returnflag = 'A' THEN 'reference_table_tier3' ELSE 'reported' END AS weight_source,
    CASE p_size % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'NA' END AS sustainable_yn, CASE WHEN l_linenumber % 2 = 0 THEN 'service' ELSE 'purchasing' END AS purchase_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
