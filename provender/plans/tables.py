"""Queries of tables: constraints, orders, limits, legacy sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from provender.operators import menu
from provender.plans import aggregates as agg
from provender.plans.base import query
from provender.plans.matching import QUEUE_SQL, queue
from provender.sources import legacy, schemas
from provender.sources.star import PRODUCTS_SQL, products


@query(f"""WITH {QUEUE_SQL}, p AS (SELECT p_partkey AS product_id FROM part WHERE p_partkey % 13 <> 0), c AS (SELECT candidate_id, a, b, CASE WHEN candidate_id % 17 = 0 THEN 'lost' ELSE status END AS status FROM q)
SELECT 'candidates.status' AS rule, status AS value, count(*) AS n FROM c WHERE status NOT IN ('pending', 'approved', 'rejected') GROUP BY status
UNION ALL SELECT 'candidates.a -> products', CAST(a AS VARCHAR), count(*) FROM c WHERE a NOT IN (SELECT product_id FROM p) GROUP BY a
UNION ALL SELECT 'candidates.b -> products', CAST(b AS VARCHAR), count(*) FROM c WHERE b NOT IN (SELECT product_id FROM p) GROUP BY b
UNION ALL SELECT 'candidates order', 'a < b', count(*) FROM c WHERE a >= b HAVING count(*) > 0""")
def schema_violations(spark, d):
    q = queue(spark, d).withColumn("status", F.when(F.col("candidate_id") % 17 == 0, "lost").otherwise(F.col("status")))
    known = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("product_id"))
    made = {"candidates": schemas.conform(q, "candidates"), "products": schemas.conform(known, "products")}
    return schemas.violations(made)


@query(f"WITH {QUEUE_SQL} SELECT candidate_id, score FROM q WHERE status = 'pending' ORDER BY score DESC, candidate_id LIMIT 20")
def queue_preview(spark, d):
    return queue(spark, d).where("status = 'pending'").orderBy(F.desc("score"), "candidate_id").limit(20).select("candidate_id", "score")


WIDE_SQL = """wide AS (SELECT p_partkey AS id, p_type AS Category, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS AASHE, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS PGH,
  CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS north, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS south, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS organic FROM part)"""


def _wide(spark, d):
    flag = lambda c: F.when(c, 1).otherwise(0)
    size, key = F.col("p_size"), F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(key.alias("id"), F.col("p_type").alias("Category"), flag(size % 2 == 0).alias("AASHE"), flag(size % 3 == 0).alias("PGH"), flag(key % 4 == 0).alias("north"), flag(key % 5 == 0).alias("south"), flag(size > 25).alias("organic"))


@query(f"WITH {WIDE_SQL} SELECT id FROM wide WHERE Category = 'SMALL' AND AASHE = 1 AND PGH = 1 AND (north = 1 OR south = 1) AND organic = 1")
def legacy_search_filters(spark, d):
    return legacy.search_sheet(_wide(spark, d), category="SMALL", standard="both", region=["north", "south"], certs=["organic"]).select("id")


@query(f"WITH {WIDE_SQL} SELECT id, concat_ws(', ', CASE WHEN north = 1 THEN 'north' END, CASE WHEN south = 1 THEN 'south' END) AS campuses FROM wide")
def campus_list_from_flags(spark, d):
    return _wide(spark, d).select("id", menu.names_of(["north", "south"]).alias("campuses"))


@query(f"WITH {PRODUCTS_SQL} SELECT product_id, price_text AS price, trim(certs) AS certs FROM products")
def clean_strings(spark, d):
    from provender.functions.text import clean

    rows = products(spark, d)
    return rows.select("product_id", F.col("price_text").alias("price"), clean(F.col("certs")).alias("certs"))


@query(f"""{agg.R}, s AS (SELECT campus, CAST(sum(total_price) AS DOUBLE) AS spend FROM purchases GROUP BY campus) SELECT campus, spend, round(spend / sum(spend) OVER (), 8) AS share, rank() OVER (ORDER BY spend DESC) AS place FROM s""")
def spend_share(spark, d):
    from pyspark.sql import Window

    sums = agg.rows(spark, d).groupBy("campus").agg(F.sum("total_price").cast("double").alias("spend"))  # one row a campus
    everything = Window.partitionBy(F.lit(1))
    return sums.select("campus", "spend", F.round(F.col("spend") / F.sum("spend").over(everything), 8).alias("share"), F.rank().over(Window.orderBy(F.desc("spend"))).cast("long").alias("place"))


_TITLES = ["croissant butter 6-Pk", "roll 2# dinner", "muffin 4 oz", "bagel plain", "pullman loaf", 'bun 6" long', "cookie 12.5oz", "tart"]
TITLES_SQL = f"""s AS (SELECT p_partkey AS id, ([{', '.join("'" + t + "'" for t in _TITLES)}])[p_partkey % 8 + 1] AS title, CASE p_size % 4 WHEN 0 THEN 'dz' WHEN 1 THEN 'ea' WHEN 2 THEN 'pk' END AS pack, p_size AS quantity FROM part),
map AS (SELECT DISTINCT title, length(title) / 32.0::DOUBLE AS lb FROM s WHERE length(title) % 2 = 1)"""


def _titles(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_size") % 4
    return part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("title"), F.when(k == 0, "dz").when(k == 1, "ea").when(k == 2, "pk").alias("pack"), F.col("p_size").alias("quantity"))


@query(f"""WITH {TITLES_SQL} SELECT id, items AS items_per_pack, CASE WHEN contains(title, '#') THEN CAST(regexp_extract(title, '[0-9.]+') AS DOUBLE) WHEN contains(title, 'oz') THEN CAST(regexp_extract(title, '[0-9.]+') AS DOUBLE) / 16 END AS told_lb, split_part(title, ' ', 1) AS first_word, round(lb * (quantity * items), 2) AS weight_lbs
FROM (SELECT *, CASE WHEN pack = 'dz' THEN 12 WHEN pack = 'pk' AND contains(title, '6-Pk') THEN 6 ELSE 1 END AS items FROM s) LEFT JOIN map USING (title)""")
def title_weights(spark, d):
    """A bakery sheet with the weights of its titles filled in."""
    rows = _titles(spark, d)
    mapping = rows.where(F.length("title") % 2 == 1).select("title", (F.length("title") / 32.0).alias("assumed_each_weight_lb"), legacy.title_group(F.col("title")).alias("weight_group_key")).distinct()
    out = legacy.fill_weights(rows, mapping)
    return out.select("id", "items_per_pack", legacy.told_weight_lb(F.col("title")).alias("told_lb"), F.split("title", " ")[0].alias("first_word"), "weight_lbs")


@query(f"""WITH {TITLES_SQL} SELECT g AS weight_group_key, count(*) AS n FROM (SELECT CASE split_part(title, ' ', 1) WHEN 'pullman' THEN 'pullman_loaf' WHEN 'bun' THEN 'sandwich_roll_6in' WHEN 'tart' THEN 'unknown' ELSE split_part(title, ' ', 1) END AS g FROM s) GROUP BY g""")
def title_groups(spark, d):
    return _titles(spark, d).groupBy(legacy.title_group(F.col("title")).alias("weight_group_key")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey AS id, ' ' || upper(p_type) AS item FROM part), d AS (SELECT lower(p_type) AS k, min(p_partkey) AS o FROM part WHERE p_type <> 'SMALL' GROUP BY ALL)
SELECT id, CASE WHEN k IS NOT NULL THEN 'sub ' || length(k) END AS sub_category FROM s LEFT JOIN d ON lower(trim(item)) = k""")
def subcategory_join(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_type")).alias("item"))
    known = part.where("p_type <> 'SMALL'").select(F.col("p_type").alias("item"), F.concat(F.lit("sub "), F.length("p_type").cast("string")).alias("sub_category"), F.col("p_partkey").alias("ord"))
    return menu.with_subcategory(rows, known).select("id", "sub_category")
