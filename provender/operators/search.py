"""Cross-campus search, upload matching, brand clean-up."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions import gates, text
from provender.functions.grams import GramIndex
from provender.functions.similarity import token_set_ratio
from provender.operators.lineage import checkpointed

# Tiers of matches.
CONFIDENT, LIKELY = 97.0, 90.0


def distinct_list(value: Column) -> Column:
    """Sorted distinct values that aren't blank."""
    return F.array_sort(F.collect_set(F.when(F.trim(value) != "", value)))


def sustainable_products(products: DataFrame, purchases: DataFrame) -> DataFrame:
    """Products whose claim holds, with their campuses, vendors and brands as sorted lists, empty if none."""
    good = products.where("validated = 'Y'")
    sold = purchases.join(good.select("product_id"), "product_id", "left_semi").groupBy("product_id").agg(*(distinct_list(F.col(c)).alias(f"{c}s" if c != "campus" else "campuses") for c in ("campus", "vendor", "brand")))
    out = good.join(sold, "product_id", "left")
    for c in ("campuses", "vendors", "brands"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.withColumn("category", F.coalesce("category", F.lit("(Unclassified)"))).withColumn("cert_list", F.coalesce(text.certificates(F.col("certs")), F.array().cast("array<string>")))


def campus_vendors(purchases: DataFrame) -> DataFrame:
    return purchases.where(text.clean(F.col("vendor")).isNotNull()).select("campus", "vendor").distinct()


# The labels of an opportunity.
NEW, BOUGHT = "New via my vendor", "Already purchased"


def by_opportunity(labelled: DataFrame, column: str = "label") -> DataFrame:
    """What is new first, then what has no label, then what is bought already; names break ties."""
    rank = F.when(F.col(column) == NEW, 0).when(F.col(column) == "", 1).otherwise(2)
    return labelled.orderBy(rank, "name", "product_id")


def opportunity(campus: str, vendors: list[str]) -> Column:
    mine = F.array(*map(F.lit, vendors)) if vendors else F.array().cast("array<string>")
    return F.when(F.array_contains("campuses", campus), BOUGHT).when(F.arrays_overlap("vendors", mine), NEW).otherwise("")


def search(products: DataFrame, *, pattern: str | None = None, category: str | None = None, cert: str | None = None, vendor: str | None = None, campus: str | None = None, region: list[str] | None = None, campuses: list[str] | None = None, new_for: tuple[str, list[str]] | None = None) -> DataFrame:
    """All filters that are given hold; the text is a pattern, case aside. region: its campuses, any of which will do.
    new_for: (campus, vendors) keeps what that campus doesn't buy yet but its vendors have."""
    out = products
    if pattern:
        out = out.where(F.col("name").rlike(f"(?i){pattern}"))
    if category:
        out = out.where(F.col("category") == category)
    if cert:
        out = out.where(F.array_contains("cert_list", cert))
    if vendor:
        out = out.where(F.array_contains("vendors", vendor))
    if campus:
        out = out.where(F.array_contains("campuses", campus))
    if region:
        out = out.where(F.arrays_overlap("campuses", F.array(*map(F.lit, region))))
    if new_for:
        out = out.where(opportunity(*new_for) == NEW)
    if campuses:
        out = out.where(F.arrays_overlap("campuses", F.array(*map(F.lit, campuses))))
    return out


def facet(products: DataFrame, column: str) -> DataFrame:
    return products.select(F.explode(column).alias("value")).distinct()


FACETS = ("category", "cert_list", "vendors", "brands", "campuses")


def _values(products: DataFrame, column: str) -> Column:
    """A facet's values of a product as a list, whether it has one or several."""
    kind = products.schema[column].dataType.simpleString()
    return F.coalesce(F.col(column), F.array().cast("array<string>")) if kind.startswith("array") else F.array_compact(F.array(F.col(column)))


def drill_down(products: DataFrame, chosen: dict[str, str], facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, n): how many products each value of each facet would leave, given what is chosen in the other facets.

    A product counts for a facet if it meets all choices but perhaps that facet's own; so it is looked at once for all facets
    together, and only values that something is left of come out.
    """
    values = {f: _values(products, f) for f in facets}
    misses = {f: ~F.array_contains(values[f], v) for f, v in chosen.items()}
    failed = sum((F.when(m, 1).otherwise(0) for m in misses.values()), F.lit(0))
    none = F.array().cast("array<struct<facet:string,value:string>>")

    def cells(f: str) -> Column:
        able = failed == (F.when(misses[f], 1).otherwise(0) if f in misses else F.lit(0))
        return F.when(able, F.transform(F.array_distinct(values[f]), lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value")))).otherwise(none)

    return products.select(F.explode(F.concat(*map(cells, facets))).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def explorer(products: DataFrame, by: str, beside: tuple[str, ...]) -> DataFrame:
    """(value, n_products, a sorted list for each of ``beside``): what each distributor or brand carries. Values of a list are told
    apart before they meet, so a group holds its different values and no rows."""
    own = products.select(F.explode(F.array_distinct(_values(products, by))).alias("value"), *beside)
    out = own.groupBy("value").agg(F.count("*").alias("n_products"))
    for c in beside:
        each = own.select("value", F.explode(c).alias("_v")).distinct().groupBy("value").agg(F.array_sort(F.collect_set("_v")).alias(c))
        out = out.join(each, "value", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


#: Texts of a block that goes out to all tasks.
BLOCK_TEXTS = 20_000


def similar_texts(x: DataFrame, y: DataFrame, k: int, least: float = LIKELY, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(_x, _y, _first, score): the k best texts of ``y`` (_y, _first; distinct) for each text of ``x`` (_x; distinct), those of at least
    ``least``; ties to the smaller _first.

    The texts that ask go out in blocks of about ``block_texts``, each as an inverted index of character grams; ``y`` stays where it
    is and is counted against the index. Only pairs that share as many grams as their lengths and the bound ask for are
    scored, and a text's bound rises to its k-th score so far. Each task gives k rows a text that asks at most, and these are
    merged. No pair above the bound is lost.
    """
    spark = x.sparkSession
    n = max(1, -(-x.count() // block_texts))
    asking = x.select("_x", F.pmod(F.xxhash64("_x"), F.lit(n)).alias("_block"))
    asking, y = (checkpointed(asking), checkpointed(y.select("_y", "_first"))) if n > 1 else (asking, y.select("_y", "_first"))
    kind = y.schema["_first"].dataType.simpleString()
    schema = f"_x string, _y string, _first {kind}, score double"
    parts = []
    for block in range(n):
        sent = spark.sparkContext.broadcast([r[0] for r in asking.where(F.col("_block") == block).select("_x").collect()])

        def run(batches, sent=sent):
            best = GramIndex(sent.value).best(k, least)
            next(best)
            first = []
            for b in batches:
                first.append(b.column(1))
                best.send(b.column(0).to_pylist())
            texts, at, other, score = best.send(None)
            if len(texts):
                order = pa.chunked_array(first).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(other, pa.string()), order.combine_chunks(), pa.array(score)], names=["_x", "_y", "_first", "score"])

        found = y.mapInArrow(run, schema)
        parts.append(checkpointed(found) if n > 1 else found)
    out = functools.reduce(DataFrame.unionByName, parts)
    top = Window.partitionBy("_x").orderBy(F.desc("score"), "_first")
    return out.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).drop("_r")


def match_uploads(uploads: DataFrame, corpus: DataFrame, k: int = 10, *, skip_own: bool = False) -> DataFrame:
    """Each upload (upload_id, name) with its match in the corpus (ord, name, product_id, ...), or none.

    The k highest scores are taken first, ties to the earlier row; the first of at least 90 that passes every gate counts.
    Uploads are distinct texts against distinct texts (similar_texts); a text's best k rows come from its best k texts, and of
    the rows of one text only the first k can count. With ``skip_own`` an upload's own row (product_id = upload_id) is no
    candidate, and one more is looked at for it.
    """
    k += skip_own
    # the ratio compares sorted tokens, so these are what grams are taken of
    ups = uploads.withColumn("_x", text.sorted_tokens(text.process(text.clean_name(F.col("name")))))
    rows = corpus.withColumn("_y", text.sorted_tokens(text.process(text.clean_name(F.col("name")))))
    x, y = ups.select("_x").distinct(), rows.groupBy("_y").agg(F.min("ord").alias("_first"))
    texts = similar_texts(x.where("_x is not null"), y.where("_y is not null"), k)
    named = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy("ord"))).where(F.col("_r") <= k)
    found = ups.join(texts, "_x").join(named.select("_y", "ord", F.col("name").alias("match"), "product_id"), "_y")
    best = Window.partitionBy("upload_id").orderBy(F.desc("score"), "ord")
    found = found.withColumn("_r", F.row_number().over(best)).where("product_id <> upload_id" if skip_own else "true").where((F.col("_r") <= k) & (gates.signature(F.col("name")) == gates.signature(F.col("match"))))
    first = found.groupBy("upload_id").agg(F.min_by(F.struct("match", "product_id", "score"), "_r").alias("_m"))
    tier = F.when(F.col("_m.score") >= CONFIDENT, "confident").when(F.col("_m.score") >= LIKELY, "review").otherwise("none")
    return uploads.join(first, "upload_id", "left").select(*uploads.columns, "_m.match", "_m.product_id", F.round("_m.score", 4).alias("score"), tier.alias("tier"))


def brand_mapping(rows: DataFrame) -> DataFrame:
    """(raw_brand, canonical_brand, merge_tier, n_rows): variants of one key go to the spelling of most rows, ties to one with
    small letters, then to the smallest."""
    counts = rows.where("brand is not null").groupBy(F.col("brand").alias("raw_brand")).agg(F.count("*").alias("n_rows")).withColumn("_c", text.normal_brand(F.col("raw_brand"))).withColumn("_k", text.brand_key(F.col("_c")))
    spellings = counts.where("_c is not null").groupBy("_k", "_c").agg(F.sum("n_rows").alias("_n"))
    canonical = spellings.groupBy("_k").agg(F.min_by("_c", F.struct(-F.col("_n"), ~F.col("_c").rlike("[a-z]"), F.col("_c"))).alias("canonical_brand"))
    tier = F.when(F.col("canonical_brand").isNull(), "clear_placeholder").when(F.col("raw_brand") == F.col("canonical_brand"), "unchanged").otherwise("exact_normalize")
    return counts.join(canonical, "_k", "left").select("raw_brand", "canonical_brand", tier.alias("merge_tier"), "n_rows")


def _handles(processed: Column) -> Column:
    """Tokens, and the three-character strings of the sorted tokens. Two texts that score 90 share a token or, without one, are
    so alike (at most a tenth of the characters unmatched) that some three characters in a row are common."""
    tokens = F.array_distinct(F.filter(F.split(processed, " +"), lambda w: w != ""))
    line = F.array_join(F.array_sort(tokens), " ")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(line) - 2, F.lit(1))), lambda i: F.concat(F.lit("\n"), F.substr(line, i, F.lit(3))))
    return F.explode(F.array_union(tokens, grams))


def brand_candidates(values: DataFrame, k: int = 5, least: float = 90.0) -> DataFrame:
    """(raw_brand, proposed_canonical, score): of each value's k nearest by token sets, itself among them, those of at least
    90 where one contains the other; the longer is to become the shorter.

    Only pairs that share a handle are scored; pairs under ``least`` can't push one above it out of the k nearest.
    """
    v = values.select("value").distinct().withColumn("_p", text.process(F.col("value")))
    h = v.select("value", "_p", _handles(F.col("_p")).alias("_h"))
    near = h.select(F.col("value").alias("x"), F.col("_p").alias("_x"), "_h").join(h.select(F.col("value").alias("y"), F.col("_p").alias("_y"), "_h"), "_h").select("x", "y", "_x", "_y").distinct()
    scored = near.withColumn("score", token_set_ratio(F.col("_x"), F.col("_y"))).where(F.col("score") >= least)
    top = scored.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))).where(F.col("_r") <= k)
    first = F.length("x") <= F.length("y")
    named = top.where(F.col("x") != F.col("y")).select(F.when(first, F.col("y")).otherwise(F.col("x")).alias("raw_brand"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("proposed_canonical"), F.round("score", 4).alias("score"))
    return named.where(F.contains(F.lower("raw_brand"), F.lower("proposed_canonical"))).groupBy("raw_brand", "proposed_canonical").agg(F.max("score").alias("score"))


def apply_brands(rows: DataFrame, mapping: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Purchases with clean brands; confirmed pairs (raw_brand, canonical_brand) afterwards."""
    m = mapping.select(F.col("raw_brand").alias("brand"), F.col("canonical_brand").alias("_b"), F.lit(True).alias("_hit"))
    out = rows.join(m, "brand", "left").withColumn("brand", F.when(F.col("_hit"), F.col("_b")).otherwise(F.col("brand"))).drop("_b", "_hit")
    if confirmed is not None:
        c = confirmed.select(F.col("raw_brand").alias("brand"), F.col("canonical_brand").alias("_b"))
        out = out.join(c, "brand", "left").withColumn("brand", F.coalesce("_b", "brand")).drop("_b")
    return out
