"""Category classification: keywords, campus columns, overrides; and certification checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions import text
from provender.functions.similarity import set_ratio, sort_ratio, token_set_ratio, token_sort_ratio  # noqa: F401
from provender.operators import patterns

# Categories and words of the overrides.
DAIRY = ["Milk (cow's milk)", "Butter", "Cream", "Cheese", "Ice cream", "Yogurt"]
PLANT_MILKS = {"oat": "Oat milk", "soy": "Soy milk", "almond": "Almond milk", "rice": "Rice milk"}
PLANTS_WITHOUT = ["coconut", "pea"]
DAIRY_FREE = r"(?i)\b(?:vegan|non-dairy|non dairy|dairy-free|dairy free|plant-based|plant based)\b"
FLAVOURS = ["berry", "blackberry", "raspberry", "cranberry", "blueberry", "strawberry", "grape", "coconut", "peach", "pear", "apple", "mango", "cherry", "lemon", "lime", "orange", "grapefruit", "banana", "pineapple"]
FLAVOUR_CATEGORIES = ["Berries", "Fruits (misc.)", "Citrus Fruit", "Sugars and sweeteners"]
NOT_PRODUCE = ["bar", "candy", "gum", "cookie", "cookies", "donut", "pastry", "danish", "scone", "dessert", "gelato", "sorbet", "sorbetto", "jam", "preserves", "syrup", "topping", "sauce", "dressing", "yogurt", "drink", "bev", "juice", "soda", "tea", "kombucha", "water", "snack", "chew", "granola", "cereal", "loaf", "pie", "tart", "muffin", "waffle", "pancake", "popsicle", "gelatin", "gummy", "gummi", "sandwich", "salad", "chip", "chips", "vinaigrette", "hibiscus", "energy", "supplement", "gatorlyte", "gatorade", "tums", "smoothie", "milkshake"]
FRESH_BEANS = r"(?i)\b(?:green\s?beans?|wax\s?beans?|romano\s?beans?|haricot|french\s?beans?|blue\s?lake\s?beans?|snap\s?beans?|string\s?beans?)\b"
# Certification aliases and the framework of each campus type.
FRAMEWORKS = {"Academic": "AASHE STARS", "Health": "Practice Greenhealth"}
ALIASES = {"organic": "USDA Organic (incl. CCOF)", "antibiotic free": "No Antibiotics Ever (NAE)", "monterey aquarium best choice green": "Monterey Bay Aquarium Seafood Watch", "gap 4 certified": "Global Animal Partnership Certified"}
HEALTH_ALIASES = {"fair trade": "Fairtrade International"}


def keyword_match(names: DataFrame, keywords: DataFrame, name: str = "name") -> DataFrame:
    """(name, keyword, category) of the longest keyword found, then the earliest, then the first in the dictionary.

    keywords: (ord, keyword, category), ord a number of each row. Works on distinct names; a name is tried with the keywords
    of which it holds a literal.
    """
    words = keywords.select("ord", "keyword", "category", text.keyword_pattern(F.col("keyword")).alias("_p"))
    hits = patterns.matches(names.select(name).distinct(), words, name, "_p")
    rank = F.struct(-F.length("keyword"), F.expr(f"regexp_instr({name}, _p)"), F.col("ord"))
    return hits.groupBy(name).agg(F.min_by(F.struct("keyword", "category"), rank).alias("_w")).select(name, "_w.keyword", "_w.category")


def campus_category(raw: DataFrame, columns: list[str]) -> DataFrame:
    """(campus, raw_name, value): the first row's first value that isn't blank, over columns from finer to coarser."""
    value = F.coalesce(*(text.clean(F.col(c)) for c in columns))
    return raw.withColumn("_v", value).where("_v is not null and raw_name is not null").groupBy("campus", "raw_name").agg(F.min_by("_v", "ord").alias("value"))


def alias_category(aliases: DataFrame, lookup: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, value, category) of each product that has one: its aliases are tried in order, and the first counts whose reported value
    is in the dictionary, letter for letter.

    aliases: id, campus, raw_name, ord; lookup: campus, raw_name, value (campus_category); categories: value, category. A value
    that the dictionary doesn't know is passed over, and the next alias is tried. One equi-join each and a grouped minimum: a
    product with very many aliases folds before the shuffle.
    """
    known = categories.where("value is not null").groupBy("value").agg(F.first("category").alias("category"))
    found = aliases.select("id", "ord", "campus", "raw_name").join(lookup, ["campus", "raw_name"]).join(known, "value")
    return found.groupBy("id").agg(F.min_by(F.struct("value", "category"), "ord").alias("_v")).select("id", "_v.value", "_v.category")


def _plural(word: str) -> str:
    return rf"(?i)\b{word}s?\b"


def _words(name: Column, words: list[str], pattern) -> Column:
    return F.concat_ws(",", *(F.when(name.rlike(pattern(w)), F.lit(w)) for w in words))


def plant_based(name: Column, category: Column) -> Column:
    """struct(category, source) where a plant-based product sits in a dairy category, else null."""
    every = [*PLANT_MILKS, *PLANTS_WITHOUT]
    beside = _words(name, every, lambda w: rf"(?i)\b{w}\s?milk\b|\bmilk\s?{w}\b")
    bare = _words(name, every, _plural)
    marked = name.rlike(DAIRY_FREE)
    found = F.when(beside != "", beside).when(marked, bare).otherwise("")
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit("unclassified").alias("source"))
    out = F.when((found == "") & ~marked, F.lit(None))
    for w, milk in PLANT_MILKS.items():
        out = out.when(found == w, F.struct(F.lit(milk).alias("category"), F.lit("plant_based_override").alias("source")))
    oils = (found == "") & category.isin("Butter", "Milk (cow's milk)") & name.rlike(_plural("butter"))
    out = out.when(oils, F.struct(F.lit("Vegetable oils").alias("category"), F.lit("plant_based_override").alias("source"))).otherwise(none)
    return F.when(category.isin(DAIRY), out)


def flavour_confusion(name: Column, category: Column, source: Column, keyword: Column) -> Column:
    """A fruit that is only a flavour leaves a product unclassified; keyword matches only."""
    hit = (source == "keyword_match") & category.isin(FLAVOUR_CATEGORIES) & F.lower(keyword).isin(FLAVOURS) & name.rlike(rf"(?i)\b(?:{'|'.join(NOT_PRODUCE)})\b")
    return F.when(hit, F.struct(F.lit(None).cast("string").alias("category"), F.lit("unclassified").alias("source")))


def fresh_beans(name: Column, category: Column) -> Column:
    hit = (category == "Beans and pulses (dried)") & name.rlike(FRESH_BEANS)
    return F.when(hit, F.struct(F.lit("Vegetables (misc.)").alias("category"), F.lit("keyword_match").alias("source")))


def classify(products: DataFrame, keywords: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """products (name, ...) with category, source and keyword. reported: (name, category), stronger than keywords."""
    found = keyword_match(products, keywords)
    out = products.join(found.withColumnsRenamed({"category": "_kc"}), "name", "left")
    out = out.join(reported.select("name", F.col("category").alias("_rc")), "name", "left") if reported is not None else out.withColumn("_rc", F.lit(None).cast("string"))
    category = F.coalesce("_rc", "_kc")
    source = F.when(F.col("_rc").isNotNull(), "campus_category").when(F.col("_kc").isNotNull(), "keyword_match").otherwise("unclassified")
    out = out.withColumns({"_c": category, "_s": source})
    name, c, s = F.col("name"), F.col("_c"), F.col("_s")
    over = F.coalesce(plant_based(name, c), flavour_confusion(name, c, s, F.col("keyword")), fresh_beans(name, c), F.struct(c.alias("category"), s.alias("source")))
    return out.withColumn("_o", over).withColumns({"category": F.col("_o.category"), "source": F.col("_o.source")}).drop("_kc", "_rc", "_c", "_s", "_o")


def certification_flags(claims: DataFrame, certificates: DataFrame, least: float = 85.0) -> DataFrame:
    """(text, campus_type, flag): 0 if every certification claimed is known and of the campus type's framework.

    claims: (text, campus_type), distinct texts are checked once. certificates: (ord, certification_name, abbreviation,
    frameworks). A part is an alias, an exact abbreviation, or the best name of at least 85; of one word by sorted tokens,
    of several by token sets. Blank texts are 0.
    """
    distinct = claims.select("text", "campus_type").distinct()
    part = F.explode(F.filter(F.transform(F.split("text", "[,;]"), text.strip), lambda p: p != "")).alias("part")
    parts = distinct.where(text.clean(F.col("text")).isNotNull()).select("text", "campus_type", part)
    low = F.lower("part")
    alias = text.recode(low, ALIASES, "")
    scoped = F.when(F.col("campus_type") == "Health", text.recode(low, HEALTH_ALIASES, "")).otherwise("")
    parts = parts.withColumn("part", F.coalesce(F.nullif(scoped, F.lit("")), F.nullif(alias, F.lit("")), F.col("part")))
    parts = parts.withColumn("framework", text.recode(F.col("campus_type"), FRAMEWORKS, ""))
    known = certificates.select("ord", "certification_name", F.lower(text.strip(F.col("abbreviation"))).alias("short"), F.transform(F.split("frameworks", ";"), text.strip).alias("covers"))
    exact = known.where("short <> ''").groupBy("short").agg(F.max_by("covers", "ord").alias("covers"))
    by_short = parts.join(exact, F.lower("part") == F.col("short"), "left")
    distinct_parts = by_short.where("covers is null").select("part").distinct()
    a, b = text.process(F.col("part")), text.process(F.col("certification_name"))
    several = F.size(F.split(text.strip(F.col("part")), r"\s+")) > 1
    scored = distinct_parts.crossJoin((known.select("ord", "certification_name", F.col("covers").alias("named")))).withColumn("score", F.when(several, token_set_ratio(a, b)).otherwise(token_sort_ratio(a, b)))
    best = scored.where(F.col("score") >= least).groupBy("part").agg(F.min_by("named", F.struct(-F.col("score"), F.col("ord"))).alias("named"))
    judged = by_short.join(best, "part", "left").withColumn("_ok", F.coalesce(F.array_contains(F.coalesce("covers", "named"), F.col("framework")), F.lit(False)))
    flags = judged.groupBy("text", "campus_type").agg(F.max(F.when(F.col("_ok"), 0).otherwise(1)).alias("flag"))
    return distinct.join(flags, ["text", "campus_type"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def validated(yn: Column, flag: Column) -> Column:
    """A claim counts only if its certifications do."""
    return F.when((yn == "Y") & (flag == 1), "N").otherwise(yn)
