"""Scalar parsing of purchase text: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and factors to pounds, gallons.
POUNDS = {"LB": 1.0, "LBS": 1.0, "POUND": 1.0, "POUNDS": 1.0, "OZ": 1.0 / 16.0, "KG": 2.20462, "KGS": 2.20462, "KILO": 2.20462, "G": 0.00220462, "GM": 0.00220462, "GMS": 0.00220462}
LITERS_PER_GALLON = 3.78541
MIN_CASE_LB = 1.0
NUMBER = r"\d+(?:\.\d+)?"
VOLUME = r"(?:\d+(?:\.\d+)?|\.\d+)"
UNIT = "LBS?|POUNDS?|OZ|KGS?|KILO|GMS?|G"
PACK_MULTIPLE = rf"(?i)^({NUMBER})\s*[/ ]\s*({NUMBER})\s*({UNIT})\s*(?:AVG?|AV)?$"
PACK_RANGE = rf"(?i)^({NUMBER})\s*-\s*({NUMBER})\s*#?\s*({UNIT})?\s*(?:AVG?|AV)?$"
PACK_BARE = rf"(?i)^({NUMBER})\s*(#)?\s*({UNIT})?\s*(?:AVG?|AV)?$"
WEIGHT_CHAIN = rf"(?i)((?:{NUMBER}\s*/\s*)+{NUMBER})\s*-?\s*(?:(LB|OZ)\b|(#))"
WEIGHT_BARE = rf"(?i)({NUMBER})\s*-?\s*(?:(LB)\b|(#))"
COUNT_CHAIN = r"(?i)((?:\d+\s*/\s*)+\d+)\s*-?\s*CT\b"
COUNT_RANGE = r"(?i)(\d+)\s*-\s*(\d+)\s*-?\s*CT\b"
COUNT_BARE = r"(?i)(\d+)\s*-?\s*CT\b"
COUNT_PAREN = r"\((\d+)\)"
DOZEN_CHAIN = r"(?i)((?:\d+\s*/\s*)+\d+)\s*-?\s*(?:DZ|DOZ)\b"
DOZEN_BARE = r"(?i)(\d+)\s*-?\s*(?:DZ|DOZ)\b"
GALLON_MIXED = r"(?i)(\d+)[\s-]+(\d+)\s*/\s*(\d+)\s*-?\s*GAL(?:LONS?)?\b"
GALLON_CHAIN = rf"(?i)({VOLUME})\s*/\s*({VOLUME})\s*-?\s*GAL(?:LONS?)?\b"
GALLON_BARE = rf"(?i)({VOLUME})\s*-?\s*GAL(?:LONS?)?\b"
LITER_CHAIN = rf"(?i)({VOLUME})\s*/\s*({VOLUME})\s*-?\s*(L(?:TR|T)?|ML)\b"
LITER_BARE = rf"(?i)({VOLUME})\s*-?\s*(L(?:TR|T)?|ML)\b"
GRAM_CHAIN = rf"(?i)({NUMBER})\s*/\s*({NUMBER})\s*-?\s*G\b"
GRAM_BARE = rf"(?i)({NUMBER})\s*-?\s*G\b"
NON_FOOD_VOLUME = r"(?i)LINER|SANITIZER|CLEANER|CLEANING|\bPUMP\b|SOAP"
# What pandas reads as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DIET_TAGS = ["x", "vegetarian", "vegan", "plant-based alternative proteins"]
CORPORATE = r"\b(?:corporation|corp|incorporated|inc|llc|l\.l\.c|lp|l\.p|co|company)\.?\s*$"
SYNONYMS = {"LIQ": "LIQUID", "PERUVIAN": "PERU", "CT": "COUNT", "PEEL": "PEELED", "GUMMI": "GUMMY", "FCY": "FANCY", "WHL": "WHOLE", "GRTD": "GRATED"}


def group(text: Column, pattern: str, n: int) -> Column:
    """The n-th group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def number(text: Column, pattern: str, n: int = 1) -> Column:
    return group(text, pattern, n).try_cast("double")


def strip(text: Column) -> Column:
    """Trims white space of all kinds."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(strip(text), F.lit(""))


def known(text: Column) -> Column:
    """Null for the tokens that stand for missing values in CSV files."""
    return F.when(~text.isin(NA_TOKENS), text)


def plain_number(text: Column) -> Column:
    """A number only if it looks like one: no '1d', 'NaN' or 'inf'. Commas are dropped."""
    bare = strip(F.regexp_replace(text, ",", ""))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def currency(text: Column) -> Column:
    return plain_number(F.regexp_replace(strip(text), "[$,]", ""))


def join_tags(columns: list[Column], drop: list[str] = DIET_TAGS) -> Column:
    """Certification columns joined by ', ' without blanks, check marks and diet tags; null if none is left."""
    kept = F.filter(F.array(*(clean(c) for c in columns)), lambda x: x.isNotNull() & ~F.lower(x).isin(drop))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def recode(text: Column, values: dict[str, str], otherwise: str = "NA") -> Column:
    out = F.lit(otherwise)
    for k, v in reversed(list(values.items())):
        out = F.when(text == k, v).otherwise(out)
    return out


def pound_factor(unit: Column) -> Column:
    """Pounds per unit; 1 for no unit, null for one that is no weight."""
    out = F.lit(None).cast("double")
    for u, f in POUNDS.items():
        out = F.when(F.upper(unit) == u, f).otherwise(out)
    return F.when(unit.isNull(), 1.0).otherwise(out)


def product(chain: Column) -> Column:
    """'a/b/c' multiplied."""
    return F.aggregate(F.split(chain, "/"), F.lit(1.0), lambda total, x: total * F.trim(x).cast("double"))


def pack_size_lb(text: Column) -> Column:
    """Pounds of a case from its pack size; the first of three shapes that fits; under a pound says nothing."""
    s = strip(text)
    multiple = number(s, PACK_MULTIPLE, 1) * number(s, PACK_MULTIPLE, 2) * pound_factor(group(s, PACK_MULTIPLE, 3))
    spread = (number(s, PACK_RANGE, 1) + number(s, PACK_RANGE, 2)) / 2 * pound_factor(group(s, PACK_RANGE, 3))
    marked = group(s, PACK_BARE, 2).isNotNull() | group(s, PACK_BARE, 3).isNotNull()
    bare = F.when(marked, number(s, PACK_BARE, 1) * pound_factor(group(s, PACK_BARE, 3)))
    found = F.when(s.rlike(PACK_MULTIPLE), multiple).when(s.rlike(PACK_RANGE), spread).when(s.rlike(PACK_BARE), bare)
    return F.when(found >= MIN_CASE_LB, found)


def _shaped(*rungs: tuple[Column, Column, str]) -> Column:
    """struct(value, shape) of the first rung whose condition holds; shape 'none' without a value otherwise."""
    out = F.struct(F.lit(None).cast("double").alias("value"), F.lit("none").alias("shape"))
    for condition, value, shape in reversed(rungs):
        out = F.when(condition, F.struct(value.alias("value"), F.lit(shape).alias("shape"))).otherwise(out)
    return out


def name_weight(name: Column) -> Column:
    chain = group(name, WEIGHT_CHAIN, 1)
    ounces = F.upper(group(name, WEIGHT_CHAIN, 2)) == "OZ"
    total = product(chain) / F.when(ounces, 16.0).otherwise(1.0)
    return _shaped((chain.isNotNull(), total, "chain"), (name.rlike(WEIGHT_BARE), number(name, WEIGHT_BARE), "bare"))


def name_case_lb(name: Column) -> Column:
    value = name_weight(name)["value"]
    return F.when(value >= MIN_CASE_LB, value)


def name_count(name: Column) -> Column:
    return _shaped(
        (name.rlike(COUNT_CHAIN), product(group(name, COUNT_CHAIN, 1)), "chain"),
        (name.rlike(COUNT_RANGE), (number(name, COUNT_RANGE, 1) + number(name, COUNT_RANGE, 2)) / 2.0, "range"),
        (name.rlike(COUNT_BARE), number(name, COUNT_BARE), "bare"),
        (name.rlike(COUNT_PAREN), number(name, COUNT_PAREN), "paren"),
    )


def dozen_count(name: Column) -> Column:
    return F.coalesce(product(group(name, DOZEN_CHAIN, 1)), number(name, DOZEN_BARE)) * 12.0


def gallons(name: Column) -> Column:
    mixed = number(name, GALLON_MIXED, 1) + F.try_divide(number(name, GALLON_MIXED, 2), number(name, GALLON_MIXED, 3))
    return _shaped(
        (name.rlike(GALLON_MIXED), mixed, "chain"),
        (name.rlike(GALLON_CHAIN), number(name, GALLON_CHAIN, 1) * number(name, GALLON_CHAIN, 2), "chain"),
        (name.rlike(GALLON_BARE), number(name, GALLON_BARE), "bare"),
    )


def liters_as_gallons(name: Column) -> Column:
    def scale(pattern, n):
        return F.when(F.upper(group(name, pattern, n)) == "ML", 0.001).otherwise(1.0)

    chain = number(name, LITER_CHAIN, 1) * number(name, LITER_CHAIN, 2) * scale(LITER_CHAIN, 3) / LITERS_PER_GALLON
    return _shaped((name.rlike(LITER_CHAIN), chain, "chain"), (name.rlike(LITER_BARE), number(name, LITER_BARE) * scale(LITER_BARE, 2) / LITERS_PER_GALLON, "bare"))


def grams_as_pounds(name: Column) -> Column:
    chain = number(name, GRAM_CHAIN, 1) * number(name, GRAM_CHAIN, 2) * POUNDS["G"]
    return _shaped((name.rlike(GRAM_CHAIN), chain, "chain"), (name.rlike(GRAM_BARE), number(name, GRAM_BARE) * POUNDS["G"], "bare"))


def each_ounces_lb(name: Column) -> Column:
    return number(name, rf"(?i)({NUMBER})\s*oz\b") / 16.0


def pack_units(pack: Column) -> Column:
    return number(pack, r"(?i)(\d+)\s*units?\b")


def pack_multiplier(pack: Column, name: Column) -> Column:
    """Each 1, dozen 12, pack the N of 'N-pk' in the name."""
    p = F.lower(strip(pack))
    return F.when(p == "ea", 1.0).when(p == "dz", 12.0).when(p == "pk", number(name, r"(?i)(\d+)\s*-?\s*pk\b"))


def plausible(weight: Column, price: Column, ceiling: float = 20.0, null_price: bool = True) -> Column:
    """The weight unless price per pound is over the ceiling; a missing price keeps it or not."""
    within = price / F.nullif(weight, F.lit(0.0)) <= ceiling
    return F.when(F.coalesce(within, F.lit(null_price)), weight)


def normal_vendor(vendor: Column) -> Column:
    v = F.regexp_replace(F.lower(strip(vendor)), "[.,]", "")
    v = strip(F.regexp_replace(v, r"\s+", " "))
    return clean(F.regexp_replace(v, CORPORATE, ""))


def clean_name(name: Column) -> Column:
    """A product's name for comparison."""
    c = F.regexp_replace(name, r"(?i)\s*\(SUS\)\s*$", "")
    c = F.translate(c, "‘’“”", "''\"\"")
    c = F.regexp_replace(c, r"^(\w+)\s+([Ss])\b", "$1$2")
    c = F.regexp_replace(c, "[()]", "")
    c = F.regexp_replace(c, r"(\d)\s*#", "$1 LB ")
    for word, to in SYNONYMS.items():
        c = F.regexp_replace(c, rf"(?i)\b{word}\b", to)
    return strip(F.regexp_replace(c, r"\s+", " "))


def process(text: Column) -> Column:
    """Letters, digits and underscores stay, in lower case; all else is a space; trimmed."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\W", " ")))


def sorted_tokens(processed: Column) -> Column:
    """Tokens in order: two texts of equal tokens are then equal, and a ratio of them needs no sorting."""
    return F.array_join(F.array_sort(F.filter(F.split(processed, " +"), lambda w: w != "")), " ")


def normal_brand(brand: Column) -> Column:
    c = F.regexp_replace(strip(brand), r"^-+\s*", "")
    c = F.regexp_replace(c, "[‘’“”`]", "'")
    return clean(F.regexp_replace(c, r"\s+", " "))


def brand_key(brand: Column) -> Column:
    return F.regexp_replace(F.lower(brand), "[^a-z0-9]", "")


def certificates(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def keyword_pattern(keyword: Column) -> Column:
    """A word-bounded pattern that also takes plurals: s, y to ies after a consonant, and es after o."""
    escaped = F.regexp_replace(keyword, r"([^A-Za-z0-9_])", r"\\$1")
    ies = F.regexp_replace(F.substr(keyword, F.lit(1), F.length(keyword) - 1), r"([^A-Za-z0-9_])", r"\\$1")
    return F.concat(F.lit(r"(?i)\b"), F.when(keyword.rlike("[^aeiouAEIOU]y$"), F.concat(F.lit("(?:"), escaped, F.lit("s?|"), ies, F.lit("ies)"))).when(keyword.endswith("o"), F.concat(escaped, F.lit("e?s?"))).otherwise(F.concat(escaped, F.lit("s?"))), F.lit(r"\b"))


def ghg_kg(pounds: Column, factor: Column) -> Column:
    return pounds * 0.45359237 * F.coalesce(factor, F.lit(0.0))


def percent_change(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, F.nullif(old, F.lit(0.0))) * 100
