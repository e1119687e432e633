"""CSV sources and sinks. Every column is read as text, in file order."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provender.functions.text import clean, known, plain_number
from provender.operators.ingest import Dictionaries


def read_text_csv(spark: SparkSession, path: str, *, skip: int = 0) -> DataFrame:
    """All columns as text under the header's own names, with ``ord`` in file order.

    Quoted cells may hold line breaks. ``skip`` lines before the header of each file are junk: the header is then read by
    position and the junk filtered by its place, as Spark's reader has no such option. A column without a name is _c and its place.
    """
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"')
    if not skip:
        df = reader.option("header", True).option("inferSchema", False).csv(path)
        return df.select("*", F.monotonically_increasing_id().alias("ord"))
    # a row of more cells than the schema's one is kept whole in the last column: that is the header, whatever its width
    one = spark.read.schema("`_c0` string, `_whole` string").option("columnNameOfCorruptRecord", "_whole").option("multiLine", True).option("quote", '"').option("escape", '"').option("header", False).csv(path)
    line = one.select("_c0", "_whole", _place().alias("ord"), _file().alias("file")).where(F.col("ord") == skip).orderBy("file").first()
    names = [line["_c0"]] if line["_whole"] is None else next(csv.reader(io.StringIO(line["_whole"], newline="")))
    names = [x or f"_c{i}" for i, x in enumerate(names)]
    return read_wide_csv(spark, path, names, skip=skip)


def _file() -> Column:
    return F.col("_metadata.file_path")


def _place() -> Column:
    """A row's place in its file. A file of many lines a cell is one partition, but small files may share one."""
    return F.row_number().over(Window.partitionBy(_file()).orderBy(F.monotonically_increasing_id())) - 1


def read_wide_csv(spark: SparkSession, path: str, columns: list[str], *, skip: int = 0) -> DataFrame:
    """As read_text_csv with a fixed header: junk lines may be narrower than the table, so the schema is given."""
    schema = ", ".join(f"`_c{i}` string" for i in range(len(columns)))
    rows = spark.read.schema(schema).option("multiLine", True).option("quote", '"').option("escape", '"').option("header", False).csv(path)
    rows = rows.select(_place().alias("ord"), "*") if skip >= 0 else rows.select(F.monotonically_increasing_id().alias("ord"), "*")
    return rows.where(F.col("ord") > skip).select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(columns)), "ord")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_dictionaries(spark: SparkSession, folder: str, present: set[str] | None = None) -> Dictionaries:
    """The weight dictionaries of a folder. Files are small tables of a few dozen rows that are compiled into expressions."""
    d = Dictionaries()

    def rows(name, *cols):
        df = read_text_csv(spark, f"{folder}/{name}.csv")
        return [tuple(r) for r in df.orderBy("ord").select(*cols).collect()]

    wanted = lambda name: present is None or name in present
    for key in ("benjerrys", "kikkasushi", "espostos", "citybaking"):
        if wanted(key):
            d.patterns[key] = [(p, float(w)) for p, w in rows(f"{key}_weight_dictionary", "pattern", "assumed_each_weight_lb")]
    if wanted("sysco_number10_can"):
        d.patterns["sysco_number10_can"] = [(p, float(w)) for p, w in rows("sysco_number10_can_dictionary", "pattern", "assumed_each_weight_lb")]
    if wanted("gal_density"):
        d.patterns["gal_density"] = [(p, float(w)) for p, w in rows("gal_density_dictionary", "pattern", "density_lb_per_gal")]
    for key in ("bordenaves", "bimbobakery"):
        if wanted(key):
            d.titles[key] = [(p, float(w)) for p, w in rows(f"{key}_weight_dictionary_by_title", "title", "assumed_each_weight_lb")]
    shared = "sysco_cross_campus_case_weight_lookup"
    if present is None and exists(spark, f"{folder}/{shared}.csv") or present is not None and "sysco_cross_campus" in present:  # not every folder has it; looked up by the upper-cased title
        d.titles["sysco_cross_campus"] = [(p.upper(), float(w)) for p, w in rows(shared, "title", "assumed_each_weight_lb")]
    for key in ("count_based_food", "sysco_ct_food", "ucr_count_food"):
        if wanted(key):
            d.counts[key] = [(p, float(w), f) for p, w, f in rows(f"{key}_dictionary", "pattern", "reference_weight_lb", "formula")]
    return d


def load_keywords(raw: DataFrame) -> DataFrame:
    """(ord, keyword, category) of the keyword file: the first two columns, trimmed, without blanks; the order breaks ties."""
    first, second = [c for c in raw.columns if c != "ord"][:2]
    return raw.select("ord", F.trim(F.col(f"`{first}`")).alias("keyword"), F.trim(F.col(f"`{second}`")).alias("category")).where("keyword <> '' and category <> ''")


def load_all(spark: SparkSession, folder: str, target: str) -> dict[str, int]:
    """Reads every reference table of a folder, replaces the stored ones, and says how many rows each has."""
    jobs = {"campuses": ("campuses", load_campuses), "certification_types": ("certification_types", load_certifications), "taxonomy": ("simap_categories", load_taxonomy), "food_groups": ("food_groups", load_food_groups)}
    counts = {}
    for table, (name, load) in jobs.items():
        replace_table(load(read_text_csv(spark, f"{folder}/{name}.csv")), f"{target}/{table}")
        counts[table] = spark.read.parquet(f"{target}/{table}").count()
    return counts


def load_campuses(raw: DataFrame) -> DataFrame:
    return raw.select(*(clean(F.col(a)).alias(b) for a, b in (("Campus", "campus"), ("Primary_standard", "primary_standard"), ("Campus_type", "campus_type"), ("abbreviation", "abbreviation"))))


def load_certifications(raw: DataFrame) -> DataFrame:
    text = [clean(known(F.col(c))).alias(c) for c in ("certification_name", "abbreviation", "frameworks", "qualifier")]
    return raw.select("ord", *text, F.when(F.lower(F.trim("needs_review")) == "true", 1).otherwise(0).alias("needs_review"))


def load_taxonomy(raw: DataFrame) -> DataFrame:
    number = lambda c, name: plain_number(F.col(f"`{c}`")).alias(name)
    return raw.select("ord", F.trim("`Meat type`").alias("meat_type"), F.trim("`Food Category`").alias("food_category"), number("C_footprint_kg_C_per_kg_food", "factor"), number("C footprint local (kg eCO2 / kg food)", "factor_local"), number("Nitrogen Content", "nitrogen_content"), number("Conventional virtual N factor (kg N loss / kg N food)", "virtual_n_factor"), number("Food waste", "food_waste"))


def load_food_groups(raw: DataFrame) -> DataFrame:
    return raw.select(F.trim("simap_category").alias("category"), F.trim("food_group").alias("food_group"))


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A full reload: the new snapshot takes the old one's place."""
    df.write.mode("overwrite").parquet(path)
