"""Filter interaction audit: what each filter removes in every order of the filters, from counts by mask and a subset-zeta transform."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import settle

SPACES = r"[\x20\x09-\x0D]+"


def text_filters(text: str = "text") -> dict[str, Column]:
    """The failure conditions that look at a text alone: A under 200 words, B under half of the words distinct, C over 2% of
    the characters A-Z, D one of the marks #$%&*|. Null texts are empty: they fail A only."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACES), lambda w: w != "")
    upper = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 200, "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, "C": upper * 100 > F.length(whole) * 2, "D": whole.rlike("[#$%&*|]")}


def _bit(order: list[str], letter: str) -> int:
    return 1 << order.index(letter)


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = "E", *, part: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they fail, bit i for the i-th letter in
    alphabetical order.

    ``copies`` is the letter of the filter that a text fails if a smaller id has the same text anywhere in the table. Texts meet
    by SHA-256, so only 32 bytes of each are shuffled. Rows are counted by digest, part and label before they meet, so a group
    of any number of copies comes down to a row a part and label; the smallest id of a text is joined back to these.
    """
    letters = sorted([*filters, *([copies] if copies else [])])
    mask = F.lit(0)
    for letter, fails in filters.items():
        mask = mask + F.when(fails, _bit(letters, letter)).otherwise(0)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("_mask"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("_text"))
    known = labels.where(f"{id_col} is not null").groupBy(F.col(id_col).alias("_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    rows = rows.join(known, "_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_good", "_toxic")})
    n = lambda when=None: F.sum("_n" if when is None else F.when(F.col(when), F.col("_n")).otherwise(0))
    if copies is None:
        cells = rows.withColumn("_n", F.lit(1))
    else:
        keys = ["_text", "part", "_mask", "_good", "_toxic"]
        # an id may stand in several rows: they are counted first, so that the rows of the smallest id are known as a number
        by_id = rows.groupBy(*keys, "_id").agg(F.count("*").alias("_n"))
        cells = settle(by_id.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.min("_id").alias("_low"), F.min_by("_n", "_id").alias("_at_low"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_no_id")))
        first = cells.groupBy("_text").agg(F.min("_low").alias("_first"))
        cells = cells.join(first, "_text")
        clean = F.col("_no_id") + F.when(F.col("_low") == F.col("_first"), F.col("_at_low")).otherwise(0)
        both = F.array(F.struct(F.col("_mask"), clean.alias("_n")), F.struct((F.col("_mask") + _bit(letters, copies)).alias("_mask"), (F.col("_n") - clean).alias("_n")))
        cells = cells.select("part", "_good", "_toxic", F.explode(both).alias("_c")).select("part", "_good", "_toxic", "_c.*")
    # the rows that copies collapse into can still be many in one part: they are counted by mask before parts meet
    return cells.groupBy("part", F.col("_mask").alias("mask")).agg(n().alias("n"), n("_good").alias("good"), n("_toxic").alias("toxic"))


def _count_of(name: str):
    return lambda mask: F.coalesce(F.element_at("_m", mask)[name], F.lit(0)).cast("long")


def _with_subset(counts: str, bit: int):
    """One step of the transform: a mask that has the bit takes in what the mask without it counts."""
    return lambda x, mask: F.when(mask.bitwiseAND(bit) != 0, x + F.get(F.col(counts), mask - bit)).otherwise(x)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", **columns: str) -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A letter names a filter; every order of them is applied left to right. Documents are counted by part and mask of failed
    filters; a subset-zeta transform of these counts says how many survive any set of filters, and so each step of each order is
    the difference of two neighbouring sets, likewise for labels. What comes after the masks works on 2^k numbers a part.
    Six filters make 4,320 rows a part, eight 322,560; more are refused.

    Null texts are empty texts, a null part is ''. A row without an id is no copy and has no label; rows that share an id are
    no copies of each other. A document with several labels has each that one of them gives. An empty table has no parts
    and so no rows. Other columns aren't looked at, whatever their names.
    """
    filters = text_filters(columns.get("text", "text")) if filters is None else filters
    letters = sorted([*filters, *([copies] if copies else [])])
    k = len(letters)
    if not 0 < k <= 8 or any(len(x) != 1 for x in letters) or len(set(letters)) < k:
        raise ValueError("one to eight filters, each named by a letter of its own")
    full = (1 << k) - 1
    per_part = settle(masks(docs, labels, filters, copies, **columns)).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit(full))
    counts = ("n", "good", "toxic")
    per_part = per_part.withColumns({f"_z_{c}": F.transform(every, _count_of(c)) for c in counts})
    # survivors of a set of filters fail none of them: they are those whose masks lie within the set's complement
    for b in range(k):  # a step a projection: nested in one expression they would grow with 3^k
        per_part = per_part.withColumns({f"_z_{c}": F.transform(f"_z_{c}", _with_subset(f"_z_{c}", 1 << b)) for c in counts})
    left = lambda c, of: F.get(F.col(f"_z_{c}"), F.lit(full) - of)
    # a filter comes after a given set of others in |set|! (k - 1 - |set|)! orders
    weight = lambda of: math.factorial(of.bit_count()) * math.factorial(k - 1 - of.bit_count())
    worth = [sum(((left("n", F.lit(of)) - left("n", F.lit(of | 1 << i))) * weight(of) for of in range(full + 1) if not of >> i & 1), F.lit(0).cast("long")) for i in range(k)]
    per_part = settle(per_part.drop("_m").withColumn("_worth", F.array(*worth)))
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(letters)))
    place = lambda at: F.array_position(F.array(*map(F.lit, letters)), F.substr("filter_order", at, F.lit(1))).cast("int")
    bit_at = lambda at: F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), place(at))
    rows = per_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    rows = rows.withColumns({"_bit": bit_at(F.col("step")), "_now": F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, i: a + bit_at(i))})
    before, now, bit = F.col("_now") - F.col("_bit"), F.col("_now"), F.col("_bit")
    lost = lambda c: left(c, before) - left(c, now)
    return rows.select(
        "part", "filter_order", "step", left("n", now).alias("kept"), lost("n").alias("removed"), (left("n", F.lit(0)) - left("n", bit) - lost("n")).alias("redundant"),
        (left("n", F.lit(full) - bit) - left("n", F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("_worth", place(F.col("step"))).alias("shapley"),
    )


#: The same in SQL, without the transform: each step counts the masks that it meets.
SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit, list_sum(list_transform(range(1, step + 1), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS upto FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, letter, sum(n) FILTER (mask & upto = 0) AS kept, sum(n) FILTER (mask & (upto - bit) = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & (upto - bit) <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & (upto - bit) = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & (upto - bit) = 0 AND mask & bit <> 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM x"""
