"""Near copies by the Jaccard similarity of word shingles: an exact join by prefixes, and its components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.shared import components, discard, give_back, settle

#: Least similarity of near copies, and the words of a shingle.
LEAST, WORDS = (4, 5), 5


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles. A text of fewer words is one shingle; one without words has none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(len(h) - words + 1, 1)
    total = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(len(h), words)):  # overflow wraps
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    total = (total ^ (total >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(total ^ (total >> np.uint64(31)))


def _mapped(docs: DataFrame, kind: str, of) -> DataFrame:
    """A row (doc_id, what ``of`` makes of the shingles) for each row of docs (doc_id, text)."""
    names = [x.split()[0] for x in f"doc_id long, {kind}".split(", ")]

    def run(batches):
        for b in batches:
            made = [of(shingles(t)) for t in b.column(1).to_pylist()]
            types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
            cols = [pa.array([m[i] for m in made], types[x.split()[1]]) for i, x in enumerate(kind.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)
        give_back()

    return docs.mapInArrow(run, f"doc_id long, {kind}")


def _signature(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64))


def frequent(docs: DataFrame, *, one_in: int = 16, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Shingles that many texts of a sample have. They only go last in the order of shingles, and any order gives the same pairs."""
    some = docs.where(F.xxhash64("text") % one_in == 0).dropDuplicates(["text"])
    seen = _mapped(some, "set array<long>", lambda h: [h.astype(np.int64)]).select(F.explode("set").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    return np.array([r.token for r in seen.orderBy(F.desc("count"), "token").limit(most).collect()], np.int64).astype(np.uint64)


def _may_reach(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets of these sizes whose first common shingle is at these places can be similar enough."""
    return (1 + F.least(na - pa_, nb - pb)) * (LEAST[0] + LEAST[1]) >= (na + nb) * LEAST[0]


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) of signatures whose sets are similar, by the sets themselves. pairs is settled, and gone afterwards."""
    named = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct().join(nodes.select("sig", F.col("rep").alias("doc_id")), "sig").select("doc_id").distinct()
    named = settle(named)
    if named.count() <= few:  # 8 MB of ids at most go to where the texts are
        named = F.broadcast(named)
    sets = settle(_mapped(docs.join(named, "doc_id", "left_semi").select("doc_id", "text"), "sig long, set array<long>", lambda h: (_signature(h), h.astype(np.int64))).drop("doc_id"))
    if not sets.groupBy("sig").count().where("count > 1").isEmpty():  # repeated rows
        each, sets = sets, settle(sets.dropDuplicates(["sig"]))
        discard(each)
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("set").alias("y")), "b")
    out = settle(both.where(F.size(F.array_intersect("x", "y")) * (LEAST[0] + LEAST[1]) >= (F.size("x") + F.size("y")) * LEAST[0]).select("a", "b"))
    discard(pairs, sets)
    return out


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group: int = 100, rounds: int = 5, first_links: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) for each row of docs: texts of similarity 4/5 and more are linked, and components named by their smallest id.

    Two sets this similar share a shingle among the first fifth of each, in any one order of shingles, so only these meet;
    every pair that met is then judged by its whole sets, so there are no false links and none is missed. Rows of equal
    sets are one node. ``first_links`` (a, b: ids) are likely pairs that were found otherwise (fingerprints); they are judged first.
    Where over ``group`` nodes share a shingle, each node is then compared with one leader of its shingles, for ``rounds`` leaders
    in turn; at last all pairs are judged that no link connects yet, so a large group of near copies makes few.
    Rows without an id name no component and make no links. Texts without words are all alike.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    last = frequent(plain)

    last = np.sort(last)

    def first(h):
        late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
        n = len(h)
        return _signature(h), n, np.concatenate([h[~late], h[late]])[: n - -(-n * LEAST[0] // LEAST[1]) + 1 if n else 0].astype(np.int64)

    rows = settle(_mapped(plain, "sig long, n long, prefix array<long>", first))
    plain = plain.where("doc_id is not null")
    nodes = settle(rows.where("doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")))
    one = rows.where("doc_id is not null").dropDuplicates(["sig"])
    tokens = one.select("sig", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "sig", "n", (F.col("pos") + 1).cast("long").alias("pos"))
    met = settle(tokens.withColumn("met", F.count("*").over(Window.partitionBy("token"))).where("met > 1"))

    def side(df, k):
        return df.select("token", *(F.col(c).alias(f"{k}_{c}") for c in df.columns if c != "token"))

    reach = _may_reach(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos"))
    # what two sets share beyond their prefixes is in the rest of one of them
    rest = lambda k: F.floor(F.col(f"{k}_n") * LEAST[0] / LEAST[1] + 0.999999) - 1
    enough = lambda common: (common + F.greatest(rest("a"), rest("b"))) * (LEAST[0] + LEAST[1]) >= (F.col("a_n") + F.col("b_n")) * LEAST[0]
    cols = ["token", "sig", "n", "pos"]
    heads = met.groupBy("sig").agg(F.collect_list("token").alias("heads"), F.sum(F.when(F.col("met") > group, 1).otherwise(0)).alias("hot"))

    def pairs_of(x, y, on, one_by: Column | None = None):
        """Pairs that meet, by the count of what their prefixes share; with ``one_by`` one pair a node of y, the least by it."""
        pairs = side(x, "a").join(side(y, "b"), "token").where(on)
        if one_by is None:
            pairs = pairs.select("a_sig", "a_n", "b_sig", "b_n").distinct()
        else:
            pairs = pairs.groupBy("b_sig").agg(F.min_by(F.struct("a_sig", "a_n", "b_n"), one_by).alias("x")).select("x.a_sig", "x.a_n", "b_sig", "x.b_n")
        pairs = pairs.join(heads.select(F.col("sig").alias("a_sig"), F.col("heads").alias("a_heads")), "a_sig").join(heads.select(F.col("sig").alias("b_sig"), F.col("heads").alias("b_heads")), "b_sig")
        return pairs.where(enough(F.size(F.array_intersect("a_heads", "b_heads")))).select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct()

    few, many = met.where(F.col("met") <= group), met.where(F.col("met") > group)
    links = few.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    if first_links is not None:
        of = lambda k: rows.where("doc_id is not null").select(F.col("doc_id").alias(k), F.col("sig").alias(f"{k}_sig")).distinct()
        likely = first_links.join(of("a"), "a").join(of("b"), "b").where("a_sig <> b_sig")
        links = _alike(settle(likely.select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct()), plain, nodes)
    many = many.join(heads.select("sig", "hot"), "sig")
    placed = lambda df: df.join(components(links).withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    apart = F.col("a_component") != F.col("b_component")
    for k in range(rounds):
        # tokens whose nodes are all one component are done
        of = placed(many.select(*cols, "hot"))
        split = of.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
        many = settle(of.join(split, "token", "left_semi"))
        if many.isEmpty():
            break
        # first the nodes of the most common shingles lead, which their near copies are nearest to, then any
        by = lambda c: F.struct(*([-F.col(f"{c}hot")] if k == 0 else []), F.xxhash64(f"{c}sig", F.lit(k)))  # noqa: B023, E731
        leaders = many.groupBy("token").agg(F.min_by(F.struct(*(c for c in many.columns if c != "token")), by("")).alias("x")).select("token", "x.*")
        links = links.unionByName(_alike(settle(pairs_of(leaders, many, apart, by("a_"))), plain, nodes))
    # the tokens that few share are all counted here, and of the others at most as many as both have
    hot = settle(heads.select("sig", "hot"))
    x = settle(placed(few.join(hot, "sig").select(*cols, "hot")))
    close = side(x, "a").join(side(x, "b"), "token").where(apart & (F.col("a_sig") < F.col("b_sig"))).groupBy(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"), "a_n", "b_n").agg(F.count("*").alias("c"), F.max(reach).alias("reach"), F.first(F.least("a_hot", "b_hot")).alias("hot"))
    links = links.unionByName(_alike(settle(close.where(F.col("reach") & enough(F.col("c") + F.col("hot"))).select("a", "b")), plain, nodes))
    if not many.isEmpty():
        of = settle(placed(many.select(*cols)))
        links = links.unionByName(_alike(settle(pairs_of(of, of, reach & apart & (F.col("a_sig") < F.col("b_sig")))), plain, nodes))
    comps = components(links).withColumnRenamed("node", "sig")
    named = settle(nodes.join(comps, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "sig").join(named.join(low, "component").select("sig", "component_id"), "sig", "left").select("doc_id", "component_id")
