"""PII: base patterns with exact spans, and terms that give protected entities away by corpus co-occurrence.
DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import settle, whole_row

#: Kinds in their order. Each pattern finds what the contract's does, from left to right, but looks at a long run once:
#: possessive parts don't give back, and a look behind keeps a search from starting within a run that failed.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Part of an address: at most 255, zeros in front allowed.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
LETTERS = r"\p{L}{2,}"


def _luhn(hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":  # the pattern has counted the digits
        return _luhn(hit)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


BLOCK, CHUNK = 256, 512
#: One text of so many, by its hash, is asked first how common a term is.
PARTS = (64, 8)


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def _scan(items: Column, step) -> Column:
    """The texts that ``step`` adds while it walks items with a place in hand: step(at, item) gives (new place, texts to add).

    Arrays grow by copying, so a walk in one go is quadratic. It is cut into blocks: what a block adds is collected by itself.
    """
    none = F.array().cast("array<string>")

    def one(acc, x):
        to, more = step(acc["at"], x)
        return F.struct(to.alias("at"), F.concat(acc["out"], more).alias("out"))

    def blocks(z):
        def block(acc, i):
            added = F.aggregate(F.slice(z, i, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return _bind(added, lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

        starts = F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), F.lit(BLOCK))
        return F.flatten(F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out")), block)["out"])

    return _bind(items, blocks)


def _places(text: Column, pattern: str, holds, word: bool = False) -> Column:
    """'start:end' of each match that holds (with ``word`` 'start:end:match'): the pieces between matches and the matches
    themselves, lengths added up in one pass."""

    def found(hits):
        def step(at, x):
            start = at + F.length(x["part"])
            end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
            said = F.concat_ws(":", start, end, *([x["hit"]] if word else []))
            return end, F.when(x["hit"].isNotNull() & holds(x["hit"]), F.array(said)).otherwise(F.array().cast("array<string>"))

        return F.when(F.size(hits) > 0, _scan(F.arrays_zip(F.split(text, pattern, -1).alias("part"), hits.alias("hit")), step)).otherwise(F.array().cast("array<string>"))

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK characters, so that a far place in a long text is found without counting up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """Characters a to b of the text that was cut into chunks; b may lie beyond its end."""
    first = F.floor(a / CHUNK).cast("int")
    own = F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1)
    return F.when(b > a, F.substr(F.array_join(own, ""), a - first * CHUNK + 1, b - a)).otherwise("")


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with a column of places for each kind: arrays of 'start:end' in code points, end exclusive. No shuffle."""
    out = docs
    for kind in KINDS:
        found = _places(text, PATTERNS[kind], lambda hit, kind=kind: _holds(kind, hit))
        if kind in ("email", "phone"):
            found = F.when(F.contains(text, F.lit("@" if kind == "email" else "+")), found).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"_{kind}", found)
    return out


def _joined(kinds: list[str]) -> Column:
    def of(kind):
        return F.transform(f"_{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s))

    return F.array_join(F.concat(*map(of, kinds)), ",")


@dataclass(frozen=True)
class Disclosure:
    """When a term gives an entity away: by the bits that are missing to it once the term is seen, -log2 P(entity | term).

    P is estimated from counts of texts, smoothed by ``prior`` texts that have the term and not the entity, so that a term of one or two
    texts proves little whatever the size of the corpus. At half a bit (P of 0.7) a term is generalised, at a fifth (0.87) removed.
    """

    generalise: float = 0.7
    remove: float = 0.87
    prior: float = 1.0
    window: int = 80
    words: int = 4
    broadcast_bytes: int = 8_000_000

    def least(self) -> int:
        """The fewest texts with both that can reach the threshold."""
        return math.ceil(self.prior * self.generalise / (1 - self.generalise) - 1e-9)


def words_of(text: Column) -> Column:
    """The different words of letters of a text in lower case, without those that an address is made of."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(LETTERS), F.lit(0)))


def revealing_terms(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """(term, share): the terms from which some protected entity follows with a probability of at least ``rule.generalise``.

    docs: (text, _email, ... as base_spans gives). An entity is a kind and a value. A term occurs with it if it is anywhere in the
    same text. Texts count once, however many copies there are, and as one where the nearest words on both sides of the
    entity are the same, so that near copies and boilerplate prove nothing; a term's own frequency is that of distinct texts. Only
    entities of as many texts as the threshold needs are joined with words, for no others could reach it: a row for each of them
    and each different word of their texts.
    """
    text = F.col("text")
    letters = lambda c: F.filter(F.split(F.lower(c), r"[\s.,;:!?]+"), lambda w: w.rlike(rf"^{LETTERS}$"))

    def context(kind):
        def of(chunks):
            def one(s):
                start, end = (F.element_at(F.split(s, ":"), i).cast("int") for i in (1, 2))
                left, right = _piece(chunks, F.greatest(start - rule.window, F.lit(0)), start), _piece(chunks, end, end + rule.window)
                nearest = F.xxhash64(F.reverse(F.slice(F.reverse(letters(left)), 1, rule.words)), F.slice(letters(right), 1, rule.words))
                return F.struct(F.xxhash64(F.lit(kind), F.lower(_piece(chunks, start, end))).alias("entity"), nearest.alias("context"))

            return F.array_distinct(F.transform(f"_{kind}", one))

        return _bind(_chunks(text), of)

    # only hashes leave the text's row: a text with very many matches isn't copied for each
    found = None
    for kind in KINDS:
        part = docs.where(F.size(f"_{kind}") > 0).select(F.xxhash64("text").alias("of"), context(kind).alias("c"))
        found = part if found is None else found.unionByName(part)
    contexts = settle(found.select("of", F.explode("c").alias("c")).select("of", "c.*").distinct())
    several = settle(_distinct_counts(contexts, ["entity"]).where(F.col("n") >= rule.least()).select("entity"))
    if several.isEmpty():
        return contexts.select(F.lit("").alias("term"), F.lit(0.0).alias("share")).limit(0)
    told = settle(contexts.join(several, "entity"))
    texts = docs.select(F.xxhash64("text").alias("of"), "text").join(told.select("of").distinct(), "of", "left_semi")
    words = settle(texts.dropDuplicates(["of"]).select("of", F.explode(words_of(text)).alias("term")))
    together = _distinct_counts(told.join(words, "of"), ["entity", "term"]).where(F.col("n") >= rule.least())
    # a term is in at least as many texts as those that it shares with entities; most common words can't come up to the threshold then
    seen = words.groupBy("term").agg(F.count("*").alias("n_seen"))
    share = lambda n_term: F.col("n") / (F.col(n_term) + rule.prior)
    candidates = settle(together.join(seen, "term").where(share("n_seen") >= rule.generalise).groupBy("term").agg(F.max("n").alias("n")))
    if candidates.isEmpty():
        return candidates.select("term", F.lit(0.0).alias("share"))

    def frequency(part):
        own = docs.select(F.xxhash64("text").alias("of"), "text")
        own = own.where(F.pmod("of", F.lit(part)) == 0) if part > 1 else own
        every = own.select("of", F.explode(words_of(text)).alias("term"))
        return every.join(_small(candidates.select("term"), rule), "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))

    # a term that is too common in a part of the texts is too common in all: common words don't meet every text, and none is lost
    for part in PARTS:
        rarer = candidates.join(frequency(part), "term", "left").withColumn("n_term", F.coalesce("n_term", F.lit(0)))
        candidates = settle(rarer.where(share("n_term") >= rule.generalise).select("term", "n"))
        if candidates.isEmpty():
            return candidates.select("term", F.lit(0.0).alias("share"))
    frequency = frequency(1)
    return candidates.join(frequency, "term").select("term", share("n_term").alias("share")).where(F.col("share") >= rule.generalise)


def _distinct_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the lesser of the different contexts and the different texts of each key. Each is told apart by a shuffle on
    key and value, and counted with partial sums, so a key of very many is spread over tasks."""
    each = lambda c, name: rows.select(*keys, c).distinct().groupBy(*keys).agg(F.count("*").alias(name))
    return each("context", "_contexts").join(each("of", "_texts"), keys).select(*keys, F.least("_contexts", "_texts").alias("n"))


def _small(df: DataFrame, rule: Disclosure) -> DataFrame:
    """Broadcast if its counted size is within the bound; a shuffled join otherwise."""
    size = df.agg(F.sum(F.length("term") + 40)).first()[0] or 0
    return F.broadcast(df) if size <= rule.broadcast_bytes else df


def term_spans(docs: DataFrame, terms: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, _hash, _generalised, _removed): the places of the revealing terms in the documents that have any.

    A document is known by its id and its text's hash, so repeated and null ids are no trouble.
    """
    every = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(LETTERS), F.lit(0)))
    having = settle(docs.select("doc_id", "_hash", F.explode(every("text")).alias("term")).join(_small(terms, rule), "term").select("doc_id", "_hash").distinct())
    texts = docs.dropDuplicates(["doc_id", "_hash"]).join(having, docs["doc_id"].eqNullSafe(having["doc_id"]) & (docs["_hash"] == having["_hash"]), "left_semi")
    at = F.split("p", ":", 3)
    places = texts.select("doc_id", "_hash", F.explode(_places(F.col("text"), LETTERS, lambda hit: F.lit(True), word=True)).alias("p")).select("doc_id", "_hash", at[0].cast("int").alias("a"), at[1].alias("b"), F.lower(at[2]).alias("term"))
    hits = places.join(_small(terms, rule), "term").select("doc_id", "_hash", F.struct("a", F.concat_ws(":", "a", "b").alias("s"), (F.col("share") >= rule.remove).alias("out")).alias("h"))
    of = lambda out: F.transform(F.filter("hs", lambda h: h["out"] == out), lambda h: h["s"])
    grouped = hits.groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return grouped.select("doc_id", "_hash", of(False).alias("_generalised"), of(True).alias("_removed"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, _hash, _email, _ip, _card, _phone, _generalised, _removed): arrays of 'start:end', a row for each row of docs.

    _generalised and _removed are the places of terms that give an entity away (revealing_terms).

    Null texts are empty. Matches of a kind don't overlap; kinds may overlap each other. Repeated rows stay; an empty table
    gives none; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    plain = plain.withColumn("_hash", F.xxhash64("text"))
    based = base_spans(plain, F.col("text"))
    terms = settle(revealing_terms(based, rule))
    out = based.drop("text")
    if terms.isEmpty():
        none = F.array().cast("array<string>")
        return out.withColumns({"_generalised": none, "_removed": none})
    more = term_spans(plain, terms, rule)
    empty = lambda c: F.coalesce(more[c], F.array().cast("array<string>")).alias(c)
    joined = out.join(more, out["doc_id"].eqNullSafe(more["doc_id"]) & (out["_hash"] == more["_hash"]), "left")
    return joined.select(*(out[c] for c in out.columns), empty("_generalised"), empty("_removed"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    spans = _joined([*KINDS, "generalised", "removed"])
    return found.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(KINDS).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def sanitise(docs: DataFrame, *, rule: Disclosure = Disclosure()) -> DataFrame:
    """The pipeline's stage: docs with personal data in ``text`` replaced by its kind in angle brackets, generalised terms by
    <term>, and removed terms by nothing. n_chars, if there, follows the new text. Overlapping spans are covered once, under the first's label."""
    kinds = {**{k: f"<{k}>" for k in KINDS}, "generalised": "<term>", "removed": ""}
    found = find(docs, rule=rule)

    def of(kind, label):
        return F.transform(f"_{kind}", lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("a"), F.split(s, ":")[1].cast("int").alias("b"), F.lit(label).alias("label")))

    every = F.concat(*(of(k, label) for k, label in kinds.items()))
    marked = found.select("doc_id", "_hash", F.array_sort(every).alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["doc_id", "_hash"])
    # the row goes in one struct, so that no column of its own can clash
    left = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    joined = left.join(marked, left["_id"].eqNullSafe(marked["doc_id"]) & (left["_h"] == marked["_hash"]), "left").select("_row", "_spans")

    def replaced(chunks):
        def step(at, s):
            return F.greatest(at, s["b"]), F.when(s["a"] >= at, F.array(_piece(chunks, at, s["a"]), s["label"])).otherwise(F.array().cast("array<string>"))

        end = F.array_max(F.transform("_spans", lambda s: s["b"]))
        return F.concat(F.array_join(_scan(F.col("_spans"), step), ""), _piece(chunks, end, F.greatest(F.size(chunks) * CHUNK, end)))

    hit = F.coalesce(F.size("_spans") > 0, F.lit(False))
    text = F.when(hit, _bind(_chunks(F.col("_row.text")), replaced)).otherwise(F.col("_row.text"))
    out = joined.select("_row", hit.alias("_hit"), text.alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_hit"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def _sql_kind(kind: str, pattern: str, ok: str, table: str = "t") -> str:
    """Matches of a pattern with their places: pieces and matches side by side, lengths added up."""
    return f"""{kind}_cut AS (SELECT rid, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS hits FROM {table}),
{kind}_at AS (SELECT rid, i, hits[i] AS hit, sum(length(parts[i])) OVER w + coalesce(sum(length(hits[i])) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {kind}_cut) WINDOW w AS (PARTITION BY rid ORDER BY i)),
{kind}_s AS (SELECT rid, hit, CAST(a AS BIGINT) AS a, CAST(a + length(hit) AS BIGINT) AS b FROM {kind}_at WHERE {ok})"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN 2 * CAST({_DIGITS}[i] AS INTEGER) - CASE WHEN CAST({_DIGITS}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST({_DIGITS}[i] AS INTEGER) END)) % 10 = 0"
_LIST = r"list_filter(string_split_regex(lower({0}), '[\s.,;:!?]+'), lambda w: regexp_full_match(w, '\p{{L}}{{2,}}'))"
#: The query in DuckDB's SQL, with Disclosure()'s figures.
SQL = rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")},
{_sql_kind("ip", r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", f"regexp_full_match(hit, '{_PART}(?:[.]{_PART}){{3}}')")},
{_sql_kind("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")},
{_sql_kind("phone", r"[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")},
found AS ({" UNION ALL ".join(f"SELECT rid, '{k}' AS kind, hit, a, b FROM {k}_s" for k in KINDS)}),
around AS (SELECT kind || ':' || lower(hit) AS entity, text, list_reverse(list_reverse({_LIST.format("substr(text, greatest(a - 80, 0) + 1, least(a, 80))")})[1:4]) AS l, {_LIST.format("substr(text, b + 1, 80)")}[1:4] AS r FROM found JOIN t USING (rid)),
near AS (SELECT DISTINCT entity, text, l, r FROM around),
entities AS (SELECT entity FROM near GROUP BY entity HAVING least(count(DISTINCT (l, r)), count(DISTINCT text)) >= 3),
words AS (SELECT rid, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', ' ', 'g')), '\p{{L}}{{2,}}'))) AS term FROM t),
plain AS (SELECT DISTINCT text, term FROM words JOIN t USING (rid)),
both_ AS (SELECT entity, term, least(count(DISTINCT (l, r)), count(DISTINCT text)) AS n_both FROM near SEMI JOIN entities USING (entity) JOIN plain USING (text) GROUP BY ALL HAVING least(count(DISTINCT (l, r)), count(DISTINCT text)) >= 3),
often AS (SELECT term, count(*) AS n_term FROM plain WHERE term IN (SELECT term FROM both_) GROUP BY term),
shares AS (SELECT term, max(n_both / (n_term + 1.0::DOUBLE)) AS share FROM both_ JOIN often USING (term) GROUP BY term HAVING max(n_both / (n_term + 1.0::DOUBLE)) >= 0.7),
having_ AS (SELECT rid FROM t WHERE len(list_intersect(regexp_extract_all(lower(text), '\p{{L}}{{2,}}'), (SELECT coalesce(list(term), []) FROM shares))) > 0),
small AS (SELECT * FROM t SEMI JOIN having_ USING (rid)),
{_sql_kind("word", "\\p{L}{2,}", "lower(hit) IN (SELECT term FROM shares)", "small")},
told AS (SELECT rid, a, b, CASE WHEN share >= 0.87 THEN 'removed' ELSE 'generalised' END AS kind FROM word_s JOIN shares ON term = lower(hit)),
every AS (SELECT rid, kind, a, b FROM found UNION ALL SELECT rid, kind, a, b FROM told),
texts AS (SELECT rid, {", ".join(f"string_agg('{k}:' || a || ':' || b, ',' ORDER BY a) FILTER (kind = '{k}') AS s_{k}, count(*) FILTER (kind = '{k}') AS n_{k}" for k in [*KINDS, "generalised", "removed"])} FROM every GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in KINDS)}, sha256(concat_ws(',', {", ".join(f"s_{k}" for k in KINDS)})) AS base_sha256, concat_ws(',', {", ".join(f"s_{k}" for k in [*KINDS, "generalised", "removed"])}) AS spans
FROM t LEFT JOIN texts USING (rid)"""
