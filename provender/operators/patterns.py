"""Dictionaries of patterns over names: an automaton of the patterns' literals brings together what can match."""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.functions.cores import cores, folded
from provender.operators.lineage import checkpointed

#: Patterns of a block whose automaton goes out to all tasks.
BLOCK_PATTERNS = 50_000

_built: dict = {}


def _automaton(rows: list[tuple[int, str]]):
    """(automaton of the literals, each with its patterns' numbers; the numbers of those without a literal), once a worker."""
    key = hash(tuple(rows))
    if key not in _built:
        _built.clear()
        where: dict[str, list[int]] = {}
        anywhere = []
        for n, pattern in rows:
            found = cores(pattern)
            if found is None:
                anywhere.append(n)
            for core in found or []:
                where.setdefault(core, []).append(n)
        auto = ahocorasick.Automaton()
        for core, numbers in where.items():
            auto.add_word(core, numbers)
        if where:
            auto.make_automaton()
        _built[key] = auto if where else None, anywhere
    return _built[key]


def candidates(names: DataFrame, dictionary: DataFrame, name: str, pattern: str, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """(name, ord) of the names and patterns (ord, pattern) that may match: all that do are among them.

    Names are looked at once a block of patterns; a name meets the patterns of which it holds a literal, and the few that have
    none. Case is ignored for A-Z, so it suits patterns that ignore case and those that don't.
    """
    spark = names.sparkSession
    rows = dictionary.where(f"{pattern} is not null").select("ord", F.col(pattern).alias("_p"))
    n = max(1, -(-rows.count() // block_patterns))
    own = names.where(F.col(name).isNotNull()).select(name)
    own = checkpointed(own) if n > 1 else own
    kind = dictionary.schema["ord"].dataType.simpleString()
    parts = []
    for block in range(n):
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod(F.xxhash64("ord"), F.lit(n)) == block).collect()])

        def run(batches, sent=sent):
            auto, anywhere = _automaton(sent.value)
            for b in batches:
                at, of = [], []
                for i, text in enumerate(b.column(0).to_pylist()):
                    hits = {*anywhere, *(n for _, numbers in auto.iter(folded(text)) for n in numbers)} if auto else anywhere
                    at += [i] * len(hits)
                    of += hits
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(of, pa.int32() if kind == "int" else pa.int64())], names=["name", "ord"])

        found = own.mapInArrow(run, f"`{name}` string, ord {'int' if kind == 'int' else 'long'}")
        parts.append(checkpointed(found) if n > 1 else found)
    return functools.reduce(DataFrame.unionByName, parts)


def matches(names: DataFrame, dictionary: DataFrame, name: str, pattern: str) -> DataFrame:
    """(name, all of dictionary) for every name and pattern that is found in it; names should be distinct."""
    met = candidates(names, dictionary, name, pattern).join(dictionary, "ord")
    return met.where(F.expr(f"regexp_like(`{name}`, `{pattern}`)"))
