"""Gates between names: facts that must agree before two names can be one product. As a signature they are a join key."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of words of one meaning.
ORIGINS = [["mexico", "mex"], ["california", "cali", "ca"], ["chile", "chilean", "chl"], ["peru", "peruvian"], ["guatemala"], ["honduras"], ["ecuador", "ecuadorian"], ["costa rica"], ["canada"], ["usa"], ["china"], ["spain"], ["italy"], ["france"], ["argentina", "argentine"], ["brazil"], ["colombia"], ["local"], ["domestic"], ["washington", "wa"], ["oregon", "*or"], ["arizona", "az"], ["idaho"], ["florida"], ["sto"]]
CONTAINERS = [["jug"], ["shaker"], ["jar"], ["bottle"], ["cup"], ["can"], ["pouch"]]
DIETS = [["diet"], ["zero"]]
COLOURS = [["red"], ["green", "grn"], ["blue"], ["black", "blk"], ["white"], ["yellow", "ylw"], ["orange"], ["purple"], ["pink", "pnk"], ["brown", "brn"], ["gold", "golden"]]
FRUITS = [["pear"], ["peach"]]
QUALITIES = [["premium"], ["choice"], ["fancy"]]
CLAIMS = [["gluten free", "gluten-free"], ["no msg"]]
VOLUMES = [["hgl"], ["gl", "gal", "gallon", "gallons"]]
NUMBERS = r"\d+(?:\.\d+)?(?:/\d+)?"


def alternatives(words: list[str]) -> str:
    """One pattern for a group; *or is the place only with its star, as 'or' is mostly a conjunction."""
    return "(?i)" + "|".join((r"\*OR\b" if w == "*or" else rf"\b{re.escape(w)}\b") for w in words)


def found(name: Column, groups: list[list[str]]) -> Column:
    """The numbers of the groups that occur, as text."""
    return F.concat_ws(",", *(F.when(name.rlike(alternatives(g)), F.lit(str(i))) for i, g in enumerate(groups)))


def numbers(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(NUMBERS), F.lit(0)))), ",")


def signature(name: Column) -> Column:
    """All thirteen gates as one text. Two raw names pass every gate exactly if their signatures are equal."""
    flag = lambda pattern: F.when(name.rlike(pattern), "1").otherwise("0")
    grades = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(r"\b([AB])\b"), F.lit(1)))), ",")
    volumes = F.concat_ws(",", *(F.when(name.rlike(rf"(?i)(?<![A-Za-z])(?:{'|'.join(g)})(?![A-Za-z])"), F.lit(str(i))) for i, g in enumerate(VOLUMES)))
    return F.concat_ws(
        "|",
        numbers(name),
        found(name, ORIGINS),
        flag(r"(?i)\(H\)|\bHALAL\b"),
        flag(r"(?i)\b(?:FZ|FRZ|FR)\b"),
        F.when(name.rlike(r"(?i)\bPOTATO(?:ES)?\b"), grades).otherwise(""),
        volumes,
        flag(r"(?i)\bDECAF(?:FEINATED)?\b"),
        *(found(name, g) for g in (CONTAINERS, DIETS, COLOURS, FRUITS, QUALITIES, CLAIMS)),
    )
