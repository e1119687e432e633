"""Several tables as one version: a change of all of them is seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/_versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """The folder of each table in a version, the latest if none is named."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{root} has no version {version if version is not None else ''}".rstrip())
    text = spark.read.text(f"{root}/_versions/{known[-1] if version is None else version}.json", wholetext=True).first()[0]
    return json.loads(text)


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{manifest(spark, root, version)[table]}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], *, dry_run: bool = False) -> int | dict[str, int]:
    """Writes tables as the next version of ``root`` and returns its number; tables that aren't given stay what they are.

    Each table goes to a folder of its own that nothing refers to, then one small file that names the folders of all tables is
    moved to its place, which is the only step that readers see. A write that fails leaves the version before as the latest,
    and its folders are no version's. Frames may read the version that they follow. If another writer was first, Conflict is
    raised and nothing is published. With ``dry_run`` nothing is written; it returns the rows that each table would have.
    """
    if dry_run:
        return {name: df.count() for name, df in tables.items()}
    known = versions(spark, root)
    at, now = (known[-1] + 1, manifest(spark, root)) if known else (1, {})
    made = {name: f"data/{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{made[name]}")
    fs, draft = _fs(spark, f"{root}/_versions/{uuid.uuid4().hex}.draft")
    _, place = _fs(spark, f"{root}/_versions/{at}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({**now, **made}, sort_keys=True).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise Conflict(f"version {at} of {root} is there already")
    return at
