"""What the training-data operators share: reading, cutting lineage, folding texts, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets a
    folder of its own; on a cluster that is an error, for executors would each write to their own disks."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="provender-"))
    return sc.getCheckpointDir()


def give_back() -> None:
    """Hands memory that a worker has freed, but holds for reuse, back to the system: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: beside it, an operator's own columns can't clash with them."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def _drop(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may have ended before; the folder is Spark's to clean then
        pass


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Lost executors lose nothing of it. Unlike a checkpoint's, later reads take only the columns and row groups that they need, and
    shuffle files of the run go with its end, as nothing can ask for them again. The Parquet files go when the driver ends, or
    with discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    atexit.register(_drop, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what settle() has written for these frames, once nothing reads them any more; other frames are left alone."""
    for df in (f for f in frames if hasattr(f, "_settled")):
        _drop(df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df._settled)


def _together(batches):
    """The smallest node that each node of a few edges reaches, by union and find."""
    parent: dict[int, int] = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(parent.setdefault(x, x)), find(parent.setdefault(y, y))
            parent[max(x, y)] = min(x, y)
    nodes = sorted(parent)
    for lo in range(0, len(nodes), 1 << 16):
        part = nodes[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, few: int = 500_000) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b: long): rows (node, component), component the smallest node.

    Up to ``few`` edges (counted first; 8 MB) are put together by one task, which spares dozens of shuffles. Beyond, it alternates large-star and small-star steps until the edges stay as they are. A step groups by node with map-side
    minima and joins the minima back, so a node with very many neighbours is a skewed join that Spark can split.
    No edges give no rows; loops and repeated edges are allowed; null ends are dropped.
    """
    spark = edges.sparkSession
    now = settle(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    if now.count() <= few:
        return settle(now.coalesce(1).mapInArrow(_together, "node long, component long"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = settle(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
