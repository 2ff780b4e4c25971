"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few longs a row) may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent (a local session, as in tests) a temporary folder stands in.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(spark, "_factloom_dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark._factloom_dir = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table that staged returned as df."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """The POSIX path of a shared folder, for files that are memory-mapped."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if not path.startswith("/"):
        raise ValueError(f"memory-mapped levels need a mounted shared folder, not {path}")
    return path


def give_back() -> None:
    """Return a Python worker's free memory to the system at the end of a task: workers live on, and wait with it."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back when it ends."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if rows is within BROADCAST_ROWS, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def one_of_each(docs: DataFrame, keys: DataFrame, sha: Column) -> DataFrame:
    """The rows of docs (all columns) whose doc_id and sha are in keys; of rows that share both, the smallest.

    keys: distinct (doc_id, sha, rows), rows being how many rows of docs have them. Only rows of keys that repeat are
    compared whole, as a minimum that each map task takes first.
    """
    names, own, of, at, row = docs.columns, *[unused(docs, n) for n in ("_sha", "_of", "_at", "_row")]
    keys = staged(keys.select(F.col("doc_id").alias(at), F.col("sha").alias(of), "rows"), "keys")
    keyed = docs.withColumn(own, sha)
    on = F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(own) == F.col(of))
    once = keyed.join(keys.filter("rows = 1").select(at, of).hint("shuffle_hash"), on, "left_semi").select(*names)
    repeats = keys.filter("rows > 1").select(at, of)
    n = repeats.count()
    if not n:
        return once
    again = keyed.join(small(repeats, n), on, "left_semi").groupBy("doc_id", own).agg(F.min(F.struct(*names)).alias(row))
    return once.unionByName(again.select(f"{row}.*"))
