"""Continuous ingestion as file micro-batches: settle, route, upsert, until nothing is left."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.commits import lease
from factloom.sources.database import Table


def run_available(stream: DataFrame, write, checkpoint: str) -> None:
    """Process everything that is there now, in micro-batches, then stop. One query for a checkpoint."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settled(files: DataFrame, seconds: int) -> DataFrame:
    """Files (modificationTime, length) that are not empty and haven't changed for `seconds`."""
    return files.filter((F.col("length") > 0) & (F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds))))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r"))
    return best.select("_r.*")


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str, order: str) -> None:
    """Merge a batch into the table at path: the buckets that it touches are written anew and swapped in at once.

    A batch that is run again changes nothing: the newest row of a key wins, and equal rows are one.
    """
    Table(spark, path).merge(new, key, order)


def until_quiet(step: Callable[[], int], most: int = 20) -> int:
    """Repeat step until it says that it did nothing, most times at most. Returns how often it did something."""
    for done in range(most):
        if not step():
            return done
    return most


def alone(spark: SparkSession, path: str, seconds: float = 60.0) -> contextlib.AbstractContextManager[bool]:
    """Whether this is the only writer of path; the loser gets False. A lock whose holder crashed lapses after `seconds`."""
    return lease(spark, path, seconds)


def unfinished(filed: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """What was filed but not finished, to be done again after a crash."""
    return filed.join(finished.select(key).distinct(), key, "left_anti")


def stale(done: DataFrame, now: DataFrame, key: str, size: str) -> DataFrame:
    """Keys whose size has grown since they were done, and those that were never done."""
    was = done.select(key, F.col(size).alias("_was"))
    return now.join(was, key, "left").filter(F.col(size) > F.coalesce("_was", F.lit(-1))).drop("_was")


def replaced_by_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """old without the rows of new's sources, and new: an import that is repeated leaves the same rows."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*old.columns).unionByName(new)


def by_lane(df: DataFrame, pages: str, most: int) -> DataFrame:
    """df with lane: large documents wait for the night."""
    return df.withColumn("lane", F.when(F.col(pages) > most, "deferred").otherwise("now"))


def queue(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first mention of each entry, in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def run_complete(agg: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there now; the table at path holds the whole result of the last batch. Readers see one
    batch's result or the next, and a crash leaves the last."""
    run = agg.writeStream.outputMode("complete").foreachBatch(lambda b, _: Table(b.sparkSession, path).replace(b) and None)
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
