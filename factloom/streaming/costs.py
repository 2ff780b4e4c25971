"""What work costs, and work that doesn't move: a record for each chunk and each batch, and an end to what stands still."""

from __future__ import annotations

import contextlib
import resource
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from factloom.sources.database import Table, written

OK = "ok"
#: The cost of one chunk: how it ended, how long it took, how much memory its worker had taken by then.
COST = "status string, seconds double, s_per_page double, peak_mb double"
BATCHES = "run string, batch long, rows long, bytes long, seconds double, status string"
PROGRESS = "run string, batch long, rows long, seconds double, rows_per_second double, observed string"


def costed(chunks: DataFrame, pages: str, work: Callable[[dict], str]) -> DataFrame:
    """chunks with result and COST of work on each row. A chunk that fails is a row as well; the others go on."""
    names = chunks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for row in b.to_dict("records"):
                began, status, result = time.monotonic(), OK, None
                try:
                    result = work(row)
                except Exception as e:  # noqa: BLE001
                    status = f"error: {type(e).__name__}: {e}"[:300]
                took = time.monotonic() - began
                made.append((result, status, took, took / max(1, row[pages]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))
            yield pd.concat([b, pd.DataFrame(made, columns=["result", "status", "seconds", "s_per_page", "peak_mb"], index=b.index)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{kinds}, result string, {COST}").select(*names, "result", *[c.split()[0] for c in COST.split(", ")])


def undone(chunks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Chunks that aren't done, or whose last try failed."""
    return chunks.join(done.filter(F.col("status") == OK).select(key), key, "left_anti")


def until_done(chunks: DataFrame, key: str, pages: str, work: Callable[[dict], str], table: Table, most: int | None = None) -> int:
    """Work on chunks in rounds of `most` until all are done, or a round ends with as many to do as before.

    Returns how many are left. table holds the last try of each chunk (key, result, COST, round); what it has from earlier
    runs isn't done again, what failed there is tried again. A round's chunks are those with the fewest tries, so that ones
    that always fail don't hold up the rest.
    """
    kind = chunks.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, result string, {COST}, tries int, at long"
    failed_before = -1
    while True:
        done = table.read(schema)
        tries = done.select(key, "tries")
        todo = undone(chunks, done, key).join(tries, key, "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
        left = todo.count()
        if not left:
            return 0
        fresh = todo.filter("tries = 0")
        now = fresh if fresh.take(1) else todo
        if now is todo and left == failed_before:
            return left
        failed_before = left if now is todo else -1
        batch = now.orderBy("tries", key).limit(most) if most else now
        made = written(costed(batch.select(key, pages, "tries"), pages, work), "costs")
        rows = made.select(key, "result", *[c.split()[0] for c in COST.split(", ")], (F.col("tries") + 1).alias("tries"), F.lit(time.time_ns()).alias("at"))
        table.merge(rows, key, "at")


def metered(write: Callable[[DataFrame, int], None], table: Table, run: str, size: str | None = None) -> Callable[[DataFrame, int], None]:
    """write for foreachBatch that also appends rows, bytes (of the column size) and seconds of each batch to table.

    Counts are observed while the batch is written: it isn't read for them. A batch that fails is recorded and raised.
    """

    def measured(batch: DataFrame, number: int) -> None:
        seen = Observation(f"batch-{number}")
        length = F.octet_length(F.col(size)) if size else F.lit(0)
        watched = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(length).alias("bytes"))
        began, status = time.monotonic(), OK
        try:
            write(watched, number)
        except Exception as e:
            status = f"error: {type(e).__name__}"
            raise
        finally:
            # an observation is there once its query has run to its end
            counts = seen.get if status == OK else {}
            row = (run, number, counts.get("rows") or 0, counts.get("bytes") or 0, time.monotonic() - began, status)
            rows = batch.sparkSession.createDataFrame([row], BATCHES).withColumn("id", F.lit(f"{run}/{number}")).withColumn("at", F.lit(time.time_ns()))
            table.merge(rows, "id", "at", 1)

    return measured


class Recorder(StreamingQueryListener):
    """Keeps each query's progress, and when it last got anywhere."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.moved: dict[str, float] = {}
        self.ended: set[str] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        self.moved[str(event.runId)] = time.monotonic()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self.rows.append((str(p.runId), p.batchId, p.numInputRows, p.batchDuration / 1000, p.processedRowsPerSecond, str(dict(p.observedMetrics))))
        self.moved[str(p.runId)] = time.monotonic()

    def onQueryIdle(self, event) -> None:
        self.moved[str(event.runId)] = time.monotonic()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def save(self, spark: SparkSession, path: str) -> None:
        """Append what has come since the last time to the parquet table at path."""
        with self._lock:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)


def watched(start: Callable[[], StreamingQuery], spark: SparkSession, seconds: float, path: str | None = None) -> str:
    """Run a query to its end: done, failed, or stalled where no batch ended (and it wasn't idle) for `seconds`, in which
    case it is stopped. Its progress is appended to path. Started again, it goes on from its checkpoint."""
    log = Recorder()
    spark.streams.addListener(log)
    try:
        query = start()
        began = time.monotonic()
        while True:
            with contextlib.suppress(Exception):
                if query.awaitTermination(max(0.05, min(1.0, seconds / 10))):
                    break
            if not query.isActive:
                break
            if time.monotonic() - max(began, log.moved.get(str(query.runId), 0.0)) > seconds:
                query.stop()
                return "stalled"
        # events come after what they tell of, the end last
        for _ in range(100):
            if str(query.runId) in log.ended:
                break
            time.sleep(0.1)
        return "failed" if query.exception() else "done"
    finally:
        spark.streams.removeListener(log)
        if path:
            log.save(spark, path)
