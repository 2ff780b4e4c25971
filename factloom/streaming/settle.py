"""Files that wait: until they stand still, and, large ones, until the night. Both are keyed state with timers.

A path's state holds what was last seen of it, so that a stream which ends and starts again from its checkpoint knows what
it has passed on: no file is lost and none comes twice. Time is event time: a timer is due when the watermark has passed
it, whatever the batches were.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed state with timers needs (a fixed value).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the streams give; times are microseconds within the state, whatever the workers' time zone.
SETTLED = "path string, length long, modified timestamp, since timestamp"
LANES = "path string, pages int, lane string, attempt int, due timestamp"
_SETTLED, _LANES = SETTLED.replace("timestamp", "long"), LANES.replace("timestamp", "long")


class Settle(StatefulProcessor):
    """Passes a path on once its length and modification have been the same for `seconds`, and again after a change."""

    def __init__(self, seconds: int):
        self.wait = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "length long, modified long, since long")
        self.passed = handle.getValueState("passed", "length long, modified long")

    def _pass(self, path: str, held: tuple) -> Iterator[Row]:
        if self.passed.exists() and tuple(self.passed.get()) == held[:2]:
            return
        self.passed.update(held[:2])
        yield Row(path=path, length=held[0], modified=held[1], since=held[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = sorted((r.us, r.length, r.modified) for r in rows)
        held = tuple(self.held.get()) if self.held.exists() else None
        for at, length, modified in seen:
            if held and at < held[2]:
                continue
            if held and held[:2] == (length, modified):
                continue
            if held and at - held[2] >= self.wait:
                yield from self._pass(key[0], held)
            # an empty file is still to be written
            held = (length, modified, at) if length > 0 else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.held.update(held)
            self.handle.registerTimer(-(-(held[2] + self.wait) // 1000))
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            yield from self._pass(key[0], tuple(self.held.get()))

    def close(self) -> None:
        pass


def settled_stream(observed: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """SETTLED for a stream of path, length, modified, seen; delay: how late what was seen may come."""
    _keep_state(observed)
    rows = observed.withWatermark("seen", delay).select("path", F.col("length").cast("long"), F.unix_micros("modified").alias("modified"), "seen", F.unix_micros("seen").alias("us"))
    out = rows.groupBy("path").transformWithState(Settle(seconds), _SETTLED, "append", "eventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("modified", "since")})


class Lane(StatefulProcessor):
    """Small files at once; large ones, and what failed, at the next night, again each night until it is done."""

    def __init__(self, most_pages: int, night: int):
        self.most, self.night = most_pages, night * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "pages int, attempt int")

    def _next_night(self, ms: int) -> int:
        day = 86_400_000
        return (ms - self.night) // day * day + day + self.night

    def _wait(self, pages: int, attempt: int, ms: int) -> None:
        self.waits.update((pages, attempt))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._next_night(ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.us, r.kind)):
            ms = r.us // 1000
            if r.kind == "done":
                self.waits.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            elif r.kind == "failed":
                pages, attempt = tuple(self.waits.get()) if self.waits.exists() else (r.pages, 1)
                self._wait(pages, attempt, ms)
            elif r.pages <= self.most:
                yield Row(path=key[0], pages=r.pages, lane="now", attempt=1, due=r.us)
            else:
                self._wait(r.pages, 0, ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.waits.exists():
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        pages, attempt = self.waits.get()
        # what isn't reported done by the next night is due again, whether it failed or was lost
        self.waits.update((pages, attempt + 1))
        self.handle.registerTimer(self._next_night(due))
        yield Row(path=key[0], pages=pages, lane="night", attempt=attempt + 1, due=due * 1000)

    def close(self) -> None:
        pass


def lane_stream(files: DataFrame, most_pages: int, night: int = 3 * 3600, delay: str = "0 seconds") -> DataFrame:
    """LANES for a stream of path, pages, kind (file, done or failed), at. night: seconds after midnight, UTC."""
    _keep_state(files)
    rows = files.withWatermark("at", delay).select("path", F.col("pages").cast("int"), "kind", "at", F.unix_micros("at").alias("us"))
    out = rows.groupBy("path").transformWithState(Lane(most_pages, night), _LANES, "append", "eventTime")
    return out.withColumn("due", F.timestamp_micros("due"))


def _keep_state(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """What is there now, to parquet files at path, each row once, however often this is started again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
