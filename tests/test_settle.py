"""Streams that hold files: late changes, restarts from a checkpoint, nights."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from factloom.streaming import settle

START = datetime(2026, 3, 28, 12, tzinfo=timezone.utc)
SEEN = "path string, length long, modified timestamp, seen timestamp"
FILES = "path string, pages int, kind string, at timestamp"


def later(seconds):
    return START + timedelta(seconds=seconds)


def since_start(column):
    return (F.unix_seconds(column) - int(START.timestamp())).alias("s")


def test_files_settle_over_restarts(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame([(p, n, later(m), later(s)) for p, n, m, s in rows], SEEN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        """A new query each time, from the same checkpoint."""
        settle.append_available(settle.settled_stream(spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in"), 20), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r.path, r.length, r.s) for r in spark.read.schema(settle.SETTLED).parquet(f"{tmp_path}/out").select("path", "length", since_start("since")).collect())

    put(("a", 5, 0, 0), ("a", 5, 0, 10), ("b", 0, 0, 0), ("b", 7, 3, 5))
    assert run() == []
    put(("a", 5, 0, 30), ("b", 8, 12, 12), ("c", 1, 1, 31))
    assert run() == [("a", 5, 0)]
    assert run() == [("a", 5, 0)], "nothing new, nothing twice"
    put(("b", 8, 12, 40), ("a", 6, 35, 41))
    assert run() == [("a", 5, 0), ("b", 8, 12)]
    # a change that comes late: c was something else all along, and settles as that
    put(("c", 2, 2, 45), ("z", 1, 1, 100))
    assert run() == [("a", 5, 0), ("a", 6, 41), ("b", 8, 12), ("c", 2, 45)]
    # touched without a change of what is seen: not again
    put(("a", 6, 35, 200), ("a", 0, 210, 210), ("a", 6, 35, 220), ("z", 1, 1, 400))
    assert run() == [("a", 5, 0), ("a", 6, 41), ("b", 8, 12), ("c", 2, 45), ("z", 1, 100)]


def test_large_files_wait_for_the_night_and_failures_come_again(spark, tmp_path):
    hour = 3600

    def put(*rows):
        spark.createDataFrame([(p, n, k, later(s)) for p, n, k, s in rows], FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        settle.append_available(settle.lane_stream(spark.readStream.schema(FILES).parquet(f"{tmp_path}/in"), 250), f"{tmp_path}/out", f"{tmp_path}/state")
        rows = spark.read.schema(settle.LANES).parquet(f"{tmp_path}/out").select("path", "lane", "attempt", since_start("due")).collect()
        return sorted((r.path, r.lane, r.attempt, r.s // hour) for r in rows)

    put(("small", 10, "file", 0), ("large", 900, "file", hour), ("huge", 999, "file", hour))
    first = [("small", "now", 1, 0)]
    assert run() == first
    # the clock of the stream passes three in the morning, 15 hours later
    put(("tick", 1, "file", 16 * hour))
    night = [("huge", "night", 1, 15), ("large", "night", 1, 15), ("tick", "now", 1, 16)]
    assert run() == sorted(first + night)
    put(("large", 900, "failed", 17 * hour), ("huge", 999, "done", 17 * hour), ("tick", 1, "failed", 18 * hour))
    assert run() == sorted(first + night)
    put(("other", 1, "file", 40 * hour))
    again = [("large", "night", 2, 39), ("tick", "night", 2, 39), ("other", "now", 1, 40)]
    assert run() == sorted(first + night + again)
    # nobody said what became of them: they are due again
    put(("other", 1, "file", 64 * hour), ("tick", 1, "done", 41 * hour))
    assert run() == sorted(first + night + again + [("large", "night", 3, 63), ("other", "now", 1, 64)])
