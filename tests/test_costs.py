"""Costs of chunks and batches, and work that stands still."""

import time

import pytest

from factloom.sources.database import Table
from factloom.streaming import costs

DOCS = "k long, text string"


def test_chunks_have_costs_and_failures_come_again(spark, tmp_path):
    def work(row):
        if row["k"] % 5 == 0:
            raise ValueError(f"bad {row['k']}")
        return f"done {row['k']}"

    chunks = spark.range(1, 24).selectExpr("id as k", "cast(id as int) as pages").repartition(3)
    t = Table(spark, str(tmp_path / "t"))
    assert costs.until_done(chunks, "k", "pages", work, t, most=6) == 4
    rows = {r.k: r for r in t.read(f"k long, result string, {costs.COST}, tries int, at long").collect()}
    assert len(rows) == 23 and all((r.status == "ok") == (k % 5 > 0) for k, r in rows.items())
    assert rows[5].status == "error: ValueError: bad 5" and rows[5].result is None and rows[7].result == "done 7"
    assert all(r.seconds >= 0 and r.peak_mb > 10 and r.s_per_page <= r.seconds for r in rows.values())
    assert all(r.tries == 1 for k, r in rows.items() if k % 5), "what is done isn't done again"
    # the next run tries what failed, and only that
    seen = spark.sparkContext.accumulator(0)

    def better(row):
        seen.add(1)
        return "at last"

    assert costs.until_done(chunks, "k", "pages", better, t) == 0 and seen.value == 4


def test_batches_are_metered(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, "xy" * k) for i in range(k + 1)], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    t = Table(spark, str(tmp_path / "costs"))

    def go(write):
        stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return stream.writeStream.foreachBatch(costs.metered(write, t, "run", "text")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    assert costs.watched(lambda: go(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")), spark, 60, f"{tmp_path}/progress") == "done"
    rows = sorted((r.rows, r.bytes, r.status) for r in t.read(costs.BATCHES).collect())
    assert rows == [(1, 0, "ok"), (2, 4, "ok"), (3, 12, "ok")]
    assert spark.read.parquet(f"{tmp_path}/progress").filter("rows > 0").count() == 3

    def fail(batch, _):
        raise RuntimeError("no")

    spark.createDataFrame([(9, "x")], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert costs.watched(lambda: go(fail), spark, 60) == "failed"
    assert t.read(costs.BATCHES).filter("status != 'ok'").first().status == "error: RuntimeError"


def test_a_stalled_query_is_stopped_and_goes_on_later(spark, tmp_path):
    spark.createDataFrame([(1, "a")], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in")
    go = lambda write: spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in").writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    # a stop waits for Python code of the batch to return
    assert costs.watched(lambda: go(lambda b, _: time.sleep(8)), spark, 2.0) == "stalled"
    got = []
    assert costs.watched(lambda: go(lambda b, _: got.append(b.count())), spark, 60) == "done" and got == [1]


@pytest.mark.parametrize("rows", [0, 3])
def test_nothing_to_do(spark, tmp_path, rows):
    chunks = spark.range(rows).selectExpr("id as k", "1 as pages")
    assert costs.until_done(chunks, "k", "pages", lambda row: "x", Table(spark, str(tmp_path / "t"))) == 0
