"""Streams over the driver's tables; each runs what is available and returns the state that it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import query, table
from factloom.sources.database import Table, written
from factloom.sources.database import scratch as _folder
from factloom.streaming import costs, ingest, settle


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Each user's newest event, merged batch by batch."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")
    at = _folder(spark, "upsert")
    ingest.run_available(stream.select("user_id", "event_type", "event_id", "value"), lambda b, _: ingest.upsert(b.sparkSession, b, at, "user_id", "event_id"), _folder(spark, "checkpoint"))
    return Table(spark, at).read("user_id long, event_type string, event_id long, value double")


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly event-time windows, in complete mode, which keeps every window."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    agg = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = _folder(spark, "windows")
    ingest.run_complete(agg, out, _folder(spark, "checkpoint"))
    return Table(spark, out).read(agg.schema).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "total")


@query("select doc_id, case when n_chars > 5000 then 'deferred' else 'now' end as lane from documents")
def deferred_lane(spark: SparkSession, d: str) -> DataFrame:
    return ingest.by_lane(table(spark, d, "documents"), "n_chars", 5000).select("doc_id", "lane")


@query("select event_type, min(event_id) as event_id from events group by event_type")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    return ingest.queue(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")


@query("select lang, count(*) as n from documents group by lang")
def stream_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files streamed and counted; each batch counts all rows that have come, and replaces what was counted before."""
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    out = _folder(spark, "counts")
    ingest.run_complete(stream.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), out, _folder(spark, "checkpoint"))
    return Table(spark, out).read("lang string, n long")


@query("""select l_orderkey % 500 as doc, count(*) as n from lineitem group by 1""")
def ingest_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Documents that grow between rounds: what is stale is done again, until nothing is, by one writer."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc"), "l_linenumber")
    at, counts = Table(spark, _folder(spark, "rounds")), "doc long, n long"
    seen = {"most": 0}

    def step() -> int:
        seen["most"] = min(seen["most"] + 3, 7)
        now = lines.filter(F.col("l_linenumber") <= seen["most"]).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        todo = written(ingest.stale(at.read(counts), now, "doc", "n"), "stale")
        at.merge(todo, "doc", "n")
        return todo.count()

    with ingest.alone(spark, at.path) as won:
        if won:
            ingest.until_quiet(step)
    return at.read(counts)


@query("""with o as (select ps.l_suppkey as doc, (['export', 'prose', 'roc'])[l_linenumber % 3 + 1] as source, l_quantity as value from lineitem ps where l_orderkey % 10 < 5)
select doc, source, value, count(*) as n from (select * from o where source <> 'export' union all select l_suppkey, 'export', l_quantity from lineitem where l_orderkey % 10 >= 5) group by all""")
def enrichment_repeated(spark: SparkSession, d: str) -> DataFrame:
    """An export that is read a second time takes the place of its earlier readings."""
    rows = table(spark, d, "lineitem")
    sources = F.array(F.lit("export"), F.lit("prose"), F.lit("roc"))
    old = rows.filter("l_orderkey % 10 < 5").select(F.col("l_suppkey").alias("doc"), F.element_at(sources, F.col("l_linenumber") % 3 + 1).alias("source"), F.col("l_quantity").alias("value"))
    new = rows.filter("l_orderkey % 10 >= 5").select(F.col("l_suppkey").alias("doc"), F.lit("export").alias("source"), F.col("l_quantity").alias("value"))
    once = ingest.replaced_by_source(old, new, "source")
    return ingest.replaced_by_source(once, new, "source").groupBy("doc", "source", "value").agg(F.count(F.lit(1)).alias("n"))


# A file for each user, whose length is the whole part of a value in tens; what is the same at two times in a row is one run.
_SEEN = "select user_id::varchar as path, (floor(value / 40) * 10)::bigint as length, ts as seen, event_id from events"


@query(f"""with o as ({_SEEN}), l as (select *, lag(length) over (partition by path order by seen, length) as was from o),
r as (select path, length, seen as since, lead(seen) over (partition by path order by seen, length) as next from l where was is distinct from length),
s as (select * from r where length > 0 and date_diff('microsecond', since, coalesce(next, (select max(seen) from o))) >= 43200000000),
d as (select *, lag(length) over (partition by path order by since) as before from s)
select path, length, since from d where before is distinct from length""")
def settled_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that have stood still for half a day, each time that they do so anew; state and timers in one stream."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    seen = stream.selectExpr("cast(user_id as string) as path", "cast(floor(value / 40) * 10 as bigint) as length", "timestamp '2020-01-01' as modified", "cast(ts as timestamp) as seen")
    out = _folder(spark, "settled")
    settle.append_available(settle.settled_stream(seen, 43_200), out, _folder(spark, "checkpoint"))
    return spark.read.schema(settle.SETTLED).parquet(out).select("path", "length", F.col("since").cast("timestamp_ntz").alias("since"))


@query("""with c as (select doc_id, unnest(range(1, greatest(1, (n_chars + 1999) // 2000) + 1)) as chunk, coalesce(text, '') as text from documents),
p as (select doc_id, chunk, substr(text, (chunk - 1) * 2000 + 1, 2000) as part from c)
select doc_id, chunk, case when contains(part, '|') then 'error: ValueError: a table' else 'ok' end as status, case when not contains(part, '|') then length(part)::varchar end as result from p""")
def chunk_costs(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all texts, each with how its work ended; one that fails doesn't stop the others."""
    docs = table(spark, d, "documents").selectExpr("doc_id", "coalesce(text, '') as text", "explode(sequence(1, cast(greatest(1, (n_chars + 1999) div 2000) as int))) as chunk")
    parts = docs.selectExpr("doc_id", "chunk", "substring(text, (chunk - 1) * 2000 + 1, 2000) as part")

    def work(row: dict) -> str:
        if "|" in row["part"]:
            raise ValueError("a table")
        return str(len(row["part"]))

    return costs.costed(parts, "chunk", work).select("doc_id", "chunk", "status", "result")
