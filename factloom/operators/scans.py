"""What is pending at each row of a sequence: a small state machine over rows, composed by partition.

Each row sets what is pending, clears it, gives a default where nothing is, or leaves it. Such steps compose: of any stretch
of rows all that counts is what it leaves, and whether that still depends on what came before. So a sequence is cut
wherever range partitions cut it; each stretch is summed up by itself; the stretches of a key, at most one for each
partition, are folded in order; and rows then read their own stretch and what was pending at its beginning. A key of any
length is dealt over as many tasks as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.database import written

#: Rows of a stretch: a task sorts a few stretches, whatever the number of rows.
STRETCH = 250_000
SET, CLEAR, DEFAULT, KEEP = "set", "clear", "default", "keep"


def pending(rows: DataFrame, key: str, order: list[str], step: Column, value: Column, parts: int | None = None) -> DataFrame:
    """rows with `before`: what is pending before each row of a key, in order; null for nothing.

    step: SET, CLEAR, DEFAULT or KEEP; value: of SET and DEFAULT. order is of unique values within a key.
    """
    own = written(rows.withColumns({"_step": step, "_value": value}), "steps")
    n = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // STRETCH))
    dealt = own.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id())
    # as many tasks as stretches, so that none holds more of them where the rows are more
    dealt = written(dealt, "stretches").repartition(n, "_part", key)

    stretch = Window.partitionBy("_part", key).orderBy(*order)
    earlier = stretch.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("_step").isin(SET, CLEAR)
    # rows after the same SET or CLEAR share a number
    dealt = dealt.withColumn("_since", F.coalesce(F.count_if(fixed).over(earlier), F.lit(0)))
    base = F.last(F.when(fixed, F.struct(F.col("_step").alias("step"), F.col("_value").alias("value"))), True).over(earlier)
    same = Window.partitionBy("_part", key, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumns({"_base": base, "_given": F.first(F.when(F.col("_step") == DEFAULT, F.col("_value")), True).over(same)})
    seen = seen.withColumn("_own", F.when(F.col("_base.step") == SET, F.col("_base.value")).otherwise(F.col("_given")))

    # what a stretch leaves, and whether it is open: something pending before it would still be
    after = F.when(F.col("_step") == SET, F.col("_value")).when(F.col("_step") == CLEAR, None).when(F.col("_step") == DEFAULT, F.coalesce("_own", "_value")).otherwise(F.col("_own"))
    last = F.struct(*order)
    sums = seen.groupBy("_part", key).agg(F.max_by(F.struct(after.alias("left"), (F.col("_base").isNull() & ~fixed).alias("open")), last).alias("x"))
    kind = dealt.schema["_value"].dataType
    chain = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "x.left", "x.open"))).alias("chain"))
    none = F.lit(None).cast(kind)
    passed = lambda a, s: F.when(s["open"], F.coalesce(a, s["left"])).otherwise(s["left"])
    begun = F.transform("chain", lambda s, i: F.struct(s["_part"].alias("_part"), F.aggregate(F.slice("chain", F.lit(1), i), none, passed).alias("_carry")))
    carried = chain.select(F.col(key).alias("_key"), F.inline(begun)).withColumnRenamed("_part", "_p")
    met = seen.join(carried, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    before = F.when(F.col("_base").isNull(), F.coalesce("_carry", "_given")).otherwise(F.col("_own"))
    return met.withColumn("before", before).select(*rows.columns, "before")


def continued_tables(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """doc, page, at, section, begun of each table of pages (doc, page, tables, heads, continued).

    tables: how many a page has; heads: the section headings on it, without those that only continue; continued: whether
    the page says that something goes on. On such a page the tables beyond its headings, first ones first, belong to the
    section that is pending; the others take the headings in turn, and what is left goes on with the last. A section that
    nothing names is Unknown and begins on its page. A page with neither tables nor that mark ends what is pending.
    """
    n, heads = F.coalesce("tables", F.lit(0)), F.coalesce("heads", F.array().cast("array<string>"))
    goes_on = F.coalesce("continued", F.lit(False))
    first = F.when(goes_on, F.greatest(n - F.size(heads), F.lit(0))).otherwise(0)
    used = F.least(F.size(heads), n - first)
    named = lambda name: F.struct(name.alias("section"), F.col("page").alias("begun"))
    step = F.when(n == 0, F.when(goes_on, KEEP).otherwise(CLEAR)).when(used > 0, SET).otherwise(DEFAULT)
    value = named(F.when(used > 0, F.get(heads, used - 1)).otherwise("Unknown"))
    at = pending(pages, "doc", ["page"], step, value, parts).filter(n > 0).withColumns({"_first": first, "_used": used})
    tables = at.withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    old = F.coalesce("before", named(F.lit("Unknown")))
    k = F.col("at") - F.col("_first")
    section = F.when(k < 0, old).when(k < F.col("_used"), named(F.get(heads, k))).when(F.col("_used") > 0, named(F.get(heads, F.col("_used") - 1))).otherwise(old)
    return tables.withColumn("x", section).select("doc", "page", "at", "x.section", "x.begun")


def summary_layouts(tables: DataFrame, parts: int | None = None) -> DataFrame:
    """tables (doc, seq, columns, address: the column of addresses by the header, null without a header, and mnemonic:
    whether the first row begins with one) with layout, the column of addresses that counts: its own, or for a table that
    goes on without a header that of the last summary table, if it has as many columns. Null for other tables."""
    own = F.col("address").isNotNull()
    value = F.struct("columns", "address")
    met = pending(tables, "doc", ["seq"], F.when(own, SET).otherwise(KEEP), value, parts)
    like = F.coalesce((F.col("before.columns") == F.col("columns")) & F.col("mnemonic"), F.lit(False))
    return met.withColumn("layout", F.when(own, F.col("address")).when(like, F.col("before.address"))).drop("before")
