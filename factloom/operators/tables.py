"""Typing of table grids: carry-forward, merged rows, fragments, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row, within its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def split_merged(df: DataFrame, values: str, units: str) -> DataFrame:
    """df with value, unit and part: a cell that holds n values with one unit or n units becomes n rows, else stays whole."""
    v, u = F.split(F.trim(values), "\\s+"), F.split(F.trim(units), "\\s+")
    fits = (F.size(v) > 1) & ((F.size(u) == 1) | (F.size(u) == F.size(v)))
    rows = df.withColumn("_u", u).withColumn("_fits", fits)
    rows = rows.select("*", F.posexplode(F.when(fits, v).otherwise(F.array(F.trim(values)))).alias("part", "value"))
    unit = F.when(F.col("_fits"), F.try_element_at("_u", F.when(F.size("_u") == 1, F.lit(1)).otherwise(F.col("part") + 1))).otherwise(F.trim(units))
    return rows.withColumn("unit", unit).drop("_u", "_fits")


def unpack_triple(packed: Column, low: Column, typ: Column, high: Column) -> Column:
    """struct(min, typ, max): three numbers in the first of the cells are all three, two are the ends."""
    n = F.regexp_extract_all(packed, F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0))
    alone = typ.isNull() & high.isNull()
    at = lambda k: F.try_element_at(n, F.lit(k)).cast("double")
    return (
        F.when(alone & (F.size(n) == 3), F.struct(at(1).alias("min"), at(2).alias("typ"), at(3).alias("max")))
        .when(alone & (F.size(n) == 2), F.struct(at(1).alias("min"), F.lit(None).cast("double").alias("typ"), at(2).alias("max")))
        .otherwise(F.struct(low.cast("double").alias("min"), typ.cast("double").alias("typ"), high.cast("double").alias("max")))
    )


def unit_from_neighbours(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """df (symbol, unit) with a missing unit taken from the row before, else after, that has the same symbol."""
    w = Window.partitionBy(*group).orderBy(order)
    near = lambda f: F.when(f("symbol").over(w) == F.col("symbol"), f("unit").over(w))
    return df.withColumn("unit", F.coalesce("unit", near(F.lag), near(F.lead)))


def repair_units(df: DataFrame, page: list[str]) -> DataFrame:
    """df (unit) with unit and flag: a bare A, V or W is micro where its page has micro and no plain unit of that kind."""
    kind = F.regexp_extract("unit", "([AVW])$", 1)
    n = df.withColumn("_kind", kind).groupBy(*page, "_kind").agg(F.count_if(F.col("unit").startswith("u")).alias("_micro"), F.count_if(F.col("unit").rlike("^[kmM]?[AVW]$") & (F.length("unit") > 1)).alias("_plain"))
    rows = df.withColumn("_kind", kind).join(n, [*page, "_kind"])
    bare = F.col("unit").isin("A", "V", "W") & (F.col("_micro") > 0)
    out = rows.withColumn("flag", F.when(bare & (F.col("_plain") > 0), "unit_unclear").when(bare, "unit_repaired"))
    return out.withColumn("unit", F.when(F.col("flag") == "unit_repaired", F.concat(F.lit("u"), F.col("unit"))).otherwise(F.col("unit"))).drop("_kind", "_micro", "_plain")


def islands(df: DataFrame, group: list[str], order: str, starts: Column, name: str) -> DataFrame:
    """Numbers the runs of rows that begin where `starts` holds; rows before the first are 0."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def assemble_registers(items: DataFrame, doc: str) -> DataFrame:
    """(doc, register, name, fields) from an item stream (doc, seq, kind, text, top, low).

    A heading opens a register; field rows join it until the next heading, or until a top bit as high as the first comes
    after a field that ended at bit 0, which is a register without heading.
    """
    rows = islands(items, [doc], "seq", F.col("kind") == "heading", "_h").filter("_h > 0")
    field = rows.filter("kind = 'field'")
    own = Window.partitionBy(doc, "_h").orderBy("seq")
    field = field.withColumn("_first", F.first("top").over(own)).withColumn("_before", F.lag("low").over(own))
    field = field.withColumn("_again", F.sum(F.when((F.col("_before") == 0) & (F.col("top") >= F.col("_first")), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    names = rows.filter("kind = 'heading'").select(doc, "_h", F.col("text").alias("name"))
    built = field.groupBy(doc, "_h", "_again").agg(F.count(F.lit(1)).alias("fields"), F.min("seq").alias("_at"))
    out = names.join(built, [doc, "_h"], "left")
    named = F.when(F.coalesce("_again", F.lit(0)) == 0, F.col("name")).otherwise(F.concat(F.col("name"), F.lit("+"), F.col("_again").cast("string")))
    return out.select(doc, named.alias("register"), F.coalesce("fields", F.lit(0)).alias("fields"))


def zip_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two newline-packed cells as rows (part, left, right), as many as the shorter has; dashes alone are dropped."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    n = F.least(F.size(x), F.size(y))
    rows = df.select("*", F.posexplode(F.arrays_zip(F.slice(x, F.lit(1), n).alias("l"), F.slice(y, F.lit(1), n).alias("r"))).alias("part", "_z"))
    return rows.withColumn("left", F.col("_z.l")).withColumn("right", F.col("_z.r")).drop("_z").filter(~F.col("right").rlike("^[-–—]*$"))


def typed_columns(header: Column, names: dict[str, list[str]]) -> Column:
    """For each kind, the 1-based position of the first header cell that is one of its names (0: none), as a struct."""
    low = F.transform(header, lambda h: F.lower(F.trim(h)))

    def first(words: list[str]) -> Column:
        return F.array_position(F.transform(low, lambda h: h.isin(words)), F.lit(True)).cast("int")

    return F.struct(*[first(words).alias(kind) for kind, words in names.items()])
