"""Record-level operators: ranges of a table section, anomalies, cascades, carry-forward, selection and clean-up of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import evidence


def section_range(rows: DataFrame, by: list[str], wanted: str, excluded: str, section: str) -> DataFrame:
    """by, lo, hi and page of the first row (seq) of a section whose symbol and parameter match wanted and not excluded.

    Its min, typ and max cells are read together: of three numbers or more the first and last count, of one the first.
    """
    blob = F.concat_ws(" ", F.coalesce("symbol", F.lit("")), F.coalesce("parameter", F.lit("")))
    kept = rows.filter(F.lower("section").contains(section) & blob.rlike(wanted) & ~blob.rlike(excluded))
    cells = F.concat_ws(" ", *[F.col(c) for c in ("min", "typ", "max")])
    first = kept.groupBy(*by).agg(F.min_by(F.struct(cells.alias("cells"), "unit", "page"), "seq").alias("r"))
    n = scalars.numbers_in(F.col("r.cells"), scalars.unit_scale(F.col("r.unit")))
    return first.withColumn("n", n).select(*by, F.try_element_at("n", F.lit(1)).alias("lo"), F.when(F.size("n") > 1, F.element_at("n", -1)).alias("hi"), F.col("r.page").alias("page"))


def anomalies(df: DataFrame) -> DataFrame:
    """df (vin, vout and page1_vout as _min and _max; vin_confidence, vout_confidence) put right, with flags and overall.

    An output that echoes the input falls back to the first page's, low, or to nothing; a zero input minimum lowers the
    input; an inverted range is none. The lowest rated level is the overall one, low if anything is flagged or no output
    is left.
    """
    c = F.col
    same = lambda a, b: evidence.close(c(f"{a}_min"), c(f"{b}_min"), 0.01) & evidence.close(c(f"{a}_max"), c(f"{b}_max"), 0.01)
    held = c("page1_vout_min").isNotNull() & c("page1_vout_max").isNotNull()
    out = df.withColumns({"_echo": same("vout", "vin"), "_back": held & ~same("page1_vout", "vin")})
    end = lambda e: F.when(c("_echo"), F.when(c("_back"), c(f"page1_vout_{e}"))).otherwise(c(f"vout_{e}"))
    level = F.when(c("_echo"), F.when(c("_back"), "low").otherwise("none")).otherwise(c("vout_confidence"))
    zero = F.coalesce(c("vin_min") == 0, F.lit(False))
    out = out.withColumns({"vout_min": end("min"), "vout_max": end("max"), "vout_confidence": level, "vin_confidence": F.when(zero, "low").otherwise(c("vin_confidence")), "_zero": zero})
    for key in ("vin", "vout"):
        bad = F.coalesce(c(f"{key}_min") > c(f"{key}_max"), F.lit(False))
        out = out.withColumn(f"_{key}", bad)
        out = out.withColumns({f"{key}_{e}": F.when(~c(f"_{key}"), c(f"{key}_{e}")) for e in ("min", "max")} | {f"{key}_confidence": F.when(c(f"_{key}"), "none").otherwise(c(f"{key}_confidence"))})
    names = [("_echo", "vout_echoes_vin"), ("_fallback", "vout_from_page1_fallback"), ("_zero", "vin_min_zero_suspect"), ("_vin", "vin_range_inverted"), ("_vout", "vout_range_inverted")]
    out = out.withColumn("_fallback", c("_echo") & c("_back"))
    out = out.withColumn("flags", F.filter(F.array(*[F.when(c(x), name) for x, name in names]), lambda x: x.isNotNull()))
    least = evidence.least_level(F.array("vin_confidence", "vout_confidence"))
    unclean = (c("vout_confidence") == "none") | (F.size("flags") > 0)
    return out.withColumn("overall", F.when(unclean & (least != "none"), "low").otherwise(least)).drop("_echo", "_back", "_zero", "_fallback", "_vin", "_vout")


def value_page(readings: Column, lo: Column, hi: Column) -> Column:
    """The page of the first reading (page, min, max) that agrees with the shown ends, else of the first with a page."""
    paged = F.filter(readings, lambda r: r["page"].isNotNull())
    fits = F.filter(paged, lambda r: evidence.same_end(r["min"], lo) & evidence.same_end(r["max"], hi))
    return F.coalesce(F.try_element_at(fits, F.lit(1))["page"], F.try_element_at(paged, F.lit(1))["page"])


def first_prefix(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first rule whose prefix text starts with; an empty value stops the search and falls through."""
    out = otherwise
    for prefix, value in reversed(rules):
        out = F.when(text.startswith(prefix), F.lit(value) if value else otherwise).otherwise(out)
    return out


def carried(df: DataFrame, by: list[str], order: str, group: Column, name: str) -> DataFrame:
    """df with name: the last group (null where a row opens none) at or before each row."""
    return df.withColumn(name, F.last(group, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def heading_before(items: DataFrame, by: str, author: Column) -> DataFrame:
    """by, title (the heading just before the first author-like line) and authors."""
    seen = F.last(F.when(F.col("label") == "heading", F.col("text")), ignorenulls=True).over(Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    lines = items.withColumn("title", seen).filter(author & (F.col("label") != "heading") & F.col("title").isNotNull())
    return lines.groupBy(by).agg(F.min_by("title", "seq").alias("title"), F.min_by("text", "seq").alias("authors"))


def joined_fragments(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows (symbol) with a lone letter joined to the next row's symbol; the next row gives its symbol up.

    A chain of lone letters joins pairwise from its start.
    """
    w = Window.partitionBy(by).orderBy(order)
    lone = F.col("symbol").rlike("^[A-Za-z]$")
    run = F.sum((~lone).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = rows.withColumns({"_lone": lone, "_run": F.coalesce(run, F.lit(0))})
    df = df.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_run").orderBy(order)))
    takes = F.col("_lone") & (F.col("_at") % 2 == 1) & F.lead("symbol").over(w).isNotNull()
    df = df.withColumns({"_takes": takes, "_next": F.lead("symbol").over(w)})
    given = F.coalesce(F.lag("_takes").over(w), F.lit(False))
    return df.withColumn("_given", given).withColumn("symbol", F.when(F.col("_takes"), F.concat("symbol", "_next")).when(~F.col("_given"), F.col("symbol"))).drop("_lone", "_run", "_at", "_takes", "_next", "_given")


def relevant(params: DataFrame, converts: Column) -> DataFrame:
    """Params of products that convert, and of others those that aren't `fsw` and have a source besides the first page."""
    other = F.exists("sources", lambda s: s != "page1")
    return params.filter(converts | ((F.col("key") != "fsw") & other))


def upserted(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and value of either side: new values win unless they are empty, so that nothing stored is lost."""
    a, b = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    return a.join(b, key, "full").select(key, F.coalesce(F.when(F.length("_new") > 0, F.col("_new")), "_old").alias(value))


def edited(props: Column, changes: Column, dropped: list[str]) -> Column:
    """A map of properties with some set and some deleted."""
    kept = F.map_filter(props, lambda k, _: ~k.isin(*dropped) & ~F.map_contains_key(changes, k))
    return F.map_concat(kept, F.map_filter(changes, lambda k, _: ~k.isin(*dropped)))


def page_text(layout: Column, plain: Column, ocr: Column) -> Column:
    """struct(reader, text): the first reader of a page that has something."""
    some = lambda name, c: F.when(F.length(F.trim(c)) > 0, F.struct(F.lit(name).alias("reader"), F.trim(c).alias("text")))
    return F.coalesce(some("layout", layout), some("plain", plain), some("ocr", ocr), F.struct(F.lit("none").alias("reader"), F.lit("no text").alias("text")))
