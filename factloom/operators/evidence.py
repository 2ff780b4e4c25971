"""Several independent readings of one quantity become one value with a confidence and a record of dissent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("none", "low", "medium", "high")


def close(a: Column, b: Column, share: float = 0.05, floor: float = 0.0) -> Column:
    """Equal within a share of the larger magnitude, or within floor; false where either is absent."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(share) * F.greatest(F.abs(a), F.abs(b)), F.lit(floor)), F.lit(False))


def same_end(a: Column, b: Column, share: float = 0.05) -> Column:
    return (a.isNull() & b.isNull()) | close(a, b, share)


def held(x: str) -> Column:
    return F.col(f"{x}_min").isNotNull() | F.col(f"{x}_max").isNotNull()


def pair_agrees(x: str, y: str) -> Column:
    return held(x) & held(y) & same_end(F.col(f"{x}_min"), F.col(f"{y}_min")) & same_end(F.col(f"{x}_max"), F.col(f"{y}_max"))


def fuse(df: DataFrame, sources: tuple[str, str, str] = ("prose", "roc", "page1")) -> DataFrame:
    """df (<source>_min, <source>_max) with source, min, max, confidence and dissent, in the sources' order of trust.

    A pair that agrees is high, and the third is the dissenter if it says something else; without agreement the first
    source stands, low; a lone source is medium, the last one low.
    """
    p, r, g = sources

    def verdict(source: str, level: str, dissent: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(source).alias("source"), F.lit(level).alias("confidence"), (none if dissent is None else dissent).alias("dissent"))

    # each test is a column of its own, so that the rules stay small
    tests = {"_pr": pair_agrees(p, r), "_pg": pair_agrees(p, g), "_rg": pair_agrees(r, g), "_p": held(p), "_r": held(r), "_g": held(g)}
    base, df = df.columns, df.withColumns(tests)
    t = F.col
    rules = [
        (t("_pr"), verdict(p, "high", F.when(t("_g") & ~t("_pg"), F.lit(g)))), (t("_pg"), verdict(p, "high", F.when(t("_r") & ~t("_pr"), F.lit(r)))), (t("_rg"), verdict(r, "high", F.when(t("_p") & ~t("_pr"), F.lit(p)))),
        (t("_p") & (t("_r") | t("_g")), verdict(p, "low", F.concat_ws(",", F.when(t("_r"), F.lit(r)), F.when(t("_g"), F.lit(g))))),
        (t("_p"), verdict(p, "medium")), (t("_r") & t("_g"), verdict(r, "low", F.lit(g))), (t("_r"), verdict(r, "medium")), (t("_g"), verdict(g, "low")),
    ]
    chosen = reduce(lambda acc, x: acc.when(*x), rules[1:], F.when(*rules[0])).otherwise(F.struct(F.lit(None).cast("string").alias("source"), F.lit("none").alias("confidence"), F.lit(None).cast("string").alias("dissent")))
    out = df.withColumn("_v", chosen).select(*base, "_v.source", "_v.confidence", "_v.dissent")
    pick = lambda end: F.coalesce(*[F.when(F.col("source") == s, F.col(f"{s}_{end}")) for s in sources])
    return out.withColumn("min", pick("min")).withColumn("max", pick("max"))


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")


def least_level(levels: Column) -> Column:
    """The lowest of an array of levels, `none` being unrated: it counts only where nothing else is there."""
    rated = F.filter(levels, lambda x: x != "none")
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in LEVELS]), F.array_min(F.transform(rated, rank))), F.lit("none"))


def sane(df: DataFrame) -> DataFrame:
    """df (min, max) with inverted ranges nulled and flags saying so; equal ends are legal."""
    bad = F.coalesce(F.col("min") > F.col("max"), F.lit(False))
    flags = F.filter(F.array(F.when(bad, F.lit("inverted_range")), F.when(F.col("min") == 0, F.lit("zero_minimum"))), lambda x: x.isNotNull())
    return df.withColumn("flags", flags).withColumns({"min": F.when(~bad, F.col("min")), "max": F.when(~bad, F.col("max"))})


def prefer_reader(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """One source read twice: the first reader's value, else the second's, and whether they disagree."""
    ends = {f"{name}_{e}": F.coalesce(f"{first}_{e}", f"{second}_{e}") for e in ("min", "max")}
    return df.withColumns(ends | {"readers_disagree": held(first) & held(second) & ~pair_agrees(first, second)})


def reconcile(df: DataFrame) -> DataFrame:
    """df (doc_min, doc_max, doc_confidence, export_min, export_max, override) with outcome, value_min, value_max, confidence, contested.

    An absent end on either side is compatible. A conflict is contested; there a high document beats the export.
    """
    fits = lambda e: F.col(f"doc_{e}").isNull() | F.col(f"export_{e}").isNull() | close(F.col(f"doc_{e}"), F.col(f"export_{e}"), 0.02, 1e-6)
    doc, export = held("doc"), held("export")
    agree = doc & export & fits("min") & fits("max")
    outcome = F.when(F.col("override").isNotNull(), "override").when(agree, "agree").when(doc & export, "conflict").when(export, "export_only").when(doc, "doc_only").otherwise("none")
    out = df.withColumn("outcome", outcome)
    strong = (F.col("outcome") == "conflict") & (F.col("doc_confidence") == "high")
    from_export = (F.col("outcome") == "export_only") | ((F.col("outcome") == "conflict") & ~strong)
    end = lambda e: F.when(F.col("outcome") == "override", F.col("override")).when(from_export, F.col(f"export_{e}")).otherwise(F.coalesce(f"doc_{e}", f"export_{e}"))
    level = F.when(F.col("outcome").isin("override", "agree"), "high").when(F.col("outcome").isin("conflict", "export_only"), "medium").when(F.col("outcome") == "doc_only", F.col("doc_confidence")).otherwise("none")
    return out.withColumns({"value_min": end("min"), "value_max": end("max"), "confidence": level, "contested": F.col("outcome") == "conflict"})
