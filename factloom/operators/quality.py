"""Audits: gates, precision and recall, multiset differences, banded shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gates(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(gate, subject) of every row that fails a check: (name, df, condition under which it fails), df's first column names it."""
    parts = [df.filter(bad).select(F.lit(name).alias("gate"), F.col(df.columns[0]).cast("string").alias("subject")) for name, df, bad in checks]
    return reduce(DataFrame.unionByName, parts)


def score(df: DataFrame, group: list[str], found: Column, true: Column) -> DataFrame:
    """Exact, wrong and missing counts, precision and recall by group."""
    out = df.groupBy(*group).agg(F.count_if(found & true).alias("exact"), F.count_if(found & ~true).alias("wrong"), F.count_if(~found & true).alias("missing"))
    return out.withColumns({"precision": F.try_divide("exact", F.col("exact") + F.col("wrong")), "recall": F.try_divide("exact", F.col("exact") + F.col("missing"))})


def multiset_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, shared, only_a, only_b): one union and one aggregate, instead of a join of counts."""
    both = a.select(*on, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*on, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    n = both.groupBy(*on).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    return n.select(*on, F.least("n_a", "n_b").alias("shared"), F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)).alias("only_a"), F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0)).alias("only_b"))


def witnessed(values: Column, text: Column) -> Column:
    """Whether every value of an array stands in the text as a whole number."""
    return F.forall(values, lambda v: F.rlike(text, F.concat(F.lit("(^|[^0-9.])"), v, F.lit("([^0-9]|$)"))))


def band(share: Column) -> Column:
    return F.when(share < 0.1, "under_10").when(share < 0.5, "10_to_50").otherwise("50_or_more")
