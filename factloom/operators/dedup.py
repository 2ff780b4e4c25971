"""Duplicates, versions and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(text: Column, least: int = 500) -> Column:
    """SHA-256 of the white-space-normalised text; null below `least` characters, so that short texts never match."""
    plain = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(plain) >= least, F.sha2(plain, 256))


def first_of_copies(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """df with first_id and copies of its digest. The sums are joined back, so that hot digests don't meet in a task."""
    rows = df.withColumn("digest", digest)
    sums = rows.groupBy("digest").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(sums, "digest")


def twins(df: DataFrame, pages: Column, digest: Column, key: str) -> DataFrame:
    """(key, twin): rows that share page count and digest with an earlier row, each with the first such row."""
    rows = df.select(key, pages.alias("n_pages"), digest.alias("digest")).filter("digest is not null")
    first = rows.groupBy("n_pages", "digest").agg(F.min(key).alias("twin"))
    return rows.join(first, ["n_pages", "digest"]).filter(F.col(key) != F.col("twin")).select(key, "twin")


def version(text: Column) -> Column:
    """'2.10' as [2, 10]; arrays compare as versions do."""
    return F.transform(F.split(text, "\\."), lambda x: x.cast("int"))


def superseded(df: DataFrame, family: str, key: str, ver: str) -> DataFrame:
    """df with newest (the family's largest version) and superseded."""
    newest = df.groupBy(family).agg(F.max(ver).alias("newest"))
    return df.join(newest, family).withColumn("superseded", F.col(ver) < F.col("newest"))


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in reading order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")
