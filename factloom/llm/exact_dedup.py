"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where its content says so: at a sentence end once a chunk has MIN_CHUNK characters, at
MAX_CHUNK at the latest. Chunks are deduplicated to identifiers: a 128-bit digest that is verified against length and a
second, independent hash over the whole corpus. A document is then its recipe, the ordered list of its identifiers, and
equal recipes mean equal texts. Texts are never shuffled; only identifiers travel, and each map task merges equal ones
before it sends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import one_of_each, staged

MIN_CHUNK, MAX_CHUNK = 512, 4096


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks whose concatenation is text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?:(?<=[.!?] )|\\z)|.{{{most}}}|.+"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.substring(F.sha2(chunk, 256), 1, 32).alias("digest"), F.length(chunk).alias("size"), F.xxhash64(chunk).alias("witness"))


def conflicts(chunked: DataFrame) -> DataFrame:
    """Digests that stand for more than one chunk: those whose length or witness differs between occurrences."""
    seen = chunked.select(F.explode("_ids").alias("c")).select("c.*")
    one = seen.groupBy("digest").agg(F.min(F.struct("size", "witness")).alias("lo"), F.max(F.struct("size", "witness")).alias("hi"))
    return one.filter("lo != hi").select("digest")


def recipes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, text_sha256 of the normalised text, and recipe: the ordered verified chunk identifiers.

    Identifiers are the digests; should any two chunks of the corpus share one, all identifiers carry length and
    witness too, so a collision never merges texts.
    """
    norm = docs.withColumn("_norm", normalise(F.col("text")))
    chunked = norm.select(*keep, F.sha2("_norm", 256).alias("text_sha256"), F.transform(chunks(F.col("_norm")), identifier).alias("_ids"))
    # chunked and hashed once; only identifiers are written
    chunked = staged(chunked, "chunked")
    clash = bool(conflicts(chunked).take(1))
    name = (lambda c: F.concat_ws(":", c.digest, c.size, F.hex(c.witness))) if clash else (lambda c: c.digest)
    return chunked.select(*keep, "text_sha256", F.transform("_ids", name).alias("recipe"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, and n_chunks.

    Null texts count as empty; texts are equal after each white-space run became one space. keep_id is the smallest
    doc_id of the group (nulls only where all are null). Of rows that also share that doc_id all are kept. Very long
    texts are chunked whole. An empty table gives an empty result; extra columns are ignored.
    """
    each = recipes(docs, ["doc_id"])
    # the list itself is compared; its digest only decides where it is compared
    each = each.select("doc_id", "text_sha256", "recipe")
    groups = each.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return each.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns, of kinds that can be ordered) that exact_groups keeps; of rows equal in doc_id and text, the smallest.

    Null texts count as empty, and one of those stays; a null doc_id stays only where its group has no other. Very long
    texts are chunked whole; an empty table gives no rows.
    """
    keys = exact_groups(docs).filter("kept").groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("rows"))
    return one_of_each(docs, keys, F.sha2(normalise(F.col("text")), 256))
