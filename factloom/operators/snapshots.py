"""What a document is read by, and what it keeps from the version before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(coverage: Column, pages: Column) -> Column:
    """Whether a layout reader has converted all pages; unknown coverage is none."""
    return F.coalesce(coverage, F.lit(0)) >= F.coalesce(pages, F.lit(0))


def looks_like_part(name: Column) -> Column:
    """Whether a name could be a part number: short, with a digit, no address."""
    return F.coalesce((F.length(name) <= 30) & name.rlike("[0-9]") & ~F.lower(name).startswith("www"), F.lit(False))


def field_count(registers: Column) -> Column:
    """Fields of all registers of an array."""
    return F.coalesce(F.aggregate(F.transform(registers, lambda r: F.coalesce(F.array_size(r["fields"]), F.lit(0))), F.lit(0), lambda a, n: a + n), F.lit(0))


def chosen_readers(docs: DataFrame) -> DataFrame:
    """docs (stem, pages, coverage, recognised, and layout and fallback: structs of registers, part and prose) with
    registers, part, prose of the reader that counts, readers (which one that was for each), and flags.

    A finished layout reading takes the place of everything that the fallback has, so that all documents are read alike; a
    recognised scan never is one. Fewer register fields than the fallback found are flagged, not repaired.
    """
    whole = complete(F.col("coverage"), F.col("pages")) & ~F.coalesce("recognised", F.lit(False))
    some = lambda c: F.coalesce(F.array_size(c), F.lit(0)) > 0
    part = F.col("layout.part")
    named = F.when(part.isNull(), None).when(looks_like_part(part), part).when(looks_like_part(F.col("stem")), F.col("stem"))
    by = lambda have, name: F.when(have, name)
    readers = F.when(whole, F.struct(
        by(some("layout.registers"), "layout").alias("registers"), by(part.isNotNull(), "layout").alias("device_info"), F.lit("layout").alias("prose"),
    )).otherwise(F.struct(
        by(some("fallback.registers"), "fallback").alias("registers"), by(F.col("fallback.part").isNotNull(), "fallback").alias("device_info"), by(F.col("fallback.prose").isNotNull(), "fallback").alias("prose"),
    ))
    fewer = whole & (field_count(F.col("fallback.registers")) > field_count(F.col("layout.registers")))
    pick = lambda c: F.when(whole, F.col(f"layout.{c}")).otherwise(F.col(f"fallback.{c}"))
    return docs.withColumns({
        "registers": pick("registers"), "part": F.when(whole, named).otherwise(F.col("fallback.part")), "prose": pick("prose"), "readers": readers,
        "flags": F.when(fewer, F.array(F.lit("register_fields_fewer"))).otherwise(F.array().cast("array<string>")),
    })


def with_sticky(now: DataFrame, before: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """now with each fact of a person (card_<fact>), else of the version before, else its own."""
    old = before.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in facts])
    met = now.join(old, F.col(key) == F.col("_k"), "left")
    kept = {f: F.coalesce(F.col(f"card_{f}"), F.col(f"_{f}"), F.col(f)) for f in facts}
    return met.withColumns(kept).drop("_k", *[f"_{f}" for f in facts], *[f"card_{f}" for f in facts])
