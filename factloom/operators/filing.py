"""Filing plans, their validation, journals and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.matching import first_rule

#: Ranges in which a journal is numbered; each is a task.
UNDO_RANGES = 64


def plan(new: DataFrame, library: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, action, folder, reason) for new (key, digest, print, family, version, name) against library (digest, print, family, version, folder).

    The first that applies decides: same content as filed, same content earlier in this batch, same print, an older or
    equal version than the library's, a newer one (which supersedes), a rule on the name, else it needs a look.
    """
    one = lambda c, *out: library.filter(F.col(c).isNotNull()).groupBy(c).agg(*out)
    same = one("digest", F.min("folder").alias("_same"))
    twin = one("print", F.min("folder").alias("_twin"))
    kin = one("family", F.max(F.struct("version", "folder")).alias("_kin"))
    # the least key of a digest, joined back: a large group of copies is a count for each task, not a window in one
    least = new.groupBy(F.col("digest").alias("_d")).agg(F.min("key").alias("_least"))
    rows = new.join(least, F.col("digest").eqNullSafe(F.col("_d"))).withColumn("_first", F.col("key") == F.col("_least")).drop("_d", "_least")
    rows = rows.join(same, "digest", "left").join(twin, "print", "left").join(kin, "family", "left")
    ruled = first_rule(F.col("name"), rules, "")
    choice = lambda action, folder, reason: F.struct(F.lit(action).alias("action"), folder.alias("folder"), F.lit(reason).alias("reason"))
    found = F.coalesce(
        F.when(F.col("_same").isNotNull(), choice("duplicate", F.col("_same"), "content")), F.when(~F.col("_first"), choice("duplicate", F.lit(None).cast("string"), "batch")),
        F.when(F.col("_twin").isNotNull(), choice("duplicate", F.col("_twin"), "print")), F.when(F.col("version") <= F.col("_kin.version"), choice("superseded", F.col("_kin.folder"), "not newer")),
        F.when(F.col("version") > F.col("_kin.version"), choice("file", F.col("_kin.folder"), "newer")), F.when(ruled != "", choice("file", ruled, "rule")), choice("look", F.lit(None).cast("string"), "none"),
    )
    return rows.select("key", found.alias("c")).select("key", "c.action", "c.folder", "c.reason")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, refused) for each check that a row breaks; a plan with any isn't applied at all."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("refused"))


def replay(journal: DataFrame) -> DataFrame:
    """(path, state) after all ops (op_seq, op, path) of a journal: the last one of a path counts."""
    return journal.groupBy("path").agg(F.max_by("op", "op_seq").alias("state"))


def undo(journal: DataFrame) -> DataFrame:
    """The ops (op_seq, op, path, each op_seq once) that take a journal back, with the step from 1 at which each must run.

    Ranges of op_seq are ranked each by itself, and start after the counts of the ranges above them. Cuts between ranges
    are sampled, so they are written down by value: the ranks and the counts see the same ranges.
    """
    back = F.create_map(*[F.lit(x) for x in ("create", "delete", "delete", "create", "move", "move")])
    rows = journal.select("op_seq", F.coalesce(back[F.col("op")], F.col("op")).alias("op"), "path")
    cuts = sorted(set(rows.approxQuantile("op_seq", [k / UNDO_RANGES for k in range(1, UNDO_RANGES)], 0.01)))
    ranged = rows.withColumn("_range", reduce(lambda a, b: a + b, [F.coalesce((F.col("op_seq") <= c).cast("int"), F.lit(1)) for c in cuts], F.lit(0)))
    before, counts = {}, dict(ranged.groupBy("_range").count().collect())
    for r in sorted(counts):
        before[r] = sum(n for k, n in counts.items() if k < r)
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_range")] if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("op_seq")))
    return ranged.withColumn("step", (rank + start).cast("long")).drop("_range")


def corrections(fixes: DataFrame, allowed: list[str]) -> DataFrame:
    """(key, pos, fix) as (key, pos, field, value, problem): `field = value`, of which the first of each field counts."""
    field, value = F.trim(F.regexp_extract("fix", "^([^=]*)=", 1)), F.trim(F.regexp_extract("fix", "^[^=]*=(.*)$", 1))
    rows = fixes.select("key", "pos", "fix", F.lower(field).alias("field"), value.alias("value"))
    again = F.row_number().over(Window.partitionBy("key", "field").orderBy("pos")) > 1
    problem = F.when(~F.col("fix").contains("="), "no sign").when(F.col("field") == "", "no field").when(F.col("value") == "", "no value").when(~F.col("field").isin(*allowed), "unknown field").when(again, "repeated")
    return rows.withColumn("problem", problem).drop("fix")


def chunks(docs: DataFrame, key: str, pages: str, size: int, done: DataFrame) -> DataFrame:
    """(key, first, last) page ranges of at most `size` that done (key, first) doesn't have."""
    rows = docs.filter(F.col(pages) > 0).select(key, pages, F.explode(F.sequence(F.lit(1), F.col(pages), F.lit(size))).alias("first"))
    return rows.withColumn("last", F.least(F.col("first") + size - 1, F.col(pages))).drop(pages).join(done, [key, "first"], "left_anti")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nearest_twin(left: DataFrame, right: DataFrame, identity: list[str]) -> DataFrame:
    """Left rows (identity, pos, min, typ, max) that no right row of their identity equals in place, with the right row
    that has the same values in another order (the first), else the first one, and which of the two it is.

    Rows without values take no part. The right side is reduced to a row for each identity and set of values before it is
    joined, so that no pairs of rows are listed.
    """
    values = F.array_sort(F.filter(F.array("min", "typ", "max"), lambda x: x.isNotNull()))
    held = F.coalesce("min", "typ", "max").isNotNull()
    own, other = left.filter(held), right.filter(held).withColumnRenamed("pos", "other")
    places = other.select(*[F.col(c).alias(f"_{c}") for c in (*identity, "min", "typ", "max")]).distinct()
    same = F.lit(True)
    for c in identity:
        same = same & (F.col(c) == F.col(f"_{c}"))
    for c in ("min", "typ", "max"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rest = own.join(places, same, "left_anti").select(*identity, "pos", values.alias("v"))
    shifts = other.groupBy(*identity, values.alias("v")).agg(F.min("other").alias("shift"))
    firsts = other.groupBy(*identity).agg(F.min("other").alias("first"))
    found = rest.join(firsts, identity).join(shifts, [*identity, "v"], "left")
    return found.select(*identity, "pos", F.coalesce("shift", "first").alias("other"), F.when(F.col("shift").isNotNull(), "column_shift").otherwise("readers_disagree").alias("flag"))
