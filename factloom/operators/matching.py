"""Record matching: richest match, prefixes, ordered rules, greedy and k-th pairing, link rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars

#: Prefixes up to which they are literals of the plan.
FEW_PREFIXES = 1_000


def richest_match(docs: DataFrame, keys: str, key: str, exports: DataFrame) -> DataFrame:
    """Each doc with the richest export (match, rich, pos) among its candidate keys; ties by key order, then position.

    Exports are reduced to their best row by match first, so that the join carries one row for each candidate.
    """
    best = exports.groupBy("match").agg(F.max(F.struct("rich", (-F.col("pos")).alias("back"))).alias("best"))
    asked = docs.select(key, F.posexplode(keys).alias("key_pos", "match"))
    found = asked.join(best, "match").select(key, "match", F.struct(F.col("best.rich"), (-F.col("key_pos")).alias("kp"), F.col("best.back")).alias("o"))
    return found.groupBy(key).agg(F.max(F.struct("o", "match")).alias("m")).select(key, F.col("m.match").alias("match"), F.col("m.o.rich").alias("rich"), (-F.col("m.o.back")).alias("pos"))


def longest_prefix(df: DataFrame, name: str, key: str, prefixes: DataFrame) -> DataFrame:
    """(key, owner) of the longest prefix (prefix, owner). Up to FEW_PREFIXES prefixes are looked up within the row; more
    meet every beginning of name that is no longer than the longest prefix by an equi-join."""
    few = prefixes.filter("prefix is not null").limit(FEW_PREFIXES + 1).collect()
    rows = df.filter(F.col(name).isNotNull())
    if len(few) <= FEW_PREFIXES:
        if not few:
            return rows.select(key, F.lit(None).cast("string").alias("owner")).limit(0)
        listed = F.array(*[F.struct(F.lit(len(r.prefix)).alias("n"), F.lit(r.prefix).alias("prefix"), F.lit(r.owner).alias("owner")) for r in few])
        own = F.array_max(F.filter(listed, lambda p: F.col(name).startswith(p["prefix"])))
        best = rows.select(key, own.alias("_p")).filter("_p is not null").groupBy(key).agg(F.max("_p").alias("_p"))
        return best.select(key, F.col("_p.owner").alias("owner"))
    most = prefixes.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0]
    cut = F.transform(F.sequence(F.lit(0), F.least(F.length(name), F.lit(most))), lambda n: F.substring(F.col(name), F.lit(1), n))
    found = rows.select(key, F.explode(cut).alias("prefix")).distinct().join(prefixes, "prefix")
    return found.groupBy(key).agg(F.max_by("owner", F.length("prefix")).alias("owner"))


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """The value of the first pattern that matches."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def kth_pairs(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """The k-th row of each identity on one side with the k-th on the other; nulls are values."""
    w = lambda o: Window.partitionBy(*on).orderBy(o)
    a = left.withColumn("_k", F.row_number().over(w(order)))
    b = right.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(order).alias(f"other_{order}")).withColumn("_r", F.row_number().over(Window.partitionBy(*[f"_{c}" for c in on]).orderBy(f"other_{order}")))
    cond = F.col("_k") == F.col("_r")
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, cond).drop("_k", "_r", *[f"_{c}" for c in on])


def _greedy(xs: Column, ys: Column) -> Column:
    """array of struct(a, b): the positions of each x and of the first free y with its symbol or label."""
    like = lambda x, y: y["symbol"].eqNullSafe(x["symbol"]) | F.coalesce(y["label"] == x["label"], F.lit(False))

    def take(state: Column, x: Column) -> Column:
        free, out = state["free"], state["out"]
        met = lambda y: F.concat(out, F.array(F.struct(x["pos"].alias("a"), y["pos"].alias("b"))))
        found = lambda k: F.struct(F.concat(F.slice(free, F.lit(1), k), F.slice(free, k + 2, F.size(free))).alias("free"), met(F.get(free, k)).alias("out"))
        first = F.array_position(F.transform(free, lambda y: like(x, y)), True).cast("int")
        return scalars.once(first, lambda k: F.when(k > 0, found(k - 1)).otherwise(state))

    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    return F.aggregate(xs, F.struct(ys.alias("free"), none.alias("out")), take, lambda state: state["out"])


def greedy_pairs(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b): one to one within a group, in order; rows match on symbol or on the label's first 20 characters, and
    on all of min, typ and max with at least one present. Rows of one position are in the order of symbol and label.

    Rows of different values never compete, so lists are those of one page and its values, and no row leaves the JVM.
    """
    number = lambda df, c: F.nullif(F.col(c), F.lit(float("nan"))) if df.schema[c].dataType.simpleString() in ("float", "double") else F.col(c)
    values, row = ["_min", "_typ", "_max"], F.struct(F.col("pos").cast("bigint").alias("pos"), "symbol", F.left("label", F.lit(20)).alias("label"))
    side = lambda df, n: df.select(*group, *[number(df, v[1:]).alias(v) for v in values], F.lit(n).alias("_side"), row.alias("_row"))
    rows = side(left, "x").unionByName(side(right, "y")).filter(F.coalesce(*values).isNotNull())
    lists = rows.groupBy(*group, *values).agg(*[F.array_sort(F.collect_list(F.when(F.col("_side") == n, F.col("_row")))).alias(n) for n in "xy"])
    return lists.filter((F.size("x") > 0) & (F.size("y") > 0)).select(*group, F.inline(_greedy(F.col("x"), F.col("y"))))


def rewrite_links(df: DataFrame, text: str, key: str, names: DataFrame, pattern: str = r"\[\[([^\]|]+)") -> DataFrame:
    """(key, old, new) for the links of each row whose target is in names (old, new), whatever its case."""
    links = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("link"))
    return links.join(names.withColumn("_low", F.lower("old")), F.lower("link") == F.col("_low")).select(key, F.col("link").alias("old"), "new")
