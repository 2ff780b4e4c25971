"""Two readings of the same documents, row by row as multisets: what agrees, what moved, what changed, what one has alone.

Equal rows are one entry with a count for each side, so that a step is arithmetic on counts. What a step leaves goes to
the next, with a coarser identity each time: page and values with the symbol, page and values, symbol and values on
another page, symbol on the same page. Where a step takes only some of an identity's rows, it takes them in the order of
the columns that the identity leaves open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUES = ("min", "typ", "max")
_KEY = ("page", *VALUES)


def shown(value: Column) -> Column:
    """A value as it is printed: without a fraction of zero."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def identity(symbol: Column, parameter: Column) -> Column:
    """What names a row: letters and digits of the symbol, else of the parameter; empty for neither."""
    name = F.when(F.coalesce(symbol, F.lit("")) != "", symbol).otherwise(F.coalesce(parameter, F.lit("")))
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def numbers_read(text: Column) -> Column:
    """What values can be read in a page's text, each once: its digits with points and a sign, cut where a number can't go
    on, and their beginnings before a point; 3.3 is read in 3.3.1 and not in 13.3 or 3.31."""
    plain = F.coalesce(text, F.lit(""))
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(plain, F.lit(f"(?:^|[^0-9.])({sign}[0-9]+(?:[.][0-9]+)*)"), F.lit(1)) for sign in ("", "-")]))
    begins = lambda parts: F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "."))
    return F.array_distinct(F.flatten(F.transform(F.transform(found, lambda x: F.split(x, "[.]")), begins)))


def witnessed(read: Column) -> Column:
    """Whether every value of a row is among the numbers_read of its page; a row without values isn't."""
    seen = F.coalesce(*[F.col(v) for v in VALUES]).isNotNull()
    for v in VALUES:
        seen = seen & (F.col(v).isNull() | F.coalesce(F.array_contains(read, shown(F.col(v))), F.lit(False)))
    return seen


def entries(base: DataFrame, variant: DataFrame) -> DataFrame:
    """doc, page, name, min, typ, max, a, b: distinct rows of both sides with how often each has them."""
    sides = []
    for df, (a, b) in ((base, (1, 0)), (variant, (0, 1))):
        sides.append(df.select("doc", "page", identity(F.col("symbol"), F.col("parameter")).alias("name"), *VALUES, F.lit(a).alias("a"), F.lit(b).alias("b")))
    return sides[0].unionByName(sides[1]).groupBy("doc", "page", "name", *VALUES).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _taken(left: DataFrame, by: list[str], order: list[str], name: str, when: Column | None = None) -> DataFrame:
    """left with name_a and name_b, what the identity `by` matches of each entry's a and b (as many of each side in all),
    and a and b without it."""
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ok = F.lit(True) if when is None else when
    both = F.least(F.sum("a").over(whole), F.sum("b").over(whole))
    room = {s: both - F.coalesce(F.sum(s).over(before), F.lit(0)) for s in "ab"}
    left = left.withColumns({f"{name}_{s}": F.when(ok, F.least(F.col(s), F.greatest(room[s], F.lit(0)))).otherwise(0) for s in "ab"})
    return left.withColumns({s: F.col(s) - F.col(f"{name}_{s}") for s in "ab"})


def aligned(base: DataFrame, variant: DataFrame) -> DataFrame:
    """entries with base and variant (the counts), same, agree_*, only_* (what agreement leaves), moved_*, changed_* of
    either side, and what is left of a and b.

    Rows without a name can't be told apart by it: they neither move nor change.
    """
    at = entries(base, variant).withColumns({"base": F.col("a"), "variant": F.col("b"), "same": F.least("a", "b")})
    at = at.withColumns({s: F.col(s) - F.col("same") for s in "ab"})
    at = _taken(at, ["doc", *_KEY], ["name"], "agree").withColumns({f"only_{s}": F.col(s) for s in "ab"})
    named = F.col("name") != ""
    at = _taken(at, ["doc", "name", *VALUES], ["page"], "moved", named)
    return _taken(at, ["doc", "page", "name"], list(VALUES), "changed", named)


def changes(base: DataFrame, variant: DataFrame) -> DataFrame:
    """doc, page, name, k, was, now: rows that changed, the k-th of a name on a page with the k-th, both in the order of
    their values, which pairs nearest values."""
    left = aligned(base, variant)

    def side(n: str, name: str) -> DataFrame:
        rows = left.filter(F.col(n) > 0).select("doc", "page", "name", *VALUES, F.explode(F.sequence(F.lit(1), n)).alias("_i"))
        k = F.row_number().over(Window.partitionBy("doc", "page", "name").orderBy(*VALUES)).alias("k")
        return rows.select("doc", "page", "name", k, F.struct(*VALUES).alias(name))

    return side("changed_a", "was").join(side("changed_b", "now"), ["doc", "page", "name", "k"])


COUNTS = ("rows_base", "rows_variant", "agree", "same_symbol", "only_base", "only_variant", "moved", "changed", "witnessed_base", "witnessed_variant")


def report(base: DataFrame, variant: DataFrame, pages: DataFrame) -> DataFrame:
    """COUNTS by doc, and for all docs with a null doc.

    base, variant: doc, page, symbol, parameter, min, typ, max. pages: doc, page, text, one row a page. A witnessed row is
    one whose page and values one side has more often, and whose page has all its values in its text.
    """
    at = aligned(base, variant)
    # rows of one page and values share their fate as a whole
    keys = at.groupBy("doc", *_KEY).agg(*[F.sum(c).alias(c) for c in ("base", "variant", "same", "agree_a", "only_a", "only_b", "moved_a", "changed_a")])
    # a page is read once, not once for each of its rows
    texts = pages.select("doc", "page", numbers_read(F.col("text")).alias("_read"))
    held = keys.join(texts, ["doc", "page"], "left").withColumn("_seen", witnessed(F.col("_read")).cast("int"))
    some = lambda n, of: F.when(F.col(n) > 0, F.col(of) * F.col("_seen")).otherwise(0)
    rows = held.select(
        "doc", F.col("base").alias("rows_base"), F.col("variant").alias("rows_variant"), (F.col("same") + F.col("agree_a")).alias("agree"), F.col("same").alias("same_symbol"),
        F.col("only_a").alias("only_base"), F.col("only_b").alias("only_variant"), F.col("moved_a").alias("moved"), F.col("changed_a").alias("changed"),
        some("only_a", "base").alias("witnessed_base"), some("only_b", "variant").alias("witnessed_variant"),
    )
    by_doc = rows.groupBy("doc").agg(*[F.sum(c).alias(c) for c in COUNTS])
    total = by_doc.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    return by_doc.unionByName(total.withColumn("doc", F.lit(None).cast(by_doc.schema["doc"].dataType)))


def register_counts(registers: DataFrame) -> DataFrame:
    """doc, registers, addressed, fields of a reading's registers (doc, address, fields as an array); ? is no address."""
    known = F.coalesce(F.col("address") != "?", F.lit(False))
    return registers.groupBy("doc").agg(F.count(F.lit(1)).alias("registers"), F.count_if(known).alias("addressed"), F.sum(F.coalesce(F.array_size("fields"), F.lit(0))).alias("fields"))


def run_together_share(items: DataFrame) -> DataFrame:
    """doc, share: per cent of text items (doc, label, text) that are read without their spaces; page headers and footers
    and blank items don't count."""
    text = F.trim("text")
    real = items.filter(~F.col("label").isin("page_header", "page_footer") & (F.length(text) > 0))
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    together = (F.length("text") >= 20) & (spaces / F.length("text") < 0.06)
    return real.groupBy("doc").agg((100 * F.count_if(together) / F.count(F.lit(1))).alias("share"))
