"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A sketch has three sub-tables of `size` cells, two to four for each paragraph; each paragraph digest is added to one cell
of each: a count, the XOR of digests and the XOR of their check hashes. Two sketches of one size subtract cell by cell,
which leaves only the paragraphs in which the documents differ. Peeling takes cells that hold a single digest, records
it, and removes it from its other cells, one sub-table after another. Where something is left, both sides are sketched
again in twice the size, with other places for the digests, until nothing is left.

Only cells that hold something are rows, so that a sketch costs what its paragraphs cost, whatever its size: building,
subtracting and peeling are sums and XORs by cell. Digests are dealt by document once, and every step after that stays
within its partition. Texts move once, to stand beside the next document's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, staged

#: Cells of the smallest sub-table; visits to sub-tables before a sketch counts as failed.
LEAST_SIZE, VISITS = 8, 7
#: Digests that a partition gets, on average.
KEYS = 150_000
#: A line longer than LEAST characters is cut after a sentence end, at MOST characters at the latest.
LEAST, MOST = 160, 640
#: Quantiles of doc_id, and parts of equal width that each interval between them is cut into at most.
QUANTILES, PARTS, PART_ROWS = 64, 4_096, 500

#: The sub-table of a record of a digest that was peeled off.
FOUND = 3


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^\\n]{{{LEAST},{MOST}}}?(?:(?<=[.!?]) |(?=\\n)|\\z)|[^\\n]{{{MOST}}}|[^\\n]+"), F.lit(0))


def digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of the paragraphs."""
    return F.array_sort(F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p))))


def size_for(n: Column) -> Column:
    """Cells of each sub-table for n digests: a power of two, two to four for a digest."""
    return F.greatest(F.lit(LEAST_SIZE), F.pow(F.lit(2), F.ceil(F.log2(2 * F.greatest(n, F.lit(1)))))).cast("long")


def _slot(key: Column, table: int, size: Column, attempt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(table), F.lit(attempt), key), size)


def _check(key: Column) -> Column:
    return F.hash(F.lit(29), key)


def _cell(table: int, slot: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct(F.lit(table).alias("t"), slot.alias("slot"), n.cast("long").alias("n"), key.alias("key"), check.alias("check"))


def _added(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells at one place added up; those that come to nothing are no rows."""
    sums = cells.groupBy(*by, "size", "t", "slot").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return sums.filter("n != 0 or key != 0 or check != 0")


def sketches(keys: DataFrame, by: list[str], attempt: int = 0) -> DataFrame:
    """The cells (t, slot, n, key, check) of each sketch. keys: rows of by, size, key and n (1, or -1 to subtract)."""
    key, n, size = F.col("key"), F.col("n"), F.col("size")
    each = F.array(*[_cell(t, _slot(key, t, size, attempt), n, key, _check(key)) for t in range(3)])
    return _added(keys.select(*by, "size", F.inline(each)), by)


def peel(cells: DataFrame, by: list[str], attempt: int = 0) -> DataFrame:
    """Cells after VISITS visits to sub-tables. Rows with t FOUND are digests (key) that came off, n 1 for those of the
    first sketch only and -1 of the second only; any other row is a cell that could not be peeled."""
    key, n, size, check = F.col("key"), F.col("n"), F.col("size"), F.col("check")
    for visit in range(VISITS):
        t = visit % 3
        single = (F.col("t") == t) & (F.abs(n) == 1) & (check == _check(key))
        same = F.struct("t", "slot", "n", "key", "check")
        off = [_cell(u, _slot(key, u, size, attempt), -n, key, check) for u in range(3) if u != t]
        rows = F.inline(F.when(single, F.array(*off, _cell(FOUND, key, n, key, check))).otherwise(F.array(same)))
        cells = _added(cells.select(*by, "size", rows), by)
    return cells


def differences(pairs: DataFrame, sizes: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """who, key and n of every digest that only one of two digest sets has: n 1 for the first set x, -1 for the second y.

    pairs: who (distinct), x and y (arrays of distinct digests). The larger set's size is taken first.
    """
    size = (sizes or (lambda n, m: F.greatest(size_for(n), size_for(m))))(F.size("x"), F.size("y"))
    todo = pairs.filter("x != y").withColumn("size", size)
    found, attempt = None, 0
    while True:
        total = todo.agg(F.coalesce(F.sum(F.size("x") + F.size("y")), F.lit(0))).first()[0]
        dealt = todo.repartition(total // KEYS + 1, "who")
        signed = lambda c, n: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(n).cast("long").alias("n")))
        keys = dealt.select("who", "size", F.inline(F.concat(signed("x", 1), signed("y", -1))))
        out = staged(peel(sketches(keys, ["who"], attempt), ["who"], attempt).select("who", "t", "key", "n"), "peeled")
        failed = out.filter(F.col("t") != FOUND).select("who").distinct()
        n = failed.count()
        done = out.filter(F.col("t") == FOUND).select("who", "key", "n")
        if n:
            failed = staged(failed, "failed")
            done = done.join(small(failed, n), "who", "left_anti")
        found = done if found is None else found.unionByName(done)
        if not n:
            return found
        todo = staged(todo.join(small(failed, n), "who", "left_semi").withColumn("size", 2 * F.col("size")), "again")
        attempt += 1


def fingerprints(sets: DataFrame, by: list[str]) -> DataFrame:
    """by and fingerprint, for sets (by, keys: distinct digests) that aren't empty: the sketch as text, its size and then
    sub-table.slot:n:key:check of each cell that holds something."""
    keys = sets.select(*by, size_for(F.size("keys")).alias("size"), F.explode("keys").alias("key"), F.lit(1).cast("long").alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("t", "slot", "n", F.hex("key").alias("key"), F.hex(F.col("check")).alias("check"))))
    show = lambda c: F.concat(c.t, F.lit("."), c.slot, F.lit(":"), c.n, F.lit(":"), c.key, F.lit(":"), c.check)
    made = sketches(keys, by).groupBy(*by).agg(F.first("size").alias("size"), cells.alias("cells"))
    return made.select(*by, F.concat_ws("|", F.col("size"), F.concat_ws(",", F.transform("cells", show))).alias("fingerprint"))


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Shared paragraphs over all paragraphs, from the sizes of two sets and of their difference; 1 for two empty sets."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - apart) / (a + b + apart))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with keys, the digests of the text, and next_text and next_keys: those of the document that
    follows in descending doc_id, the first after the last.

    Rows of one doc_id follow one another by text; null ids come last. Ids are cut into parts at quantiles and then by
    width, at most QUANTILES * PARTS in number; each part also gets the row that follows its last one.
    """
    cuts = [i / QUANTILES for i in range(1, QUANTILES)]
    s = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.percentile_approx("doc_id", cuts, 10_000)).first()
    low, high, rows = s[0], s[1], s[2]
    if not rows:
        low, high, inner = 0, 0, []
    else:
        inner = sorted({x for x in s[3] if low <= x < high})
    parts = max(1, min(PARTS, rows // (QUANTILES * PART_ROWS)))
    starts = [low, *[x + 1 for x in inner]]
    widths = [max(1, -(-(e - a) // parts)) for a, e in zip(starts, [*starts[1:], high + 1])]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    interval = F.size(F.filter(longs(inner), lambda x: x < F.col("doc_id"))) if inner else F.lit(0)
    part = _let(interval, lambda k: k * parts + ((F.col("doc_id") - F.element_at(longs(starts), k + 1)) / F.element_at(longs(widths), k + 1)).cast("int"))
    rows_ = docs.withColumn("_part", F.coalesce(part, F.lit(-1)))
    tops = rows_.groupBy("_part").agg(F.max("doc_id").alias("_top"))
    # at most QUANTILES * PARTS + 1 rows
    order = Window.orderBy("_part")
    tops = tops.withColumn("_to", F.coalesce(F.lead("_part").over(order), F.min("_part").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    marked = rows_.join(small(tops, QUANTILES * PARTS if parts * QUANTILES > 100_000 else 1), "_part")
    both = F.array(F.struct(F.col("_part").alias("in"), F.lit(False).alias("extra")), F.struct(F.col("_to").alias("in"), F.lit(True).alias("extra")))
    placed = marked.withColumn("_at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_top")), both).otherwise(F.slice(both, 1, 1))))
    window = Window.partitionBy("_at.in").orderBy(F.col("_at.extra"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    placed = placed.withColumn("keys", digests(F.col("text")))
    following = {"next_text": F.lead("text").over(window), "next_keys": F.lead("keys").over(window)}
    return placed.withColumns(following).filter(~F.col("_at.extra")).select("doc_id", "text", "keys", "next_text", "next_keys")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last half replaced by as much of the next document's beginning. Null texts count as empty;
    a text without paragraphs has an empty fingerprint. A table of one row is its own next. Rows that repeat a doc_id are
    fingerprinted one by one. Very long texts are sketched whole, by one task. Extra columns are ignored.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("keys").alias("a"), F.col("next_keys").alias("c"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("b"), "c")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    pair = lambda i, x, y: F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = rows.select("row", F.inline(F.array(pair(0, "a", "b"), pair(1, "a", "c")))).select((2 * F.col("row") + F.col("i")).alias("who"), "x", "y")
    apart = differences(pairs).groupBy("who").agg(F.count(F.lit(1)).alias("apart"))
    of = lambda i: F.max(F.when(F.col("who") % 2 == i, F.col("apart"))).alias(f"apart{i}")
    apart = staged(apart.groupBy(F.expr("who div 2").alias("row")).agg(of(0), of(1)), "apart")
    total = rows.agg(F.coalesce(F.sum(F.size("a") + F.size("b")), F.lit(0))).first()[0]
    parts = total // KEYS + 1
    sets = rows.select("row", "a", "b").repartition(parts, "row")
    side = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("keys"))
    texts = fingerprints(sets.select("row", F.inline(F.array(side("a"), side("b")))), ["row", "side"])
    text = lambda c: F.max(F.when(F.col("side") == c, F.col("fingerprint"))).alias(f"of_{c}")
    texts = texts.groupBy("row").agg(text("a"), text("b"))
    each = rows.select("row", "doc_id", "n_chars", "edited_sha256", *[F.size(c).alias(c) for c in "abc"])
    out = each.repartition(parts, "row").join(texts, "row", "left").join(apart.repartition(parts, "row"), "row", "left")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("of_a", F.lit("")).alias("fingerprint"), F.coalesce("of_b", F.lit("")).alias("edited_fingerprint"),
        likeness(a, b, F.coalesce("apart0", F.lit(0))).alias("near_edited"), likeness(a, c, F.coalesce("apart1", F.lit(0))).alias("near_next"),
    )
