"""Which short passages stand in which texts, word boundaries or not.

A passage is found by a key: up to three of its whole words, the inner ones, which stand between spaces wherever the
passage stands. Up to FEW passages, keys are a set within the plan: a text's words are looked up one by one, its few
candidates are checked where the text is at hand, and nothing is shuffled but hits. More passages meet the texts' word
groups by a join. Passages without an inner word have a run of characters for a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passages up to which keys are literals of the plan (beyond it they are joined), and words of a key.
FEW, WORDS = 5_000, 3


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "\\s+", " ")


def _keyed(heads: DataFrame) -> DataFrame:
    """heads (item, head) with n (words of the key) and key; the first and the last word may go on in a text."""
    words = F.split("head", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    n = F.least(F.size(inner), F.lit(WORDS))
    return heads.select("item", "head", n.alias("n"), F.array_join(F.slice(inner, F.lit(1), n), " ").alias("key"))


def _looked_up(words: Column, keys: list[str], n: int) -> Column:
    """Keys of n words that a text's words have: places of a key's first word first, then the whole key there."""
    first = sorted({k.split(" ")[0] for k in keys})
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(first), i + 1)), lambda i: i.isNotNull())
    groups = F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.filter(groups, lambda g: g.isin(keys))


def _joined_up(docs: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """doc, item, head of texts and heads that share a key, by a join."""
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    return docs.select("doc", F.explode(F.array_distinct(groups)).alias("key")).join(heads.filter(F.col("n") == n), "key").select("doc", "item", "head").distinct()


def passages_found(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """item, doc of every passage (item, head) that stands in a text (doc, text), both squeezed; nulls and
    empty passages stand nowhere."""
    # a table of few files is dealt to all cores, as each word is looked at
    cores = docs.sparkSession.sparkContext.defaultParallelism
    dealt = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    plain = dealt.filter("text is not null").select("doc", squeezed(F.col("text")).alias("p"))
    split = plain.withColumn("w", F.split("p", " "))
    keyed = _keyed(heads.filter("head != ''"))
    few = keyed.limit(FEW + 1).collect()
    if len(few) <= FEW:
        by_n: dict[int, list[str]] = {}
        for r in few:
            by_n.setdefault(r.n, []).append(r.key if r.n else r.head)
        keys = {n: sorted(set(k)) for n, k in by_n.items()}
        if not keys:
            return plain.select(F.lit(None).cast(heads.schema["item"].dataType).alias("item"), "doc").limit(0)

        def candidates(words: Column) -> Column:
            """words is a lambda's variable, so that a text is split once."""
            found = [_looked_up(words, k, n) for n, k in sorted(keys.items()) if n]
            if 0 in keys:
                found.append(F.filter(F.array(*[F.lit(h) for h in keys[0]]), lambda h: F.contains(F.col("p"), h)))
            return F.array_distinct(F.concat(*found))

        # outer: an inner one would have the whole expression a second time, in a filter of its own
        met = plain.select("doc", "p", F.explode_outer(F.element_at(F.transform(F.array(F.split("p", " ")), candidates), 1)).alias("met")).filter("met is not null")
        # at most FEW rows
        named = keyed.select("item", "head", F.when(F.col("n") > 0, F.col("key")).otherwise(F.col("head")).alias("met"))
        return met.join(F.broadcast(named), "met").filter(F.contains(F.col("p"), F.col("head"))).select("item", "doc").distinct()
    found = [_joined_up(split, keyed, n) for n in range(1, WORDS + 1)]
    # without an inner word, the first characters are the key, as many as the shortest of these passages has
    loose = keyed.filter("n = 0")
    size = loose.agg(F.min(F.length("head"))).first()[0]
    if size:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - size + 1, F.lit(1))), lambda i: F.substring("p", i, F.lit(size)))
        short = loose.withColumn("key", F.left("head", F.lit(size)))
        found.append(plain.select("doc", F.explode(F.array_distinct(runs)).alias("key")).join(short, "key").select("doc", "item", "head").distinct())
    pairs = reduce(DataFrame.unionByName, found)
    hits = pairs.join(plain, "doc").filter(F.contains(F.col("p"), F.col("head"))).select("item", "doc")
    return hits.distinct()
