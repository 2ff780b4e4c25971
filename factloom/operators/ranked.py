"""The best documents of a ranked search without reading all postings: blocks of documents with the most that each can give.

Documents are dealt into blocks of about BLOCK by a hash of their key. For each term a block keeps the largest weight that
one of its documents has for it. A query adds these up to a bound for each block, scores the blocks with the largest bounds
first, and then only those whose bound reaches the score of the last document that it would return.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.search import tokens
from factloom.sources.database import scratch

#: Documents of a block, blocks of the first round for each document that is wanted, and the weights' constants.
BLOCK, AHEAD, K, B = 64, 2, 1.2, 0.75
#: Tokens of a task that builds an index.
TOKENS = 1_000_000


class RankedIndex:
    """Term weights of documents by term and block, with each block's largest, in a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.read = 0

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str = "text", path: str | None = None) -> RankedIndex:
        """Written once. Texts are dealt by block, so that terms are counted and gathered by block where its texts are: no
        posting moves between tasks, and a task has about TOKENS of them however large the table is."""
        spark = docs.sparkSession
        at = path or scratch(spark, "ranked")
        texts = docs.filter(F.col(text).isNotNull()).select(key, text)
        texts.select(key, F.size(tokens(F.col(text))).alias("_n")).write.parquet(f"{at}/lengths")
        n, mean, total = spark.read.parquet(f"{at}/lengths").agg(F.count(F.lit(1)), F.avg("_n"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        blocks = max(1, -(-n // BLOCK))
        parts = max(spark.sparkContext.defaultParallelism, -(-total // TOKENS))
        dealt = texts.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartition(parts, "block")
        words = dealt.select("block", key, tokens(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
        f = F.col("count")
        weight = f * (K + 1) / (f + K * (1 - B + B * F.col("_n") / F.lit(mean or 1.0)))
        counts = words.select("block", key, "_n", F.explode("_w").alias("term")).groupBy("block", key, "_n", "term").count()
        listed = counts.withColumn("weight", weight).groupBy("term", "block").agg(F.max("weight").alias("best"), F.count(F.lit(1)).alias("docs"), F.collect_list(F.struct(key, "weight")).alias("weights"))
        listed.sortWithinPartitions("term", "block").write.parquet(f"{at}/blocks")
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.parquet(f"{at}/size")
        return cls(spark, at, key)

    def _scored(self, rows: DataFrame, idf: dict[str, float]) -> DataFrame:
        value = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])[F.col("term")]
        return rows.groupBy(self.key).agg(F.sum(value * F.col("weight")).alias("rank"))

    def top(self, terms: list[str], most: int) -> DataFrame:
        """key, rank of the `most` best documents that have any of the terms; equal ranks are in the order of keys.

        read is then the number of postings that were looked at.
        """
        terms = sorted(set(terms))
        blocks = self.spark.read.parquet(f"{self.path}/blocks").filter(F.col("term").isin(terms))
        weights = blocks.select("term", "block", F.inline("weights"))
        n = self.spark.read.parquet(f"{self.path}/size").first().n
        held = {r.term: r.docs for r in blocks.groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in held.items()}
        if not idf:
            self.read = 0
            return weights.select(self.key, F.col("weight").alias("rank")).limit(0)
        value = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])[F.col("term")]
        # sums of several terms are rounded in their own order, so a bound has that much room
        bounds = blocks.groupBy("block").agg((F.sum(value * F.col("best")) + 1e-9).alias("bound"), F.sum("docs").alias("docs"))
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(max(1, AHEAD * most)).collect()]
        order = [F.desc("rank"), self.key]
        early = self._scored(weights.filter(F.col("block").isin(first)), idf)
        best = early.orderBy(*order).limit(most).collect()
        floor = best[-1]["rank"] if len(best) == most else 0.0
        rest = bounds.filter((F.col("bound") >= floor) & ~F.col("block").isin(first)).select("block")
        late = self._scored(weights.join(rest, "block", "left_semi"), idf)
        more = late.orderBy(*order).limit(most).collect()
        self.read = bounds.filter((F.col("bound") >= floor) | F.col("block").isin(first)).agg(F.sum("docs")).first()[0]
        kind = weights.select(self.key, F.col("weight").alias("rank")).schema
        return self.spark.createDataFrame([tuple(r) for r in best + more], kind).orderBy(*order).limit(most)
