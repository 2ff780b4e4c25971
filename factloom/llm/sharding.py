"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns virtual nodes at 64-bit places of the ring; a key belongs to the first node at or after its own place.
Shards accept keys up to their bound; what overflows continues clockwise to the next shard with room. With the bounds
floor(n / shards) and one more for the first n mod shards shards, every shard ends exactly full: counts are at most one
apart, and only overflowing keys leave their home.

The ring is cut into equal slices, and a slice at each node within it. Only counts by such cuts (at most 2 ** MAX_BITS and
one for each node) reach the driver; rows are ranked within their cut.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused

#: The least and most slices that the ring is cut into, as bits.
LEAST_BITS, MAX_BITS = 12, 16
#: Rows that a slice should hold on average.
SLICE_ROWS = 20_000


def virtual_nodes(shards: int, each: int) -> list[tuple[int, int]]:
    """(place from 0 to 2 ** 64 - 1, shard), in ring order. A shard's nodes don't depend on how many others there are."""
    made = {}
    for s in range(shards):
        for v in range(each):
            made[int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")] = s
    if len(made) < shards * each:
        raise ValueError("two virtual nodes share a place")
    return sorted(made.items())


def allocate(counts: dict[tuple[int, int], int], before: list[int], shards: int, nodes: list[tuple[int, int]]) -> list[tuple]:
    """Segments (slice, cut, first rank, end rank, shard, first slot, home) by a clockwise walk over the cuts.

    before: nodes that lie before each slice. A cut is the number of nodes of its slice that lie before its keys.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, ahead, out = [0] * shards, list(range(len(nodes))), []

    def open_node(k: int) -> int:
        """The first node from k on, clockwise, whose shard has room; full ones are skipped for good."""
        passed = []
        while not room[nodes[k][1]]:
            passed.append(k)
            k = (k + 1) % len(nodes) if ahead[k] == k else ahead[k]
        for p in passed:
            ahead[p] = k
        return k

    for cut in sorted(counts):
        left, rank = counts[cut], 0
        k = (before[cut[0]] + cut[1]) % len(nodes)
        home = nodes[k][1]
        while left:
            k = open_node(k)
            s = nodes[k][1]
            take = min(left, room[s])
            out.append((*cut, rank, rank + take, s, filled[s], home))
            room[s], filled[s], left, rank = room[s] - take, filled[s] + take, left - take, rank + take
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bounded_ring(df: DataFrame, key: Column, order: list[Column], shards: int = 8, each: int = 64) -> DataFrame:
    """df with home_shard, shard and slot (gapless from 0 in each shard) added.

    key: decides the place on the ring. order: columns that break ties of it; rows equal in all of them are
    interchangeable. Null keys hash like any value. An empty df gives an empty result. df's own columns of these three
    names are replaced, others stay whatever their names.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark, nodes = df.sparkSession, virtual_nodes(shards, each)
    total = df.count()
    bits = min(MAX_BITS, max(LEAST_BITS, (total // SLICE_ROWS).bit_length()))
    places = [p for p, _ in nodes]
    before = [bisect.bisect_left(places, s << (64 - bits)) for s in range(1 << bits)]
    ends = [*before[1:], len(nodes)]
    kept = df.drop("home_shard", "shard", "slot")
    h, part, cut, rank, lo, hi, first, at = (unused(kept, n) for n in ("_h", "_slice", "_cut", "_rank", "_lo", "_hi", "_first", "_nodes"))
    rows = kept.withColumn(h, F.xxhash64(F.lit("ring"), key)).withColumn(part, F.shiftrightunsigned(h, 64 - bits).cast("int"))
    # one row for each slice that has nodes
    held = [{part: s, at: [_signed(p) for p in places[a:b]]} for s, (a, b) in enumerate(zip(before, ends)) if b > a]
    inner = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(held)), f"array<struct<{part}:int,{at}:array<bigint>>>")))
    rows = rows.join(F.broadcast(inner), part, "left")
    rows = rows.withColumn(cut, F.coalesce(F.size(F.filter(at, lambda p: p < F.col(h))), F.lit(0))).drop(at)
    rows = rows.withColumn(cut, F.greatest(F.col(cut), F.lit(0)))
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy(part, cut).count().collect()}
    names = (part, cut, lo, hi, "shard", first, "home_shard")
    kind = f"array<struct<{part}:int,{cut}:int,{lo}:bigint,{hi}:bigint,shard:int,{first}:bigint,home_shard:int>>"
    segments = [dict(zip(names, x)) for x in allocate(counts, before, shards, nodes)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(segments)), kind)))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(part, cut).orderBy(h, *order)) - 1)
    # at most one segment for each cut and one more for each shard that fills up: a fixed bound
    placed = ranked.join(F.broadcast(table), [part, cut]).filter((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return placed.withColumn("slot", F.col(first) + F.col(rank) - F.col(lo)).select(*kept.columns, "home_shard", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard, home_shard.

    Null texts count as empty. Rows that share a doc_id are placed one by one; equal rows are interchangeable. The law
    is `rows`, so grown_shard is null. Extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = bounded_ring(rows, F.col("doc_id"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
