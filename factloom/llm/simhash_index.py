"""SimHash near-duplicates by a hierarchical index in Gray order, exact for up to DIFFERENCES differing bits.

1. A document's fingerprint has a bit where more than half of its shingles' hashes have it. Equal fingerprints collapse
   to one code, so that a group of copies is one code from here on.
2. Upper nodes are masked bit patterns that their codes share. A node's unshared bits (those in its bit_or and not in its
   bit_and) are cut into DIFFERENCES + 1 blocks; two codes that differ in at most DIFFERENCES bits agree in one block, so
   each pair lies whole in a child. Nodes of more than NODE_CODES codes are cut again, level by level: no node that a
   task opens is large, however many codes resemble each other. A node of at most DIFFERENCES unshared bits is one group.
3. Within a node a task sorts the codes by Gray rank, where neighbours share long patterns, and builds a tree whose
   entries keep the shared mask and pattern of what lies below. Pairs of subtrees are walked from the root: differences
   between their patterns accumulate from level to level as masks widen, pairs beyond DIFFERENCES are pruned whole, and
   so are pairs that lie in one component already. Only leaf groups that are left compare codes.
4. Links leave a task as stars, each code with the least one that it reaches there; components join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged, trimmed
from .shingle_join import components

BITS, DIFFERENCES, WORDS, SEED = 64, 4, 4, 42
#: Codes of a node up to which a task compares them; those of a leaf group; subtrees under an inner entry.
NODE_CODES, LEAF, FAN = 16_384, 16, 8
#: Shingles hashed at a time, and pairs of subtrees or codes that are expanded at a time.
BLOCK, PAIRS = 1 << 16, 1 << 20
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half of the XXH64 of the text's word shingles, repeats included; zero without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and code (the fingerprint as a signed long) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], _U).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(codes)], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(made), "doc_id long, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(k)
    return rank


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Trees over the codes of several nodes, leaf groups first; every level's entries have a shared mask and pattern."""

    def __init__(self, node: np.ndarray, code: np.ndarray) -> None:
        """node: sorted numbers; code: in Gray order within each node."""
        self.levels = []
        of, low, high = node, code, code
        size = LEAF
        while True:
            first = np.concatenate([[True], of[1:] != of[:-1]])
            begins = np.flatnonzero(first)
            within = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
            at = np.flatnonzero(within % size == 0)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            # Children of entry i are start[i] to end[i] of the level below.
            self.levels.append({"start": at, "end": np.append(at[1:], len(of)), "mask": ~(low ^ high), "pattern": low})
            of = of[at]
            if len(of) == len(np.unique(of)):
                return
            size = FAN


def _expanded(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a child of a with a child of b, and which pair of a and b each comes from."""
    wide = end[b] - start[b]
    n = (end[a] - start[a]) * wide
    of = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return start[a][of] + k // wide[of], start[b][of] + k % wide[of], of


def _tops(top: np.ndarray) -> np.ndarray:
    while True:
        up = top[top]
        if np.array_equal(up, top):
            return top
        top = up


def _joined(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after linking a with b: each place's least reachable place."""
    while len(a):
        x, y = top[a], top[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        top = _tops(top)
    return top


def _uniform(top: np.ndarray, levels: list[dict]) -> list[np.ndarray]:
    """For each level's entries the component that holds all below, or -1."""
    low = high = top
    out = []
    for level in levels:
        low, high = np.minimum.reduceat(low, level["start"]), np.maximum.reduceat(high, level["start"])
        out.append(np.where(low == high, low, -1))
    return out


def linked(node: np.ndarray, code: np.ndarray, differences: int = DIFFERENCES) -> np.ndarray:
    """For each place the least place of its node that links reach; code: in Gray order within sorted nodes."""
    top = np.arange(len(code))
    if len(code) < 2:
        return top
    near = np.flatnonzero((node[1:] == node[:-1]) & (ones(code[1:] ^ code[:-1]) <= differences))
    top = _joined(top, near, near + 1)
    levels = _Forest(node, code).levels
    roots = np.arange(len(levels[-1]["start"]))
    whole = _uniform(top, levels)
    # Each item: the level of the entries of its pairs, the pairs, and the differences accumulated up to them.
    stack = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), _U))]
    while stack:
        k, a, b, far, seen = stack.pop()
        one = (whole[k][a] >= 0) & (whole[k][a] == whole[k][b])
        both = levels[k]["mask"][a] & levels[k]["mask"][b]
        far = far + ones((levels[k]["pattern"][a] ^ levels[k]["pattern"][b]) & both & ~seen)
        keep = ~one & (far <= differences)
        a, b, far, seen = a[keep], b[keep], far[keep], both[keep]
        start, end = levels[k]["start"], levels[k]["end"]
        n = (end[a] - start[a]) * (end[b] - start[b])
        cuts = np.unique(np.append(np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1, [0, len(a)]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            x, y, of = _expanded(a[i:j], b[i:j], start, end)
            if k:
                keep = x <= y
                stack.append((k - 1, x[keep], y[keep], far[i:j][of[keep]], seen[i:j][of[keep]]))
                continue
            keep = (x < y) & (top[x] != top[y])
            x, y = x[keep], y[keep]
            near = ones(code[x] ^ code[y]) <= differences
            if near.any():
                top = _joined(top, x[near], y[near])
                whole = _uniform(top, levels)
    return top


def _stars(table: pa.Table) -> pa.Table:
    """Edges of each code with the least code that it reaches within a node, for the nodes of one group."""
    node = table.column("node").to_numpy()
    code = table.column("code").to_numpy().view(_U)
    order = np.lexsort((gray_rank(code), node))
    node, code = node[order], code[order]
    top = linked(node, code)
    moved = np.flatnonzero(top != np.arange(len(top)))
    return pa.table({"a": code[moved].view(np.int64), "b": code[top[moved]].view(np.int64)})


def _blocks(open_: str) -> str:
    """SQL: DIFFERENCES + 1 masks that divide the bits of open_, with about as many bits each."""
    parts = DIFFERENCES + 1
    # A bit's block is its rank among the open bits, times parts, over their number.
    ranked = f"filter(transform(sequence(0, {BITS - 1}), i -> shiftleft(1L, i)), m -> (m & {open_}) != 0)"
    return (
        f"transform(sequence(0, {parts - 1}), p -> aggregate(transform({ranked}, (m, r) -> if(floor(r * {parts} / bit_count({open_})) = p, m, 0L)), 0L, (x, y) -> x | y))"
    )


def _children(codes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Codes under the children of nodes (node, same, open): code, node."""
    cut = nodes.select("node", F.posexplode(F.expr(_blocks("open"))).alias("block", "mask"))
    met = codes.join(cut, "node")
    # A child is named by its parent, the block and the code's bits there.
    return met.select("code", F.xxhash64("node", "block", F.col("code").bitwiseAND(F.col("mask"))).alias("node"))


def code_components(codes: DataFrame) -> DataFrame:
    """(id, group): for each code of codes (distinct longs) that has a link, the smallest code reachable."""
    spark = codes.sparkSession
    level = codes.select("code", F.lit(0).cast("long").alias("node"))
    edges = []
    while True:
        level = staged(level, "simhash-level")
        nodes = level.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("code").alias("least"), F.expr("bit_or(code) & ~bit_and(code)").alias("open"),
        )
        nodes = staged(nodes.filter("n > 1"), "simhash-nodes")
        close = nodes.filter(f"bit_count(open) <= {DIFFERENCES}")
        edges.append(level.join(close, "node").filter("code != least").select(F.col("code").alias("a"), F.col("least").alias("b")))
        rest = nodes.filter(f"bit_count(open) > {DIFFERENCES}")
        small = rest.filter(f"n <= {NODE_CODES}")
        # Nodes are dealt in sets of about NODE_CODES codes, so that a task's arrays are long and bounded.
        total = small.agg(F.sum("n")).first()[0] or 0
        if total:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // NODE_CODES))
            dealt = level.join(small.select("node"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)))
            edges.append(dealt.groupBy("part").applyInArrow(_stars, "a long, b long"))
        large = rest.filter(f"n > {NODE_CODES}")
        if not large.take(1):
            break
        level = _children(level, large.select("node", "open"))
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    return components(staged(links.distinct(), "simhash-links"), "simhash")


def near_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links) for every row.

    Null and empty texts, and texts without words, have fingerprint zero and link like any other. Rows that repeat a
    doc_id keep a row each. A null doc_id takes part, and is a component's id only where no member has another. Texts are
    read whole, BLOCK shingles at a time. An empty table gives no rows; extra columns are ignored.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    codes = staged(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    groups = code_components(codes.select("code"))
    named = codes.join(groups, codes.code == groups.id, "left").select("code", "least", F.coalesce("group", "code").alias("group"))
    named = staged(named, "named")
    best = named.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = staged(named.join(best, "group").select(F.col("code").alias("of"), "component_id"), "labels")
    made = rows.join(labels, rows.code == labels.of)
    return made.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
