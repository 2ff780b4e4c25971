"""Audit of how filters interact: which rows each removes, in every order, from counts of failure masks alone.

1. Each text's failures of the text filters are a mask of bits. Texts are routed by their XXH64: a task of the map side
   first keeps a bounded chain for each fingerprint, so that a group of copies leaves it as one record, and what lost to
   a smaller id there goes on without its text.
2. A partition of the routed records is sorted by fingerprint and id. It stores one fingerprint's collision chain at a
   time, each link the full text with its minimum id (the first that comes), and marks all ids that aren't the minimum.
3. Masks with their labels are counted in one vector for each part, merged by combineByKey; all orders follow from it.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SHORT, REPEATED, CAPITALS, SYMBOLS, COPY = 1, 2, 4, 8, 16
#: Bytes of text that a task's map side holds in chains, and that a routed partition gets on average.
CHAIN_BYTES, PARTITION_BYTES = 16 << 20, 32 << 20
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
COLUMNS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def text_mask(text: str, raw: bytes) -> int:
    """Failures of the filters that look at one text: under 100 words, repeated words, capitals, symbols."""
    words = raw.split()
    n = len(words)
    mask = SHORT if n < 100 else 0
    if 100 * len(set(words)) < 80 * n:
        mask |= REPEATED
    if 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * len(text):
        mask |= CAPITALS
    return mask | SYMBOLS if len(raw.translate(None, _SYMBOLS)) < len(raw) else mask


def _settled(doc_id: int | None, counts: dict, mask: int) -> tuple:
    """A record whose mask is known; it is dealt by its id, without a text."""
    return (xxhash.xxh64_intdigest(str(doc_id)), doc_id or 0), (None, doc_id, tuple(counts.items()), mask)


def _chained(rows: Iterable) -> Iterator[tuple]:
    """((fingerprint, id), (text or None, id, ((part, rows), ...), mask)): of copies that meet here, one with its text."""
    chains, held = {}, 0

    def emptied() -> Iterator[tuple]:
        for print_, chain in chains.items():
            for raw, (least, counts, mask) in chain.items():
                yield (print_, least), (raw, least, tuple(counts.items()), mask)
        chains.clear()

    for doc_id, text, lang in rows:
        text, part = text or "", lang or ""
        raw = text.encode()
        if doc_id is None:
            yield _settled(None, {part: 1}, text_mask(text, raw))
            continue
        chain = chains.setdefault(xxhash.xxh64_intdigest(raw), {})
        link = chain.get(raw)
        if link is None:
            chain[raw] = (doc_id, {part: 1}, text_mask(text, raw))
            held += len(raw) + 200
            if held > CHAIN_BYTES:
                yield from emptied()
                held = 0
            continue
        least, counts, mask = link
        if doc_id == least:
            counts[part] = counts.get(part, 0) + 1
        elif doc_id > least:
            yield _settled(doc_id, {part: 1}, mask | COPY)
        else:
            yield _settled(least, counts, mask | COPY)
            chain[raw] = (doc_id, {part: 1}, mask)
    yield from emptied()


def _masked(records: Iterable) -> Iterator[tuple]:
    """(doc_id, part, mask, rows) of records sorted by fingerprint and id; one fingerprint's chain is held at a time."""
    chain, of = {}, None
    for (print_, _), (raw, doc_id, counts, mask) in records:
        if raw is not None:
            if print_ != of:
                chain, of = {}, print_
            if doc_id > chain.setdefault(raw, doc_id):
                mask |= COPY
        for part, n in counts:
            yield doc_id, part, mask, n


def failure_masks(docs: DataFrame) -> RDD:
    """(doc_id, part, mask of failures, rows) for all rows of docs; rows that are equal in all these may be counted together."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    return rows.rdd.mapPartitions(_chained).repartitionAndSortWithinPartitions(n, lambda key: key[0]).mapPartitions(_masked)


def non_minimum_ids(docs: DataFrame) -> DataFrame:
    """doc_id of each row whose whole text a smaller doc_id has, too."""
    copies = failure_masks(docs).filter(lambda r: r[2] & COPY).flatMap(lambda r: [(r[0],)] * r[3])
    return docs.sparkSession.createDataFrame(copies, "doc_id long", verifySchema=False)


def _added(vector: list, row: tuple) -> list:
    mask, n, good, toxic = row
    vector[mask] += n
    vector[32 + mask] += n * good
    vector[64 + mask] += n * toxic
    return vector


def _merged(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def report(part: str, vector: list) -> Iterator[tuple]:
    """Rows of every order and step of one part, from its counts by mask: all rows, good rows, toxic rows."""

    @functools.cache
    def total(start: int, some: int, none: int) -> int:
        """Rows that fail some (0: no matter) and nothing of none."""
        return sum(n for m, n in enumerate(vector[start : start + 32]) if (m & some or not some) and not m & none)

    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows, shares = [], dict.fromkeys(FILTERS, 0)
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order):
            bit = bits[f]
            removed = total(0, bit, before)
            shares[f] += removed
            rows.append((f, "".join(order), step + 1, total(0, 0, before | bit), removed, total(0, bit, 0) - removed, vector[bit], total(32, bit, before), total(64, bit, before)))
            before |= bit
    for f, *row in rows:
        yield (part, *row, shares[f])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang), order of the five filters and step.

    kept, removed, redundant (fails this filter, removed earlier), unique_fails (fails no other), good_lost and toxic_lost
    (removed here with a label), shapley (removed by this filter over all orders) are counts of rows. Null text counts as
    empty and null lang as the empty part. A row with a null doc_id is no copy and makes none, and has no labels; rows
    that repeat a doc_id and its text aren't copies of each other. A doc_id with several labels is good or toxic if one
    of them says so. An empty table gives no rows; very long texts are read whole; extra columns are ignored.
    """
    spark = docs.sparkSession
    masks = spark.createDataFrame(failure_masks(docs), "doc_id long, part string, mask int, n long", verifySchema=False)
    said = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    rows = masks.join(said, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: _added([0] * 96, row), _added, _merged, n)
    return spark.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), COLUMNS, verifySchema=False)
