"""Repair of a conversation's structure by its cheapest edits, found as shortest paths with Dial's buckets.

A conversation's rows are a line of layers with four states each: nothing yet, after the system's turn, after the
user's, after the assistant's. Arcs keep, rerole or delete a row, or insert an empty turn; their costs are small integers,
so a ring of buckets serves as the queue. Distances to the end are recorded; the audit then walks from the start along
tight arcs (those that lie on a cheapest path), each time by the letter that comes first in ASCII. Every letter leads
to one state, so the walk is the least string.

Faults and edits need a code of one byte for each row: texts stay out of the first shuffle. The second brings the texts
of a conversation after its audit, in order, and hashes them as they stream by. SHA-256 takes its input in order, so
one conversation's texts are one task's stream, of which it holds a batch; sorting spills. What a task holds of a
conversation is a byte for each row and the audit, which is a cell of the result in any case. Dial works on SEGMENT rows
at a time, last segment first, and keeps four distances at each segment's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import trimmed

#: Costs of the edits; an undeleted truncated row adds its own.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The next state without a choice, and by a row's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
TAKES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
INITIALS = ("s", "u", "a", "")
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Bits of a row's code above its initial's number.
CUT, GONE = 4, 8
SEGMENT = 1 << 16
#: Buckets of the ring: more than the largest cost and than the spread of distances within one layer.
RING = 16
_FAR = 1 << 60
#: Distances after the last row, by state: nothing or a whole exchange may end it, else turns are inserted.
AFTER = [0, 2 * INSERT, INSERT, 0]
BLANKS = " \t\n\x0b\f\r"


def _arcs(code: int) -> list[tuple[int, int, int]]:
    """(from state, to state, cost) of a row's arcs."""
    arcs = [(q, q, DELETE) for q in range(4)]
    if not code & GONE:
        more = TRUNCATED if code & CUT else 0
        arcs += [(q, to, KEEP + more) for q, to in TAKES[INITIALS[code & 3]].items()]
        arcs += [(q, NEXT[q], REROLE + more) for q in range(4)]
    return arcs


#: Arcs backwards: by code and state reached, the states they come from with their costs; and of insertions.
_BACK = [[[(q, cost) for q, to, cost in _arcs(code) if to == r] for r in range(4)] for code in range(16)]
_INSERTED = [[q for q in range(4) if NEXT[q] == r] for r in range(4)]
_KEPT = [[None if code & GONE else TAKES[INITIALS[code & 3]].get(q) for q in range(4)] for code in range(16)]


def distances(codes: bytes, end: list[int]) -> list[int]:
    """Distances of all nodes (4 x row + state) to the conversation's end, from those at the last layer."""
    n = len(codes)
    dist = [_FAR] * (4 * n + 4)
    ring = [[] for _ in range(RING)]
    for q, d in enumerate(end):
        dist[4 * n + q] = d
        ring[d % RING].append(4 * n + q)
    done, left, d = bytearray(4 * n + 4), 4, min(end)
    while left:
        bucket = ring[d % RING]
        for v in bucket:
            left -= 1
            if done[v]:
                continue
            done[v] = 1
            row, r = v >> 2, v & 3
            back = [(v - r + q, d + INSERT) for q in _INSERTED[r]]
            if row:
                back += [(v - r - 4 + q, d + cost) for q, cost in _BACK[codes[row - 1]][r]]
            for u, far in back:
                if far < dist[u]:
                    dist[u] = far
                    ring[far % RING].append(u)
                    left += 1
        ring[d % RING] = []
        d += 1
    return dist


def _walk(codes: bytes, dist: list[int], q: int, last: bool) -> tuple[str, int]:
    """Letters along tight arcs from the first layer's state q, and the state reached at the last layer."""
    out, i, n = [], 0, len(codes)
    while True:
        far = dist[4 * i + q]
        if i == n and (not last or not far):
            return "".join(out), q
        if i < n and far == DELETE + dist[4 * i + 4 + q]:
            out.append("D")
            i += 1
        elif far == INSERT + dist[4 * i + NEXT[q]]:
            out.append("I")
            q = NEXT[q]
        else:
            more = TRUNCATED if codes[i] & CUT else 0
            to = _KEPT[codes[i]][q]
            if to is not None and far == KEEP + more + dist[4 * i + 4 + to]:
                out.append("K")
                q = to
            else:
                out.append("R")
                q = NEXT[q]
            i += 1


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation whose rows have these codes."""
    cuts = list(range(0, len(codes), SEGMENT)) or [0]
    ends = {len(cuts): AFTER}
    for k in range(len(cuts) - 1, 0, -1):
        ends[k] = distances(codes[cuts[k] : cuts[k] + SEGMENT], ends[k + 1])[:4]
    audit, q, cost = [], START, 0
    for k, at in enumerate(cuts):
        part = codes[at : at + SEGMENT]
        dist = distances(part, ends[k + 1])
        cost = dist[START] if not k else cost
        letters, q = _walk(part, dist, q, k + 1 == len(cuts))
        audit.append(letters)
    return cost, "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that CRC-32 of conv_id:turn (null: one space) deals: conv_id, turn, role, text, copies."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with what tells role and text apart, their digest; ties of a turn are in its order."""
    return rows.withColumn("key", F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256))


def _last(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, key, code (without repeats), blank, rows (how many are equal), again (an earlier turn has the same)."""
    last = _last(F.col("text"))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    cut = F.when((last == "") | last.isin(".", "!", "?"), 0).otherwise(CUT)
    equal = rows.groupBy("conv_id", "turn", "key", (number + cut).alias("code"), (last == "").alias("blank")).agg(F.sum("copies").alias("rows"))
    first = equal.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("like")).agg(F.min(F.struct("turn")).alias("first"))
    met = equal.join(first, equal.conv_id.eqNullSafe(first.of) & (equal.key == first.like))
    return met.select("conv_id", "turn", "key", "code", "blank", "rows", (F.struct("turn") != F.col("first")).alias("again"))


class _Conversation:
    """Counts and codes of one conversation, fed with its rows in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, code: int, blank: bool, rows: int, again: bool) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        for k in range(rows):
            repeat = again or k > 0
            if self.codes and INITIALS[self.codes[-1] & 3] + INITIALS[code & 3] not in ("su", "ua", "au"):
                self.illegal += 1
            self.blank += blank
            self.duplicate += repeat and not blank
            self.truncated += bool(code & CUT) and not repeat
            self.codes.append(code & 3 | GONE if blank or repeat else code)

    def result(self) -> tuple:
        cost, audit = cheapest(bytes(self.codes))
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batched(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now = None
        for conv_id, turn, _, *row in _tuples(batches):
            if now is None or conv_id != now.conv_id:
                if now:
                    yield now.result()
                now = _Conversation(conv_id)
            now.add(turn, *row)
        if now:
            yield now.result()

    return _batched(rows(), [f.split()[0] for f in FOUND.split(", ")], [pa.int64()] * 7 + [pa.string()])


class _Repaired:
    """SHA-256 of a conversation's repaired rows, fed in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserts(self) -> None:
        while self.audit.startswith("I", self.at):
            self.state, self.at = NEXT[self.state], self.at + 1
            self._put(NAMES[self.state], "")

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = TAKES[role[:1]][self.state]
            self._put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._put(NAMES[self.state], text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation its row of results, which comes first, with the hash of what follows."""

    def rows() -> Iterator[tuple]:
        found = now = None
        for conv_id, kind, _, _, role, text, copies, *counts in _tuples(batches):
            if not kind:
                if now:
                    yield *found, now.digest()
                found, now = (conv_id, *counts, text), _Repaired(text)
                continue
            for _ in range(copies):
                now.add(role, text)
        if now:
            yield *found, now.digest()

    names = [*[f.split()[0] for f in FOUND.split(", ")], "repaired_sha256"]
    return _batched(rows(), names, [pa.int64()] * 7 + [pa.string()] * 2)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row for each conv_id of rows (and of conversations): faults, cost, audit and hash of the cheapest repair.

    rows: conv_id, turn, role, text without nulls in role and text, and copies. Order is by turn, nulls first; rows of one
    turn are in the order of their digests, and equal ones after each other. A null conv_id is a conversation of its own.
    A conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows.
    Very long texts are read whole and not held together; extra columns are ignored.
    """
    rows = _keyed(rows.select("conv_id", "turn", "role", "text", "copies"))
    order = [F.col("turn").asc_nulls_first(), "key"]
    narrow = _faults(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = narrow.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(trimmed(_audited), FOUND)
    every = (rows if conversations is None else conversations).select(F.col("conv_id").alias("every")).distinct()
    counts = [f.split()[0] for f in FOUND.split(", ")[1:-1]]
    heads = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").cast("long").alias("conv_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"), F.lit("").alias("role"),
        F.coalesce("audit", F.lit("")).alias("text"), F.lit(1).alias("copies"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
    )
    body = rows.select(
        F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "key", "role", "text", "copies", *[F.lit(0).cast("long").alias(c) for c in counts],
    )
    stream = heads.unionByName(body).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", *order)
    return stream.mapInArrow(trimmed(_hashed), f"{FOUND}, repaired_sha256 string")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """repair of damaged rows for every conv_id of conversations; nulls of role and text are one space. See repair."""
    return repair(damaged(conversations), conversations)
