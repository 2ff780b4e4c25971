"""Similarity self-join on word shingles by a token-group matrix, exact for Jaccard >= 3/4.

1. A document's set is its distinct shingle hashes. Equal sets collapse to one node.
2. Tokens are dealt into buckets, packed, and each bucket tells which of its tokens occur in more than one node. A node
   of n tokens can only link if all but n // 4 of them are shared, so most nodes end here: the matrix's coarsest bound,
   one query against the union of everything else. Long sets show only the tokens below a cut, of which n // 4 may be
   missing as well.
3. The rest is partitioned into groups of similar nodes by min-hashes. Each chunk of CHUNK nodes is compared whole, as a
   product of token matrices; across the chunks of a large min-hash group all compare with its best connected node. The
   connected components of these links are the groups of the matrix.
4. Two linked sets of q <= m tokens share o with 7 o >= 3 (q + m). So a node that shares s tokens with other groups can
   link to sizes of at most 7 s / 3 less its own, and as the smaller one needs 6/7 of its own tokens. Buckets count s for
   both roles against nodes whose own bounds allow it, twice; few nodes are left.
5. A smaller node's rarest s - ceil(6 q / 7) + 1 shared tokens must meet every partner. They name the groups to ask; of
   two groups that meet so, the nodes of the one with fewer members ask the other.
6. A group's row of the matrix, stored in chunks, is the union of its members' tokens. It bounds each query's overlap;
   only chunks that reach the bound are opened and compared. A link between two groups joins them.

No pair within a group is listed, nothing is capped, and no bound drops a link. A text's cost is in proportion to its
length, whatever that is; its words and hashes must fit into a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, one_of_each, small, staged, trimmed

WORDS, CHUNK, ROUNDS = 5, 256, 3
#: Tokens that a map task gathers before it deals them, and that a bucket holds on average.
FLUSH = BUCKET = 750_000
#: Nodes whose counts are summed together, pairs that a bucket expands together, and words that are hashed together.
PART, BLOCK, SLICE = 100_000, 400_000, 50_000
#: Sets with more than this share of all rows are dealt once, by their first row; there are at most 1 / HOT of them.
HOT = 1e-3

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_BYTES = _mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def _hashed(parts: list[bytes], k: int) -> np.ndarray:
    joined = np.frombuffer(b" ".join(parts), np.uint8)
    gaps = np.flatnonzero(joined == 32)
    start = np.concatenate([[0], gaps + 1])[: len(parts) - k + 1]
    end = np.concatenate([gaps, [len(joined)]])[k - 1 :]
    sums = np.zeros(len(joined) + 1, _U)
    np.cumsum(_BYTES[joined] * _power(_BASE, len(joined))[: len(joined)], out=sums[1:])
    span = (sums[end] - sums[start]) * _power(pow(_BASE, -1, 1 << 64), len(joined))[start]
    return _mixed(span ^ (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole word sequence if that is shorter."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, _U)
    k = min(words, len(parts))
    return np.unique(np.concatenate([_hashed(parts[i : i + SLICE + k - 1], k) for i in range(0, len(parts) - k + 1, SLICE)]))


def node_of(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def _cut(n: np.ndarray) -> np.ndarray:
    """The bound on a token's upper 32 bits below which sets of n tokens are looked at."""
    return np.minimum(1.0, 0.25 + 5 / np.sqrt(np.maximum(n, 1))) * 2.0**32


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# --- tokens in buckets

_DEALT = "bucket int, nodes binary, counts binary, tokens binary"
#: What travels with a node's tokens: before there are groups, and then also its group, that group's members and the
#: largest sizes that the node can link to as the smaller (up) and as the larger set (down); -1 where it can't.
_PLAIN = np.dtype([("id", "i8"), ("n", "i4")])
_STATE = np.dtype([("id", "i8"), ("group", "i8"), ("members", "i4"), ("n", "i4"), ("up", "i4"), ("down", "i4")])


def _deal(rows: Iterator[tuple[tuple, np.ndarray]], kind: np.dtype, buckets: int, cut: bool = False) -> Iterator[pa.RecordBatch]:
    """rows: (fields of kind, tokens). One packed row for each bucket and flush, in the order of its nodes.

    cut: show only the tokens below the cut of a set that has 3/4 as many, as partners look further down.
    """
    nodes, sets, held = [], [], 0

    def flush() -> pa.RecordBatch:
        about = np.array(nodes, kind)
        which = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(t) for t in sets])
        every = np.concatenate(sets)
        if cut:
            seen = (every >> _U(32)) < _cut(np.ceil(0.75 * about["n"]))[which]
            every, which = every[seen], which[seen]
        bucket = ((every & _U(0xFFFFFFFF)) % _U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        every, which, bucket = (every[order] >> _U(32)).astype(np.uint32), which[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            new = np.flatnonzero(np.diff(which[lo:hi].astype(np.int64), prepend=-1))
            counts = np.diff(np.append(new, hi - lo)).astype(np.uint32)
            out.append((bucket[lo], about[which[lo:hi][new]].tobytes(), counts.tobytes(), every[lo:hi].tobytes()))
        nodes.clear(), sets.clear()
        kinds = [pa.int32()] + [pa.binary()] * 3
        columns = zip(*out) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["bucket", "nodes", "counts", "tokens"])

    for about, tokens in rows:
        if len(tokens):
            nodes.append(about), sets.append(tokens)
            held += len(tokens)
            if held >= FLUSH:
                yield flush()
                held = 0
    if sets:
        yield flush()


def _entries(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token and place of its node for each entry of a bucket, by token and then the node's size; and the nodes."""
    tokens, counts, nodes = [], [], []
    for x, n, t in zip(*[table.column(c).to_pylist() for c in ("nodes", "counts", "tokens")]):
        nodes.append(np.frombuffer(x, kind)), counts.append(np.frombuffer(n, np.uint32)), tokens.append(np.frombuffer(t, np.uint32))
    about, token = np.concatenate(nodes), np.concatenate(tokens)
    at = np.repeat(np.arange(len(about), dtype=np.int32), np.concatenate(counts))
    order = np.argsort(token.astype(np.int64) << 32 | about["n"][at])
    return token[order], at[order], about


_COUNTS = "part int, ids binary, ups binary, downs binary"


def _by_part(ids: np.ndarray, ups: np.ndarray, downs: np.ndarray, parts: int) -> pa.Table:
    """Counts of a bucket's nodes, packed by the part of the nodes that sums them."""
    some = (ups > 0) | (downs > 0)
    ids, ups, downs = ids[some], ups[some].astype(np.int32), downs[some].astype(np.int32)
    part = (ids.astype(_U) % _U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    cuts = np.split(order, starts[1:]) if len(order) else []
    return pa.table({
        "part": pa.array([part[c[0]] for c in cuts], pa.int32()), "ids": pa.array([ids[c].tobytes() for c in cuts], pa.binary()),
        "ups": pa.array([ups[c].tobytes() for c in cuts], pa.binary()), "downs": pa.array([downs[c].tobytes() for c in cuts], pa.binary()),
    })


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


def _summed(table: pa.Table) -> pa.Table:
    ids, back = np.unique(_joined(table, "ids", np.int64), return_inverse=True)
    total = lambda name: np.bincount(back, weights=_joined(table, name, np.int32), minlength=len(ids)).astype(np.int64)
    return pa.table({"id": ids, "ups": total("ups"), "downs": total("downs")})


def _counted(dealt: DataFrame, count, parts: int) -> DataFrame:
    """id, ups and downs of every node: what count finds in the buckets, summed."""

    def counted(table: pa.Table) -> pa.Table:
        out = count(table, parts)
        give_back()
        return out

    counts = dealt.groupBy("bucket").applyInArrow(counted, _COUNTS)
    return counts.groupBy("part").applyInArrow(_summed, "id long, ups long, downs long")


def _shared(table: pa.Table, parts: int) -> pa.Table:
    """How many of each node's tokens, as far as it is looked at, occur in other nodes too."""
    token, at, about = _entries(table, _PLAIN)
    _, ids = np.unique(about["id"], return_inverse=True)
    order = np.lexsort((ids[at], token))
    token, at = token[order], at[order]
    new = np.diff(token.astype(np.int64), prepend=-1) != 0
    other = np.ones(len(token), bool)
    other[1:] = (ids[at][1:] != ids[at][:-1]) | new[1:]
    first = np.flatnonzero(new)
    many = np.repeat(np.add.reduceat(other.astype(np.int64), first), np.diff(np.append(first, len(token)))) if len(first) else other
    hit = (many > 1) & (token < _cut(about["n"])[at])
    n = np.bincount(at[hit], minlength=len(about))
    return _by_part(about["id"], n, 0 * n, parts)


# --- bounds against other groups


def _least_partner(n):
    """The size of the smallest set that a set of n tokens can link to."""
    return (3 * n + 3) // 4


def _needs(n):
    """How many of its n tokens the smaller of two linked sets has in the other, at least."""
    return (6 * n + 6) // 7


def _exists(lo: np.ndarray, hi: np.ndarray, group: np.ndarray, value: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each entry i: is there one in lo[i]:hi[i] of another group whose value is least[i] or more?

    Windows of 1, 2, 4, ... entries keep their best value, its group, and the best of any other group; two windows of one
    length cover each range.
    """
    out = np.zeros(len(lo), bool)
    long = hi - lo
    best, whose, second, step = value, group, np.full(len(value), -1, value.dtype), 1
    todo = np.flatnonzero(long > 0)
    while len(todo):
        now = todo[long[todo] < 2 * step]
        for x in (lo[now], hi[now] - step):
            out[now] |= np.where(whose[x] != group[now], best[x], second[x]) >= least[now]
        todo = todo[long[todo] >= 2 * step]
        if len(todo):
            a, b = slice(0, len(best) - step), slice(step, None)
            same, first = whose[a] == whose[b], best[a] >= best[b]
            won = np.where(first, best[a], best[b])
            rest = np.where(same, np.maximum(second[a], second[b]), np.where(first, np.maximum(best[b], second[a]), np.maximum(best[a], second[b])))
            best, whose, second, step = won, np.where(first, whose[a], whose[b]), rest, 2 * step
    return out


def _meets(token: np.ndarray, at: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: may its token lie in a larger partner, and in a smaller partner, of another group?"""
    key = token.astype(np.int64) << 32 | about["n"][at]
    head = token.astype(np.int64) << 32
    n, up, down, group = (about[x][at].astype(np.int64) for x in ("n", "up", "down", "group"))
    upper = _exists(np.searchsorted(key, head | n), np.searchsorted(key, head | np.maximum(up, 0), "right"), group, down, n)
    lower = _exists(np.searchsorted(key, head | _least_partner(n)), np.searchsorted(key, head | np.maximum(np.minimum(n, down), 0), "right"), group, up, n)
    return upper & (up >= n), lower & (down >= 0)


def _reach(table: pa.Table, parts: int) -> pa.Table:
    """How many of each node's tokens larger and smaller partners may have."""
    token, at, about = _entries(table, _STATE)
    upper, lower = (np.bincount(at[x], minlength=len(about)) for x in _meets(token, at, about))
    return _by_part(about["id"], upper, lower, parts)


_RARE = "part int, bucket int, ids binary, sizes binary, tokens binary, groups binary"


def _rarities(table: pa.Table, parts: int) -> pa.Table:
    """The tokens that asking nodes may share with larger partners, each with the number of groups that have it."""
    token, at, about = _entries(table, _STATE)
    hit, _ = _meets(token, at, about)
    order = np.lexsort((about["group"][at], token))
    t, g = token[order].astype(np.int64), about["group"][at][order]
    new = np.diff(t, prepend=-1) != 0
    other = new.copy()
    other[1:] |= g[1:] != g[:-1]
    first = np.flatnonzero(new)
    many = np.empty(len(t), np.int32)
    many[order] = np.repeat(np.add.reduceat(other.astype(np.int32), first), np.diff(np.append(first, len(t))))
    ids, n, token, many = about["id"][at][hit], about["n"][at][hit], token[hit], many[hit]
    part = (ids.astype(_U) % _U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.split(order, np.flatnonzero(np.diff(part[order], prepend=-1))[1:]) if len(order) else []
    pack = lambda x: pa.array([x[c].tobytes() for c in cuts], pa.binary())
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "part": pa.array([part[c[0]] for c in cuts], pa.int32()), "bucket": pa.array([bucket] * len(cuts), pa.int32()),
        "ids": pack(ids), "sizes": pack(n), "tokens": pack(token), "groups": pack(many),
    })


def _prefixes(table: pa.Table) -> pa.Table:
    """Each node's rarest tokens, as many as every larger partner must meet, by bucket."""
    ids, n, token, many = (_joined(table, c, k) for c, k in (("ids", np.int64), ("sizes", np.int32), ("tokens", np.uint32), ("groups", np.int32)))
    each = [len(x) // 8 for x in table.column("ids").to_pylist()]
    bucket = np.repeat(np.array(table.column("bucket").to_pylist(), np.int32), each)
    order = np.lexsort((token, bucket, many, ids))
    ids, n, token, bucket = ids[order], n[order], token[order], bucket[order]
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    size = np.diff(np.append(first, len(ids)))
    rank = np.arange(len(ids)) - np.repeat(first, size)
    asks = np.flatnonzero(rank <= np.repeat(size, size) - _needs(n))
    order = asks[np.argsort(bucket[asks], kind="stable")]
    cuts = np.split(order, np.flatnonzero(np.diff(bucket[order], prepend=-1))[1:]) if len(order) else []
    return pa.table({
        "bucket": pa.array([bucket[c[0]] for c in cuts], pa.int32()),
        "ids": pa.array([ids[c].tobytes() for c in cuts], pa.binary()), "tokens": pa.array([token[c].tobytes() for c in cuts], pa.binary()),
    })


def _crossed(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal values in two sorted arrays, BLOCK pairs at a time or, for a longer list, one of a's."""
    lo, hi = np.searchsorted(b, a), np.searchsorted(b, a, "right")
    done = np.concatenate([[0], np.cumsum(hi - lo)])
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(done, done[i] + BLOCK, "right")) - 1)
        many = (hi - lo)[i:j]
        left = np.repeat(np.arange(i, j), many)
        yield left, np.arange(len(left)) - np.repeat(done[i:j] - done[i], many) + lo[left]
        i = j


def _by_group(token: np.ndarray, group: np.ndarray, *values: tuple[np.ndarray, np.ufunc]) -> list[np.ndarray]:
    """token and group of each distinct pair, by token, and each value's reduction over the pair."""
    order = np.lexsort((group, token))
    t, g = token[order], group[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    return [t[first], g[first]] + [f.reduceat(v[order], first) if len(first) else v for v, f in values]


def _asked(asks: pa.Table, table: pa.Table) -> pa.Table:
    """(id, other): nodes that ask other groups, of the two groups that meet in a token the one with fewer members.

    Nodes are crossed with groups, never with nodes.
    """
    out = {"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64())}
    if not asks.num_rows or not table.num_rows:
        return pa.table(out)
    token, at, about = _entries(table, _STATE)
    names, place = np.unique(about["id"], return_inverse=True)
    wanted = np.searchsorted(names, _joined(asks, "ids", np.int64)) << 32 | _joined(asks, "tokens", np.uint32).astype(np.int64)
    asking = np.isin(place[at] << 32 | token.astype(np.int64), wanted)
    answers = about["down"][at] >= 0
    field = lambda name, of: about[name][at][of].astype(np.int64)
    found = []

    def keep(pairs: np.ndarray) -> None:
        found.append(np.unique(pairs, axis=0))
        if sum(map(len, found)) > BLOCK:
            found[:] = [np.unique(np.concatenate(found), axis=0)]

    q_id, q_group, q_n, q_up, q_members = (field(x, asking) for x in ("id", "group", "n", "up", "members"))
    m_id, m_group, m_n, m_down, m_members = (field(x, answers) for x in ("id", "group", "n", "down", "members"))
    q_token, m_token = token[asking], token[answers]
    t, g, least, most, down, members = _by_group(m_token, m_group, (m_n, np.minimum), (m_n, np.maximum), (m_down, np.maximum), (m_members, np.maximum))
    for i, j in _crossed(q_token, t):
        fewer = (q_members[i] < members[j]) | ((q_members[i] == members[j]) & (q_group[i] < g[j]))
        ok = fewer & (q_group[i] != g[j]) & (most[j] >= q_n[i]) & (least[j] <= q_up[i]) & (down[j] >= q_n[i])
        keep(np.stack([q_id[i][ok], g[j][ok]], 1))
    t, g, least, up, members = _by_group(q_token, q_group, (q_n, np.minimum), (q_up, np.maximum), (q_members, np.maximum))
    for i, j in _crossed(m_token, t):
        fewer = (m_members[i] < members[j]) | ((m_members[i] == members[j]) & (m_group[i] < g[j]))
        ok = fewer & (m_group[i] != g[j]) & (least[j] <= m_n[i]) & (up[j] >= m_n[i]) & (m_down[i] >= least[j])
        keep(np.stack([m_id[i][ok], g[j][ok]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    give_back()
    return pa.table({"id": pa.array(pairs[:, 0], pa.int64()), "other": pa.array(pairs[:, 1], pa.int64())})


# --- comparing sets

#: Pairs that a token makes between two chunks from which on it is a column of the dense product; columns at a time.
DENSE, COLUMNS = 1_024, 2_048


def _overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of common tokens of each set of a and each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not a or not b:
        return out
    which = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ta, ia, tb, ib = np.concatenate(a), which(a), np.concatenate(b), which(b)
    common = np.intersect1d(ta, tb)
    sides = []
    for t, i in ((ta, ia), (tb, ib)):
        at = np.minimum(np.searchsorted(common, t), max(len(common) - 1, 0))
        ok = common[at] == t if len(common) else np.zeros(len(t), bool)
        order = np.argsort(at[ok], kind="stable")
        sides.append((at[ok][order], i[ok][order]))
    (ca, ia), (cb, ib) = sides
    pairs = np.bincount(ca, minlength=len(common)) * np.bincount(cb, minlength=len(common))
    dense = np.flatnonzero(pairs >= DENSE)
    for k in range(0, len(dense), COLUMNS):
        some = dense[k : k + COLUMNS]
        flat = []
        for c, i, rows in ((ca, ia, len(a)), (cb, ib, len(b))):
            at = np.minimum(np.searchsorted(some, c), len(some) - 1)
            ok = some[at] == c
            m = np.zeros((rows, len(some)), np.float32)
            m[i[ok], at[ok]] = 1
            flat.append(m)
        out += (flat[0] @ flat[1].T).astype(np.int64)
    few_a, few_b = pairs[ca] < DENSE, pairs[cb] < DENSE
    ca, ia, cb, ib = ca[few_a], ia[few_a], cb[few_b], ib[few_b]
    for i, j in _crossed(ca, cb):
        out += np.bincount(ia[i] * len(b) + ib[j], minlength=out.size).reshape(out.shape)
    return out


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])
    return 7 * _overlap(a, b) >= 3 * sizes


def _sets(table: pa.Table, name: str = "tokens") -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in table.column(name).to_pylist()]


_STAR = "round int, head long, a long, b long, links long"


def _star(table: pa.Table) -> pa.Table:
    """A forest that spans the links of a chunk, as (a, b), and its node with the most links, as a without b."""
    table = table.sort_by("id")
    ids, sets = table.column("id").to_pylist(), _sets(table)
    linked = _links(sets, sets)
    np.fill_diagonal(linked, False)
    many = linked.sum(1)
    a, b, seen = [ids[int(many.argmax())]], [None], np.zeros(len(ids), bool)
    for i in np.argsort(-many, kind="stable"):
        todo = [] if seen[i] else [i]
        seen[i] = True
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(linked[k] & ~seen):
                seen[j] = True
                a.append(ids[j]), b.append(ids[k]), todo.append(j)
    same = lambda name, kind: pa.array([table.column(name)[0].as_py()] * len(a), kind)
    return pa.table({"round": same("round", pa.int32()), "head": same("head", pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([int(many.max())] * len(a), pa.int64())})


def _edges(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _led(nodes: pa.Table, leaders: pa.Table) -> pa.Table:
    """Links of a chunk's nodes with the leader of their min-hash group."""
    ids, sets, a, b = np.array(nodes.column("id").to_pylist(), np.int64), _sets(nodes), [], []
    for leader, words in zip(leaders.column("id").to_pylist(), _sets(leaders)):
        to = ids[_links(sets, [words])[:, 0] & (ids != leader)].tolist() if sets else []
        a += to
        b += [leader] * len(to)
    return _edges(a, b)


def _union(table: pa.Table) -> pa.Table:
    """A chunk's row of the matrix: the union of its members' tokens, with the smallest and largest member's size."""
    sets = _sets(table)
    size = [len(s) for s in sets]
    row = {c: table.column(c).slice(0, 1).combine_chunks() for c in ("other", "chunk")}
    return pa.table(row | {"least": pa.array([min(size)], pa.int64()), "most": pa.array([max(size)], pa.int64()), "union": pa.array([np.unique(np.concatenate(sets)).tobytes()], pa.binary())})


def _bounded(queries: pa.Table, unions: pa.Table) -> pa.Table:
    """The queries whose overlap with a chunk's union allows a link with a member."""
    ids, sets = queries.column("id").to_pylist(), _sets(queries)
    out = []
    for least, most, union in zip(unions.column("least").to_pylist(), unions.column("most").to_pylist(), _sets(unions, "union")):
        n = np.array([len(s) for s in sets], np.int64)
        fits = (most >= _least_partner(n)) & (least <= 4 * n // 3)
        out += [i for i, s, x, ok in zip(ids, sets, np.maximum(least, _least_partner(n)), fits) if ok and 7 * int(np.isin(s, union, assume_unique=True).sum()) >= 3 * (len(s) + x)]
    row = {c: pa.array([queries.column(c)[0].as_py()] * len(out) if out else [], t) for c, t in (("other", pa.int64()), ("chunk", pa.int32()))}
    return pa.table({"id": pa.array(out, pa.int64())} | row)


def _opened(queries: pa.Table, members: pa.Table) -> pa.Table:
    """A link of each query with a chunk's members, if there is one."""
    ids, to = queries.column("id").to_pylist(), members.column("id").to_pylist()
    linked = _links(_sets(queries), _sets(members)) if ids and to else np.zeros((0, 0), bool)
    some = np.flatnonzero(linked.any(1))
    return _edges([ids[i] for i in some], [to[linked[i].argmax()] for i in some])


# --- the join


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, group) for every id that has an edge (a, b): the smallest id reachable.

    Each round takes the smallest label of the neighbours and then that label's own; it ends when nothing changes.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")), name)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("group").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("group").alias("was"), F.least("group", "near").alias("group"))
        up = step.select(F.col("id").alias("up"), F.col("group").alias("top"))
        new = staged(step.join(up, step.group == up.up, "left").select("id", "was", F.least("group", F.coalesce("top", "group")).alias("group")), name)
        labels = new.select("id", "group")
        if not new.filter("was != group").take(1):
            return labels


def _renewed(df: DataFrame) -> DataFrame:
    """df with columns of new identity, as the other side of a cogroup with a frame of the same origin needs."""
    return df.toDF(*df.columns)


def _buckets(tokens: int) -> int:
    return max(8, -(-tokens // BUCKET))


def _short(node: str) -> int:
    return int(node[:15], 16)


def _described(docs: DataFrame, words: int) -> DataFrame:
    """docs with the size of each row's set, how much of it is looked at, and its node."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            seen = [int(np.count_nonzero((s >> _U(32)) < c)) for s, c in zip(sets, _cut(n))]
            yield _batch(doc_id=b.column(0), sha=b.column(2), n=pa.array(n), seen=pa.array(seen, pa.int64()), node=pa.array([node_of(s) for s in sets], pa.string()))

    rows = docs.select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    return staged(rows.mapInArrow(trimmed(describe), "doc_id long, sha string, n long, seen long, node string"), "sets")


def _alive(docs: DataFrame, table: DataFrame, words: int) -> DataFrame:
    """node and rep of each node that shares enough of its tokens with others, and an id that numbers them."""
    rows, tokens = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = _buckets(tokens)
    nodes = table.filter("n > 0").groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("seen").alias("seen"))
    nodes = nodes.groupBy("node").agg(F.min("doc_id").alias("rep"), F.sum("rows").alias("rows"), F.min_by("rows", "doc_id").alias("once"), F.first("n").alias("n"), F.first("seen").alias("seen"))
    often = (F.col("rows") > max(HOT * rows, 2)) & F.col("rep").isNotNull()
    nodes = staged(nodes.withColumn("hot", often), "nodes")
    # at most 1 / HOT nodes
    hot = {r.node: r.rep for r in nodes.filter("hot").select("node", "rep").collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    s = shingles(t.as_py(), words)
                    name = node_of(s)
                    if name not in hot or hot[name] == i:
                        yield (_short(name), len(s)), s

        return _deal(each(), _PLAIN, buckets, cut=True)

    counted = _counted(docs.select("doc_id", "text").mapInArrow(trimmed(dealt), _DEALT), _shared, rows // PART + 1)
    # every row that was dealt was counted; names that agree in these 60 bits share their sums, which drops neither
    short = F.expr("cast(conv(substring(node, 1, 15), 16, 10) as bigint)")
    times = F.when(F.col("hot"), F.col("once")).otherwise(F.col("rows"))
    kept = nodes.withColumns({"id": short, "times": times}).join(counted, "id").filter("ups >= times * (seen - floor(n / 4))")
    return staged(kept.select("node", "rep").withColumn("id", F.monotonically_increasing_id()), "alive")


def _opened_sets(docs: DataFrame, alive: DataFrame, found: int, words: int) -> DataFrame:
    """id, n, tokens and min-hashes of each node of alive, from a text that has it."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                sets = [s for t in b.column(0).slice(k, 500) if len(s := shingles(t.as_py(), words))]
                heads = [[int(_mixed(s * _U(2 * r + 1) ^ _U((r + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)).min() >> _U(1)) for r in range(ROUNDS)] for s in sets]
                yield _batch(
                    node=pa.array([node_of(s) for s in sets], pa.string()), n=pa.array([len(s) for s in sets], pa.int32()),
                    tokens=pa.array([s.tobytes() for s in sets], pa.binary()), heads=pa.array(heads, pa.list_(pa.int64())),
                )

    reps = alive.select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select("doc_id", "text").join(small(reps.hint("shuffle_hash"), found), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    sets = texts.mapInArrow(trimmed(opened), "node string, n int, tokens binary, heads array<long>")
    # rows that repeat a doc_id may bring other sets along
    sets = staged(sets.join(small(alive.select("node", "id").hint("shuffle_hash"), found), "node").drop("node"), "open-sets")
    return staged(sets.dropDuplicates(["id"]), "open-sets-once") if sets.count() > found else sets


def _grouped(sets: DataFrame, found: int) -> DataFrame:
    """Edges (a, b) of links within min-hash groups: all within a chunk, and those with the leader across chunks."""
    tokens = sets.select("id", "tokens")
    placed = sets.select("id", F.posexplode("heads").alias("round", "head"))
    groups = placed.groupBy("round", "head").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"), F.count(F.lit(1)).alias("nodes"))
    groups = groups.filter("nodes > 1").drop("nodes")
    placed = staged(placed.join(groups, ["round", "head"]).withColumn("chunk", F.pmod(F.xxhash64("id", "round"), "chunks").cast("int")), "placed")
    side = lambda df: small(df.hint("shuffle_hash"), ROUNDS * found)
    star = tokens.join(side(placed), "id").groupBy("round", "head", "chunk").applyInArrow(_star, _STAR)
    star = staged(star, "star")
    edges = star.filter("b is not null").select("a", "b")
    wide = placed.filter("chunks > 1")
    if not wide.take(1):
        return edges
    shape = wide.select("round", "head", "chunks").distinct()
    leaders = star.filter("b is null").join(shape, ["round", "head"]).groupBy("round", "head", "chunks").agg(F.max_by("a", F.struct("links", "a")).alias("id"))
    leaders = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("round", "head", "chunk", "id")
    beside = tokens.join(side(leaders), "id").select("round", "head", "chunk", "id", "tokens")
    nodes = tokens.join(side(wide), "id").select("round", "head", "chunk", "id", "tokens")
    keys = ["round", "head", "chunk"]
    return edges.union(nodes.groupBy(*keys).cogroup(_renewed(beside).groupBy(*keys)).applyInArrow(_led, "a long, b long"))


def _across(sets: DataFrame, state: DataFrame, found: int) -> DataFrame | None:
    """Edges (a, b) of links between groups: enough to join all groups that are linked. None without any."""
    tokens = sets.select("id", "tokens")
    total = sets.agg(F.sum("n")).first()[0]
    buckets, parts = _buckets(total), found // PART + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for *about, t in zip(*[b.column(i).to_pylist() for i in range(6)], b.column(6)):
                    yield tuple(about), np.frombuffer(t.as_py(), _U)

        return _deal(each(), _STATE, buckets)

    def active(state: DataFrame) -> DataFrame:
        rows = tokens.join(small(state.hint("shuffle_hash"), found), "id")
        return rows.select(*_STATE.names, "tokens").mapInArrow(trimmed(dealt), _DEALT)

    state = state.withColumns({"up": F.expr("cast(floor(4 * n / 3) as int)"), "down": F.col("n")})
    for _ in range(2):
        state = state.join(_counted(active(state), _reach, parts), "id")
        up = F.expr("case when ups >= ceil(6 * n / 7) then least(up, cast(floor(7 * ups / 3) as int) - n) else -1 end")
        down = F.expr("case when downs >= ceil(3 * n / 4) then least(down, cast(floor(7 * downs / 3) as int) - n) else -1 end")
        state = state.withColumns({"up": up, "down": down}).filter("up >= 0 or down >= 0")
        state = staged(state.select("id", "group", "members", "n", "up", "down"), "reach")
        if not state.filter("up >= 0").take(1) or not state.filter("down >= 0").take(1):
            return None
    packed = staged(active(state), "dealt")
    rare = packed.groupBy("bucket").applyInArrow(lambda t: _rarities(t, parts), _RARE)
    asks = rare.groupBy("part").applyInArrow(_prefixes, "bucket int, ids binary, tokens binary")
    asked = asks.groupBy("bucket").cogroup(_renewed(packed).groupBy("bucket")).applyInArrow(_asked, "id long, other long")
    asked = staged(asked.distinct(), "asked")

    keys = ["other", "chunk", "turn"]
    in_turns = lambda df: df.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    turn = F.pmod(F.xxhash64("id"), F.col("turns")).cast("int").alias("turn")
    turns = lambda df, *by: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("turns"))
    chunks = state.groupBy(F.col("group").alias("other")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    shape = staged(turns(asked, "other").join(chunks, "other"), "shape")
    members = state.select("id", F.col("group").alias("other")).join(shape, "other").select("id", "other", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"))
    members = staged(tokens.join(small(members.hint("shuffle_hash"), found), "id"), "members")
    unions = staged(members.groupBy("other", "chunk").applyInArrow(_union, "other long, chunk int, least long, most long, union binary"), "unions")
    queries = asked.join(shape, "other").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("id", "other", "chunk", turn)
    queries = queries.join(tokens, "id")
    rows = in_turns(unions.join(shape.select("other", "turns"), "other"))
    passed = queries.groupBy(*keys).cogroup(_renewed(rows).groupBy(*keys)).applyInArrow(_bounded, "id long, other long, chunk int")
    passed = staged(passed, "passed")
    again = staged(turns(passed, "other", "chunk"), "turns")
    queries = passed.join(again, ["other", "chunk"]).select("id", "other", "chunk", turn).join(tokens, "id")
    rows = in_turns(members.join(again, ["other", "chunk"]))
    return queries.groupBy(*keys).cogroup(_renewed(rows).groupBy(*keys)).applyInArrow(_opened, "a long, b long")


def _labelled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, sha (of the text), n, node, component_id and label, a name of the component, for every row of docs."""
    table = _described(docs, words)
    alive = _alive(docs, table, words)
    found = alive.count()
    reps = table.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    if found:
        sets = _opened_sets(docs, alive, found, words)
        links = staged(_grouped(sets, found), "links")
        groups = components(links, "groups")
        state = sets.select("id", "n").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
        sizes = state.groupBy("group").agg(F.count(F.lit(1)).cast("int").alias("members"))
        state = staged(state.join(sizes, "group").select("id", "group", "members", "n"), "state")
        across = _across(sets, state, found)
        if across is not None:
            groups = components(links.union(staged(across, "across")), "components")
        named = alive.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
        least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
        named = staged(named.join(least, "group").select("node", "component_id", F.col("group").cast("string").alias("label")), "named")
        reps = reps.join(small(named.hint("shuffle_hash"), found), "node", "left")
    else:
        reps = reps.withColumns({"component_id": F.lit(None).cast("long"), "label": F.lit(None).cast("string")})
    reps = reps.select("node", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "node").alias("label"))
    out = table.join(reps, "node", "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def link_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row of docs.

    Null and empty texts, and texts without words, have no shingles and link with nothing: component_id is their own
    doc_id. Equal sets link. A null doc_id takes part, and is a component's id only where no member has another. Rows
    that repeat a doc_id are nodes by their sets. An empty table gives no rows; extra columns are ignored.
    """
    return _labelled(docs, words).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of docs (all columns, of kinds that can be ordered) of each component: that of the smallest doc_id.

    Of rows with that doc_id, the smallest set's stays, then the smallest text's and the smallest row. A null doc_id
    stays only where a component has no other. Rows without words link with nothing and all stay, nulls too. Very long
    texts are read whole; an empty table gives no rows.
    """
    rows = _labelled(docs, words).filter("n > 0")
    rows = staged(rows.select("label", "doc_id", "node", "sha"), "labelled")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "sha")).alias("best")).select("best.doc_id", "best.sha")
    many = rows.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("rows"))
    keys = best.join(many, best.doc_id.eqNullSafe(many.doc_id) & (best.sha == many.sha)).select(best.doc_id, best.sha, "rows")
    wordless = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return one_of_each(docs, keys, F.sha2("text", 256)).unionByName(docs.filter(wordless))
