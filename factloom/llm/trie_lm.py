"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 is the sorted vocabulary (hashes) with its counts. A node of level k is an (n-1)-gram context's successor: the
successors of a context are a sorted run of word ids, found through Elias-Fano coded monotone pointers, and searched
only within that run. Beside each node stands its quantised discounted probability, beside each context the quantised
mass that its discounts leave to shorter contexts, so that the model's probabilities sum to one.

Levels are built one after another: map tasks count n-grams whose context is a node, a reduce task merges one range of
contexts and writes that shard. Shards are files in the shared folder which every task maps into memory; nothing that
grows with the corpus is broadcast or collected, only each shard's size.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import local_path, shared_dir
from .shingle_join import _BASE, _BYTES, _mixed, _power

#: Every n-gram is kept; a larger LEAST prunes those seen less often.
ORDER, LEAST, DISCOUNT = 3, 1, 0.75
#: Tokens that a task looks at together.
BLOCK = 500_000
#: Bytes of text for each shard, and bounds on the number of shards (as powers of two).
SHARD_BYTES, MIN_BITS, MOST_BITS = 8 << 20, 3, 16
#: Quantised values are -log10 of a probability, in steps of 1 / STEP.
STEP = 6_000

_U = np.uint64
#: Place of a byte's n-th one.
_NTH = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int8), axis=1, kind="stable")
_END = int(_mixed(np.array([0x5EED], _U))[0])


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words in order, then the end's."""
    parts = (text or "").encode().lower().split()
    out = np.full(len(parts) + 1, _END, _U)
    if parts:
        joined = np.frombuffer(b" ".join(parts), np.uint8)
        gaps = np.flatnonzero(joined == 32)
        start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
        sums = np.zeros(len(joined) + 1, _U)
        np.cumsum(_BYTES[joined] * _power(_BASE, len(joined))[: len(joined)], out=sums[1:])
        span = (sums[end] - sums[start]) * _power(pow(_BASE, -1, 1 << 64), len(joined))[start]
        out[:-1] = _mixed(span ^ (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    return out


class EliasFano:
    """A monotone sequence in about 2 + log2(u / n) bits a value: low bits packed, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(_U)
        n, u = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max(0, (u // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=_U)) & _U(1)
        lows = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")
        at = (values >> _U(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 1 if n else 0) + 1023 & ~511, np.uint8)
        high[at] = 1
        words = np.packbits(high, bitorder="little").view(_U)
        ranks = np.concatenate([[0], np.cumsum(high.reshape(-1, 512).sum(1, dtype=np.int64))])
        return {"ef_low": np.concatenate([lows, np.zeros(8, np.uint8)]), "ef_high": words, "ef_rank": ranks, "ef_bits": np.array([low])}

    @staticmethod
    def access(ef: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
        """The values at i: a select in the high bits, and the low bits beside it."""
        low = int(ef["ef_bits"][0])
        block = np.searchsorted(ef["ef_rank"], i, "right") - 1
        left = i - ef["ef_rank"][block]
        words = ef["ef_high"].reshape(-1, 8)[block]
        ones = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        k = (ones <= left[:, None]).sum(1)
        rows = np.arange(len(i))
        left = left - np.where(k > 0, ones[rows, np.maximum(k - 1, 0)], 0)
        parts = np.ascontiguousarray(words[rows, k]).view(np.uint8).reshape(-1, 8)
        ones = np.cumsum(np.bitwise_count(parts), 1, dtype=np.uint8)
        j = (ones <= left[:, None]).sum(1)
        left = left - np.where(j > 0, ones[rows, np.maximum(j - 1, 0)], 0)
        place = block * 512 + k * 64 + j * 8 + _NTH[parts[rows, j], left]
        value = (place - i) << low
        if low:
            at = i * low
            raw = ef["ef_low"]
            wide = np.ndarray((len(raw) - 7,), "<u8", buffer=raw.data, strides=(1,))
            value |= ((wide[at >> 3] >> (at & 7).astype(_U)) & _U((1 << low) - 1)).astype(np.int64)
        return value


def _store(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, written whole under another name first: a task that is run twice leaves the same file."""
    head, at = {}, 0
    for k, x in arrays.items():
        head[k] = [x.dtype.str, at, len(x)]
        at += -(-x.nbytes // 8) * 8
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        text = json.dumps(head).encode()
        f.write(len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8))
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(own, path)


_mapped: dict[str, dict[str, np.ndarray]] = {}


def _open(path: str) -> dict[str, np.ndarray]:
    if path not in _mapped:
        if len(_mapped) > 20_000:
            _mapped.clear()
        raw = np.memmap(path, np.uint8, "r")
        size = int(raw[:8].view("<u8")[0])
        base = 8 + -(-size // 8) * 8
        head = json.loads(raw[8 : 8 + size].tobytes())
        _mapped[path] = {k: raw[base + at : base + at + n * np.dtype(d).itemsize].view(d) for k, (d, at, n) in head.items()}
    return _mapped[path]


class Trie:
    """The levels built so far. Node ids of a level run through its shards; first[k][s] is shard s's first id."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.first, self.total = path, bits, [], 0

    def shard(self, level: int, s: int) -> dict[str, np.ndarray]:
        return _open(f"{self.path}/{level}/{s}")

    def add(self, sizes: dict[int, int]) -> None:
        self.first.append(np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(1 << self.bits)])]).astype(np.int64))

    @property
    def vocabulary(self) -> int:
        return int(self.first[0][-1])

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each hash of a sorted array."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted((hashes >> _U(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1))
        first = self.first[0]
        for s in range(1 << self.bits):
            lo, hi = cuts[s], cuts[s + 1]
            if lo < hi and first[s + 1] > first[s]:
                d = self.shard(1, s)
                at = np.minimum(np.searchsorted(d["hash"], hashes[lo:hi]), len(d["hash"]) - 1)
                hit = d["hash"][at] == hashes[lo:hi]
                ids[lo:hi][hit] = at[hit] + first[s]
                counts[lo:hi][hit] = d["count"][at[hit]]
        return ids, counts

    def successors(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For contexts in ascending order: node id (-1: none), discounted probability (0) and the mass left over."""
        node, prob, rest = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        cuts = np.searchsorted(context, self.first[level - 2])
        for s in range(1 << self.bits):
            a, b = cuts[s], cuts[s + 1]
            if a == b:
                continue
            d, base = self.shard(level, s), self.first[level - 2][s]
            local = context[a:b] - base
            new = np.flatnonzero(np.diff(local, prepend=-1))
            own, runs = local[new], np.diff(np.append(new, b - a))
            ends = EliasFano.access(d, np.concatenate([own, own + 1]))
            lo, end = np.repeat(ends[: len(own)], runs), np.repeat(ends[len(own) :], runs)
            rest[a:b] = np.power(10.0, d["rest"][local] / -STEP)
            hi, want, names = end.copy(), word[a:b], d["word"]
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                less = names[mid] < want[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            hit = np.flatnonzero(lo < end)
            hit = hit[names[lo[hit]] == want[hit]]
            node[a + hit] = lo[hit] + self.first[level - 1][s]
            prob[a + hit] = np.power(10.0, d["prob"][lo[hit]] / -STEP)
        return node, prob, rest


def _code(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-STEP * np.log10(np.maximum(p, 1e-300))), 65_535).astype(np.uint16)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


_DEALT = "shard int, keys binary, runs binary, words binary, counts binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 4
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "keys", "runs", "words", "counts"])


def _read(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(f"u{max(1, len(raw) // n)}")).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The lowest byte of every number, then the next: high bytes, mostly zeros, compress away in the shuffle."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _joined(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK) -> Iterator[tuple[list[int], pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows from, to, token hashes, length of each text), a block of texts at a time."""
    for b in batches:
        held, n, lo = [], 0, 0
        for i, t in enumerate(b.column(text)):
            held.append(tokens(t.as_py()))
            n += len(held[-1])
            if n >= size or i + 1 == b.num_rows:
                yield b.slice(lo, i + 1 - lo), np.concatenate(held), np.array([len(x) for x in held])
                held, n, lo = [], 0, i + 1


def _positions(trie: Trie, hashes: np.ndarray, lengths: np.ndarray, levels: int) -> Iterator[tuple]:
    """For each level from 1: node ids (-1), and counts (level 1) or probabilities and left-over mass."""
    names, back = np.unique(hashes, return_inverse=True)
    ids, counts = trie.words(names)
    word, count = ids[back], counts[back]
    yield word, count, None
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    context = word
    for level in range(2, levels + 1):
        # the context of a position ends just before it
        before = np.concatenate([[-1], context[:-1]])
        before[place < level - 1] = -1
        ask = np.flatnonzero(before >= 0)
        node, prob, rest = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        key = before[ask] << 32 | np.where(word[ask] >= 0, word[ask], 0xFFFFFFFF)
        pairs, at = np.unique(key, return_inverse=True)
        n, p, r = trie.successors(level, pairs >> 32, pairs & 0xFFFFFFFF)
        node[ask], prob[ask], rest[ask] = n[at], p[at], r[at]
        yield node, prob, rest
        context = node


def held_out(doc_id: Column) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def build(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> Trie:
    """The trie of docs (text), all of whose rows are counted. n-grams of two words or more are nodes from `least` on."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(MIN_BITS, (size // SHARD_BYTES).bit_length()))
    trie = Trie(local_path(shared_dir(spark, "trie")), bits)
    path = trie.path

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in _blocks(batches, 0, 4 * BLOCK):
            names, n = np.unique(hashes, return_counts=True)
            cuts = np.searchsorted((names >> _U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
            yield _dealt([(s, names[a:b].tobytes(), b"", b"", _narrow(n[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])

    def merge_words(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, _U) for x in table.column("keys").to_pylist()]
        counts = [_read(c, len(k)) for k, c in zip(raw, table.column("counts").to_pylist())]
        names, back = np.unique(np.concatenate(raw), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        s = table.column("shard")[0].as_py()
        _store(f"{path}/1/{s}", {"hash": names, "count": _narrow(n)})
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(names)]), "total": pa.array([int(n.sum())])})

    texts = docs.select("text")
    sizes = texts.mapInArrow(count_words, _DEALT).groupBy("shard").applyInArrow(merge_words, "shard int, n long, total long").collect()
    trie.add({r.shard: r.n for r in sizes})
    trie.total = sum(r.total for r in sizes)
    if trie.vocabulary >= 1 << 32:
        raise ValueError("word ids are 32 bits")

    for level in range(2, order + 1):
        first = trie.first[-1]

        # each round's functions are sent to the executors before the next begins
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, hashes, lengths in _blocks(batches, 0, 2 * BLOCK):
                found = list(_positions(trie, hashes, lengths, level - 1))
                word, context = found[0][0], found[-1][0]
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                before = np.concatenate([[-1], context[:-1]])
                ask = np.flatnonzero((place >= level - 1) & (before >= 0))
                pairs, n = np.unique(before[ask].astype(_U) << _U(32) | word[ask].astype(_U), return_counts=True)
                own, words = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.uint32)
                cuts = np.searchsorted(own, first)
                rows = []
                for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        new = np.flatnonzero(np.diff(own[a:b], prepend=-1))
                        runs = np.diff(np.append(new, b - a))
                        steps = np.diff(own[a:b][new], prepend=first[s])
                        rows.append((s, _planes(steps), _narrow(runs).tobytes(), _planes(words[a:b]), _narrow(n[a:b]).tobytes()))
                yield _dealt(rows)

        def merge(table: pa.Table) -> pa.Table:
            keys, counts = [], []
            for k, r, w, c in zip(*[table.column(x).to_pylist() for x in ("keys", "runs", "words", "counts")]):
                own, words = np.cumsum(_joined(k), dtype=_U), _joined(w)
                keys.append(np.repeat(own, _read(r, len(own))) << _U(32) | words)
                counts.append(_read(c, len(words)))
            names, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts))
            s = table.column("shard")[0].as_py()
            size = int(first[s + 1] - first[s])
            own = (names >> _U(32)).astype(np.int64)
            total = np.bincount(own, n, size)
            keep = n >= least
            own, names, n = own[keep], names[keep], n[keep]
            p = (n - DISCOUNT) / total[own]
            rest = np.maximum(1 - np.bincount(own, p, size), 1e-9)
            pointers = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=size))])
            _store(f"{path}/{level}/{s}", EliasFano.encode(pointers) | {"word": (names & _U(0xFFFFFFFF)).astype(np.uint32), "prob": _code(p), "rest": _code(rest)})
            return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(n)])})

        sizes = texts.mapInArrow(count, _DEALT).groupBy("shard").applyInArrow(merge, "shard int, n long").collect()
        done = {r.shard: r.n for r in sizes}
        # shards without any n-gram
        for s in range(1 << bits):
            if s not in done:
                n = int(first[s + 1] - first[s])
                none = np.zeros(0, np.uint16)
                _store(f"{path}/{level}/{s}", EliasFano.encode(np.zeros(n + 1, np.int64)) | {"word": none.astype(np.uint32), "prob": none, "rest": np.zeros(n, np.uint16)})
        grown = Trie(path, bits)
        grown.first, grown.total = list(trie.first), trie.total
        grown.add(done)
        trie = grown
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """docs' rows (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score."""
    levels, total = len(trie.first), trie.total
    floor = np.log10(total + trie.vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hashes, lengths in _blocks(batches, 2):
            found = _positions(trie, hashes, lengths, levels)
            _, count, _ = next(found)
            base = np.log10(count + 1.0) - floor
            p = np.power(10.0, base)
            for _, prob, rest in found:
                # no context: prob 0 and rest 1
                p = prob + rest * p
            cuts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, cuts) for x in ((count > 0).astype(np.int64), base, np.log10(p))]
            cols = [b.column(0), b.column(1), pa.array(lengths, pa.int64()), pa.array(sums[0]), pa.array(np.full(len(lengths), total)), pa.array(sums[1]), pa.array(np.minimum(sums[2], 0.0))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Learns from rows whose fold isn't held out. Null and empty texts are the end alone; very long ones are read whole. With nothing to learn from,
    every score is 0. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(rows, build(rows.filter(~F.col("held_out")), order, least))
