"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document is cut into whole windows and a rest; rests are cut into pieces of at most PIECE ids. Each block of BLOCK
such pieces is a number-partitioning problem: partial partitions start as one piece in one of k slots; the two whose
slots differ most are merged, the fullest slots of one with the emptiest of the other, until one partition is left,
whose k windows are nearly equal. k starts at the least possible and rises whenever a window exceeds the capacity.

Scan partitions are packed as they stream by: nothing is shuffled, and a task holds one block. A task that is run again
reads the same rows in the same order and gives the same windows.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY, PIECE, BLOCK = 2048, 512, 512
#: Words whose ids a Python worker remembers, and texts that are encoded together.
CACHE, TOGETHER = 400_000, 64

#: Letters that case or normal forms may turn into something else than letters are encoded one by one.
_MARKED = re.compile("[^a-z\xdf-\xf6\xf8-\xff]")
_WIDE = re.compile("[^\x00-\xff]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary never joins tokens over white space, nor over the place between a letter or digit and a full stop or
    comma that ends a word, and it lower-cases. So each distinct word is encoded once, without what ends it. Texts with
    special tokens' strings go to the tokenizer whole; only Latin-1 texts are lower-cased here, where that is one to one.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.known, self.cores = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._bytes(m) for m in ("", ".", ",")}

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        marks, cores = self.marks, self.cores
        parts = [(w, w[:-1], w[-1]) if w[-1:] in marks and w[-2:-1].isalnum() and w[-2] < "\u0100" else (w, w, "") for w in words]
        new = {c for _, c, _ in parts}.difference(cores)
        # a core of letters is one run of the vocabulary, whose last token says that it ends there: these go in one string
        runs = [c for c in new if c.isalpha() and not _MARKED.search(c)]
        for k in range(0, len(runs), 256):
            some = runs[k : k + 256]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a run of letters isn't one word of the vocabulary")
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            cores.update(zip(some, map(raw.__getitem__, map(slice, at, at[1:]))))
        rest = list(new.difference(runs))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            cores[w] = array("I", e.ids).tobytes()
        self.known.update([(w, cores[c] + marks[m]) for w, c, m in parts])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.cores) > CACHE:
            self.cores.clear()
        split = [None if "<|" in t else (t if _WIDE.search(t) else t.lower()).replace("\n", " ").split(" ") for t in texts]
        self._learn(set().union(*[w for w in split if w is not None]).difference(self.known))
        get = self.known.__getitem__
        return [self._bytes(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split)]


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each piece."""
    m = len(sizes)
    sums = np.zeros(k, np.int64)
    heap = []
    for i, s in enumerate(sizes):
        # slots in ascending order; nodes name what is in them (-1: nothing)
        first = sums.copy()
        first[-1] = s
        nodes = np.full(k, -1, np.int64)
        nodes[-1] = i
        heap.append((-s if k > 1 else 0, i, first, nodes))
    heapq.heapify(heap)
    merges, at = [], m
    for n in range(m, 2 * m - 1):
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both, y = a + b[::-1], y[::-1]
        order = np.argsort(both, kind="stable")
        both, x, y = both[order], x[order], y[order]
        nodes = np.where(x < 0, y, x)
        joint = (x >= 0) & (y >= 0)
        new = np.arange(at, at + joint.sum())
        nodes[joint] = new
        merges.append((new, x[joint], y[joint]))
        at += len(new)
        both -= both[0]
        heapq.heappush(heap, (-int(both[-1]), n, both, nodes))
    window = np.zeros(at, np.int64)
    held = heap[0][3]
    window[held[held >= 0]] = np.arange(k)[held >= 0]
    for new, x, y in reversed(merges):
        window[x] = window[y] = window[new]
    return window[:m]


def windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece, and their number."""
    weight = np.asarray(sizes, np.int64)
    k = max(1, -(-int(weight.sum()) // capacity))
    while True:
        at = differencing(sizes, k)
        if np.bincount(at, weight, k).max() <= capacity:
            return at, k
        k += 1


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, piece: int, block: int, end: int) -> Iterator[pa.RecordBatch]:
    encode, tail = WordEncoder(path), np.asarray([end], "<u4").tobytes()
    sequence = TaskContext.get().partitionId() << 32
    out: list[tuple] = []
    rests: list[tuple] = []

    def settle() -> None:
        nonlocal sequence
        at, k = windows([r[2] for r in rests], capacity)
        filled = [0] * k
        for r, w in zip(rests, at.tolist()):
            out.append((*r, sequence + w, filled[w]))
            filled[w] += r[2]
        sequence += k
        rests.clear()

    def batch() -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)
        out.clear()
        return made

    def encoded(rows: pa.RecordBatch) -> Iterator[tuple]:
        for k in range(0, rows.num_rows, TOGETHER):
            part = rows.slice(k, TOGETHER)
            for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                yield doc, ids + tail

    for rows in batches:
        for doc, ids in encoded(rows):
            n = len(ids) // 4
            whole = n - n % capacity
            for start in [*range(0, whole, capacity), *range(whole, n, piece)]:
                size = min(capacity if start < whole else piece, n - start)
                row = (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n)
                if size == capacity:
                    out.append((*row, sequence, 0))
                    sequence += 1
                else:
                    rests.append(row)
            while len(rests) >= block:
                settle()
            if len(out) >= 20_000:
                yield batch()
    if rests:
        settle()
    if out:
        yield batch()


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK, end: int = 1) -> DataFrame:
    """One row for each piece of each document: SCHEMA.

    Null and empty texts are the end id alone. Documents of any length are cut; rows that repeat are packed each.
    tokenizer: a vocabulary file (None: the public word-level one). A null doc_id stays null. An empty table gives no
    rows; extra columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _pack(b, tokenizer, capacity, piece, block, end), SCHEMA)
