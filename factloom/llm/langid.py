"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

A text's lower-cased bytes, whatever they are, are one sequence. A forward and a backward GRU read it, a softmax over both
states labels every position, and a document's probabilities are the mean over the positions of its letters. The sequence
is read in chunks of CHUNK bytes, all of them lanes of one batch; so that a chunk's states are those of the running text,
both networks begin WARM bytes outside it, where the gates have long let go of what came before. No position's label
depends on how texts are dealt or batched.

The network is trained by backpropagation through time on the driver, on a sample of at most SAMPLE_DOCS labelled
documents and PER_DOC stretches of SPAN bytes of each; the parameters don't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import trimmed

SAMPLE_DOCS, PER_DOC, SPAN = 1_600, 4, 64
CHUNK, WARM = 256, 24
HIDDEN, EPOCHS, BATCH, RATE = 8, 5, 64, 0.02
#: Lanes that are read together.
LANES = 1_024
#: Bytes of letters: of ASCII, and all parts of others.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _squashed(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: from -1 to 1, and much cheaper than a hyperbolic tangent. Its slope is (1 - |y|) squared."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """The same from 0 to 1, in place."""
    _squashed(x)
    x += 1
    x *= 0.5
    return x


class Gru:
    """One direction. x: bytes (time, batch). Gates: update z, reset r, candidate c."""

    names = ("table", "u", "v")

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.table = (rng.normal(0, 0.3, (256, 3 * hidden))).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(np.float32)
        self.v = rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        n = self.v.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            a = self.table[x[t]]
            g = _gate(a[:, : 2 * n] + h @ self.u)
            z, r = g[:, :n], g[:, n:]
            c = _squashed(a[:, 2 * n :] + (r * h) @ self.v)
            if keep is not None:
                keep.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def states(self, x: np.ndarray) -> np.ndarray:
        """forward without what training keeps, in buffers that every step uses again."""
        n, b = self.v.shape[0], x.shape[1]
        out = np.empty((*x.shape, n), np.float32)
        h, a = np.zeros((b, n), np.float32), np.empty((b, 3 * n), np.float32)
        g, c = np.empty((b, 2 * n), np.float32), np.empty((b, n), np.float32)
        for t in range(len(x)):
            np.take(self.table, x[t], 0, out=a, mode="clip")
            np.matmul(h, self.u, out=g)
            g += a[:, : 2 * n]
            _gate(g)
            np.multiply(g[:, n:], h, out=out[t])
            np.matmul(out[t], self.v, out=c)
            c += a[:, 2 * n :]
            _squashed(c)
            c -= h
            c *= g[:, :n]
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def backward(self, x: np.ndarray, kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from those of the outputs, back through time."""
        n = self.v.shape[0]
        grad = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        dh = np.zeros_like(dout[0])
        for t in reversed(range(len(x))):
            h, z, r, c = kept[t]
            d = dout[t] + dh
            # a gate is half of 1 and a squashed value, so its slope is twice min(y, 1 - y) squared
            dc = d * z * (1 - np.abs(c)) ** 2
            dz = d * (c - h) * 2 * np.minimum(z, 1 - z) ** 2
            drh = dc @ self.v.T
            dr = drh * h * 2 * np.minimum(r, 1 - r) ** 2
            gates = np.concatenate([dz, dr], 1)
            dh = d * (1 - z) + drh * r + gates @ self.u.T
            grad["u"] += h.T @ gates
            grad["v"] += (r * h).T @ dc
            np.add.at(grad["table"], x[t], np.concatenate([gates, dc], 1))
        return grad


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.ahead, self.back = langs, Gru(hidden, rng), Gru(hidden, rng)
        self.w = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32)
        self.b = np.zeros(len(langs), np.float32)

    def _parts(self) -> list[tuple[object, str]]:
        return [(g, k) for g in (self.ahead, self.back) for k in Gru.names] + [(self, "w"), (self, "b")]

    def label(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch, language) of positions by the states of both directions there."""
        n = ahead.shape[2]
        e = ahead @ self.w[:n]
        e += back @ self.w[n:]
        e += self.b
        np.exp(np.minimum(e, 80, out=e), out=e)
        e /= e @ np.ones((e.shape[2], 1), e.dtype)
        return e

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every position of whole sequences."""
        return self.label(self.ahead.forward(x), self.back.forward(x[::-1])[::-1])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over all positions, in the order of _parts, and the loss."""
        a, b = [], []
        h = np.concatenate([self.ahead.forward(x, a), self.back.forward(x[::-1], b)[::-1]], 2)
        e = h @ self.w + self.b
        e = np.exp(e - e.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        loss = -float(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)).mean())
        d = p
        d[:, np.arange(len(y)), y] -= 1
        d /= d.shape[0] * d.shape[1]
        n = self.ahead.v.shape[0]
        dh = d @ self.w.T
        one = self.ahead.backward(x, a, dh[:, :, :n])
        two = self.back.backward(x[::-1], b, dh[::-1, :, n:])
        flat = d.reshape(-1, d.shape[2])
        return [g[k] for g in (one, two) for k in Gru.names] + [h.reshape(-1, 2 * n).T @ flat, flat.sum(0)], loss

    def train(self, spans: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """Adam over batches of stretches (bytes, one row each). Returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(getattr(o, k)) for o, k in self._parts()]
        s = [np.zeros_like(x) for x in m]
        step, total = 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(spans)), []
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                grads, loss = self.gradients(spans[at].T, labels[at])
                total.append(loss)
                step += 1
                for i, ((o, name), g) in enumerate(zip(self._parts(), grads)):
                    m[i] += 0.1 * (g - m[i])
                    s[i] += 0.001 * (g * g - s[i])
                    change = rate * (0.5**epoch) * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
                    setattr(o, name, getattr(o, name) - change.astype(np.float32))
        return float(np.mean(total)) if total else 0.0


def raw(text: str | None) -> np.ndarray:
    """The bytes that are read of a text; none of one without a letter."""
    text = (text or "").lower()
    return np.frombuffer(text.encode(), np.uint8) if any(map(str.isalpha, text)) else np.zeros(0, np.uint8)


def lanes(codes: np.ndarray) -> np.ndarray:
    """Rows of WARM bytes before a chunk, the chunk, and WARM after it; spaces stand outside the text."""
    n = max(1, -(-len(codes) // CHUNK))
    padded = np.full(n * CHUNK + 2 * WARM, 32, np.uint8)
    padded[WARM : WARM + len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + 2 * WARM)[::CHUNK][: n if len(codes) else 0]


class Labeller:
    """Mean probabilities of texts, lanes of many texts together."""

    def __init__(self, net: Network):
        self.net = net

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """For each lane the sums of its letters' probabilities by language, then the number of letters."""
        out = np.empty((len(rows), len(self.net.langs) + 1))
        for k in range(0, len(rows), LANES):
            x = np.ascontiguousarray(rows[k : k + LANES].T)
            ahead, back = self.net.ahead.states(x[:-WARM])[WARM:], self.net.back.states(x[: WARM - 1 : -1])[: WARM - 1 : -1]
            p = self.net.label(ahead, back)
            letters = _LETTER[x[WARM:-WARM]]
            out[k : k + LANES, :-1] = np.einsum("tbl,tb->bl", p, letters.astype(np.float32))
            out[k : k + LANES, -1] = letters.sum(0)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities of each text by language; zeros if it is null or has no letter."""
        out, held, of = np.zeros((len(texts), len(self.net.langs) + 1)), [], []
        n = 0
        for i, t in enumerate(texts):
            rows = lanes(raw(t.as_py()))
            # a very long text is read by parts
            for k in range(0, len(rows), 4 * LANES):
                held.append(rows[k : k + 4 * LANES])
                of += [i] * len(held[-1])
                n += len(held[-1])
                if n >= 4 * LANES:
                    np.add.at(out, of, self.sums(np.concatenate(held)))
                    held, of, n = [], [], 0
        if n:
            np.add.at(out, of, self.sums(np.concatenate(held)))
        return out[:, :-1] / np.maximum(out[:, -1:], 1)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the document is kept from training; a null id counts as the empty text, which is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, per_doc: int = PER_DOC) -> Network | None:
    """A network from a sample of docs (doc_id, text, lang) outside the held-out fold; None without labelled text.

    Each language gets an equal share of the sample: the documents that a hash of doc_id and text puts first, and of each
    at most per_doc stretches of SPAN bytes, which tasks choose. The sample depends on the rows alone, not on how they are dealt.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs, per = sorted(counts), max(1, sample_docs // len(counts))
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40)))
    # twice as many as are wanted pass the bound, so that too few are all but ruled out; nothing else is sent
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 40, -(-2 * ((per + 20) << 40) // n)))])
    drawn = drawn.filter(F.col("draw") < bound[F.col("lang")]).select("lang", "draw", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for draw, t in zip(b.column(1).to_pylist(), b.column(2)):
                codes = raw(t.as_py())
                padded = np.concatenate([codes, np.full(max(0, SPAN - len(codes)), 32, np.uint8)])
                starts = np.random.default_rng(draw).integers(0, len(padded) - SPAN + 1, per_doc) if len(codes) else []
                held.append([padded[i : i + SPAN].tobytes() for i in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.list_(pa.binary()))], ["lang", "draw", "pieces"])

    some = drawn.mapInArrow(trimmed(cut), "lang string, draw long, pieces array<binary>").dropDuplicates()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "pieces"))
    some = some.withColumn("at", first).filter(F.col("at") <= per).orderBy("lang", "at").collect()
    spans = [(p, langs.index(r.lang)) for r in some for p in r.pieces]
    net = Network(langs)
    net.train(np.frombuffer(b"".join(bytes(p) for p, _ in spans), np.uint8).reshape(-1, SPAN), np.array([k for _, k in spans], np.int64))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs' rows as doc_id, held_out, lang_pred, score; the prediction reads the text only."""
    doc = F.col("doc_id")
    if net is None:
        return docs.select("doc_id", held_out(doc).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Labeller(net)
        for b in batches:
            p = read(b.column(2))
            top = np.minimum(1.0, p.max(1))
            names = [net.langs[k] if x > 0 else "und" for k, x in zip(p.argmax(1), top)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(top)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(doc).alias("held_out"), "text").mapInArrow(trimmed(label), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs.

    `und` with score 0 where the text is null or has no letter, and everywhere if there is nothing to learn from. Rows
    that repeat get a row each; extra columns are ignored.
    """
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs (all columns) with a language that is predicted with a score of `least` or more.

    Null and empty texts, and texts without letters, have none and go; very long ones are read whole. Repeated rows stay
    or go together. Without labelled rows to learn from, and from an empty table, no rows are returned.
    """
    net, names = fit(docs), docs.columns
    if net is None:
        return docs.limit(0)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Labeller(net)
        for b in batches:
            top = read(b.column(b.schema.get_field_index("text"))).max(1)
            yield b.filter(pa.array((top > 0) & (top >= least)))

    return docs.mapInArrow(trimmed(kept), docs.schema).select(*names)
