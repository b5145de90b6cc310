"""The language of a text, by a bidirectional gated recurrent network over its bytes.

One unit runs over the bytes forwards, one backwards; both together label every position with a probability for each
language, and a document gets the mean over the bytes of its letters. The network is trained here in numpy by
backpropagation through time, on a bounded sample of labelled rows.

Texts go through in stretches of CORE bytes, each with MARGIN more bytes on either side that are read but not counted,
so the steps of one stretch, not the length of a text, bound the recursion, and many stretches go side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table

#: Size of each unit; bytes of a stretch and of its margins; cells of logits that are worked on at once.
HIDDEN, CORE, MARGIN, SIDE_BY_SIDE = 8, 256, 16, 2048
#: Labelled rows that are learnt from at most, in equal parts for each language, and the characters taken of each.
LABELLED, STRETCH = 2_400, 96
#: Rounds over the sample, rows of a step, step size.
EPOCHS, STEP, RATE = 10, 96, 0.02
#: A row is held out if crc32(doc_id) is divisible by this.
FOLDS = 5
UNKNOWN = "und"
_PAD = 256
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to letters, or to characters beyond ASCII; the last is padding.
_COUNTED = np.array([chr(b).isalpha() if b < 128 else b < 256 for b in range(257)])


class Network:
    """Two gated recurrent units and a layer over both. W: what a byte adds to the gates; U: what the state adds; V, c: to the labels.

    Rows of W and U are the update gate, the reset gate and the new state, HIDDEN each; the first axis is the direction.
    """

    NAMES = ("W", "U", "b", "V", "c")

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0, dtype: type = np.float32):
        rng, n = np.random.default_rng(seed), len(languages)
        self.languages, self.hidden = languages, hidden
        self.W = rng.normal(0, 0.3, (2, 3 * hidden, 257)).astype(dtype)
        self.U = rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(dtype)
        self.b = np.zeros((2, hidden, 1), dtype)
        self.V = rng.normal(0, hidden**-0.5, (2, n, hidden)).astype(dtype)
        self.c = np.zeros((n, 1), dtype)

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits (time, direction, language, row) of bytes x (time, direction, row), each direction in its own order, without c."""
        steps, _, rows = x.shape
        k, dtype = self.hidden, self.W.dtype
        h = np.zeros((2, k, rows), dtype)
        # With sigmoid(x) = (1 + tanh(x / 2)) / 2, halves go into the weights, and one tanh serves both gates.
        half = np.repeat(np.array([0.5, 0.5, 1], dtype), k)[None, :, None]
        of_byte, of_state, b = self.W * half, self.U * dtype.type(0.5), self.b * dtype.type(0.5)
        g, a = np.empty((2, 3 * k, rows), dtype), np.empty((2, 3 * k, rows), dtype)
        out = np.empty((steps, 2, len(self.languages), rows), dtype)
        for t in range(steps):
            np.matmul(of_state, h, out=g)
            for d in (0, 1):
                np.take(of_byte[d], x[t, d], axis=1, out=a[d], mode="clip")
            zr = np.add(a[:, : 2 * k], g[:, : 2 * k])
            np.tanh(zr, out=zr)
            zr += 1  # twice the gates
            q = g[:, 2 * k :] + b
            n = zr[:, k:] * q
            n += a[:, 2 * k :]
            np.tanh(n, out=n)
            new = h - n
            new *= zr[:, :k]
            new *= 0.5
            new += n
            if keep is not None:
                keep.append((h, zr[:, :k] / 2, zr[:, k:] / 2, q * 2, n, new))
            h = new
            np.matmul(self.V, h, out=out[t])
        return out

    def gradients(self, x: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the counted positions, and its gradient by backpropagation through time."""
        kept: list = []
        p = aligned(self.run(x, kept), length) + self.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        steps, _, rows = x.shape
        mask = _COUNTED[x[:, 0]]
        total = max(1, int(mask.sum()))
        at = np.arange(rows)
        loss = -float(np.log(np.maximum(p[:, label, at], 1e-30))[mask].sum()) / total
        p[:, label, at] -= 1
        p *= mask[:, None] / total
        grad = {"c": p.sum(axis=(0, 2))[:, None]}
        dl = np.stack([p, turned(p, length)], axis=1)
        k = self.hidden
        grad |= {n: np.zeros_like(getattr(self, n)) for n in ("U", "b", "V")}
        da = np.empty((steps, 2, 3 * k, rows), self.W.dtype)
        dh = np.zeros((2, k, rows), self.W.dtype)
        back = self.U.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, z, r, q, n, new = kept[t]
            grad["V"] += dl[t] @ new.transpose(0, 2, 1)
            dh += self.V.transpose(0, 2, 1) @ dl[t]
            dn = dh * (1 - z) * (1 - n * n)
            da[t, :, :k] = dh * (h - n) * z * (1 - z)
            da[t, :, k : 2 * k] = dn * q * r * (1 - r)
            da[t, :, 2 * k :] = dn
            of_state = da[t].copy()
            of_state[:, 2 * k :] = dn * r
            grad["U"] += of_state @ h.transpose(0, 2, 1)
            grad["b"] += of_state[:, 2 * k :].sum(axis=2, keepdims=True)
            dh = dh * z + back @ of_state
        grad["W"] = np.zeros_like(self.W)
        for d in (0, 1):
            np.add.at(grad["W"][d].T, x[:, d].ravel(), da[:, d].transpose(0, 2, 1).reshape(-1, 3 * k))
        return loss, grad


def turned(p: np.ndarray, length: np.ndarray) -> np.ndarray:
    """p (time, ..., row) of each row's first `length` steps in reverse order; the others stay."""
    t = np.arange(len(p))[:, None]
    order = np.where(t < length, length - 1 - t, t)
    if (order == order[:, :1]).all():
        return p[order[:, 0]]
    return np.take_along_axis(p, order.reshape(len(p), *[1] * (p.ndim - 2), -1), axis=0)


def aligned(out: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The sum of both directions' logits at each position."""
    return out[:, 0] + turned(out[:, 1], length)


def both_ways(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bytes (time, direction, row) of the stretches low..high of data, padded behind the end."""
    t = np.arange(int((high - low).max()))[:, None]
    inside = t < high - low
    x = np.full((len(t), 2, len(low)), _PAD, dtype=np.int64)
    x[:, 0][inside] = data[(low + t)[inside]]
    x[:, 1][inside] = data[(high - 1 - t)[inside]]
    return x


def octets(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def trained(rows: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """A network that has learnt from (language, text) by Adam."""
    net = Network(sorted({lang for lang, _ in rows}), hidden, seed)
    if not rows:
        return net
    number = {lang: k for k, lang in enumerate(net.languages)}
    data = [np.frombuffer(octets(text), dtype=np.uint8) for _, text in rows]
    label = np.array([number[lang] for lang, _ in rows])
    some = np.flatnonzero([_COUNTED[d].any() for d in data])
    rng = np.random.default_rng(seed)
    mean = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    square, step = {n: np.zeros_like(x) for n, x in mean.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(some)
        for at in range(0, len(order), STEP):
            rows_of = order[at : at + STEP]
            high = np.cumsum([len(data[i]) for i in rows_of])
            low = np.concatenate([[0], high[:-1]])
            _, grad = net.gradients(both_ways(np.concatenate([data[i] for i in rows_of]), low, high), high - low, label[rows_of])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for n, g in grad.items():
                g = g / max(1.0, size)
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.01 * (g * g - square[n])
                value = getattr(net, n)
                value -= rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)
    return net


def probabilities(net: Network, texts: list[str | None]) -> np.ndarray:
    """Mean probability of each language over the counted bytes of each text; zero where there are none."""
    data = [octets(t or "") for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    ends = np.cumsum(sizes)
    every = np.frombuffer(b"".join(data), dtype=np.uint8)
    stretches = -(-sizes // CORE)
    doc = np.repeat(np.arange(len(texts)), stretches)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * CORE + (ends - sizes)[doc]
    end = np.minimum(start + CORE, ends[doc])
    low, high = np.maximum(start - MARGIN, (ends - sizes)[doc]), np.minimum(end + MARGIN, ends[doc])
    total, counted = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    order = np.argsort(high - low, kind="stable")
    side = max(64, SIDE_BY_SIDE * 8 // max(8, len(net.languages)))
    for at in range(0, len(order), side):
        i = order[at : at + side]
        x = both_ways(every, low[i], high[i])
        p = aligned(net.run(x), high[i] - low[i]) + net.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        place = low[i] + np.arange(len(x))[:, None]
        mask = _COUNTED[x[:, 0]] & (place >= start[i]) & (place < end[i])
        p *= (mask / p.sum(axis=1))[:, None]
        np.add.at(total, doc[i], p.sum(axis=0).T)
        np.add.at(counted, doc[i], mask.sum(axis=0))
    return total / np.maximum(counted, 1)[:, None]


def positions(net: Network, text: str) -> np.ndarray:
    """Probabilities (byte, language) of every position of the lower-cased text's UTF-8, read as one stretch."""
    data = np.frombuffer(octets(text), dtype=np.uint8)
    if not len(data):
        return np.zeros((0, len(net.languages)))
    p = aligned(net.run(both_ways(data, np.array([0]), np.array([len(data)]))), np.array([len(data)])) + net.c
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True))[:, :, 0]


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; one without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS == 0


def sample(docs: DataFrame, rows: int = LABELLED) -> list[tuple[str, str]]:
    """At most `rows` (lang, stretch of text) of labelled rows that are not held out, as many of each language.

    Rows and places are chosen by hash. More languages than rows raise an error.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~is_held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(rows + 1).collect()
    if len(counts) > rows:
        raise ValueError(f"more than {rows} languages")
    if not counts:
        return []
    each = rows // len(counts)
    counts = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long")
    likely = known.join(F.broadcast(counts), "lang").where(F.pmod("h", "n") < 4 * each)  # counts: at most `rows` rows
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - STRETCH + 1, F.lit(1))) + 1
    likely = likely.select("lang", "h", F.substring("text", place.cast("int"), F.lit(STRETCH)).alias("text"))
    first = likely.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= each)
    return [(r["lang"], r["text"]) for r in first.orderBy("lang", "k").collect()]


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row: the language of the highest mean probability, which is the score.

    `und` and 0 for a text that is null or has no letter, and for any text if the network knows no language. Equal
    probabilities go to the first language by name. Repeated rows and null ids stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                texts = [t if t and _LETTER.search(t) else None for t in part.column(2).to_pylist()]
                if net.languages and len(texts):
                    p = probabilities(net, texts)
                    best = p.argmax(axis=1)
                    langs = [UNKNOWN if t is None else net.languages[k] for t, k in zip(texts, best)]
                    scores = [0.0 if t is None else min(1.0, float(p[i, k])) for i, (t, k) in enumerate(zip(texts, best))]
                else:
                    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predicted(docs, trained(sample(docs)))


QUERIES = {"op11_language": op11_language}
ORACLES: dict[str, str] = {}
