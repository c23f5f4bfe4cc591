"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer
network with a temperature.

Words (lower-cased) and their shapes (runs of character classes, as `Aa,` or `a%`) fall into
BUCKETS by hash. Every bucket has a sparse ternary index vector from its number; a bucket's
context vector sums the index vectors of its neighbours in the training texts, scaled to
length one; buckets without contexts use their index vector. A document is the mean of its
words' vectors and of its shapes' vectors, with a few figures of the pool (log of its size, and
how far it is concentrated on few words, how often a word follows itself). A tanh layer and a logistic one are fitted with
numpy; the temperature is fitted on a part of the sample that the weights did not see.

Fitted on at most MAX_LABELLED labelled texts. Whole texts are scored. Null and empty texts
score as the empty pool. Repeated rows score alike, ties and all; null ids are kept. A very long
text is a slice of its own and is pooled piece by piece. Only the id and text columns are read,
so other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, bytes_of, crc_mod, ship, slices, table
from ._labels import MAX_LABELLED, labelled_sample

BUCKETS = 1 << 15
SIZE = 64
NONZERO = 6
WINDOW = 2
HIDDEN = 32
SEED = 5
THRESHOLD = 0.3
#: Words whose vectors are gathered at once.
CHUNK = 1 << 16

SHAPE_OF = np.full(256, ord("#"), np.uint8)
SHAPE_OF[97:123] = ord("a")
SHAPE_OF[65:91] = ord("A")
SHAPE_OF[48:58] = ord("0")
SHAPE_OF[128:] = ord("a")
for _c in b".,;:'\"()-":
    SHAPE_OF[_c] = ord(".")
for _c in b"!?":
    SHAPE_OF[_c] = ord("!")
SHAPE_OF[ord("|")] = ord("|")


def _bucket(words: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w, seed) % BUCKETS for w in words.to_pylist()), np.int64, len(words))


def _shapes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word's shape, and the distinct shapes."""
    data, offsets = bytes_of(words)
    kind = SHAPE_OF[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1]] = True
    at = np.append(0, np.cumsum(keep))[offsets]
    arr = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kind[keep]))])
    d = arr.dictionary_encode()
    return d.indices.to_numpy(), d.dictionary


class Units:
    """Bucket of every word and every shape of some texts, as look-ups by distinct word."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        self.bounds = w.bounds
        self.index, distinct = w.encoded()
        if len(distinct):
            low = pa.array([x.lower() for x in distinct.to_pylist()], pa.binary())
            shape, kinds = _shapes(distinct)
            self.word = _bucket(low, SEED)
            self.shape, self.kinds = shape, _bucket(kinds, SEED + 1)
        else:
            self.word, self.shape, self.kinds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, SIZE), np.float32)
    rows = np.arange(BUCKETS)
    for i in range(NONZERO):
        out[rows, rng.integers(0, SIZE, BUCKETS)] += 1 if i % 2 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def context_vectors(sequences: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    out = np.zeros_like(index)
    for s in sequences:
        for d in range(1, WINDOW + 1):
            if len(s) > d:
                for a, b in ((s[:-d], s[d:]), (s[d:], s[:-d])):
                    pair, n = np.unique(a.astype(np.int64) * BUCKETS + b, return_counts=True)
                    np.add.at(out, pair // BUCKETS, index[pair % BUCKETS] * n[:, None].astype(np.float32))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), index).astype(np.float32)


def pooled(u: Units, words: np.ndarray, shapes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = len(u.bounds) - 1
    count = np.diff(u.bounds)
    mean, own = np.zeros((n, SIZE)), np.zeros((n, SIZE))
    text = np.repeat(np.arange(n), count)
    for i in range(0, len(text), CHUNK):
        t = text[i : i + CHUNK]
        b = u.word[u.index[i : i + CHUNK]]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        mean[t[first]] += np.add.reduceat(words[b], first, axis=0)
        own[t[first]] += np.add.reduceat(index[b], first, axis=0)
    kind = np.zeros((n, SIZE))
    if len(text):  # a row for each shape that a text holds: at most one for each word
        pair, times = np.unique(text.astype(np.int64) << 32 | u.kinds[u.shape[u.index]], return_counts=True)
        for i in range(0, len(pair), CHUNK):
            t, k = pair[i : i + CHUNK] >> 32, pair[i : i + CHUNK] & 0xFFFFFFFF
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            kind[t[first]] += np.add.reduceat(shapes[k] * times[i : i + CHUNK, None].astype(np.float32), first, axis=0)
    some = np.maximum(count, 1)[:, None]
    mean, own, kind = mean / some, own / some, kind / some
    size = np.log1p(count)[:, None]
    focus = np.linalg.norm(own, axis=1, keepdims=True)
    b = u.word[u.index] if len(text) else np.zeros(0, np.int64)
    same = np.append(False, (b[1:] == b[:-1]) & (text[1:] == text[:-1])) if len(text) else np.zeros(0, bool)
    echo = np.bincount(text, weights=same, minlength=n)[:, None] / some
    return np.hstack([mean, kind, size, focus, focus * np.sqrt(count)[:, None] / 10, echo, (count == 0)[:, None]])


class Network:
    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4):
        rng = np.random.default_rng(SEED)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.center) / self.scale
        part = rng.random(len(x)) < 0.15
        if part.sum() < 20 or len(set(y[part])) < 2:
            part[:] = False
        tx, ty = x[~part], y[~part]
        d = x.shape[1]
        p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for e in range(epochs):
            order = rng.permutation(len(tx))
            for i in range(0, len(order), batch):
                bx, by = tx[order[i : i + batch]], ty[order[i : i + batch]]
                h = np.tanh(bx @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - by) / len(bx)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [bx.T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
                step += 1
                r = rate * 0.5 * (1 + np.cos(np.pi * e / epochs))
                for a, gr, mi, vi in zip(p, grads, m, v):
                    mi += 0.1 * (gr - mi)
                    vi += 0.001 * (gr * gr - vi)
                    a -= r * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if part.any():
            z, t = self.logits(x[part] * self.scale + self.center), y[part]
            options = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, -z / c) * t + np.logaddexp(0, z / c) * (1 - t)) for c in options]
            self.temperature = float(options[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.center) / self.scale) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


class QualityModel:
    def __init__(self, words: np.ndarray, shapes: np.ndarray, index: np.ndarray, network: Network):
        self.words, self.shapes, self.index, self.network = words, shapes, index, network

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.network.probability(pooled(Units(texts), self.words, self.shapes, self.index))


def fit(sample: DataFrame) -> QualityModel:
    """From (id, text, y). Workers send bucket numbers (two bytes a word), not texts; twice: for
    the context vectors, then pooled."""
    spark = sample.sparkSession
    ship(spark)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                u = Units(b.column(1).slice(i, j - i))
                w, s = u.word[u.index].astype(np.uint16), (u.kinds[u.shape])[u.index].astype(np.uint16)
                cut = list(zip(u.bounds[:-1], u.bounds[1:]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([w[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([s[x:y].tobytes() for x, y in cut], pa.binary()), b.column(2).slice(i, j - i).cast(pa.int32())], names=["id", "w", "s", "y"])

    kind = sample.schema["id"]
    f = T.StructField
    got = sample.mapInArrow(sequences, T.StructType([kind, f("w", T.BinaryType()), f("s", T.BinaryType()), f("y", T.IntegerType())])).toArrow().sort_by("id")
    w = [np.frombuffer(x, np.uint16) for x in got.column("w").to_pylist()]
    s = [np.frombuffer(x, np.uint16) for x in got.column("s").to_pylist()]
    y = got.column("y").to_numpy().astype(float)
    index = index_vectors()
    words, shapes = context_vectors(w, index), context_vectors(s, index)
    rows = []
    for a, b in zip(w, s):
        u = Units.__new__(Units)
        u.bounds, u.index = np.array([0, len(a)]), np.arange(len(a))
        u.word, u.shape, u.kinds = a.astype(np.int64), np.arange(len(b)), b.astype(np.int64) if len(b) else np.zeros(1, np.int64)
        m = pooled_one(u, words, shapes, index)
        rows.append(m)
    if not rows:
        rows, y = [pooled_one(Units(pa.array([""])), words, shapes, index)], np.array([1.0])
    return QualityModel(words, shapes, index, Network(np.vstack(rows), y))


def pooled_one(u: Units, words: np.ndarray, shapes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """`pooled` for one text given as buckets."""
    n = len(u.index)
    if not n:
        mean = own = kind = np.zeros(SIZE)
    else:
        mean, own, kind = words[u.word].mean(axis=0, dtype=float), index[u.word].mean(axis=0, dtype=float), shapes[u.kinds].mean(axis=0, dtype=float)
    focus = np.linalg.norm(own)
    echo = float((u.word[1:] == u.word[:-1]).sum()) / max(n, 1)
    return np.hstack([mean, kind, [np.log1p(n), focus, focus * np.sqrt(n) / 10, echo, n == 0]])


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row of docs; no shuffle. The model is some 12 MB."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0]

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(1)):
                p = sent.value.score(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([kind, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled_sample(docs, labels, "quality", crc_mod("doc_id", 5) == 0, most=MAX_LABELLED))
    return quality_scores(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
