"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Words are strings of letter classes between a start and an end sign; other characters are
skipped, and runs of single-letter words are read as one word, so `i.d.i.o.t` and `i d i o t`
meet `idiot`. The kernel compares words by their common subsequences of three signs with gaps:
an occurrence that spans s signs (at most SPAN) weighs DECAY ** (s - 3). Inserted characters
thus cost weight but not the match. Kernels are scaled by the occurrences' root of summed
squares.

Landmarks are training words: those most bound to toxic texts, and frequent others. Nyström
features K(word, landmarks) K(landmarks, landmarks)^-1/2 go into linear machines with hinge
loss, in two stages. Labels stand on texts. The first machine finds single words: rounds choose
the witnesses, the words of a toxic text that score highest, against the words of clean texts,
hardest first. The second is trained on sentences, which inherit their text's label: of each
labelled text the SENTENCES that the first machine finds strongest, each the sum of its words'
features over the root of their number, so that several words speak together; rounds move a
toxic text's label to its strongest sentence. Both machines are linear in the landmarks'
subsequence features, so each folds into one weight per subsequence and scoring costs one pass
over each distinct word.

A text scores by its strongest words and its strongest sentence: a logistic fit on the greatest
margin of either, the number of words with a margin above zero, and the text's size. Whole texts
are scored. Null and empty
texts score as texts without words. Repeated rows score alike, ties and all; null ids are kept. A very
long text is a slice of its own. Only the id and text columns are read, so other columns may
have any name. An empty table gives no rows; a sample of one label gives its share as score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import Words, bytes_of, crc_mod, ship, slices, table, tidy
from ._labels import MAX_LABELLED, labelled_sample

SIGNS = 44
START, STOP = 42, 43
SPAN = 6
DECAY = 0.6
LANDMARKS = 160
THRESHOLD = 0.3
SEED = 11
#: Sentences of a labelled text that the second machine learns from.
SENTENCES = 2
#: Their machine is held closer to zero than the words', which keeps small samples from being learned by heart.
SENTENCE_RIDGE = 3e-3
#: Distinct words whose subsequences are listed at once, and subsequences whose landmarks are.
CHUNK, ROWS = 1 << 16, 1 << 14

SIGN_OF = np.full(256, -1, np.int8)
SIGN_OF[97:123] = SIGN_OF[65:91] = np.arange(26)
SIGN_OF[128:192] = 26 + np.arange(64) % 16  # the last byte of a two-byte letter; its first is skipped
#: Second bytes of upper-case Latin letters stand 32 before those of lower case; low bits agree.
OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def signs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signs, bounds) of each word, start and end included."""
    data, offsets = bytes_of(words)
    s = SIGN_OF[data]
    at = np.append(0, np.cumsum(s >= 0))[offsets]
    n = len(words)
    out = np.full(at[-1] + 2 * n, START, np.int64)
    size = np.diff(at)
    out[np.arange(at[-1]) + np.repeat(2 * np.arange(n) + 1, size)] = s[s >= 0]
    bounds = at + 2 * np.arange(n + 1)
    out[bounds[1:] - 1] = STOP
    return out, bounds


def occurrences(s: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: words, subsequence numbers, weight."""
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = bounds[1:][word]
    where = np.arange(len(s))
    for j, k in OFFSETS:
        ok = where + k < last
        i = where[ok]
        yield word[ok], (s[i] * SIGNS + s[i + j]) * SIGNS + s[i + k], DECAY ** (k - 2)


def features(words: pa.Array, dtype=np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, scaled weight) of all occurrences in some words."""
    s, bounds = signs(words)
    w, u, v = zip(*((a, b, np.full(len(a), c, dtype)) for a, b, c in occurrences(s, bounds)))
    w, u, v = np.concatenate(w), np.concatenate(u), np.concatenate(v)
    norm = np.sqrt(np.bincount(w, weights=v * v, minlength=len(words)))
    return w, u, (v / np.maximum(norm[w], 1e-9)).astype(dtype)


def dense(words: pa.Array) -> np.ndarray:
    """words x SIGNS^3; for a few words only."""
    w, u, v = features(words)
    out = np.zeros((len(words), SIGNS**3), np.float32)
    np.add.at(out, (w, u), v)
    return out


def kernel(words: pa.Array, marks: np.ndarray) -> np.ndarray:
    """K(word, landmark) for rows of `dense` landmarks."""
    out = np.zeros((len(words), len(marks)), np.float32)
    turned = np.ascontiguousarray(marks.T)
    for i in range(0, len(words), 4096):
        part = words.slice(i, 4096)
        w, u, v = features(part)
        order = np.argsort(w, kind="stable")
        w, u, v = w[order], u[order], v[order]
        for c in range(0, len(w), ROWS):
            first = np.flatnonzero(np.append(True, np.diff(w[c : c + ROWS]) != 0))
            gain = turned[u[c : c + ROWS]]
            gain *= v[c : c + ROWS, None]
            out[i + w[c : c + ROWS][first]] += np.add.reduceat(gain, first, axis=0)
    return out


def spelled(w: Words) -> tuple[pa.Array, np.ndarray]:
    """(words, text of each): the words of some texts and, besides, each run of three or more
    words of one letter as one word."""
    text = w.text_of_word()
    one = np.diff(w.offsets) == 1
    if not one.any():
        return w.array(), text
    runs = np.flatnonzero(np.diff(np.concatenate([[False], one, [False]]).astype(np.int8)))
    extra, of = [], []
    for a, b in zip(runs[::2], runs[1::2]):
        cuts = np.flatnonzero(np.diff(text[a:b])) + a + 1
        for x, y in zip([a, *cuts], [*cuts, b]):
            if y - x >= 3:
                extra.append(w.data[w.offsets[x] : w.offsets[y]].tobytes())
                of.append(text[x])
    if not extra:
        return w.array(), text
    return pa.concat_arrays([w.array(), pa.array(extra, pa.binary())]), np.append(text, np.array(of, np.int64))


ENDS = np.isin(np.arange(256), list(b".!?"))


def sentences_of(w: Words, texts: pa.Array) -> np.ndarray:
    """Number of the sentence of each word, from 0 on over all texts: one ends with a word that
    ends in . ! or ?, or with its text."""
    n = len(w)
    if not n:
        return np.zeros(0, np.int64)
    stop = ENDS[w.data[w.offsets[1:] - 1]]
    new = np.zeros(n, bool)
    new[1:] = stop[:-1]
    new[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    new[0] = True
    return np.cumsum(new) - 1


class ToxicityModel:
    """weights, bias: margin of a word; sentence_weights, sentence_bias: of a sentence; platt:
    logistic weights over the text's figures."""

    def __init__(self, weights: np.ndarray, bias: float, platt: np.ndarray, sentence_weights: np.ndarray | None = None, sentence_bias: float = 0.0):
        self.weights, self.bias, self.platt = weights, bias, platt
        self.sentence_weights, self.sentence_bias = sentence_weights, sentence_bias

    def folded(self, words: pa.Array, weights: list[np.ndarray]) -> list[np.ndarray]:
        """The words' scaled sums of each weighting of subsequences."""
        out = [np.empty(len(words)) for _ in weights]
        for i in range(0, len(words), CHUNK):
            part = words.slice(i, CHUNK)
            s, bounds = signs(part)
            total, norm = [np.zeros(len(part)) for _ in weights], np.zeros(len(part))
            for w, u, c in occurrences(s, bounds):
                for t, x in zip(total, weights):
                    t += c * np.bincount(w, weights=x[u], minlength=len(part))
                norm += c * c * np.bincount(w, minlength=len(part))
            for o, t in zip(out, total):
                o[i : i + len(part)] = t / np.maximum(np.sqrt(norm), 1e-9)
        return out

    def margins(self, words: pa.Array) -> np.ndarray:
        return self.folded(words, [self.weights])[0] + self.bias

    def figures(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts, lower=True)
        n = len(texts)
        words, text = spelled(w)
        d = words.dictionary_encode()
        which = d.indices.to_numpy()
        if not len(d.dictionary):
            return text_figures(np.zeros(0), text, n, np.full(n, -2.0))
        some = [self.weights] if self.sentence_weights is None else [self.weights, self.sentence_weights]
        each = self.folded(d.dictionary, some)
        strongest = np.full(n, -2.0)
        if self.sentence_weights is not None:
            sentence = sentences_of(w, texts)
            _, margin = sentence_margins(each[1][which[: len(w)]], sentence, self.sentence_bias)
            first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
            np.maximum.at(strongest, text[: len(w)][first], margin)
        return text_figures((each[0] + self.bias)[which], text, n, strongest)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.figures(texts) @ self.platt, -700, 700)))


def sentence_margins(value: np.ndarray, sentence: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(words, margin) of each sentence from the values of its words."""
    size = np.bincount(sentence)
    return size, np.bincount(sentence, weights=value) / np.sqrt(np.maximum(size, 1)) + bias


def text_figures(margin: np.ndarray, text: np.ndarray, n: int, strongest: np.ndarray) -> np.ndarray:
    best = np.full(n, -2.0)
    np.maximum.at(best, text, margin)
    count = np.bincount(text, minlength=n)
    over = np.bincount(text, weights=margin > 0, minlength=n)
    return np.stack([np.clip(best, -2, 2), np.log1p(over), over / np.sqrt(np.maximum(count, 1)), np.log1p(count) / 10, np.clip(strongest, -2, 2), np.ones(n)], axis=1)


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient; the bias is not shrunk."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(float)
    weight = weight / weight.sum()
    gram = sum(x1[i : i + 4096].T @ (x1[i : i + 4096] * weight[i : i + 4096, None]) for i in range(0, len(x1), 4096))
    size = 2 * float(np.linalg.eigvalsh(gram)[-1]) + 2 * ridge
    w = v = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        g = -2 * (x1.T @ (weight * y * slack))
        g[:-1] += 2 * ridge * v[:-1]
        new = v - g / size
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps; ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def first_of_copies(index: np.ndarray, bounds: np.ndarray, words: pa.Array) -> np.ndarray:
    """False for texts whose three words of smallest hash are those of an earlier text: near
    copies would make all their words look bound to their label."""
    parts = (words.slice(i, CHUNK).to_pylist() for i in range(0, len(words), CHUNK))
    order = np.fromiter((zlib.crc32(w) for p in parts for w in p), np.int64, len(words))
    seen, out = set(), np.ones(len(bounds) - 1, bool)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b - a >= 3:
            key = tuple(np.sort(order[index[a:b]])[:3])
            out[i] = key not in seen
            seen.add(key)
    return out


def _numbered(got: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bounds, number of each word, distinct words) of a table's word lists in order; words are
    numbered as they come up, whatever the order of arrival."""
    lists = got.column("w").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy()
    size = np.diff(at)[order]
    bounds = np.append(0, np.cumsum(size))
    d = lists.flatten().dictionary_encode()
    take = np.arange(bounds[-1]) + np.repeat(at[:-1][order] - bounds[:-1], size)
    index = d.indices.to_numpy()[take]
    del take
    number, first = np.unique(index, return_index=True)
    number = number[np.argsort(first)]
    to = np.empty(len(d.dictionary), np.int32)
    to[number] = np.arange(len(number), dtype=np.int32)
    return bounds, to[index], d.dictionary.take(pa.array(number))


def fit(sample: DataFrame, rounds: int = 4) -> ToxicityModel:
    """From (id, text, y). Workers send each text's distinct words."""
    ship(sample.sparkSession)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                words, text = spelled(Words(b.column(1).slice(i, j - i), lower=True))
                d = words.dictionary_encode()
                key = np.unique(text * max(len(d.dictionary), 1) + d.indices.to_numpy())
                of = key // max(len(d.dictionary), 1)
                at = np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32)
                w = pa.ListArray.from_arrays(pa.array(at), d.dictionary.take(pa.array(key % max(len(d.dictionary), 1))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), w, b.column(2).slice(i, j - i).cast(pa.int32())], names=["id", "w", "y"])

    f = T.StructField
    schema = T.StructType([sample.schema["id"], f("w", T.ArrayType(T.BinaryType())), f("y", T.IntegerType())])
    got = sample.mapInArrow(distinct, schema).toArrow().combine_chunks()
    order = pc.sort_indices(got.column("id")).to_numpy()
    y = got.column("y").to_numpy()[order].astype(bool)
    if not y.any() or y.all():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return ToxicityModel(np.zeros(SIGNS**3, np.float32), 0.0, np.array([0, 0, 0, 0, 0, np.log(share / (1 - share))]))
    bounds, index, words = _numbered(got, order)
    del got
    tidy()
    single = first_of_copies(index, bounds, words)
    text = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(bounds))
    once = single[text]
    rng = np.random.default_rng(SEED)

    hit = np.bincount(index[once & y[text]], minlength=len(words))
    clean = np.bincount(index[~y[text]], minlength=len(words))
    n_hit, n_clean = (y & single).sum(), (~y).sum()
    a, b = (hit + 0.5) / (n_hit + 1), (clean + 0.5) / (n_clean + 1)
    z = (np.log(a) - np.log(b)) / np.sqrt(1 / (hit + 0.5) + 1 / (clean + 0.5))
    strong = np.argsort(-z, kind="stable")[: LANDMARKS // 2]
    frequent = np.argsort(np.where(z > 1, 0, -clean), kind="stable")[: LANDMARKS // 2]
    chosen = np.unique(np.append(strong, frequent))
    marks = dense(words.take(pa.array(chosen)))
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    good = value > 1e-4 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # Nyström map

    in_clean = np.flatnonzero(clean > 0)
    pool = rng.choice(in_clean, min(len(in_clean), 30_000), replace=False)
    pool = np.union1d(pool, in_clean[np.argsort(-clean[in_clean], kind="stable")[:4000]])
    positive = np.flatnonzero((z > 3.5) & (hit >= 4) & (a > 5 * b))
    if len(positive) < 5:
        positive = strong[:5]
    for r in range(rounds):
        pool = np.setdiff1d(pool, positive)
        rows = np.concatenate([positive, pool])
        x = kernel(words.take(pa.array(rows)), marks) @ root.astype(np.float32)
        yy = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        ww = np.where(yy > 0, np.log1p(hit[rows]), np.log1p(clean[rows]))
        ww[yy > 0] *= 0.3 * ww[yy < 0].sum() / max(ww[yy > 0].sum(), 1e-9)
        w, bias = hinge(x, yy, ww)
        weights = (marks.T @ (root @ w)).astype(np.float32)
        margin = ToxicityModel(weights, bias, np.zeros(6)).margins(words)
        if r == rounds - 1:
            break
        # witnesses: words of toxic texts only, over the margin; hard negatives: the nearest of clean texts
        witness = np.flatnonzero((hit > 0) & (clean == 0) & (margin > 0.5) & (z > 1))
        positive = np.union1d(positive[(margin[positive] > 0) | (z[positive] > 0.4 * z.max())], witness)
        if len(positive) < 5:
            positive = strong[:5]
        hard = in_clean[np.argsort(-margin[in_clean], kind="stable")[:10_000]]
        pool = np.union1d(pool, hard)
    first = ToxicityModel(weights, bias, np.zeros(6))
    del index, words, margin, text, x, yy, ww, pool, in_clean, hit, clean, a, b, z, once, bounds
    tidy()
    second, second_bias = fit_sentences(sample, first, marks, root)
    model = ToxicityModel(weights, bias, np.zeros(6), second, second_bias)
    x, y = labelled_figures(sample, model)
    model.platt = logistic(x, y)
    return model


def fit_sentences(sample: DataFrame, model: ToxicityModel, marks: np.ndarray, root: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the machine over sentences. Workers send the strongest sentences of each
    text, SENTENCES at most, as words."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                w = Words(b.column(1).slice(i, j - i), lower=True)
                d = w.array().dictionary_encode()
                which, sentence = d.indices.to_numpy(), sentences_of(w, b.column(1))
                if not len(which):
                    continue
                value = np.maximum(sent.value.margins(d.dictionary), -1)[which]
                size, margin = sentence_margins(value, sentence, 0.0)
                begin = np.cumsum(size) - size
                of = w.text_of_word()[begin]
                best = np.full(len(size), -np.inf)
                np.maximum.at(best, sentence, value)
                order = np.lexsort((np.arange(len(size)), -best, of))
                rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
                keep = np.sort(order[rank < SENTENCES])
                rows = [pa.array(np.unique(which[begin[k] : begin[k] + size[k]])) for k in keep]
                cuts = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), d.dictionary.take(pa.concat_arrays(rows)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(of[keep])), lists, b.column(2).slice(i, j - i).take(pa.array(of[keep])).cast(pa.int32())], names=["id", "w", "y"])

    f = T.StructField
    got = sample.mapInArrow(strongest, T.StructType([sample.schema["id"], f("w", T.ArrayType(T.BinaryType())), f("y", T.IntegerType())])).toArrow()
    if not got.num_rows:
        return np.zeros(SIGNS**3, np.float32), 0.0
    got = got.sort_by("id").combine_chunks()
    lists = got.column("w").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds = lists.offsets.to_numpy()
    d = lists.flatten().dictionary_encode()
    each = kernel(d.dictionary, marks) @ root.astype(np.float32)
    which = d.indices.to_numpy()
    x = np.add.reduceat(each[which], bounds[:-1], axis=0) / np.sqrt(np.diff(bounds))[:, None]
    y = got.column("y").to_numpy().astype(bool)
    ids = got.column("id").to_pylist()
    text = np.append(0, np.cumsum([a != b for a, b in zip(ids, ids[1:])])) if ids else np.zeros(0, np.int64)
    use = np.ones(len(y), bool)
    for _ in range(rounds):
        sign = np.where(y[use], 1.0, -1.0)
        weight = np.where(sign > 0, 0.3 * (sign < 0).sum() / max((sign > 0).sum(), 1), 1.0)
        w, bias = hinge(x[use], sign, weight, ridge=SENTENCE_RIDGE)
        margin = x @ w + bias
        top = np.full(text[-1] + 1, -np.inf)
        np.maximum.at(top, text, margin)
        use = ~y | (margin >= top[text])  # a toxic text's label stands on its strongest sentence
    del x, each, got, lists, d, which
    tidy()
    return (marks.T @ (root @ w)).astype(np.float32), bias


def labelled_figures(sample: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """(figures, labels) of the labelled texts, a few numbers each."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                x = sent.value.figures(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(list(x)), b.column(2).slice(i, j - i).cast(pa.int32())], names=["id", "x", "y"])

    f = T.StructField
    got = sample.mapInArrow(run, T.StructType([sample.schema["id"], f("x", T.ArrayType(T.DoubleType())), f("y", T.IntegerType())])).toArrow().sort_by("id")
    return np.array(got.column("x").to_pylist()), got.column("y").to_numpy().astype(float)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row of docs; no shuffle. The model is under 1 MB."""
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


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled_sample(docs, labels, "toxic", crc_mod("doc_id", 4) == 2, most=MAX_LABELLED))
    return toxicity_scores(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
