"""Language-model scores by context-tree weighting over bytes.

Texts are lower-cased (A-Z) and read as bytes with an end mark. A byte is eight binary
decisions, most significant first; each decision has a context tree over the DEPTH bytes
before it, as they are. A node's counts give a Krichevsky-Trofimov block probability, and
P_w = (P_e + product of the children's P_w) / 2 mixes all depths. Scoring freezes the model: a
decision's probability mixes the estimates along its context's path with the posterior
weights; the weight left below the deepest node with data goes to that node's estimate.

Nothing is cut: every (context, byte) of the training texts counts, and the tree grows with
them. It is never in one place. Texts lie in blocks; a block sends each of its distinct
(context, byte) keys once, with its training count, to the group of the key's last SPLIT
bytes. A group merges the counts and weighs its subtrees; the few levels above SPLIT are weighed
by last byte, the root on the driver (256 rows). The weights come back the same way, groups
answer each block with the log probabilities of its keys, and blocks sum them over their texts.

Beside it stands a unigram base over words and one end token per text with add-one smoothing.
Its vocabulary is never collected: blocks send their distinct words with the same rows, to
groups by hash, and get the counts of their own words back.

A null text is empty; an empty text has only its end. Null ids hash as empty text. Repeated
rows are scored alike and all counted. A null flag counts as training. An empty table gives no
rows. Very long texts stand alone in a block, whole. Other columns are not touched, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, Words, bytes_of, crc_mod, load, pack, per_text, ship, slices, store, table, text_blocks, tidy, unpack, written

PAD, END = 0xFE, 0xFF  # bytes that UTF-8 does not use
DEPTH = 6
#: Bytes of context that choose a key's group; deeper subtrees lie whole in one group.
SPLIT = 3
#: Bytes of text in a block, and of a part of it whose keys are sorted at once.
BLOCK_BYTES, SLICE = 8 << 20, 2 << 20
#: Groups at most; a block sends one row to each at most, so rows grow with the blocks only.
MAX_GROUPS = 4096
#: No word: stands for the end of a text.
END_TOKEN = b"\n"
U = np.uint64
HALF = float(np.log(0.5))


# ---------------------------------------------------------------- keys
def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, positions to predict, bounds): every text follows DEPTH pads and ends with END."""
    raw, offsets = bytes_of(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    shift = np.arange(n) * (DEPTH + 1) + DEPTH
    out = np.full(len(raw) + n * (DEPTH + 1), PAD, np.uint8)
    out[np.arange(len(raw)) + np.repeat(shift, size)] = LOWER[raw]
    out[offsets[1:] + shift] = END
    return out, np.flatnonzero(out != PAD), np.append(0, np.cumsum(size + 1))


def keys_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before each position, latest first, then its own: one number each."""
    k = np.zeros(len(data), U)
    for d in range(1, DEPTH + 1):
        k[d:] |= data[:-d].astype(U) << U(8 * (DEPTH - d + 1))
    k |= data
    return k[at]


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys without their oldest byte of context."""
    return (keys >> U(16)) << U(8) | (keys & U(255))


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def group_of(keys: np.ndarray, depth: int, groups: int) -> np.ndarray:
    """Group of each sorted key of `depth` bytes of context, by the last SPLIT of them."""
    context = keys >> U(8 * (depth - SPLIT) + 8)
    return ((context * U(0x9E3779B97F4A7C15) >> U(40)) % U(groups)).astype(np.uint16)


def local_keys(texts: pa.Array, mark: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, sorted key << 8 | mark of its text) of parts of at most SLICE bytes and 256
    texts; where mark is None, a text's mark is its place in the part."""
    for i, j in slices(texts, SLICE):
        for a in range(i, j, 256):
            b = min(a + 256, j)
            data, at, bounds = stream(texts.slice(a, b - a))
            own = np.arange(b - a) if mark is None else mark[a:b]
            yield a, np.sort(keys_of(data, at) << U(8) | np.repeat(own.astype(U), np.diff(bounds)))


def block_keys(texts: pa.Array, train: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct keys of some texts in order, and how often training texts hold each."""
    keys, counts, held = [], [], 0
    for _, s in local_keys(texts, train if train is not None else np.zeros(len(texts), bool)):
        k = s >> U(8)
        first = edges(k)
        keys.append(k[first])
        if train is not None:
            counts.append(np.add.reduceat((s & U(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64))
        held += len(first)
        if held > 3_000_000 and len(keys) > 8:
            k, n = merged(keys, counts if train is not None else None)
            keys, counts, held = [k], [n], len(k)
    return merged(keys, counts if train is not None else None)


def merged(keys: list[np.ndarray], counts: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, U), None if counts is None else np.zeros(0, np.int64)
    k = np.concatenate(keys)
    if counts is None:
        k = np.sort(k)
        return k[edges(k)], None
    if len(keys) == 1:
        return k, counts[0]
    by = np.argsort(k, kind="stable")
    k, n = k[by], np.concatenate(counts)[by]
    first = edges(k)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def _pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def _open_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U), dtype=U)


# ---------------------------------------------------------------- the tree
#: lgamma(n + 0.5) - lgamma(0.5) and lgamma(n + 1) of small counts.
SMALL = 1 << 14
_HALVES = np.append(0, np.cumsum(np.log(np.arange(SMALL) + 0.5)))
_WHOLES = np.append(0, np.cumsum(np.log(np.arange(SMALL) + 1.0)))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def _log_rising(n: np.ndarray, small: np.ndarray, shift: float, base: float) -> np.ndarray:
    out = small[np.minimum(n, SMALL)]
    big = n > SMALL
    if big.any():
        out[big] = _stirling(n[big] + shift) - base
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov block probability of so many zeros and ones."""
    half = 0.5 * float(np.log(np.pi))
    return _log_rising(zeros, _HALVES, 0.5, half) + _log_rising(ones, _HALVES, 0.5, half) - _log_rising(zeros + ones, _WHOLES, 1.0, 0.0)


class Levels:
    """Keys and counts of depths `deep` up to `shallow`, and each key's place one level up."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, deep: int, shallow: int):
        self.keys, self.counts, self.up = {deep: keys}, {deep: counts}, {}
        for d in range(deep - 1, shallow - 1, -1):
            self.keys[d], self.up[d + 1] = np.unique(shorter(self.keys[d + 1]), return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], weights=self.counts[d + 1], minlength=len(self.keys[d])).astype(np.int64)
        self.deep, self.shallow = deep, shallow


def runs(keys: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first key, number for each key) of the decision nodes after `bit` bits of the byte."""
    node = keys >> U(8 - bit)
    first = edges(node)
    number = np.zeros(len(keys), np.int64)
    number[first[1:]] = 1
    return first, np.cumsum(number)


def sweep(t: Levels, below: list[np.ndarray] | None = None, above: list[tuple] | None = None, leaves: bool = True):
    """Weighs the levels decision by decision (bit by bit). below: log P_w of the deepest level's
    nodes where the tree goes on under it. Without `above`: log P_w of the shallowest level's
    nodes, for each bit. With it, (total, left, leaf) for the nodes of the shallowest level as
    their parents have them: the probability of a one at the deepest level's nodes if `leaves`,
    else (total, left, leaf) for these."""
    out = []
    for bit in range(8):
        first, number, estimate, weight, seen, parent = {}, {}, {}, {}, {}, {}
        weighted = None
        for d in range(t.deep, t.shallow - 1, -1):
            first[d], number[d] = runs(t.keys[d], bit)
            n = len(first[d])
            byte = (t.keys[d] >> U(7 - bit)) & U(1)
            total = np.bincount(number[d], weights=t.counts[d], minlength=n).astype(np.int64)
            ones = np.bincount(number[d], weights=t.counts[d] * byte.astype(np.int64), minlength=n).astype(np.int64)
            own = log_kt(total - ones, ones)
            estimate[d], seen[d] = (ones + 0.5) / (total + 1.0), total > 0
            if d == t.deep:
                weighted, weight[d] = (own, None) if below is None else (below[bit], None)
            else:
                parent[d + 1] = number[d][t.up[d + 1][first[d + 1]]]
                children = np.bincount(parent[d + 1], weights=weighted, minlength=n)
                weighted = np.logaddexp(own, children) + HALF
                weight[d] = np.exp(own + HALF - weighted)
        if above is None:
            out.append(weighted)
            continue
        total, left, leaf = above[bit]
        for d in range(t.shallow, t.deep + (1 if leaves else 0)):
            if d > t.shallow:
                total, left, leaf = total[parent[d]], left[parent[d]], leaf[parent[d]]
            leaf = np.where(seen[d], total + left * estimate[d], leaf)
            if weight[d] is not None:
                total, left = total + left * weight[d] * estimate[d], left * (1 - weight[d])
        if leaves:
            out.append(leaf)
        else:
            to = parent[t.deep]
            out.append((total[to], left[to], leaf[to]))
    return out


def log_bytes(t: Levels, ones: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each of the deepest level's keys."""
    keys = t.keys[t.deep]
    out = np.zeros(len(keys))
    for bit in range(8):
        p = ones[bit][runs(keys, bit)[1]]
        out += np.log10(np.where((keys >> U(7 - bit)) & U(1), p, 1 - p))
    return out


def _join_runs(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Parts of (sorted keys, values of their nodes for each bit) as one: (order, keys, values)."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    whole = keys[order]
    values = []
    for bit in range(8):
        each = np.concatenate([p[1][bit][runs(p[0], bit)[1]] for p in parts])[order]
        values.append(each[runs(whole, bit)[0]])
    return order, whole, values


def _cut_runs(keys: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
    """Values of nodes, end to end, as one array for each bit."""
    sizes = [len(runs(keys, bit)[0]) for bit in range(8)]
    return np.split(flat, np.cumsum(sizes)[:-1])


# ---------------------------------------------------------------- the job
_FIELDS = [("what", T.StringType(), pa.string()), ("block", T.LongType(), pa.int64()), ("grp", T.LongType(), pa.int64()), *((c, T.BinaryType(), pa.binary()) for c in "abcd")]
_ROW = T.StructType([T.StructField(n, t) for n, t, _ in _FIELDS])
_ROWS = pa.schema([(n, t) for n, _, t in _FIELDS])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ROWS.names, r)) for r in rows], _ROWS)


def word_groups(words: pa.Array, groups: int) -> np.ndarray:
    """Group of each word, by a hash of its bytes."""
    data, offsets = bytes_of(words)
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, U))[place % 64] ^ (place // 64).astype(U)
    h = size.astype(U)
    some = size > 0
    if len(data):
        h[some] += np.add.reduceat((data.astype(U) + U(1)) * power, offsets[:-1][some])
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return ((h >> U(32)) % U(groups)).astype(np.uint16)


def block_words(texts: pa.Array) -> tuple[Words, np.ndarray, pa.Array]:
    """(words, index of each, distinct words and, last, the end token)."""
    w = Words(texts, lower=True)
    index, words = w.encoded()
    return w, index, pa.concat_arrays([words, pa.array([END_TOKEN], pa.binary())])


def _subtrees(keys: np.ndarray, counts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, Levels]]:
    """(from, to, levels from SPLIT down) of parts that hold whole subtrees, `most` keys or one each."""
    first = np.append(edges(keys >> U(8 * (DEPTH - SPLIT) + 8)), len(keys))
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + most, side="right")) - 1)
        a, b = int(first[i]), int(first[j])
        yield a, b, Levels(keys[a:b], counts[a:b], DEPTH, SPLIT)
        i = j


def _flags(t: pa.Table) -> np.ndarray:
    return t.column("held_out").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def scored(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes with the end
    mark, bits_per_byte) for each row of docs; the model and the base learn from rows whose
    boolean column held_out is false or null."""
    spark = docs.sparkSession
    ship(spark)
    kind = T.StructField("id", docs.select(F.col(id_col).alias("id")).schema[0].dataType)
    # columns are renamed one by one, so that clashing names cannot meet
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    made = written(text_blocks(docs, "text", block_bytes))
    groups = min(MAX_GROUPS, 4 * made.count() + 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block: its keys for every group, and its words."""
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = load(data)
                texts, train = t.column("text").combine_chunks(), ~_flags(t)
                keys, counts = block_keys(texts, train)
                to = group_of(keys, DEPTH, groups)
                by = np.argsort(to, kind="stable")
                to, keys, counts = to[by], keys[by], counts[by].astype(np.int32)
                cut = np.searchsorted(to, np.arange(groups + 1))
                w, index, words = block_words(texts)
                n = np.bincount(index, weights=np.repeat(train, np.diff(w.bounds)), minlength=len(words)).astype(np.int32)
                n[-1] = train.sum()
                to = word_groups(words, groups)
                by = np.argsort(to, kind="stable")
                words, n = words.take(pa.array(by)), n[by]
                own = np.searchsorted(to[by], np.arange(groups + 1))
                del by, to, index, w, texts, t
                for g in range(groups):
                    a, b_, x, y = cut[g], cut[g + 1], own[g], own[g + 1]
                    if b_ > a or y > x:
                        yield from _rows([("sent", block, g, _pack_keys(keys[a:b_]), pack(counts[a:b_]), store(pa.table({"w": words.slice(x, y - x)})), pack(n[x:y]))]).to_batches()
                del keys, counts, words, n
                tidy()

    field = T.StructField
    sent = written(made.select("block", "a").mapInArrow(send, _ROW))

    def weigh(key, t):
        """A group's counts as one, what its subtrees weigh at SPLIT, by last byte, and for each
        block the counts of the words that it sent."""
        k, n = merged([_open_keys(x) for x in t.column("a").to_pylist()], [unpack(x, np.int32).astype(np.int64) for x in t.column("b").to_pylist()])
        out = [("state", -1, key[0].as_py(), _pack_keys(k), pack(n))]
        for _, _, levels in _subtrees(k, n):
            w = sweep(levels)
            top = levels.keys[SPLIT]
            first = [runs(top, bit)[0] for bit in range(8)]
            last = (top >> U(8 * SPLIT)).astype(np.int64)
            for c in np.unique(last).tolist():
                a, b = np.searchsorted(last, [c, c + 1])
                cut = [w[bit][slice(*np.searchsorted(first[bit], [a, b]))] for bit in range(8)]
                out.append(("up", c, key[0].as_py(), _pack_keys(top[a:b]), pack(levels.counts[SPLIT][a:b]), pack(np.concatenate(cut))))
        words = [load(x).column("w").combine_chunks() for x in t.column("c").to_pylist()]
        d = pa.concat_arrays(words).dictionary_encode()
        index = d.indices.to_numpy()
        count = np.zeros(len(d.dictionary), np.int64)
        np.add.at(count, index, np.concatenate([unpack(x, np.int32) for x in t.column("d").to_pylist()]))
        for block, c in zip(t.column("block").to_pylist(), np.split(count[index], np.cumsum([len(x) for x in words])[:-1])):
            out.append(("count", block, key[0].as_py(), pack(c)))
        out.append(("tokens", -1, key[0].as_py(), pack(np.array([count.sum(), (count > 0).sum()], np.int64))))
        tidy()
        return _rows(out)

    weighed = written(sent.groupBy("grp").applyInArrow(weigh, _ROW))
    totals = [unpack(r["a"], np.int64) for r in weighed.where("what = 'tokens'").select("a").collect()]  # MAX_GROUPS at most
    tokens, distinct = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    log_all = float(np.log10(tokens + distinct + 1))
    ups = weighed.where("what = 'up'").select("block", "grp", "a", "b", "c")

    def top_levels(t: pa.Table) -> tuple[np.ndarray, Levels, list[np.ndarray]]:
        """Groups of the keys at SPLIT below one last byte, their levels up to it, and P_w."""
        parts = []
        for a, c in zip(t.column("a").to_pylist(), t.column("c").to_pylist()):
            k = _open_keys(a)
            parts.append((k, _cut_runs(k, unpack(c, np.float64))))
        order, keys, below = _join_runs(parts)
        counts = np.concatenate([unpack(x, np.int64) for x in t.column("b").to_pylist()])[order]
        return keys, Levels(keys, counts, SPLIT, 1), below

    def rise(key, t):
        _, levels, below = top_levels(t)
        w = sweep(levels, below)
        return _rows([("one", key[0].as_py(), -1, _pack_keys(levels.keys[1]), pack(levels.counts[1]), pack(np.concatenate(w)))])

    ones = ups.groupBy("block").applyInArrow(rise, _ROW).toArrow().sort_by("block")  # one row for each byte: 256 at most
    above: dict[int, list] = {}
    if ones.num_rows:
        parts = [(k := _open_keys(a), _cut_runs(k, unpack(c, np.float64))) for a, c in zip(ones.column("a").to_pylist(), ones.column("c").to_pylist())]
        _, keys, below = _join_runs(parts)  # already in order
        levels = Levels(keys, np.concatenate([unpack(x, np.int64) for x in ones.column("b").to_pylist()]), 1, 0)
        start = [(np.zeros(m), np.ones(m), np.full(m, 0.5)) for m in (len(runs(levels.keys[0], bit)[0]) for bit in range(8))]
        found = sweep(levels, below, start, leaves=False)
        last = (keys >> U(8)).astype(np.int64)
        for c in np.unique(last).tolist():
            a, b = np.searchsorted(last, [c, c + 1])
            cut = [slice(*np.searchsorted(runs(keys, bit)[0], [a, b])) for bit in range(8)]
            above[c] = [tuple(v[s] for v in found[bit]) for bit, s in enumerate(cut)]
    root = spark.sparkContext.broadcast(above)

    def fall(key, t):
        """What the levels above SPLIT leave to the subtrees of one last byte, for their groups."""
        keys, levels, below = top_levels(t)
        found = sweep(levels, below, root.value[key[0].as_py()], leaves=False)
        to = group_of(keys, SPLIT, groups)
        each = [[v[runs(keys, bit)[1]] for v in found[bit]] for bit in range(8)]
        out = []
        for g in np.unique(to).tolist():
            mine = np.flatnonzero(to == g)
            k = keys[mine]
            flat = [np.concatenate([each[bit][x][mine][runs(k, bit)[0]] for bit in range(8)]) for x in range(3)]
            out.append(("down", key[0].as_py(), g, _pack_keys(k), pack(np.concatenate(flat))))
        return _rows(out)

    downs = ups.groupBy("block").applyInArrow(fall, _ROW)

    def answer(key, t):
        """For each block, the log probabilities of the keys that it sent to this group."""
        what = t.column("what").to_pylist()
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        i = what.index("state")
        keys, counts = _open_keys(a[i]), unpack(b[i], np.int64)
        parts = []
        for i in sorted((i for i, w in enumerate(what) if w == "down"), key=lambda i: t.column("block")[i].as_py()):
            k = _open_keys(a[i])
            parts.append((k, [_cut_runs(k, x) for x in np.split(unpack(b[i], np.float64), 3)]))
        if parts:  # a group may hold words alone
            top = np.concatenate([p[0] for p in parts])
            each = [[np.concatenate([p[1][x][bit] for p in parts]) for x in range(3)] for bit in range(8)]
        value = np.empty(len(keys), np.float32)
        for x, y, levels in _subtrees(keys, counts):
            lo, hi = np.searchsorted(top, [levels.keys[SPLIT][0], levels.keys[SPLIT][-1] + U(1)])
            cut = [slice(*np.searchsorted(runs(top, bit)[0], [lo, hi])) for bit in range(8)]
            value[x:y] = log_bytes(levels, sweep(levels, None, [tuple(v[s] for v in each[bit]) for bit, s in enumerate(cut)]))
        value = (value.view(np.uint32) & np.uint32(0xFFFFFF00)).view(np.float32)  # 16 bits of mantissa travel
        out = []
        for i, w in enumerate(what):
            if w == "keys":
                mine = value[np.searchsorted(keys, _open_keys(a[i]))]
                out.append(("value", t.column("block")[i].as_py(), key[0].as_py(), pack(mine)))
        tidy()
        return _rows(out)

    states = weighed.where("what = 'state'")
    blank = F.lit(None).cast("binary")
    messages = sent.select(F.lit("keys").alias("what"), "block", "grp", "a", blank.alias("b"), blank.alias("c"), blank.alias("d"))
    replies = messages.unionByName(states).unionByName(downs).groupBy("grp").applyInArrow(answer, _ROW)

    def finish(key, t):
        what = t.column("what").to_pylist()
        a, grp = t.column("a").to_pylist(), t.column("grp").to_pylist()
        t = load(a[what.index("text")])
        texts, out = t.column("text").combine_chunks(), _flags(t)
        keys, _ = block_keys(texts, None)
        to = group_of(keys, DEPTH, groups)
        by = np.argsort(to, kind="stable")
        value = np.empty(len(keys), np.float32)
        value[by] = np.concatenate([unpack(a[i], np.float32) for i in sorted((i for i, w in enumerate(what) if w == "value"), key=grp.__getitem__)])
        del by, to
        score = np.zeros(len(texts))
        for i, s in local_keys(texts, None):
            k = s >> U(8)
            first = edges(k)
            each = np.repeat(value[np.searchsorted(keys, k[first])], np.diff(np.append(first, len(k))))
            part = np.bincount((s & U(255)).astype(np.int64), weights=each)
            score[i : i + len(part)] = part
        del keys, value
        w, index, words = block_words(texts)
        to = word_groups(words, groups)
        c = np.empty(len(words), np.int64)
        c[np.argsort(to, kind="stable")] = np.concatenate([unpack(a[i], np.int64) for i in sorted((i for i, x in enumerate(what) if x == "count"), key=grp.__getitem__)])
        del to
        gain = np.log10(c + 1.0) - log_all
        size = np.diff(bytes_of(texts)[1]) + 1
        m = len(texts)
        result = pa.table(
            {
                "id": t.column("id"), "held_out": pa.array(out), "n_tokens": pa.array(np.diff(w.bounds) + 1, pa.int64()),
                "n_known": pa.array(per_text((c[index] > 0).astype(np.int64), w.bounds) + int(c[-1] > 0), pa.int64()),
                "train_tokens": pa.array([tokens] * m, pa.int64()), "base_score": pa.array(per_text(gain[index], w.bounds) + gain[-1]),
                "score": pa.array(score), "n_bytes": pa.array(size, pa.int64()), "bits_per_byte": pa.array(-score / np.log10(2) / size),
            }
        )
        del w, index, words, c, gain
        tidy()
        return result

    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([kind, field("held_out", T.BooleanType()), field("n_tokens", long), field("n_known", long), field("train_tokens", long), field("base_score", double), field("score", double), field("n_bytes", long), field("bits_per_byte", double)])
    both = made.select(F.lit("text").alias("what"), "block", F.lit(-1).cast("bigint").alias("grp"), "a").unionByName(weighed.where("what = 'count'").select("what", "block", "grp", "a")).unionByName(replies.select("what", "block", "grp", "a"))
    done = both.groupBy("block").applyInArrow(finish, schema)
    return done.withColumnRenamed("id", id_col)


def lm_scores(docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`scored` for each row of docs, with the model and the base learned from corpus alone."""
    told = docs.select(F.struct(F.col(id_col).alias("id")).alias(id_col), F.col(text_col).alias("text"), F.lit(True).alias("held_out"))
    other = corpus.select(F.lit(None).cast(told.schema[0].dataType).alias(id_col), F.col(text_col).alias("text"), F.lit(False).alias("held_out"))
    out = scored(told.unionByName(other), "held_out", id_col, "text").where("held_out")
    return out.withColumn(id_col, F.col(id_col)["id"]).drop("held_out")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    return scored(docs, "held_out")
