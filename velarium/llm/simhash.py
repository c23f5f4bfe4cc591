"""SimHash near-duplicates by multi-index hashing.

Fingerprints: texts are lower-cased (A-Z), split into words, and every three-word shingle
(repeats included, words joined by one space; fewer words: the whole sequence) votes with its
XXH64; a bit is 1 if set in over half the hashes. No words: fingerprint zero, linked like any
other. Null texts are empty.

Links: fingerprints at most two bits apart. Equal fingerprints collapse first, so copies cost
one row. Each distinct fingerprint is stored in one table per 32-bit segment; two fingerprints
within two bits differ by at most one bit in a segment, so each fingerprint probes every table
with the ball of radius one around its segment (only towards smaller values: the other side of
a pair probes the rest), and full distances are verified.

A segment value that more than BUCKET distinct fingerprints share is not joined, since its
pairs grow with the square. Every fingerprint that holds or probes such a value emits itself
and its 64 one-bit neighbours instead: two fingerprints are within two bits exactly if their
neighbourhoods meet, and at most 65 fingerprints can emit one neighbour. That is exact and
linear whatever the group's size.

Components come from distributed min-label stars. Null ids are kept; a component's id is its
smallest id that is not null. An empty table gives no rows; other columns are not touched.

The pipeline's stage (keep_one) links documents whose sets of five-word shingles have a Jaccard
similarity of at least 0.8. Fingerprints of these shingles find the first links, by the same
multi-index hashing, each verified on the sets. Such texts differ in ten of 64 bits on average
and in any number at worst, so no radius holds them all; what fingerprints miss is completed by
a prefix filter, which misses no pair: shingles stand in order of the number of sets that hold
them, counted over the whole corpus by groups of shingles, and two similar sets must share one
among their rarest fifth. Shingles of one set only need not be sent at all. Candidates already in
one component make no pair, nor do those whose parity bitmaps differ in more bits than similar
sets can differ in tokens (each token flips one bit of its set's bitmap); all others are verified
on the whole sets. Texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, components, discard, gathered, load, pack, ship, slices, table, text_blocks, tidy, unpack, written

SEED = 42
WORDS_PER_SHINGLE = 3
DISTANCE = 2
BUCKET = 64
#: Hot segment values up to which they are sent to every executor (12 bytes each).
MAX_BROADCAST_VALUES = 200_000
#: The pipeline's stage: words of a shingle, and the least Jaccard similarity as a fraction.
STAGE_WORDS = 5
SIMILAR = (4, 5)
#: Bytes of text in a block, and groups of shingles at most; a block sends each one row.
BLOCK_BYTES, MAX_GROUPS = 4 << 20, 4096
#: Words of 64 bits of a set's parity bitmap.
BITMAP = 8
#: Turns in which crowded lists try one pair a set before all pairs are tried.
ROUNDS = 4


def shingles_of(texts: pa.Array, k: int = WORDS_PER_SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """uint64 hashes of each text's shingles, repeats included."""
    w = Words(texts, lower=True)
    n = len(w)
    size = np.diff(w.offsets)
    spaced = np.full(len(w.data) + n, 32, np.uint8)  # each word and one space
    start = w.offsets[:-1] + np.arange(n)
    spaced[np.arange(len(w.data)) + np.repeat(np.arange(n), size)] = w.data
    end = start + size
    view = memoryview(spaced)
    digest = xxhash.xxh64_intdigest
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if a == b:
            spans = []
        elif b - a <= k:
            spans = [(int(start[a]), int(end[b - 1]))]
        else:
            spans = zip(start[a : b - k + 1].tolist(), end[a + k - 1 : b].tolist())
        yield np.array([digest(view[i:j], seed) for i, j in spans], np.uint64)


def fingerprints_of(texts: pa.Array, k: int = WORDS_PER_SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    for row, h in enumerate(shingles_of(texts, k, seed)):
        if not len(h):
            continue
        votes = np.zeros(64, np.int64)
        for c in range(0, len(h), 1 << 16):
            part = h[c : c + (1 << 16)]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""
    ship(docs.sparkSession)
    kind = docs.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i, j in slices(texts):
                fp = fingerprints_of(texts.slice(i, j - i), k, seed)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([kind, T.StructField("fp", T.LongType())]))


def near_pairs(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, each once) that connect exactly
    those within two bits. Outside hot values these are all such pairs; inside, each
    neighbourhood is linked to its smallest member."""
    table_ = fps.select("fp", F.posexplode(F.array(F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)"))).alias("seg", "val"))
    hot = written(table_.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("seg", "val"))
    few = hot.count()
    mark = F.broadcast if few <= MAX_BROADCAST_VALUES else (lambda x: x)
    ball = "concat(array(val), transform(filter(sequence(0, 31), i -> (shiftrightunsigned(val, i) & 1L) = 1L), i -> val ^ shiftleft(1L, i)))"
    probes = table_.select("fp", "seg", F.explode(F.expr(ball)).alias("val"))
    if few:
        cold_table = table_.join(mark(hot), ["seg", "val"], "left_anti")
        cold_probes = probes.join(mark(hot), ["seg", "val"], "left_anti")
    else:
        cold_table, cold_probes = table_, probes
    pairs = (
        cold_probes.select(F.col("fp").alias("a"), "seg", "val")
        .join(cold_table.select(F.col("fp").alias("b"), "seg", "val"), ["seg", "val"])
        .where(f"a <> b AND bit_count(a ^ b) <= {DISTANCE}")
        .select("a", "b")
    )
    if few:
        # the full ball: a pair may meet in a hot value from either side
        whole = "concat(array(val), transform(sequence(0, 31), i -> val ^ shiftleft(1L, i)))"
        crowded = table_.select("fp", "seg", F.explode(F.expr(whole)).alias("val")).join(mark(hot), ["seg", "val"], "left_semi").select("fp").distinct()
        near = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("key"))
        least = near.groupBy("key").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("of"))  # 65 at most
        pairs = pairs.unionByName(least.where("size(of) > 1").select("a", F.explode("of").alias("b")).where("a <> b"))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of docs."""
    fps = written(fingerprints(docs, id_col, text_col))
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    comp = written(components(near_pairs(distinct.select("fp"))))
    classes = comp.join(distinct, comp["node"] == distinct["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = comp.join(classes, "component").select(F.col("node").alias("fp"), "component_id")
    by_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Shingles:
    """Distinct shingles of k words of each of some texts, as 64-bit hashes put together from the
    words' hashes (fewer words: the whole sequence). `tokens` are the distinct hashes of all in
    order; `text` and `which` name, text by text, the tokens that it holds, in order."""

    def __init__(self, texts: pa.Array, k: int):
        w = Words(texts, lower=True)
        index, words = w.encoded()
        own = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words.to_pylist()), U, len(words))[index] if len(index) else np.zeros(0, U)
        begin, end = w.bounds[:-1], w.bounds[1:]
        count = np.where(end > begin, np.maximum(end - begin - k + 1, 1), 0)
        text = np.repeat(np.arange(len(count)), count)
        at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(end[text] - at, k)
        h = size.astype(U)
        padded = np.append(own, np.zeros(k, U))
        for j in range(k):
            h = _mix(h ^ np.where(j < size, padded[at + j], U(0)))
        del w, index, words, own, padded, at, size
        self.n, self.k = len(count), k
        self.hashes, self.of = h, text  # repeats included
        self.tokens, inverse = np.unique(h, return_inverse=True)
        s = np.sort(text.astype(U) << U(32) | inverse.astype(U))
        s = s[np.append(True, s[1:] != s[:-1])] if len(s) else s
        self.text, self.which = (s >> U(32)).astype(np.int64), (s & U(0xFFFFFFFF)).astype(np.int64)
        self.sizes = np.bincount(self.text, minlength=self.n)

    def held(self) -> np.ndarray:
        """Number of texts that hold each token."""
        return np.bincount(self.which, minlength=len(self.tokens))

    def nodes(self) -> np.ndarray:
        """Hash of each text's set."""
        total = np.zeros(self.n, U)
        first = np.flatnonzero(np.append(True, self.text[1:] != self.text[:-1])) if len(self.text) else np.zeros(0, np.int64)
        if len(first):
            total[self.text[first]] = np.add.reduceat(_mix(self.tokens[self.which]), first)
        return _mix(total ^ _mix(self.sizes.astype(U) + U(1)))

    def fingerprints(self) -> np.ndarray:
        """SimHash of each text: a bit is 1 if set in over half its shingles' hashes."""
        votes = np.zeros((self.n, 64), np.int64)
        for a in range(0, len(self.hashes), 1 << 16):
            of = self.of[a : a + (1 << 16)]
            bits = np.unpackbits(self.hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            votes[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        total = np.bincount(self.of, minlength=self.n)[:, None]
        return np.packbits(votes * 2 > total, axis=1, bitorder="little").view(U).ravel()

    def bitmaps(self) -> np.ndarray:
        """Parity bitmap of each text's set: its bits that differ from another's are no more than
        the tokens that only one of the two sets holds."""
        bit = ((self.tokens >> U(7)) % U(64 * BITMAP)).astype(np.int64)
        out = np.empty((self.n, BITMAP), np.int64)
        cuts = np.append(0, np.cumsum(self.sizes))
        for a in range(0, self.n, 2048):  # many short texts would make many counters
            b = min(a + 2048, self.n)
            i, j = cuts[a], cuts[b]
            odd = np.bincount((self.text[i:j] - a) * (64 * BITMAP) + bit[self.which[i:j]], minlength=(b - a) * 64 * BITMAP) & 1
            out[a:b] = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(b - a, BITMAP)
        return out

    def prefixes(self, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, token) of the rarest of each text's tokens, so many that two sets as
        similar as SIMILAR share one; those of rarity 0, which one set holds, are left out."""
        s = np.sort(self.text.astype(U) << U(40) | rarity[self.which].astype(U) << U(32) | self.which.astype(U))
        text, which = (s >> U(40)).astype(np.int64), (s & U(0xFFFFFFFF)).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(s)) - first[text]
        take = self.sizes + (-self.sizes * SIMILAR[0] // SIMILAR[1]) + 1
        use = (place < take[text]) & (rarity[which] > 0)
        return text[use], place[use], self.tokens[which[use]]


def token_group(tokens: np.ndarray, groups: int) -> np.ndarray:
    return ((tokens >> U(33)) % U(groups)).astype(np.uint16)


def marks(docs: DataFrame, id_col: str, text_col: str, k: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Blocks of the texts, and for each text (id, at, node, size, fp, bits, places, tokens): where
    it stands, its set's hash and size, its fingerprint and bitmap, and its prefix. How many sets hold a token
    is counted by groups, to which blocks send the low half of each distinct token once; tokens
    that share it in a group count together, which changes the order for all alike."""
    kind = T.StructField("id", docs.select(F.col(id_col).alias("id")).schema[0].dataType)
    blocks = written(text_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", block_bytes))
    groups = min(MAX_GROUPS, 4 * blocks.count() + 4)

    def texts_of(data: bytes) -> pa.Array:
        return load(data).column("text").combine_chunks()

    def by_group(tokens: np.ndarray):
        to = token_group(tokens, groups)
        by = np.argsort(to, kind="stable")
        first = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])) if len(by) else np.zeros(0, np.int64)
        return by, to[by[first]], first, np.append(first[1:], len(by))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sh = Shingles(texts_of(data), k)
                by, group, first, last = by_group(sh.tokens)
                low, n = (sh.tokens[by] & U(0xFFFFFFFF)).astype(np.uint32), sh.held()[by].astype(np.uint32)
                del sh, by
                tidy()
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(first), pa.int64()), pa.array(group.astype(np.int64)), pa.array([pack(low[x:y]) for x, y in zip(first, last)], pa.binary()), pa.array([pack(n[x:y]) for x, y in zip(first, last)], pa.binary())], names=["block", "grp", "a", "b"])
        tidy()

    def answer(key, t):
        low = [unpack(x, np.uint32) for x in t.column("a").to_pylist()]
        n = np.concatenate([unpack(x, np.uint32) for x in t.column("b").to_pylist()])
        s = np.sort(np.concatenate(low).astype(U) << U(32) | np.arange(len(n), dtype=U))
        value, at = (s >> U(32)).astype(np.uint32), (s & U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        total = np.repeat(np.add.reduceat(n[at].astype(np.int64), first), np.diff(np.append(first, len(at))))
        rarity = np.empty(len(at), np.uint8)
        rarity[at] = np.ceil(np.log2(total)).astype(np.uint8)  # 0 for one set only, then octaves
        cuts = np.cumsum([len(x) for x in low])[:-1]
        tidy()
        return pa.table({"block": t.column("block"), "grp": t.column("grp"), "a": pa.array([pack(x) for x in np.split(rarity, cuts)], pa.binary())})

    sent = blocks.mapInArrow(send, "block bigint, grp bigint, a binary, b binary")
    replies = sent.groupBy("grp").applyInArrow(answer, "block bigint, grp bigint, a binary")

    def finish(key, left, right):
        t = load(left.column("a")[0].as_py())
        sh = Shingles(t.column("text").combine_chunks(), k)
        by, group, _, _ = by_group(sh.tokens)
        rarity = np.zeros(len(by), np.uint8)
        got = dict(zip(right.column("grp").to_pylist(), right.column("a").to_pylist()))
        if len(by):
            rarity[by] = np.concatenate([unpack(got[g], np.uint8) for g in group.tolist()])
        text, place, token = sh.prefixes(rarity)
        cuts = pa.array(np.searchsorted(text, np.arange(sh.n + 1)).astype(np.int32))
        at = (key[0].as_py() << 24) + np.arange(sh.n)
        tidy()
        return pa.table({
            "id": t.column("id"), "at": pa.array(at, pa.int64()), "node": pa.array(sh.nodes().view(np.int64)), "size": pa.array(sh.sizes, pa.int64()), "fp": pa.array(sh.fingerprints().view(np.int64)),
            "bits": pa.FixedSizeListArray.from_arrays(pa.array(sh.bitmaps().ravel()), BITMAP).cast(pa.list_(pa.int64())), "places": pa.ListArray.from_arrays(cuts, pa.array(place, pa.int64())), "tokens": pa.ListArray.from_arrays(cuts, pa.array(token.view(np.int64))),
        })

    long = T.LongType()
    schema = T.StructType([kind, *(T.StructField(c, long) for c in ("at", "node", "size", "fp")), *(T.StructField(c, T.ArrayType(long)) for c in ("bits", "places", "tokens"))])
    return blocks, blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def shingle_sets(blocks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) for the texts that wanted (node, at) names: their distinct tokens in order, 8
    bytes each. Only those texts are read again."""
    rows = wanted.select((F.shiftright("at", 24)).alias("block"), F.struct((F.col("at") % (1 << 24)).alias("row"), "node").alias("r")).groupBy("block").agg(F.collect_list("r").alias("rows"))  # a block's texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = load(data).column("text").combine_chunks().take(pa.array([r["row"] for r in some]))
                for i, j in slices(texts):
                    sh = Shingles(texts.slice(i, j - i), k)
                    data_ = sh.tokens[sh.which]
                    cuts = np.append(0, np.cumsum(sh.sizes))
                    yield pa.RecordBatch.from_arrays([pa.array([r["node"] for r in some[i:j]], pa.int64()), pa.array([data_[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["node", "set"])
        tidy()

    return blocks.join(rows, "block").select("a", "rows").mapInArrow(run, "node bigint, set binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) have a Jaccard similarity of at least SIMILAR."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n * SIMILAR[1] >= SIMILAR[0] * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def fingerprint_stars(nodes: DataFrame) -> DataFrame:
    """(a, b): one pair of sets for each fingerprint that several sets share, and for each link of
    the multi-index hashing, from (node, fp)."""
    one = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    equal = nodes.join(one.where("n > 1"), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = near_pairs(one.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    near = pairs.join(one.select(F.col("fp").alias("x"), F.col("head").alias("a")), "x").join(one.select(F.col("fp").alias("y"), F.col("head").alias("b")), "y").select("a", "b")
    return equal.unionByName(near)


def similar_links(marked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(a, b): links between distinct sets that connect exactly those with a Jaccard similarity of
    at least SIMILAR. The first come from fingerprints. Then candidates that are not connected
    yet share a prefix token, may reach the overlap by their sizes and places, and are verified.
    Where more than BUCKET components share a token, each set is tried first with one other of
    a list that it shares; what remains in one component then makes no more pairs."""
    nodes = written(marked.groupBy("node").agg(F.min_by(F.struct("at", "size", "fp", "bits", "places", "tokens"), "at").alias("m")).select("node", "m.*"))
    post = nodes.select("node", "size", F.inline(F.arrays_zip(F.col("places").alias("pos"), F.col("tokens").alias("token"))))
    lists = post.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    live = written(post.join(lists, "token"))
    rows = live.count()
    stars = written(fingerprint_stars(nodes.where("size > 0").select("node", "fp")))
    wanted = live.select("node").unionByName(stars.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = written(shingle_sets(blocks, nodes.select("node", "at").join(wanted, "node", "left_semi"), k))
    # from the first common token on: the overlap must reach SIMILAR / (1 + SIMILAR) of both sizes
    may = f"least(sa - pa, sb - pb) * {sum(SIMILAR)} >= {SIMILAR[0]} * (sa + sb)"

    differ = " + ".join(f"bit_count(xa[{i}] ^ xb[{i}])" for i in range(BITMAP))
    close = f"({differ}) * {sum(SIMILAR)} <= {SIMILAR[1] - SIMILAR[0]} * (sa + sb)"

    def side(df: DataFrame, x: str, *more) -> DataFrame:
        return df.select("token", F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("pos").alias(f"p{x}"), F.col("c").alias(f"c{x}"), *(F.col(m).alias(f"x{x}") for m in more))

    def pairs(df: DataFrame) -> DataFrame:
        d = written(gathered(df.join(nodes.select("node", "bits"), "node"), 4 * rows))
        return side(d, "a", "bits").join(side(d, "b", "bits"), "token").where(f"a < b AND ca <> cb AND {may} AND {close}").select("a", "b").distinct()

    links, settled = written(verified(stars, sets)), False
    for turn in range(ROUNDS + 1):
        cur = written(gathered(live.join(components(links), "node", "left").select("token", "node", "size", "pos", F.coalesce("component", "node").alias("c")), rows))
        mixed = written(gathered(cur.groupBy("token").agg(F.count_distinct("c").alias("n"), F.min_by(F.struct("node", "size", "pos", "c"), F.xxhash64("node", "token", F.lit(turn))).alias("p")).where("n > 1"), rows))
        # a list in one component stays in one, so later turns carry the others' rows alone
        rest = written(gathered(cur.join(mixed.select("token"), "token", "left_semi"), rows))
        if settled or turn == ROUNDS or mixed.where(F.col("n") > BUCKET).isEmpty():
            return links.unionByName(verified(pairs(rest), sets))
        tried = side(rest, "a").join(side(mixed.select("token", "p.*"), "b"), "token").where(f"ca <> cb AND {may}")
        some = tried.groupBy("a").agg(F.min_by("b", F.xxhash64("token", F.lit(turn))).alias("b"))
        new = written(verified(some, sets))
        settled = new.isEmpty()  # tries that link nothing any more end the turns
        before, links = links, written(links.unionByName(new))
        for old in (before, live, cur, mixed, new):
            discard(old)
        live = rest


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = STAGE_WORDS) -> DataFrame:
    """(id, component_id) for each row of docs: documents whose sets of k-word shingles have a
    Jaccard similarity of at least SIMILAR are linked."""
    blocks, found = marks(docs, id_col, text_col, k)
    marked = written(found)
    comp = written(components(similar_links(marked, blocks, k)))
    distinct = marked.groupBy("node").agg(F.min("id").alias("least"))
    by_node = written(distinct.join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c")))
    classes = by_node.groupBy("c").agg(F.min("least").alias("component_id"))
    return marked.select(F.col("id").alias(id_col), "node").join(by_node.join(classes, "c").select("node", "component_id"), "node").select(id_col, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id. Rows that
    repeat an id stay or go together; rows without an id stay unless copied by one that has."""
    seen = similar_documents(docs, id_col, text_col)
    gone = seen.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
