"""Repeated passages by merged Burrows-Wheeler transforms.

A byte is removed if a string of LENGTH bytes covers it that also starts in a document with a
smaller id; strings are judged on the input. Texts are UTF-8 bytes and matches never cross
documents.

Routing. Every LENGTH-byte window has a minimizer, the least hash of its GRAM-byte strings;
equal windows have equal minimizers. Runs of window starts with one minimizer make a segment,
and a segment can only repeat where its minimizer does. Blocks of documents send their distinct
minimizers (a few bytes each) to groups, which answer which occur twice or more; only those
segments travel on, equal ones of a block once, with the smallest id. A block sends one row to
a group at most and there are MAX_GROUPS at most, so rows grow with the blocks alone; a group
works through its minimizers in parts of about PART_BYTES. A minimizer with more than `hot`
different segments travels as single windows by their own hash, so no part grows with one
common passage's surroundings; these windows are merged like all others.

Merging. Every segment that travels goes through the merge. The segments of a part are cut into
shards, block by block; each shard's suffixes are sorted into its Burrows-Wheeler transform, in
which a symbol is the STEP bytes before a suffix, with the place of the suffix that is longer by
them. The merge starts with the shards one after another, each in its own order, and refines the
interleave: from an order by prefixes of length i, one stable pass over the symbols gives the
order by prefixes of length i + STEP, and the intervals of equal prefixes with it. Suffixes of
different shards are never compared or sorted together. Only the suffixes that some window
needs at a length take part, and those alone in their interval retire. At LENGTH bytes, the
intervals left are the repeated windows, with common prefixes of LENGTH at least; each takes the
smallest id in it.

Null texts are empty. Null ids stand after all others; documents of equal id never match each
other. Repeated rows are treated alike. Texts shorter than LENGTH lose nothing. An empty table
gives no rows. Blocks hold whole rows, so other columns pass through whatever their names.
Memory is bounded by a block, or by one text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bytes_of, ship, slices, table, tidy, written

LENGTH = 50
GRAM = 24
#: Bytes of text in a block, in a group, in a part of it that is merged at once (both before
#: selection), and in a shard. What is merged at once fits a processor's cache.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES, SHARD_BYTES = 8 << 20, 6 << 20, 3 << 18, 1 << 16
#: Groups at most; a block sends each of them one row.
MAX_GROUPS = 1024
#: Different segments of a minimizer from which on they travel as single windows.
HOT = 4096
#: Bytes of a symbol of the transforms.
STEP = 4
CHUNK = 1 << 19
NO_ID = np.iinfo(np.int64).max
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(31)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    return x


def _words(raw: np.ndarray) -> np.ndarray:
    """Little-endian uint64 of the eight bytes from each position on (the last seven left out)."""
    n = len(raw) - 7
    out = np.empty(max(n, 0), U)
    for k in range(min(8, max(n, 0))):
        m = (n - k + 7) // 8
        out[k::8] = np.frombuffer(raw.data, "<u8", m, k)
    return out


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (16 to 24) from each position on."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    w = _words(raw)
    h = w[:n] * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(32)
    h += w[8 : 8 + n]
    h *= U(0x165667B19E3779F9)
    h ^= h >> U(32)
    h += w[GRAM - 8 : GRAM - 8 + n]
    return _mix(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        n = len(h) - width + 1
        m = np.minimum(m[:n], m[width - have : width - have + n])
    return m


class Segments:
    """Of a block: document, first byte, window starts, minimizer and content hash of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = np.ascontiguousarray(raw)
        out: list[tuple] = []
        last = len(raw) - LENGTH + 1
        for a in range(0, last, CHUNK):
            b = min(a + CHUNK, last)
            h = gram_hashes(raw[a : b + LENGTH - 1])
            m = _least(h, LENGTH - GRAM + 1)
            lo = np.searchsorted(offsets, a, side="right") - 1
            hi = np.searchsorted(offsets, b, side="left")
            ok = np.ones(b - a, bool)  # windows that end inside their document
            for e in offsets[lo + 1 : hi + 2].tolist():
                ok[max(0, e - LENGTH + 1 - a) : max(0, min(e, b) - a)] = False
            edge = np.empty(b - a, bool)
            edge[0] = True
            np.not_equal(m[1:], m[:-1], out=edge[1:])
            cut = edge.copy()
            cut[1:] |= ok[1:] != ok[:-1]
            first = np.flatnonzero(cut)
            size = np.diff(np.append(first, b - a))
            use = ok[first]
            first, size = first[use], size[use]
            most = LENGTH - GRAM + 1  # in periodic text one minimizer can rule a long run
            if len(size) and size.max() > most:
                pieces = -(-size // most)
                at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(np.repeat(size, pieces) - at * most, most)
                first = np.repeat(first, pieces) + at * most
            end = first + size + LENGTH - 1
            c = h[first] * U(0xFF51AFD7ED558CCD)
            c ^= h[end - GRAM]
            c = _mix(c * U(0xC4CEB9FE1A85EC53) + h[np.minimum(first + GRAM, end - GRAM)])
            c = _mix(c + h[np.maximum(end - 2 * GRAM, first)] * U(0x9FB21C651E98DF25) + size.astype(U))
            out.append((first + a, size, m[first], c))
        if out:
            self.start, self.size, self.key, self.content = (np.concatenate(x) for x in zip(*out))
        else:
            self.start, self.size, self.key, self.content = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1

    def summary(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct minimizers, how many contents each has here, and 255 at most; one more if
        a content occurs twice, so that the minimizer counts as repeated)."""
        order = np.argsort(self.key)
        key = self.key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(first, len(key)))
        count = np.ones(len(first), np.int64)
        several = total > 1
        if several.any():
            some = np.repeat(several, total)
            group = np.repeat(np.arange(several.sum()), total[several])
            content = self.content[order][some]
            by = np.lexsort((content, group))
            new = np.append(True, (content[by][1:] != content[by][:-1]) | (group[by][1:] != group[by][:-1]))
            count[several] = np.maximum(np.bincount(group[by], weights=new).astype(np.int64), 2)
        return key[first], np.minimum(count, 255).astype(np.uint8)

    def chosen(self, keep: np.ndarray, windows: np.ndarray, raw: np.ndarray) -> Segments:
        """Segments with keep set; those with windows set as single windows."""
        out = Segments.__new__(Segments)
        whole, single = keep & ~windows, np.flatnonzero(keep & windows)
        n = self.size[single]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(self.start[single], n) + step
        h = np.empty(len(start), U)
        for i in range(0, len(start), CHUNK):
            grid = raw[start[i : i + CHUNK, None] + np.arange(LENGTH)]
            w = np.zeros((len(grid), 56), np.uint8)
            w[:, :LENGTH] = grid
            acc = np.full(len(grid), 0x27D4EB2F165667C5, U)
            for column in w.view(U).T:
                acc = _mix((acc ^ column) * U(0xC2B2AE3D27D4EB4F))
            h[i : i + CHUNK] = acc
        out.start, out.size = np.append(self.start[whole], start), np.append(self.size[whole], np.ones(len(start), np.int64))
        out.key, out.content = np.append(self.key[whole], h), np.append(self.content[whole], h)
        out.doc = np.append(self.doc[whole], np.repeat(self.doc[single], n))
        return out


def _four(keys: np.ndarray) -> bytes:
    """The low four bytes of each key. Within a bucket of some 10^5 keys these tell nearly all
    apart; two that agree only send a segment on for nothing."""
    return (keys & U(0xFFFFFFFF)).astype("<u4").tobytes()


def _from_four(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(U)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(33)) % U(buckets)).astype(np.int64)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U(8)) % U(parts)).astype(np.uint32)


# ---------------------------------------------------------------- transforms
def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start .. start + size of each range, end to end."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def suffix_order(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): positions of text sorted by what follows, up to the end of their segment
    (`left` bytes away, its end mark included); ties stand in order of position. Sorted by five
    bytes, then by doubled lengths; numbers, places and what was sorted share one 64-bit word."""
    n = len(text)
    bits = U(max(1, n.bit_length()))
    if 3 * int(bits) > 63:
        raise ValueError("a shard holds two million bytes at most")
    low = (U(1) << bits) - U(1)
    depth = 5
    words = _words(np.append(text, np.zeros(16, np.uint8)))[:n].byteswap() >> U(24)
    short = np.flatnonzero(left < depth)
    words[short] &= ~((U(1) << (U(8) * (depth - left[short]).astype(U))) - U(1))
    s = np.sort(words << bits | np.arange(n, dtype=U))
    order = (s & low).astype(np.int32)
    s >>= bits
    rank = np.empty(n, np.int32)  # the first place of those equal so far
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])).astype(np.int32) if n else np.zeros(0, np.int32)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    live = np.flatnonzero(np.repeat(size > 1, size))
    live = live[left[order[live]] > depth].astype(np.int32)  # an end mark ends all that share it
    while len(live):
        at = order[live]
        s = np.sort(rank[at].astype(U) << (bits + bits) | rank[at + depth].astype(U) << bits | np.arange(len(live), dtype=U))
        at = at[s & low]
        order[live] = at
        s >>= bits
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(first, len(s)))
        rank[at] = np.repeat(live[first], size)
        depth *= 2
        live = live[np.repeat(size > 1, size) & (left[at] > depth)]
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def transform(text: np.ndarray, left: np.ndarray, done: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, symbols, link): suffix order and its inverse, the number of the `step` bytes
    before each suffix, and the place of the suffix that is longer by them (-1 where its segment
    has fewer before it, by `done`)."""
    order, place = suffix_order(text, left)
    link = place[order - step]  # what wraps around is marked next
    link[done[order] < step] = -1
    return order, place, symbols(text, order, step), link


def symbols(text: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Number of the `step` bytes before each position, in their order."""
    out = np.zeros(len(at), np.uint32)
    for k in range(step, 0, -1):
        out = out << np.uint32(8) | text[at - k]
    return out


def repeated_windows(segments: list[bytes] | tuple[np.ndarray, np.ndarray], least: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of all windows that also occur in a segment with a smaller `least`.
    segments: a list, or (bytes end to end, sizes)."""
    if isinstance(segments, list):
        data, sizes = np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments], np.int64)
    else:
        data, sizes = segments
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = sizes + 1  # with an end mark, which no UTF-8 text holds
    first = np.cumsum(full) - full
    text = np.full(int(full.sum()), 0xFF, np.uint8)
    text[spans(first, sizes)] = data
    done = np.arange(len(text), dtype=np.int32) - np.repeat(first.astype(np.int32), full)  # bytes before, in the segment
    left = np.repeat(full.astype(np.int32), full) - done
    shard = np.cumsum(full) // shard_bytes
    cuts = np.append(first[np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))], len(text)).tolist()
    order, symbol, link = np.empty(len(text), np.int32), np.empty(len(text), np.uint32), np.empty(len(text), np.int32)
    odd = length % STEP
    begin: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        o, place, t, k = transform(text[a:b], left[a:b], done[a:b])
        order[a:b], symbol[a:b], link[a:b] = o + np.int32(a), t, np.where(k < 0, -1, k + np.int32(a))
        # of each window the suffix right behind its end; symbols of `odd` bytes for a first pass
        where = o[done[a:b][o] >= length]
        begin.append((symbols(text[a:b], where, odd), place[where - odd] + np.int32(a)))
    # the interleave: shards one after another, each in its own order
    at = np.concatenate([x[1] for x in begin])
    interval = np.zeros(len(at), np.uint32)
    if odd and len(at):
        at, interval = _refine(np.concatenate([x[0] for x in begin]), at, interval)
    del begin
    for _ in range(length // STEP):
        if not len(at):
            break
        at, interval = _refine(symbol[at], link[at], interval)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = order[at]
    mine = np.repeat(np.arange(n, dtype=np.int32), full)[where]
    starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    smallest = np.repeat(np.minimum.reduceat(least[mine], starts), np.diff(np.append(starts, len(at))))
    hit = smallest < least[mine]
    return mine[hit], where[hit] - first[mine[hit]]


def _refine(symbol: np.ndarray, to: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: entries in stable order of the symbols before them, at their longer suffixes,
    with the numbers of the new intervals; entries alone in theirs are left out."""
    by = np.sort(symbol.astype(U) << U(32) | np.arange(len(symbol), dtype=U))  # stable: places break ties
    symbol, by = (by >> U(32)).astype(np.uint32), (by & U(0xFFFFFFFF)).astype(np.uint32)
    to, interval = to[by], interval[by]
    same = (symbol[1:] == symbol[:-1]) & (interval[1:] == interval[:-1])
    new = np.append(True, ~same)
    number = np.cumsum(new, dtype=np.uint32)
    shared = np.append(False, same)
    shared[:-1] |= same
    return to[shared], number[shared]


# ---------------------------------------------------------------- the job
def _pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a)
    return raw.nbytes.to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw.tobytes(), asbytes=True)


def _open(b: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], size, codec="zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


def _store(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _load(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _order_ids(ids: pa.ChunkedArray) -> np.ndarray:
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


_B = T.BinaryType()
_ROW = T.StructType([T.StructField("what", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), *(T.StructField(c, _B) for c in "abcd")])


def _row(what: str, block: int, bucket: int, *data: bytes) -> pa.RecordBatch:
    cols = [pa.array([what]), pa.array([block], pa.int64()), pa.array([bucket], pa.int64())]
    cols += [pa.array([x], pa.binary()) for x in (*data, *[None] * (4 - len(data)))]
    return pa.RecordBatch.from_arrays(cols, names=_ROW.names)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT, max_groups: int = MAX_GROUPS, texts: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned: one that docs does not use) of n_bytes,
    n_removed, n_spans, kept_sha256, and if `texts`, kept_text: null where nothing is removed, else
    the characters of which any byte is kept, as a text must be valid."""
    spark = docs.sparkSession
    ship(spark)
    name = "_passages"
    while name in docs.columns:
        name += "_"
    names = list(docs.columns)
    i_id, i_text = names.index(id_col), names.index(text_col)

    def by_bucket(keys: np.ndarray):
        to = bucket_of(keys, buckets)
        by = np.argsort(to, kind="stable")
        return by, np.searchsorted(to[by], np.arange(buckets + 1))

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            out = _row("text", number, -1, _store(pa.Table.from_batches(held).combine_chunks()))
            number += 1
            size = 0
            held.clear()
            return out

        for b in batches:
            for i, j in slices(b.column(i_text), block_bytes):
                held.append(b.slice(i, j - i))
                size += int(bytes_of(held[-1].column(i_text))[1][-1])
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()
        tidy()

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, count = Segments(*bytes_of(_load(data).column(i_text))).summary()
                by, cuts = by_bucket(keys)
                for k in range(buckets):
                    part = by[cuts[k] : cuts[k + 1]]
                    if len(part):
                        yield _row("keys", block, k, _four(keys[part]), _pack(count[part]))
        tidy()

    made = written(docs.mapInArrow(make_blocks, _ROW))
    blocks = made.select("block", "a")
    total = made.count() * block_bytes
    buckets = min(max(1, -(-total // bucket_bytes)), max_groups)
    parts = max(1, -(-total // (buckets * part_bytes)))

    def answer(key, t):
        """Which minimizers of a bucket are repeated, and which are hot, for each block."""
        t = t.combine_chunks()
        blocks = t.column("block").to_pylist()
        keys = [_from_four(x) for x in t.column("a").to_pylist()]
        counts = [_open(x, np.uint8) for x in t.column("b").to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every)
        n = np.concatenate(counts).astype(np.int64)[order]
        s = every[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        sums = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(s))))
        flag = np.empty(len(s), np.uint8)
        flag[order] = (sums > 1).astype(np.uint8) + (sums > hot)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": t.column("bucket"), "flags": pa.array([_pack(f) for f in np.split(flag, cuts)], pa.binary())})

    keys = blocks.mapInArrow(list_keys, _ROW).select("block", "bucket", "a", "b")
    flags = keys.groupBy("bucket").applyInArrow(answer, "block bigint, bucket bigint, flags binary")

    def select(key, left, right):
        """A block's repeated segments: contents for the buckets, occurrences for itself."""
        out = []
        block = key[0].as_py()
        if left.num_rows:
            t = _load(left.column("a")[0].as_py())
            raw, offsets = bytes_of(t.column(i_text))
            ids = _order_ids(t.column(i_id))
            seg = Segments(raw, offsets)
            keys = np.unique(seg.key)
            by, cuts = by_bucket(keys)
            flag = np.zeros(len(keys), np.uint8)
            for k, f in zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist()):
                flag[by[cuts[k] : cuts[k + 1]]] = _open(f, np.uint8)
            of = flag[np.searchsorted(keys, seg.key)] if len(seg.key) else np.zeros(0, np.uint8)
            seg = seg.chosen(of > 0, of > 1, raw)
            both = _mix(seg.key ^ (seg.content * U(0x9E3779B97F4A7C15)))
            own = ids[seg.doc]
            order = np.argsort(both)
            head = np.append(True, both[order][1:] != both[order][:-1]) if len(order) else np.zeros(0, bool)
            rep = order[head]  # of each content, an occurrence, and the smallest id
            least = np.minimum.reduceat(own[order], np.flatnonzero(head)) if len(order) else own
            to = bucket_of(seg.key[rep], buckets)
            by = np.argsort(to, kind="stable")
            rep, least = rep[by], least[by]
            number = np.empty(len(by), np.int64)
            number[by] = np.arange(len(by))
            content = np.empty(len(order), np.int64)
            content[order] = number[np.cumsum(head) - 1] if len(order) else content[order]
            smallest = own <= least[content] if len(order) else np.zeros(0, bool)
            out.append(_row("own", block, -1 - block, _pack(np.diff(seg.start, prepend=0).astype(np.int32)), _pack(seg.size.astype(np.uint8)), _pack(content.astype(np.int32)), _pack(smallest)))
            cuts = np.searchsorted(to[by], np.arange(buckets + 1))
            for k in range(buckets):
                r = rep[cuts[k] : cuts[k + 1]]
                if len(r):
                    text = raw[spans(seg.start[r], seg.size[r] + LENGTH - 1)]
                    out.append(_row("segments", block, k, _pack(text), _pack(seg.size[r].astype(np.uint8)), _pack(part_of(seg.key[r], parts)), _pack(np.append(least[cuts[k] : cuts[k + 1]], cuts[k]))))
        tidy()
        return pa.Table.from_batches(out, schema=out[0].schema) if out else pa.Table.from_batches([_row("none", block, -1)]).slice(0, 0)

    chosen = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(select, _ROW)

    def merge(key, t):
        """For each block's contents of this bucket: the window starts to remove where the id
        is the block's smallest, one bit each. A block's own row passes through."""
        if key[0].as_py() < 0:
            return pa.table({"block": t.column("block"), "at": pa.array([-1], pa.int64()), "mask": t.column("a"), "b": t.column("b"), "c": t.column("c"), "d": t.column("d")})
        t = t.sort_by("block").combine_chunks()
        texts = [_open(x, np.uint8) for x in t.column("a").to_pylist()]
        starts = [_open(x, np.uint8).astype(np.int64) for x in t.column("b").to_pylist()]
        part = np.concatenate([_open(x, np.uint32) for x in t.column("c").to_pylist()])
        last = [_open(x, np.int64) for x in t.column("d").to_pylist()]
        least = np.concatenate([x[:-1] for x in last])
        cuts = np.cumsum([len(x) for x in starts])[:-1]
        size = np.concatenate(starts) + LENGTH - 1
        data = np.concatenate(texts)
        del texts, starts
        first = np.cumsum(size) - size
        result = np.zeros(len(size), U)
        for k in range(parts):
            mine = np.flatnonzero(part == k)
            if len(mine):
                one = parts == 1
                s, o = repeated_windows((data if one else data[spans(first[mine], size[mine])], size[mine]), least[mine])
                np.add.at(result, mine[s], U(1) << o.astype(U))  # each window once
        tidy()
        return pa.table({"block": t.column("block"), "at": pa.array([int(x[-1]) for x in last], pa.int64()), "mask": pa.array([_pack(m) for m in np.split(result, cuts)], pa.binary()), **{x: pa.nulls(len(last), pa.binary()) for x in "bcd"}})

    replies = chosen.groupBy("bucket").applyInArrow(merge, "block bigint, at bigint, mask binary, b binary, c binary, d binary")

    def finish(key, left, right):
        t = _load(left.column("a")[0].as_py())
        raw, offsets = bytes_of(t.column(i_text))
        rows = right.to_pylist()
        own = next(r for r in rows if r["at"] == -1)
        start, size, content, smallest = (_open(own[c], d) for c, d in (("mask", np.int32), ("b", np.uint8), ("c", np.int32), ("d", bool)))
        start = np.cumsum(start, dtype=np.int64)
        masks = np.zeros(int(content.max()) + 1 if len(content) else 0, U)
        for r in rows:
            if r["at"] >= 0:
                m = _open(r["mask"], U)
                masks[r["at"] : r["at"] + len(m)] = m
        bits = np.where(smallest, masks[content], U(0xFFFFFFFFFFFFFFFF)) if len(content) else np.zeros(0, U)
        change = np.zeros(len(raw) + 1, np.int16)  # every window start counts once

        for o in range(LENGTH - GRAM + 1):
            go = (size > o) & ((bits >> U(o)) & U(1)).astype(bool)
            np.add.at(change, start[go] + o, 1)
            np.add.at(change, start[go] + o + LENGTH, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        del change
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < len(raw)]
        rise[edge] = gone[edge]
        total, risen = np.append(0, np.cumsum(gone, dtype=np.int32)), np.append(0, np.cumsum(rise, dtype=np.int32))
        n_gone, n_spans = total[offsets[1:]] - total[offsets[:-1]], risen[offsets[1:]] - risen[offsets[:-1]]
        digests, kept = [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if n_gone[i]:
                digests.append(hashlib.sha256(raw[a:b][~gone[a:b]].tobytes()).hexdigest())
                kept.append(_valid(raw[a:b], gone[a:b]) if texts else None)
            else:
                digests.append(hashlib.sha256(raw[a:b]).hexdigest())
                kept.append(None)
        result = pa.StructArray.from_arrays([pa.array(np.diff(offsets), pa.int64()), pa.array(n_gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
        if not texts:
            t = t.drop_columns([text_col])
        tidy()
        return t.append_column(name, result)

    schema = T.StructType([*(f for f in docs.schema if texts or f.name != text_col), T.StructField(name, T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]))])
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema), name


def _valid(raw: np.ndarray, gone: np.ndarray) -> str:
    """What is left of a text, in whole characters: one stays if any of its bytes does."""
    lead = (raw & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    kept = np.zeros(char[-1] + 1, bool)
    kept[char[~gone]] = True
    return raw[kept[char]].tobytes().decode()


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated passages taken out of their texts; length_col, if there, follows."""
    out, name = judged(docs, id_col, text_col)
    kept = F.col(f"{name}.kept_text")
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.when(F.col(f"{name}.n_removed") > 0, kept).otherwise(F.col(c)).alias(c))
        elif c == length_col:
            cols.append(F.when(F.col(f"{name}.n_removed") > 0, F.length(kept)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return out.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", f"{name}.n_spans", f"{name}.kept_sha256")
