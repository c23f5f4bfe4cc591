"""Helpers shared by the training-data operators: shared folder, word scanning on
Arrow buffers, distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of bytes that are none of these.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
IS_WHITE = np.isin(np.arange(256), list(WHITE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, whatever their working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_velarium_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="velarium-")) / "velarium_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "velarium").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._velarium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, set here only if unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="velarium-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df computed once, kept as Parquet in the shared folder; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/velarium/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._velarium_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what `written` kept for df; nothing may read df, or what was made of it, later."""
    path = df.__dict__.pop("_velarium_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, m: int):
    """crc32(id as text) mod m; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def tidy() -> None:
    """Give freed memory back, so that a worker that lives on does not hold its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


# ---------------------------------------------------------------- Arrow text
def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (a longer text stands alone, whole)."""
    _, offsets = bytes_of(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def store(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def load(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def pack(a: np.ndarray) -> bytes:
    """A column of numbers; bytes of equal weight stand together, which compresses well."""
    a = np.ascontiguousarray(a)
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(b[8:], size, codec="zstd", asbytes=True), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def text_blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """(block, a): whole rows of docs in stored tables of about block_bytes of text each; a longer
    text stands alone. Rows grow with the text alone."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            data = store(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["block", "a"])

        for b in batches:
            for i, j in slices(b.column(at), block_bytes):
                held.append(b.slice(i, j - i))
                size += int(bytes_of(held[-1].column(at))[1][-1])
                if size >= block_bytes:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()
        tidy()

    return docs.mapInArrow(run, "block bigint, a binary")


class Words:
    """Words of consecutive texts: `data` holds their bytes end to end, `offsets` bounds each
    word, `bounds` gives each text's range of words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, offsets = bytes_of(texts)
        if lower:
            raw = LOWER[raw]
        white = IS_WHITE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets[:-1]] = True
        inside = ~white
        start = inside.copy()
        if len(raw):
            start[1:] &= white[:-1] | first[1:-1]
        at = np.flatnonzero(start)
        self.bounds = np.searchsorted(at, offsets)
        kept = np.cumsum(inside, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        self.data = raw[inside]
        self.offsets = np.append(kept[at] - 1, len(self.data)) if len(at) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data))])

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(index of each word, distinct words)."""
        d = self.array().dictionary_encode()
        return d.indices.to_numpy(), d.dictionary

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values over each text's range."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Small rows that are worth a task.
TASK_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than its number of small rows is worth; more rows, more tasks."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


# ---------------------------------------------------------------- components
def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over links (nulls dropped, nodes without
    links absent). Alternating large-star and small-star; each round is written to the shared
    folder, so a lost executor costs one round. Group minima are partial aggregates and the
    joins carry single rows, so a hub's neighbours never gather in one task."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def star(e: DataFrame, large: bool, rows: int) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e
        m = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        j = both.join(m, both["u"] == m["c"])
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select(F.col("c").alias("u"), F.col("m").alias("v")))
        out = gathered(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 2 * rows)
        return gathered(out.distinct(), rows)

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = sign(e)
    for _ in range(rounds):
        before, e = e, written(star(star(e, True, was[0]), False, was[0]))
        discard(before)
        now = sign(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
