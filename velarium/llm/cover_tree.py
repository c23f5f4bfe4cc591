"""Near-duplicate embeddings by cosine, found by cover trees traversed in pairs.

Unit vectors are compared by chord length, a metric: a cosine of c is a chord of
sqrt(2 - 2 c). A tree's levels halve the radius: each node's points are covered by centers
that lie more than half its radius apart, the node's own center first (so levels nest), and
every child keeps the true radius that covers its points. Two trees are traversed together:
all children of a node are held against all children of another at once, and a pair of children
is dropped if its centers are farther apart than both radii and the threshold. What is left at
the points is verified in double precision.

At scale, equal vectors collapse first (copies cost one row). A tree over a sample that grows
with the vectors gives cells, one for about BLOCK vectors; each vector goes to its nearest cell,
and a cell that stays too large is cut by hash into blocks. A vector is sent to its own block,
and to another only if its distance to that one's center is within its covering radius and the
threshold: no partner of it can lie in a block that it does not reach. Each pair of blocks that
some vector reaches is one task. A task emits per vector the number of its links and one
edge to the smallest vector it is connected to there, so the output stays linear in the
vectors however dense a group is.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors
of different lengths link with nothing either. Null ids are kept and counted as vectors; a
component's id is its smallest id that is not null. An empty table gives no rows; other
columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import components, ship, table, written

COSINE = 0.9
LEAF = 64
FEW = 16
BLOCK = 8192
#: Cells at most (their centers go to every executor), and vectors of the sample for each cell.
MAX_CELLS, SAMPLE = 16_384, 4
SLACK = 1e-9


def chord(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


#: Single-precision products of unit vectors are off by less than this.
ROUNDING = 4e-6


class Node:
    """Children by their centers (single precision), radii (rounded up; 0: one point), first
    points, and, for those of several points, nodes."""

    __slots__ = ("centers", "children", "heads", "radii")

    def __init__(self, x: np.ndarray, points: np.ndarray, radius: float):
        self.heads, self.radii = points, np.zeros(len(points))
        self.children = np.full(len(points), None, object)
        if len(points) > LEAF and radius > 1e-3:
            centers, owner, far = net(x, points, radius / 2)
            if len(centers) < len(points):
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(centers) + 1))
                large = np.diff(cuts) > FEW  # smaller children stand here point by point
                loose = points[~large[owner]]
                self.heads = np.append(loose, centers[large])
                self.radii = np.append(np.zeros(len(loose)), far[large])
                self.children = np.full(len(self.heads), None, object)
                for n, k in enumerate(np.flatnonzero(large), len(loose)):
                    mine = order[cuts[k] : cuts[k + 1]]
                    mine = mine[np.argsort(points[mine] != centers[k], kind="stable")]  # own center first
                    self.children[n] = Node(x, points[mine], radius / 2)
        self.centers = x[self.heads]

    def part(self, some: np.ndarray) -> Node:
        out = Node.__new__(Node)
        out.centers, out.radii, out.heads, out.children = self.centers[some], self.radii[some], self.heads[some], self.children[some]
        return out


def net(x: np.ndarray, points: np.ndarray, radius: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centers, center of each point, covering radii): centers lie farther apart than radius
    and cover all points within it (but for rounding); the first point is a center."""
    owner = np.full(len(points), -1)
    gap = np.ones(len(points))
    centers: list[int] = []
    left = np.arange(len(points))
    near = np.float32(1 - radius * radius / 2)
    while len(left):
        some = left[:batch]
        far = x[points[some]] @ x[points[some]].T < near
        free = np.ones(len(some), bool)
        new = []
        for i in range(len(some)):
            if free[i]:
                new.append(i)
                free &= far[i]
        chosen = points[some[new]]
        d = x[points[left]] @ x[chosen].T
        best = d.argmax(axis=1)
        cosine = d[np.arange(len(left)), best]
        ok = cosine >= near
        ok[new] = True
        best[new], cosine[new] = np.arange(len(new)), 2
        owner[left[ok]], gap[left[ok]] = len(centers) + best[ok], cosine[ok]
        centers.extend(chosen.tolist())
        left = left[~ok]
    reach = np.where(gap > 1.5, 0.0, np.sqrt(np.maximum(0.0, 2 - 2 * gap) + 4 * ROUNDING))
    far = np.zeros(len(centers))
    np.maximum.at(far, owner, reach)
    return np.array(centers), owner, far


def close(u: Node, v: Node, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children whose balls may hold points within the limit."""
    rows, cols = [], []

    def compare(a: np.ndarray, b: np.ndarray, wide: bool) -> None:
        for k in range(0, len(a), 1024):
            i = a[k : k + 1024]
            dot = u.centers[i] @ v.centers[b].T
            if wide:
                span = np.minimum(2.0, limit + u.radii[i][:, None] + v.radii[b][None, :])
                hit = dot >= 1 - span * span / 2 - ROUNDING
            else:
                hit = dot >= np.float32(1 - limit * limit / 2 - ROUNDING)
            p = np.flatnonzero(hit)
            rows.append(i[p // len(b)])
            cols.append(b[p % len(b)])

    thin_u, thin_v = u.radii == 0, v.radii == 0
    parts = [(thin_u, thin_v, False), (~thin_u, np.ones(len(thin_v), bool), True), (thin_u, ~thin_v, True)]
    for m, n, wide in parts:
        a, b = np.flatnonzero(m), np.flatnonzero(n)
        if len(a) and len(b):
            compare(a, b, wide)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def dual(a: Node, b: Node, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points (rows of each tree's array) that may lie within the limit, in batches;
    none that does is left out. A child of several points descends against all children of the
    other node that it may reach, at once."""
    stack = [(a, b)]
    while stack:
        u, v = stack.pop()
        i, j = close(u, v, limit)
        one_u, one_v = u.radii[i] == 0, v.radii[j] == 0
        both = one_u & one_v
        if both.any():
            yield u.heads[i[both]], v.heads[j[both]]
        for k, some in grouped(i[~one_u], j[~one_u]):
            stack.append((u.children[k], v.part(some)))
        rest = one_u & ~one_v
        for k, some in grouped(j[rest], i[rest]):
            stack.append((u.part(some), v.children[k]))


def grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else [], len(keys)).astype(int)
    for x, y in zip(cuts[:-1], cuts[1:]):
        yield keys[x], values[x:y]


class Links:
    """Counts and connections of points, fed with batches of linked pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.count = np.zeros(n, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def settle(self) -> np.ndarray:
        while (self.label[self.label] != self.label).any():
            self.label = self.label[self.label]
        return self.label


def join_blocks(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, cosine: float) -> Links:
    """Links between rows `left` and `right` of unit vectors x; the same rows if `same`."""
    links = Links(len(x))
    if not len(left) or not len(right):
        return links
    single = x.astype(np.float32)
    a = Node(single, left, 2.0)
    b = a if same else Node(single, right, 2.0)
    for i, j in dual(a, b, chord(cosine)):
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
            if not len(i):
                continue
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[ok], j[ok]
        np.add.at(links.count, i, weight[j])
        np.add.at(links.count, j, weight[i])
        links.add(i, j)
    return links


def cells(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centers of the first tree level that has enough, in nested order."""
    if not len(sample) or wanted <= 1:
        return sample[:1]
    radius, points, single = 2.0, np.arange(len(sample)), sample.astype(np.float32)
    while True:
        radius /= 2
        centers, _, _ = net(single, points, radius)
        if len(centers) >= min(wanted, len(sample)) or radius < 1e-6:
            return sample[centers[:wanted]]
        points = np.append(centers, np.setdiff1d(points, centers))


def unit(vectors: pa.Array, size: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    spark = rows.sparkSession
    ship(spark)
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    base = rows.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("_sound"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = base.withColumn("_sound", F.when(F.col("_sound"), length > 0).otherwise(False))
    uid = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v")), F.lit("-"), F.size("v").cast("string"))
    base = written(base.select("id", F.when(F.col("_sound"), uid).alias("uid"), F.when(F.col("_sound"), F.col("v")).alias("v")))
    distinct = written(base.where("uid IS NOT NULL").groupBy("uid").agg(F.count("*").alias("m"), F.min("id").alias("least"), F.first("v").alias("v")).withColumn("size", F.size("v")))

    found = None
    for size, n in distinct.groupBy("size").agg(F.count("*")).sort("size").collect():  # vector lengths are few
        part = _join(distinct.where(F.col("size") == size).select("uid", "m", "v"), size, n, cosine, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found)
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    comp = written(components(found.where("uid <> root").select("uid", "root"), "uid", "root"))
    least = comp.join(distinct, comp["node"] == distinct["uid"]).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = comp.join(least, "component").select(F.col("node").alias("uid"), "component_id")
    by = distinct.select("uid", "m", "least").join(counts, "uid", "left").join(linked, "uid", "left")
    by = by.select(F.col("uid").alias("u"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = base.select("id", "uid").join(by, F.col("uid") == F.col("u"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _join(distinct: DataFrame, size: int, n: int, cosine: float, block: int) -> DataFrame:
    """(uid, n, root) of every pair of blocks, for vectors of one length."""
    spark = distinct.sparkSession
    wanted = min(MAX_CELLS, -(-n // block))
    sample = unit(distinct.orderBy("uid").limit(max(4096, SAMPLE * wanted)).select("v").toArrow().column("v").combine_chunks(), size)
    centers = cells(sample, wanted)
    sent = spark.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(unit(b.column(2), size), sent.value)
            k = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(k, pa.int32()), pa.array(d[np.arange(len(k)), k])], names=["uid", "m", "v", "cell", "far"])

    f = T.StructField
    fields = [f("uid", T.StringType()), f("m", T.LongType()), distinct.schema["v"]]
    placed = written(distinct.mapInArrow(place, T.StructType([*fields, f("cell", T.IntegerType()), f("far", T.DoubleType())])))
    radius, parts = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
    for cell, far, count in placed.groupBy("cell").agg(F.max("far"), F.count("*")).collect():  # MAX_CELLS rows at most
        radius[cell], parts[cell] = far, -(-count // block)
    first = np.append(0, np.cumsum(parts))
    reach = radius + chord(cosine) + SLACK
    plan = spark.sparkContext.broadcast((first, reach))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, reach = plan.value
        parts = np.diff(first)
        for whole in batches:
            for i in range(0, len(whole), 1024):
                b = whole.slice(i, 1024)
                cell = b.column(3).to_numpy()
                number = np.fromiter((int(u[:8].rjust(8, "0").replace("-", "0"), 16) for u in b.column(0).to_pylist()), np.int64, len(cell))
                own = first[cell] + number % np.maximum(parts[cell], 1)
                near = distances(unit(b.column(2), size), sent.value) <= reach
                near[np.arange(len(cell)), cell] = True
                row, to = np.nonzero(near & (parts > 0))
                n = parts[to]  # a cell's blocks share its ball
                row = np.repeat(row, n)
                other = np.repeat(first[to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pair = np.minimum(own[row], other) << 32 | np.maximum(own[row], other)
                part = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(own[row]), part.column(0), part.column(1), part.column(2)], names=["pair", "block", "uid", "m", "v"])

    def work(key, t):
        t = t.sort_by("uid").combine_chunks()  # any order of arrival gives the same
        pair = key[0].as_py()
        uid, block_ = t.column("uid"), t.column("block").to_numpy()
        low, high = pair >> 32, pair & 0xFFFFFFFF
        x = unit(t.column("v").combine_chunks(), size)
        links = join_blocks(x, t.column("m").to_numpy(), np.flatnonzero(block_ == low), np.flatnonzero(block_ == high), low == high, cosine)
        some = pa.array(np.flatnonzero(links.count))
        return pa.table({"uid": uid.take(some), "n": pa.array(links.count).take(some), "root": uid.take(pa.array(links.settle()).take(some))})

    dealt = placed.select("uid", "m", "v", "cell").mapInArrow(deal, T.StructType([f("pair", T.LongType()), f("block", T.LongType()), *fields]))
    return dealt.groupBy("pair").applyInArrow(work, "uid string, n bigint, root string")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
