"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A source's size is its words (a null source is a source of its own, ordered last). The mix's
total is shared among sources by weight; no target exceeds `most` times its source, and what
is cut off is shared again by weight among the others, in closed form: sources in order of
cap to weight, the first whose share fits its cap ends the capped ones.

The total is dealt in blocks of equal words. Sources get blocks by highest quotients
target / (2 k + 1); each source's blocks are dealt in the same way over its shards, by their
sizes. Shards are parts of a source of about SHARD_WORDS words, by a hash of id and text, so a
source with a third of all rows is many shards, and no task holds more than a few of them.
The rounded quotas already are the highest quotients but for a few seats; only candidates for
those are listed and ranked (at most about two for each claimant).

In a shard, documents stand in seeded order, end to end, as a ring of words. A quota goes round
the ring as often as it holds it whole; its other blocks are consecutive from a seeded block on.
Hence at most two documents of a shard are taken in part, and none more than `most` times.

Null and empty texts have size 0 and are never taken. Repeated rows are separate documents.
Very long texts are one document of their size. An empty table gives no rows. `mixed` tells rows
apart by a hash of all their columns, so rows that differ in any column stay apart and only rows
equal in all of them share their copies; it carries each row as one struct, so other columns
pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_WORDS = 1 << 14
SEED = 7
#: Sources up to which their table is sent to every executor (under 100 bytes each).
MAX_BROADCAST_SOURCES = 50_000


def row_hash(docs: DataFrame, seed: int):
    """Hash of all columns of a row; types that have no hash count as JSON."""
    odd = ("map", "variant")
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(t in f.dataType.simpleString() for t in odd) else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(F.lit(seed), *cols)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, mark: bool = False) -> DataFrame:
    """(id, source, size, key, mark): key is a seeded hash of id and text, mark one of the row if
    asked for, else 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        (row_hash(docs, seed) if mark else F.lit(0).cast("bigint")).alias("mark"),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
    )


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source throughout."""
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("pos") % len(weights) + 1).cast("double")
    s = sources.withColumn("pos", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), "pos")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("rank", F.row_number().over(by))
    s = s.withColumn("end", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("rank", "level"))).over(every))
    target = F.when(F.col("end").isNull() | (F.col("rank") < F.col("end.rank")), F.col("cap")).otherwise(F.col("end.level") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def sainte_lague(units: DataFrame, keys: list[str], claim: str, seats: int) -> DataFrame:
    """units with a column `seats`: `seats` in all, to the highest quotients claim / (2 k + 1);
    ties go by keys, which must be unique. A claim of zero gets none."""
    total, m = units.agg(F.sum(claim), F.count(F.when(F.col(claim) > 0, 1))).first()
    if not seats or not total or not m:
        return units.withColumn("seats", F.lit(0).cast("bigint"))
    quota = F.col(claim) * F.lit(seats / total)
    u = written(units.withColumn("_base", F.floor(quota + 0.5).cast("bigint")).withColumn("_reach", (F.ceil(quota * F.lit(m / (2 * seats))) + 2).cast("int")))
    missing = seats - u.agg(F.sum("_base")).first()[0]
    if not missing:
        return u.withColumnRenamed("_base", "seats").drop("_reach")
    if missing > 0:
        ks = F.sequence(F.lit(0), F.col("_reach") - 1)
        quotient = F.col(claim) / (2 * (F.col("_base") + F.col("_k")) + 1)
        order = [F.desc("_quotient"), *(F.asc_nulls_last(k) for k in keys)]
    else:
        ks = F.when(F.col("_base") > 0, F.sequence(F.lit(0), F.least(F.col("_reach").cast("bigint"), F.col("_base")).cast("int") - 1))
        quotient = F.col(claim) / (2 * (F.col("_base") - F.col("_k")) - 1)
        order = [F.asc("_quotient"), *(F.desc_nulls_first(k) for k in keys)]
    c = u.where(F.col(claim) > 0).select(*keys, "_base", claim, F.explode(ks).alias("_k")).select(*keys, quotient.alias("_quotient"))
    change = c.orderBy(*order).limit(abs(missing)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    on = [u[k].eqNullSafe(change[f"_{k}"]) for k in keys]
    step = F.coalesce(F.col("_n"), F.lit(0)) * (1 if missing > 0 else -1)
    return u.join(change, on, "left").select(*units.columns, (F.col("_base") + step).cast("bigint").alias("seats"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, mark: bool = False) -> DataFrame:
    """(id, source, size, key, mark, source_size, target, taken) for each row of docs."""
    sized = written(sizes(docs, id_col, text_col, source_col, seed, mark))
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    blocks = int(total / block + 0.5)
    dealt = written(sainte_lague(sources, ["source"], "target", blocks).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint")).withColumnRenamed("source", "_source"))
    small = F.broadcast if n <= MAX_BROADCAST_SOURCES else (lambda x: x)
    placed = sized.join(small(dealt), F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod("key", "shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("of"), F.first("source_size").alias("whole"))
    shards = written(shards.withColumn("claim", F.coalesce(F.try_divide(F.col("of") * F.col("words"), F.col("whole")), F.lit(0.0))))
    quotas = sainte_lague(shards, ["source", "shard"], "claim", blocks)
    words = F.least(F.col("seats") * block, F.col("words") * most)
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.ceil(F.col("words") / block)) * block
    quotas = quotas.where("words > 0").select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "words",
        F.expr(f"least(seats * {block}, words * {most}) div words").alias("rounds"), (words % F.col("words")).alias("rest"), start.alias("start"),
    )
    ring = Window.partitionBy("source", "shard").orderBy("key", F.asc_nulls_last("id"), "size", "mark")
    run = placed.select("id", "source", "size", "key", "mark", "source_size", "target", "shard").withColumn("at", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    j = run.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")

    def within(lo: str, hi: str) -> str:
        return f"greatest(0L, least(at + size, {hi}) - greatest(at, {lo}))"

    taken = F.expr(f"coalesce(rounds * size + {within('start', 'least(start + rest, words)')} + {within('0L', 'start + rest - words')}, 0L)")
    return j.select("id", "source", "size", "key", "mark", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """docs as the mix takes them, in whole documents: each row as often as its taken words go
    into its size, rounded. Rows equal in all columns count as one with their copies summed."""
    m = mix(docs, id_col, text_col, source_col, seed=seed, mark=True, **options)
    copies = m.where("size > 0").groupBy("id", "key", "mark").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("n")).where("n > 0")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("_key"), row_hash(docs, seed).alias("_mark"))
    j = rows.join(copies, (F.col("_mark") == F.col("mark")) & (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id"))).dropDuplicates(["_mark", "_key", "_id"])
    return j.select("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy")).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")
