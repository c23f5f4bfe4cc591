"""Minting, suffixing and checking of ids over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def mint(df: DataFrame, name: str = "native", birth: str = "birth", death: str | None = None) -> DataFrame:
    """df with a column gid."""
    return df.withColumn("gid", ids.global_id(F.col(name), F.col(birth), F.col(death) if death else F.lit(None).cast("int")))


def suffix(df: DataFrame, key: str = "gid", order: str = "ord", out: str = "unique_gid") -> DataFrame:
    """The k-th repeat of an id in input order becomes id--k. Repeats are numbered in one window
    over the id; a proposed id that the batch already holds is passed over, which a second
    window settles by counting the held numbers below it."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = df.withColumn("_k", F.row_number().over(w) - 1)
    held = df.select(F.regexp_extract(key, "^(.*?)--([0-9]+)$", 1).alias("_base"), F.regexp_extract(key, "^(.*?)--([0-9]+)$", 2).cast("int").alias("_n")).where("_base <> ''").distinct()
    taken = held.groupBy("_base").agg(F.array_sort(F.collect_set("_n")).alias("_taken"))
    j = numbered.join(taken, F.col(key) == F.col("_base"), "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_k"), lambda k, n: F.when(n <= k, k + 1).otherwise(k))
    return j.withColumn(out, F.when(F.col("_k") == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("--"), free.cast("string")))).drop("_k", "_base", "_taken")


def repoint(df: DataFrame, gid: str = "gid", advisors: str = "advisors", order: str = "ord") -> DataFrame:
    """Ids made unique, and every reference to a repeated id led to its last holder."""
    s = suffix(df, gid, order)
    last = Window.partitionBy(gid).orderBy(F.desc(order))
    moved = s.withColumn("_r", F.row_number().over(last)).where(f"_r = 1 AND {gid} <> unique_gid").select(F.col(gid).alias("_from"), F.col("unique_gid").alias("_to"))
    refs = s.select(order, F.posexplode_outer(advisors).alias("_p", "_a")).join(moved, F.col("_a") == F.col("_from"), "left")
    back = refs.where("_a IS NOT NULL").groupBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_to", "_a").alias("a")))), lambda x: x["a"]).alias("_advisors"))
    return s.join(back, order, "left").drop(advisors).withColumnRenamed("_advisors", advisors)


def canonical_row(df: DataFrame, columns: list[str] | None = None):
    """One delimited string for a row: columns by name, doubles to six places, null empty."""
    kinds = dict(df.dtypes)
    parts = []
    for c in sorted(columns or df.columns):
        v = F.when(F.isnan(c), 0.0).otherwise(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        v = F.format_string("%.6f", v.cast("double")) if kinds[c] in ("double", "float") else v.cast("string")
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit(""))))
    return F.concat_ws("|", *parts)


def batch_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-free hash of a batch: rows, and the exact sum of 64-bit hashes of canonical rows."""
    return df.select(F.xxhash64(canonical_row(df, columns)).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("hash"))
