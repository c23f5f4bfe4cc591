"""Comparing snapshots and logging changes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .identity import canonical_row


def diff(old: DataFrame, new: DataFrame, key: str = "gid") -> DataFrame:
    """(key, action): INSERT, DELETE or UPDATE, in one full outer join on the key of row hashes."""
    fields = [c for c in old.columns if c != key]
    a = old.select(key, F.sha2(canonical_row(old, fields), 256).alias("_a"))
    b = new.select(key, F.sha2(canonical_row(new, fields), 256).alias("_b"))
    action = F.when(F.col("_a").isNull(), "INSERT").when(F.col("_b").isNull(), "DELETE").when(F.col("_a") != F.col("_b"), "UPDATE")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action IS NOT NULL")


def field_diff(old: DataFrame, new: DataFrame, key: str = "gid") -> DataFrame:
    """(key, field, before, after) of rows on both sides whose field changed."""

    def long(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != key]
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields))
        return df.select(key, F.inline(pairs))

    return long(old, "before").join(long(new, "after"), [key, "field"]).where("NOT (before <=> after)")


def changelog_lines(d: DataFrame, key: str = "gid", table: str = "entries") -> DataFrame:
    line = F.when(F.col("action") == "INSERT", F.concat(F.lit(f"INSERT INTO {table}(gid) VALUES ("), F.col(key).cast("string"), F.lit(");")))
    line = line.when(F.col("action") == "DELETE", F.concat(F.lit(f"DELETE FROM {table} WHERE gid = "), F.col(key).cast("string"), F.lit(";")))
    line = line.otherwise(F.concat(F.lit(f"UPDATE {table} SET touched = 1 WHERE gid = "), F.col(key).cast("string"), F.lit(";")))
    return d.select(key, line.alias("line"))


def graph_lines(edges: DataFrame) -> DataFrame:
    s, a = F.col("student").cast("string"), F.col("advisor").cast("string")
    return edges.select("student", "advisor", F.concat(F.lit("MERGE (:Person {id: "), s, F.lit("})-[:ADVISED_BY]->(:Person {id: "), a, F.lit("})")).alias("line"))


def dot(edges: DataFrame) -> DataFrame:
    """One row: a Graphviz text, lines in order. For drawings, that is small graphs."""
    lines = edges.select(F.concat(F.lit('  "'), F.col("student").cast("string"), F.lit('" -> "'), F.col("advisor").cast("string"), F.lit('";')).alias("l"))
    return lines.agg(F.concat(F.lit("digraph lineage {\n  rankdir=BT;\n"), F.array_join(F.array_sort(F.collect_list("l")), "\n"), F.lit("\n}\n")).alias("dot"))


def chain(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Hash-chained log: each row's hash covers the one before. Sequential by definition, so it
    runs per log; `verify` needs no replay."""
    fields = sorted(columns)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        last, before, now = "", [], []
        for r in p[fields].itertuples(index=False):
            before.append(last)
            last = hashlib.sha256((last + json.dumps([str(x) for x in r])).encode()).hexdigest()
            now.append(last)
        return p.assign(prev_hash=before, hash=now)[[*p.columns, "prev_hash", "hash"]]

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.groupBy("log").applyInPandas(run, f"{schema}, prev_hash string, hash string")


def verify(log: DataFrame, order: str) -> DataFrame:
    """(log, ok): whether every row points at the hash of the one before."""
    w = Window.partitionBy("log").orderBy(order)
    good = F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit(""))
    return log.withColumn("_g", good).groupBy("log").agg(F.every("_g").alias("ok"))


def retain(runs: DataFrame, keep: int, days: int, today) -> DataFrame:
    """Runs to delete: older than `days`, or beyond the `keep` newest."""
    w = Window.orderBy(F.desc("made"))
    return runs.withColumn("_r", F.row_number().over(w)).where((F.col("_r") > keep) | (F.datediff(today, F.col("made")) > days)).drop("_r")


def evict(cache: DataFrame, needed: int) -> DataFrame:
    """Cache rows to drop, oldest and least hit first, until `needed` bytes are free."""
    score = F.unix_seconds("ts") + F.col("hits") * 3600
    return running(cache.withColumn("_score", score), "_score", ["id"], "size", 3600).where(F.col("_before") < needed).drop("_before", "_score")


def running(df: DataFrame, by: str, ties: list[str], value: str, step: int) -> DataFrame:
    """df with `_before`: the sum of value over all rows that stand earlier by (by, ties). Sums of
    stretches of `step` are added up first (one row each), then rows within their stretch, so no
    task sees more than a stretch."""
    d = df.withColumn("_stretch", F.floor(F.col(by) / step))
    sums = d.groupBy("_stretch").agg(F.sum(value).alias("_s"))
    w = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(F.col("_stretch").alias("_k"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_head"))
    inside = Window.partitionBy("_stretch").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, -1)
    j = d.join(heads, F.col("_stretch") == F.col("_k")).withColumn("_before", F.col("_head") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return j.drop("_stretch", "_k", "_head")
