"""Rolling analytics over metric events. A metric's points are ordered by (ts, event_id); windows
are by metric."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


#: Rows of a metric that one task works on, and seconds whose rows are numbered at once.
CHUNK, STRETCH = 50_000, 86_400


def numbered(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """df with `i`, the place of each row in its metric from 1 on: rows are counted by stretch of
    time, the counts (one row each) added up, and rows numbered inside their stretch."""
    d = df.withColumn("_s", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / stretch))
    counts = d.groupBy("metric", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("metric").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(F.col("metric").alias("_m"), F.col("_s").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head"))
    j = d.join(heads, F.col("metric").eqNullSafe(F.col("_m")) & (F.col("_s") == F.col("_k")))
    return j.withColumn("i", F.col("_head") + F.row_number().over(Window.partitionBy("metric", "_s").orderBy(*ORDER))).drop("_s", "_m", "_k", "_head")


def chunked(df: DataFrame, frame: int, chunk: int = CHUNK) -> DataFrame:
    """Numbered rows in chunks of each metric (`_chunk`), with the last frame - 1 rows of the chunk
    before repeated in front (`_halo`), so that a frame never leaves its chunk."""
    d = numbered(df).withColumn("_own", F.floor((F.col("i") - 1) / chunk))
    late = (F.col("i") - 1) % chunk >= chunk - (frame - 1)
    both = F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return d.withColumn("_chunk", F.explode(both)).withColumn("_halo", F.col("_chunk") > F.col("_own")).drop("_own")


def _w(frame: int):
    return Window.partitionBy("metric", "_chunk").orderBy("i").rowsBetween(1 - frame, 0)


def anomalies(df: DataFrame, frame: int = 100, least: int = 10, limit: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """Points more than `limit` sample deviations from the mean of their last `frame`, themselves
    included, from `least` points on."""
    w = _w(frame)
    d = chunked(df, frame, chunk).withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg("value").over(w)).withColumn("sd", F.stddev_samp("value").over(w))
    z = F.abs(F.col("value") - F.col("mean")) / F.col("sd")
    return d.withColumn("z", z).where(~F.col("_halo") & (F.col("n") >= least) & (F.col("sd") > 0) & (F.col("z") > limit)).drop("_chunk", "_halo", "i")


def features(df: DataFrame, frame: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Hour, weekday (Monday 0), mean and slope of the last `frame` points."""
    w = _w(frame)
    d = chunked(df, frame, chunk).withColumn("i", F.col("i").cast("double"))
    mean, slope = F.round(F.avg("value").over(w), 6), F.round(F.regr_slope("value", "i").over(w), 6)
    d = d.withColumn("mean", mean).withColumn("slope", slope).where("NOT _halo")
    return d.select("metric", "event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "mean", "slope")


def latest(df: DataFrame, n: int) -> DataFrame:
    """The last n points of each metric, numbered from the newest (1)."""
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def trend(df: DataFrame, span: int = 20, percent: float = 20.0) -> DataFrame:
    """Means of the last `span` points and of those before; a change beyond percent is a trend."""
    d = latest(df, 2 * span)
    g = d.groupBy("metric").agg(F.avg(F.when(F.col("back") <= span, F.col("value"))).alias("now"), F.avg(F.when(F.col("back") > span, F.col("value"))).alias("before"))
    change = 100 * (F.col("now") - F.col("before")) / F.abs("before")
    return g.select("metric", F.round("now", 6).alias("now"), F.round("before", 6).alias("before"), F.round(change, 6).alias("percent"), F.when(change > percent, "rising").when(change < -percent, "falling").otherwise("stable").alias("trend"))


def p95_change(df: DataFrame, recent: int = 24, lo: int = 50, hi: int = 100, factor: float = 1.5) -> DataFrame:
    """Nearest-rank 95th percentile of the last points against that of an older stretch."""
    d = latest(df, hi)

    def p95(c):
        a = F.array_sort(F.collect_list(F.when(c, F.col("value"))))
        return F.try_element_at(a, (F.floor(0.95 * F.size(a)) + 1).cast("int"))

    g = d.groupBy("metric").agg(p95(F.col("back") <= recent).alias("now"), p95(F.col("back") > lo).alias("before"))
    return g.withColumn("worse", F.col("now") > factor * F.col("before"))


def forecast(df: DataFrame, span: int = 20, minutes: int = 30, step: int = 5) -> DataFrame:
    """Least-squares line over the last points, read every `step` minutes ahead."""
    d = latest(df, span).withColumn("x", (F.lit(span) - F.col("back")).cast("double"))
    g = d.groupBy("metric").agg(F.regr_slope("value", "x").alias("a"), F.regr_intercept("value", "x").alias("b"))
    ahead = g.select("metric", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(minutes // step))).alias("k"))
    return ahead.select("metric", (F.col("k") * step).alias("minutes"), F.round(F.col("b") + F.col("a") * (span - 1 + F.col("k")), 6).alias("value"))


def summary(df: DataFrame) -> DataFrame:
    newest = F.struct("ts", "event_id")
    return df.groupBy("metric").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.min_by("value", newest).alias("first_value"), F.max_by("value", newest).alias("last_value"),
    )


def alerts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Points that a rule (metric, op, threshold) matches; eq and ne within 1e-6."""
    gap = F.col("value") - F.col("threshold")
    hit = F.when(F.col("op") == "gt", gap > 0).when(F.col("op") == "lt", gap < 0).when(F.col("op") == "eq", F.abs(gap) < 1e-6).otherwise(F.abs(gap) >= 1e-6)
    return df.join(rules, "metric").where(hit)


def rate_limit(df: DataFrame, limit: int, seconds: int = 60, key: str = "client") -> DataFrame:
    """(key, event_id, allowed): at most `limit` allowed requests in any `seconds`; denied ones
    are not counted, so each key is replayed in order. A key's state is its last `limit` times."""

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts", "event_id"])
        held: list = []
        out = []
        for t in p["ts"]:
            while held and (t - held[0]).total_seconds() >= seconds:
                held.pop(0)
            out.append(len(held) < limit)
            if out[-1]:
                held.append(t)
        return pd.DataFrame({key: p[key], "event_id": p["event_id"], "allowed": out})

    return df.select(key, "event_id", "ts").groupBy(key).applyInPandas(replay, f"{key} bigint, event_id bigint, allowed boolean")


def sessions(df: DataFrame, gap_minutes: int, key: str = "client") -> DataFrame:
    """(key, session, start, end, n): runs of events less than the gap apart."""
    w = Window.partitionBy(key).orderBy(*ORDER)
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) >= gap_minutes * 60_000_000, F.lit(True))
    d = df.withColumn("_n", new.cast("int")).withColumn("session", F.sum("_n").over(w))
    return d.groupBy(key, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the latest value of right at or before its time: both sides in one sorted pass
    per key instead of a range join."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(key, time, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b, allowMissingColumns=True)
    return u.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")
