"""Operators between batches and over samples of a batch: registry of ids, splits, evaluation within
groups, close fingerprints, and limits of requests by slots and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register(batch: DataFrame, known: DataFrame, gid: str = "gid") -> DataFrame:
    """batch with `unique_gid`: an id that the registry holds gets the next suffix --n that it does
    not hold. The registry is aggregated by its base id first, so one row meets each id."""
    base = F.regexp_replace("gid", "--[0-9]+$", "")
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("gid", "--([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    taken = known.select(F.col(gid).alias("gid")).distinct().select(base.alias("_base"), n.alias("_k")).groupBy("_base").agg(F.collect_set("_k").alias("_ks"))
    j = batch.join(taken, F.col(gid) == F.col("_base"), "left")
    clash = F.array_contains("_ks", 0)
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_ks") + 1), "_ks"))
    return j.withColumn("unique_gid", F.when(clash, F.concat(gid, F.lit("--"), free.cast("string"))).otherwise(F.col(gid))).drop("_base", "_ks")


def resuffix(rows: DataFrame, gid: str = "gid", order: str = "ord") -> DataFrame:
    """rows with `unique_gid`: ids that rows bring along; the first keeps it, the k-th further one
    gets the k-th suffix that no row brings along itself."""
    w = Window.partitionBy(gid).orderBy(order)
    base = F.regexp_replace(gid, "--[0-9]+$", "")
    own = rows.where(F.col(gid).rlike("--[0-9]+$")).select(base.alias("_b"), F.regexp_extract(gid, "--([0-9]+)$", 1).cast("int").alias("_k")).distinct()
    taken = own.groupBy("_b").agg(F.collect_set("_k").alias("_ks"))
    j = rows.withColumn("_n", F.row_number().over(w) - 1).join(taken, F.col(gid) == F.col("_b"), "left")
    ks = F.coalesce("_ks", F.array().cast("array<int>"))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("_n") + F.size(ks) + 1), ks))
    named = F.concat(gid, F.lit("--"), F.element_at(free, F.greatest(F.col("_n"), F.lit(1))).cast("string"))
    return j.withColumn("unique_gid", F.when(F.col("_n") > 0, named).otherwise(F.col(gid))).drop("_n", "_b", "_ks")


def split(df: DataFrame, group: str, name: str, share: float = 0.2) -> DataFrame:
    """df with `part`, test or train: in each group the names with the smallest hashes, share of
    them rounded and one at least, are the test part; the same for any order of rows."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count_distinct(name).alias("_n"))
    ranked = df.select(F.col(group).alias("_g"), F.col(name).alias("_w")).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(F.md5("_w"), "_w")))
    marks = ranked.join(sizes, "_g").select("_g", "_w", F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5)), "test").otherwise("train").alias("part"))
    return df.join(marks, (F.col(group) == F.col("_g")) & (F.col(name) == F.col("_w"))).drop("_g", "_w")


def agreeing(df: DataFrame, words: str, label: str, endings: dict[str, str], groups: dict[str, str]) -> DataFrame:
    """Rows of which no word has an ending that speaks for another group than the label's."""

    def against(w: Column) -> Column:
        g = F.try_element_at(F.create_map(*(F.lit(x) for kv in groups.items() for x in kv)), F.col(label))
        tests = [F.coalesce(w.endswith(e) & (F.length(w) > len(e) + 1) & (g != groups[r]), F.lit(False)) for e, r in endings.items() if r in groups]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return df.where(~F.exists(words, against))


def within_anchor(df: DataFrame, predictions: str, truth: str) -> DataFrame:
    """(family, n, right, top): rows by the first letter of the truth; right: the best prediction of
    that letter is the truth; top: the best of all is. predictions: array of regions, best first."""
    family = F.substr(truth, F.lit(1), F.lit(1))
    inside = F.filter(predictions, lambda p: F.startswith(p, family))
    g = df.where(F.size(inside) > 0).groupBy(family.alias("family"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.try_element_at(inside, F.lit(1)) == F.col(truth)).alias("right"), F.count_if(F.try_element_at(predictions, F.lit(1)) == F.col(truth)).alias("top"))


# ---------------------------------------------------------------- close fingerprints
def same_places(a: Column, b: Column) -> Column:
    """Characters that agree place by place, over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    equal = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda t, x: t + x)
    return F.when(a == b, 1.0).when(longest == 0, 0.0).otherwise(equal / longest)


def close_fingerprints(df: DataFrame, fingerprint: str, order: str, least: float = 0.85) -> DataFrame:
    """(fingerprint, first, other, similarity): of each distinct fingerprint the most similar one
    that came first in order, if it agrees in `least` of the places. Candidates share a stretch of
    two characters at its place: of n characters, at most n (1 - least) / least places of a partner
    differ, each in one stretch, so that one of the first stretches beyond that number is equal."""
    d = df.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(order).alias("first"))
    n = F.length("fp")
    last = F.least(F.floor(n * ((1 - least) / least)), F.greatest(F.floor(n / 2) - 1, F.lit(0))).cast("int")
    keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr("fp", i * 2 + 1, F.lit(2))))
    k = d.select("fp", "first", F.explode(keys).alias("key"))
    pairs = k.alias("a").join(k.alias("b"), "key").where("b.first < a.first").select(F.col("a.fp").alias("fp"), F.col("a.first").alias("first"), F.col("b.fp").alias("other"), F.col("b.first").alias("_o")).distinct()
    s = pairs.withColumn("similarity", F.round(same_places(F.col("fp"), F.col("other")), 9)).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("other", "similarity"), F.struct("similarity", -F.col("_o")))
    return s.groupBy("fp", "first").agg(best.alias("m")).select("fp", "first", "m.other", "m.similarity")


# ---------------------------------------------------------------- requests
def slots(df: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """(key, slot, requests, denied) of fixed slots of time: what goes beyond the limit is denied."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    return df.groupBy(key, slot.alias("slot")).agg(F.count("*").alias("requests")).withColumn("denied", F.greatest(F.col("requests") - limit, F.lit(0)))


def token_bucket(df: DataFrame, key: str, burst: int, per_minute: int, per_hour: int, cooldown: int) -> DataFrame:
    """(key, event_id, reason): requests in order, denied (reason burst, minute, hour or cooldown) or
    allowed (null). A bucket of `burst` tokens fills by whole tokens, burst a minute; a denial
    starts a cooldown. A key's state is its tokens and its allowed times of an hour."""
    import pandas as pd

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts", "event_id"])
        tokens, filled, until, allowed, out = burst, None, None, [], []
        for t in p["ts"].astype("int64") / (1_000_000 if str(p["ts"].dtype).startswith("datetime64[us") else 1_000_000_000):
            filled = t if filled is None else filled
            if until is not None and t < until:
                out.append("cooldown")
                continue
            until = None
            allowed = [x for x in allowed if x > t - 3600]
            more = int((t - filled) * burst / 60)
            if more > 0:
                tokens, filled = min(burst, tokens + more), t
            minute = sum(x > t - 60 for x in allowed)
            reason = "burst" if tokens <= 0 else "minute" if minute >= per_minute else "hour" if len(allowed) >= per_hour else None
            if reason:
                until = t + cooldown
            else:
                tokens -= 1
                allowed.append(t)
            out.append(reason)
        return pd.DataFrame({key: p[key], "event_id": p["event_id"], "reason": out})

    return df.select(key, "event_id", "ts").groupBy(key).applyInPandas(replay, f"{key} bigint, event_id bigint, reason string")


# ---------------------------------------------------------------- metrics
def insights(df: DataFrame, top: int = 10, high: float = 3.0) -> DataFrame:
    """(metric, value, change, severity) of the metrics whose newest value lies farthest from their
    mean, in deviations."""
    newest = F.max_by("value", F.struct("ts", "event_id"))
    g = df.groupBy("metric").agg(newest.alias("value"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    change = F.round((F.col("value") - F.col("_m")) / F.col("_s"), 6)
    g = g.select("metric", "value", change.alias("change"), F.when(F.abs(change) > high, "high").when(F.abs(change) > 1, "medium").otherwise("low").alias("severity"))
    return g.orderBy(F.desc(F.abs("change")), "metric").limit(top)


def short_trend(df: DataFrame, span: int = 5, flat: float = 0.1) -> DataFrame:
    """(metric, slope, trend) of the last `span` points."""
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id"))
    d = df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= span).withColumn("_x", (-F.col("_back")).cast("double"))
    s = d.groupBy("metric").agg(F.round(F.regr_slope("value", "_x"), 6).alias("slope"))
    return s.withColumn("trend", F.when(F.abs("slope") < flat, "stable").when(F.col("slope") > 0, "rising").otherwise("falling"))


def capacity(df: DataFrame, span: int = 10, limits: dict[str, float] | None = None, default: float = 80.0) -> DataFrame:
    """(metric, mean, limit, over): mean of the last `span` points against the metric's limit."""
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("event_id"))
    d = df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= span)
    m = F.create_map(*(F.lit(x) for kv in (limits or {"": default}).items() for x in kv))
    g = d.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean")).withColumn("limit", F.coalesce(F.try_element_at(m, F.col("metric")), F.lit(default)))
    return g.withColumn("over", F.col("mean") > F.col("limit"))
