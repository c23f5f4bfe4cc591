"""Quality gates, validation rules and evaluation of predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the three modes.
MODES = {
    "quick": {"duplicates": 0.5, "external": 1.0, "coverage": 60.0, "roundtrip": 0.90},
    "full": {"duplicates": 0.1, "external": 0.5, "coverage": 80.0, "roundtrip": 0.95},
    "extreme": {"duplicates": 0.0, "external": 0.0, "coverage": 90.0, "roundtrip": 0.97},
}


def gates(measures: DataFrame, mode: str) -> DataFrame:
    """(gate, value, bound, ok) from one row of measures; the first two must not exceed theirs."""
    rows = []
    for gate, bound in MODES[mode].items():
        at_most = gate in ("duplicates", "external")
        ok = F.col(gate) <= bound if at_most else F.col(gate) >= bound
        rows.append(F.struct(F.lit(gate).alias("gate"), F.round(F.col(gate).cast("double"), 6).alias("value"), F.lit(bound).alias("bound"), ok.alias("ok")))
    return measures.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def blocked(gate_rows: DataFrame) -> None:
    """Raise if any gate fails. There are as many rows as gates."""
    bad = [r["gate"] for r in gate_rows.where("NOT ok").collect()]
    if bad:
        raise ValueError(f"quality gates failed: {', '.join(bad)}")


def completeness(required: list[Column], recommended: list[Column]) -> Column:
    """100 less the share of missing fields, recommended ones by half; truncated."""
    missing = sum((F.when(~c, 1.0).otherwise(0.0) for c in required), F.lit(0.0)) + sum((F.when(~c, 0.5).otherwise(0.0) for c in recommended), F.lit(0.0))
    return (100 * (1 - missing / (len(required) + len(recommended)))).cast("int")


def rules(checks: dict[str, Column]) -> Column:
    """Names of the checks whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def filled(c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & (v.cast("string") != "") & (v.cast("string") != "0")


def temporal_checks(birth: Column, death: Column, today: int) -> dict[str, Column]:
    span = death - birth
    return {
        "born_in_future": birth > today,
        "very_early": birth < 0,
        "dies_before_birth": span < 0,
        "short_life": (span >= 0) & (span < 20),
        "long_life": span > 110,
    }


def calibration(pred: DataFrame, conf: str = "conf", y: str = "y") -> DataFrame:
    """(bucket, n, mean_conf, mean_y) over ten equal bins."""
    b = F.least(F.floor(F.col(conf) * 10), F.lit(9)).cast("int")
    return pred.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(y).alias("mean_y"))


def ece_brier(pred: DataFrame, conf: str = "conf", y: str = "y") -> DataFrame:
    total = pred.agg(F.count("*").alias("n"), F.avg((F.col(conf) - F.col(y)) ** 2).alias("brier"))
    e = calibration(pred, conf, y).agg(F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("mean_y"))).alias("w"))
    return total.join(F.broadcast(e)).select(F.col("n"), F.round(F.col("w") / F.col("n"), 9).alias("ece"), F.round("brier", 9).alias("brier"))


def isotonic(pred: DataFrame, conf: str = "conf", y: str = "y", digits: int = 4) -> DataFrame:
    """(threshold, p): the step function of pooled adjacent violators. Predictions are summed by
    rounded confidence first, so the ordered pass sees 10 ** digits + 1 points at most, whatever
    the rows."""
    points = pred.groupBy(F.round(conf, digits).alias("x")).agg(F.sum(y).alias("s"), F.count("*").alias("n"))

    def pool(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("x")
        stack: list[list[float]] = []
        for x, s, n in zip(p["x"], p["s"], p["n"]):
            stack.append([x, s, n])
            while len(stack) > 1 and stack[-2][1] / stack[-2][2] >= stack[-1][1] / stack[-1][2]:
                x1, s1, n1 = stack.pop()
                stack[-1] = [x1, stack[-1][1] + s1, stack[-1][2] + n1]
        return pd.DataFrame({"threshold": [a for a, _, _ in stack], "p": [b / c for _, b, c in stack]})

    return points.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(pool, "threshold double, p double")


def risk_coverage(pred: DataFrame, steps: int = 20, conf: str = "conf", y: str = "y") -> DataFrame:
    """(threshold, coverage, precision) for thresholds k / steps: predictions fall into bins once,
    and points are running sums over the bins."""
    b = pred.groupBy(F.floor(F.col(conf) * steps).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    w = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return b.select(
        F.round(F.col("b") / steps, 6).alias("threshold"),
        F.round(F.sum("n").over(w) / F.sum("n").over(total), 9).alias("coverage"),
        F.round(F.sum("s").over(w) / F.sum("n").over(w), 9).alias("precision"),
    )


def skyline(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points that no other one reaches on both axes and beats on one: a running maximum instead
    of a comparison of all pairs."""
    w = Window.orderBy(F.desc(x), F.desc(y))
    best = F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tie = F.max(y).over(Window.partitionBy(x))
    top = points.withColumn("_tie", tie).where(f"{y} = _tie").dropDuplicates([x, y])
    return top.withColumn("_best", best).where(f"_best IS NULL OR {y} > _best").drop("_best", "_tie")


def median_alerts(recent: DataFrame, baseline: DataFrame, key: str, value: str, allowed: float) -> DataFrame:
    """(key, baseline, recent, change, alert): medians per key, alert if they differ by more than
    the allowed share."""
    m = lambda d, n: d.groupBy(key).agg(F.percentile(value, 0.5).alias(n), F.count("*").alias(f"n_{n}"))
    j = m(baseline, "base").join(m(recent, "recent"), key)
    change = (F.col("recent") - F.col("base")) / F.col("base")
    return j.select(key, F.round("base", 6).alias("base"), F.round("recent", 6).alias("recent"), F.round(change, 6).alias("change"), ((F.abs(change) > allowed) & (F.col("n_recent") >= 3)).alias("alert"))


def fold_of(key: Column, k: int) -> Column:
    """Fold of a row, by its hash."""
    return (F.conv(F.substr(F.md5(key.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % k).cast("int")
