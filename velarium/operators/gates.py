"""Gates over a batch: every measure is one conditional aggregate, and a gate a comparison of one
row; running gates keep their sums in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the eight gates in three modes; duplicates and the difference of reruns
#: must be none, memory stays under six gigabytes.
BOUNDS = {
    "quick": {"external": 1.0, "roundtrip": 0.97, "conflicts": 2.0, "coherence": 0.85, "minutes": 35.0},
    "full": {"external": 0.5, "roundtrip": 0.97, "conflicts": 1.0, "coherence": 0.92, "minutes": 70.0},
    "extreme": {"external": 0.0, "roundtrip": 0.99, "conflicts": 0.0, "coherence": 0.97, "minutes": 120.0},
}
COMMON = {"duplicates": 0.0, "memory": 6.0, "difference": 0.0}
ORDER = ("duplicates", "external", "roundtrip", "conflicts", "coherence", "memory", "minutes", "difference")
AT_LEAST = ("roundtrip", "coherence", "idempotency", "coverage")
#: Bounds of the strict gates; production halves the errors that pass.
STRICT = {"duplicates": 0.001, "errors": 0.01, "coverage": 0.2, "coherence": 0.3, "minutes": 35.0, "collisions": 0.02, "idempotency": 1.0}
PRODUCTION = {"errors": 0.005}
#: Minutes for a million rows, and share of good rows, that a stream must keep.
MINUTES, SUCCESS = 35.0, 0.95


def _rows(measures: DataFrame, bounds: dict[str, float], order) -> DataFrame:
    """(gate, value, bound, ok) of the measures that are not null."""

    def one(gate: str) -> Column:
        c = F.col(gate).cast("double")
        ok = c >= bounds[gate] if gate in AT_LEAST else c <= bounds[gate]
        return F.when(c.isNotNull(), F.struct(F.lit(gate).alias("gate"), F.round(c, 6).alias("value"), F.lit(float(bounds[gate])).alias("bound"), ok.alias("ok")))

    return measures.select(F.inline(F.array_compact(F.array(*(one(g) for g in order)))))


def eight(measures: DataFrame, mode: str = "quick") -> DataFrame:
    """The eight gates from one row of measures: duplicates, external (percent), roundtrip, conflicts
    (percent), coherence, memory (GB), minutes (for a million rows), difference (bytes)."""
    return _rows(measures, COMMON | BOUNDS[mode], ORDER)


def strict(measures: DataFrame, production: bool = False) -> DataFrame:
    """The seven strict gates from one row of rates; a null rate is not judged."""
    bounds = STRICT | (PRODUCTION if production else {})
    return _rows(measures, bounds, STRICT)


def decided(gate_rows: DataFrame) -> DataFrame:
    """(passed, score, failed): whether all gates hold, the mean of their values, and those that
    fail, in order."""
    return gate_rows.agg(F.every("ok").alias("passed"), F.round(F.avg("value"), 6).alias("score"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("gate")))).alias("failed"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(duplicates, rate): keys that occur more than once, and their share of the filled rows."""
    g = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))
    d = F.count_if(F.col("n") > 1)
    return g.agg(d.alias("duplicates"), F.coalesce(d / F.sum("n"), F.lit(0.0)).alias("rate"))


def fast(df: DataFrame, gid: str, external: str, minutes: float | None = None, score: float | None = None, most_external: float = 0.5, least_score: float = 0.85) -> DataFrame:
    """One row (ok, repeated, external): ids that repeat in the batch (rows beyond the first),
    percent of external ids that do, and whether these, the speed and the score hold. The whole
    batch is counted: partial aggregation makes sampling needless."""

    def extra(c: str, name: str) -> DataFrame:
        g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_of"))

    j = extra(gid, "repeated").join(F.broadcast(extra(external, "x")))  # one row each
    percent = F.coalesce(100.0 * F.col("x") / F.nullif("x_of", F.lit(0)), F.lit(0.0))
    rest = (minutes is None or minutes <= MINUTES) and (score is None or score >= least_score)
    return j.select(((F.col("repeated") == 0) & (percent <= most_external) & F.lit(rest)).alias("ok"), "repeated", F.round(percent, 6).alias("external"))


def running(df: DataFrame, gid: str, status: str) -> DataFrame:
    """Sums of a running gate: seen, good and failed rows and distinct ids; on a stream, the state
    of a complete aggregation (distinct ids are then a sketch's estimate)."""
    unique = F.approx_count_distinct(gid) if df.isStreaming else F.count_distinct(gid)
    bad = F.coalesce(F.col(status) == "processing_error", F.lit(False))
    return df.agg(F.count("*").alias("seen"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), unique.alias("ids"))


def decision(sums: DataFrame, rows_per_second: float) -> DataFrame:
    """sums with minutes for a million rows, the share of good rows, and whether both hold."""
    if rows_per_second <= 0:
        return sums.withColumn("minutes", F.lit(None).cast("double")).withColumn("rate", F.lit(None).cast("double")).withColumn("ok", F.lit(False))
    rate = F.col("good") / F.greatest(F.col("seen"), F.lit(1))
    minutes = 1_000_000 / rows_per_second / 60
    return sums.withColumn("minutes", F.lit(round(minutes, 6))).withColumn("rate", F.round(rate, 6)).withColumn("ok", (rate >= SUCCESS) & F.lit(minutes <= MINUTES))


def blended(betweenness: Column, authority: Column, weight: float = 0.6, other: float = 0.4) -> Column:
    """Weighted mean of two scores, in 0 to 1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (weight * betweenness + other * authority) / (weight + other))), 6)


def same_rows(a: DataFrame, b: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(removed, added, ok): rows of either side that the other lacks, repeats counted, without the
    columns that belong to a run."""
    cols = [c for c in a.columns if c not in skip]
    x = a.select(*cols).withColumn("_n", F.lit(1)).unionAll(b.select(*cols).withColumn("_n", F.lit(-1)))
    g = x.groupBy(*cols).agg(F.sum("_n").alias("n"))
    removed, added = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0))
    return g.agg(removed.alias("removed"), added.alias("added")).withColumn("ok", F.expr("removed = 0 AND added = 0"))
