"""Queries: gates over a batch, registry of ids, splits, close fingerprints, request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import gates as G
from ..operators import identity
from ..sources import views as V
from .identity import MINTED
from .registry import query

_MEASURES = f"""{MINTED}, g AS (SELECT gid, count(*) AS c FROM minted GROUP BY gid), m AS (SELECT count(*) FILTER (c > 1)::DOUBLE AS duplicates, 0.4::DOUBLE AS external, 0.98::DOUBLE AS roundtrip, 1.5::DOUBLE AS conflicts,
  (SELECT round(avg(CASE WHEN advisor IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM minted) AS coherence, 3.0::DOUBLE AS memory, 36.0::DOUBLE AS minutes, 0.0::DOUBLE AS difference FROM g)"""


def measures(spark, sf):
    e = identity.mint(V.entries(spark, sf))
    dup = e.groupBy("gid").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).cast("double").alias("duplicates"))
    rest = e.agg(F.round(F.avg(F.when(F.col("advisor").isNotNull(), 1.0).otherwise(0.0)), 6).alias("coherence"))
    return dup.join(F.broadcast(rest)).selectExpr("duplicates", "0.4D AS external", "0.98D AS roundtrip", "1.5D AS conflicts", "coherence", "3D AS memory", "36D AS minutes", "0D AS difference")


def _gate_sql(bounds: dict[str, float], order) -> str:
    return " UNION ALL ".join(f"SELECT '{g}' AS gate, round({g}, 6)::DOUBLE AS value, {float(bounds[g])}::DOUBLE AS bound, {g} {'>=' if g in G.AT_LEAST else '<='} {bounds[g]} AS ok FROM m" for g in order)


@query("eight_gates", f"WITH {_MEASURES} {_gate_sql(G.COMMON | G.BOUNDS['quick'], G.ORDER)}")
def eight_gates(spark, sf):
    return G.eight(measures(spark, sf), "quick")


_RATES = f"""{V.ENTRIES_SQL}, m AS (SELECT 0.0005::DOUBLE AS duplicates, round(avg(CASE WHEN ord % 150 = 0 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS errors, round(avg(CASE WHEN ord % 4 = 0 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS coverage, 0.2::DOUBLE AS coherence, 30.0::DOUBLE AS minutes, 0.01::DOUBLE AS collisions FROM entries)"""
_STRICT = [g for g in G.STRICT if g != "idempotency"]


def rates(spark, sf):
    def share(k: int):
        return F.round(F.avg(F.when(F.col("ord") % k == 0, 1.0).otherwise(0.0)), 9)

    return V.entries(spark, sf).agg(F.lit(0.0005).alias("duplicates"), share(150).alias("errors"), share(4).alias("coverage"), F.lit(0.2).alias("coherence"), F.lit(30.0).alias("minutes"), F.lit(0.01).alias("collisions"), F.lit(None).cast("double").alias("idempotency"))


@query("strict_gates", f"WITH {_RATES} {_gate_sql(G.STRICT | G.PRODUCTION, _STRICT)}")
def strict_gates(spark, sf):
    return G.strict(rates(spark, sf), production=True)


@query("gate_decision", f"WITH {_RATES}, r AS ({_gate_sql(G.STRICT, _STRICT)}) SELECT bool_and(ok) AS passed, round(avg(value), 6) AS score, array_to_string(list_sort(list(gate) FILTER (NOT ok)), ',') AS failed FROM r")
def gate_decision(spark, sf):
    return G.decided(G.strict(rates(spark, sf))).withColumn("failed", F.array_join("failed", ","))


@query("fast_gates", f"WITH {MINTED}, a AS (SELECT CAST(sum(c - 1) AS BIGINT) AS repeated FROM (SELECT count(*) AS c FROM minted GROUP BY gid)), b AS (SELECT 100.0 * sum(c - 1) / sum(c) AS x FROM (SELECT count(*) AS c FROM minted WHERE ord % 3 = 0 GROUP BY ord // 6)) SELECT repeated = 0 AND x <= 0.5 AS ok, repeated, round(x, 6)::DOUBLE AS external FROM a, b")
def fast_gates(spark, sf):
    e = identity.mint(V.entries(spark, sf)).withColumn("x", F.when(F.col("ord") % 3 == 0, F.floor(F.col("ord") / 6)))
    return G.fast(e, "gid", "x", minutes=30.0)


@query("running_gates", f"WITH {MINTED}, s AS (SELECT count(*) AS seen, count(*) FILTER (ord % 30 <> 0) AS good, count(*) FILTER (ord % 30 = 0) AS bad, count(DISTINCT gid) AS ids FROM minted) SELECT seen, good, bad, ids, round(1000000 / 500.0 / 60, 6)::DOUBLE AS minutes, round(good / seen, 6) AS rate, good / seen >= 0.95 AS ok FROM s")
def running_gates(spark, sf):
    e = identity.mint(V.entries(spark, sf)).withColumn("status", F.when(F.col("ord") % 30 == 0, "processing_error"))
    return G.decision(G.running(e, "gid", "status"), 500.0)


@query("blended_score", f"WITH {V.ENTRIES_SQL} SELECT ord, round(0.6 * ((ord % 11) / 10.0) + 0.4 * ((ord % 7) / 6.0), 6)::DOUBLE AS score FROM entries")
def blended_score(spark, sf):
    return V.entries(spark, sf).select("ord", G.blended((F.col("ord") % 11) / 10, (F.col("ord") % 7) / 6).alias("score"))


@query("rerun_difference", f"WITH {V.SNAPSHOTS_SQL}, a AS (SELECT gid, status, price FROM snap_old), b AS (SELECT gid, status, price FROM snap_new) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS removed, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS added, false AS ok")
def rerun_difference(spark, sf):
    old, new = V.snapshots(spark, sf)
    return G.same_rows(old, new, skip=("priority",))


_IDS = "CASE WHEN ord % 6 = 0 THEN 'G' || (ord // 12) || '--1' ELSE 'G' || (ord // 4) END"


@query(
    "id_registry",
    f"""WITH {V.ENTRIES_SQL}, known AS (SELECT DISTINCT 'G' || (ord // 4) AS gid FROM entries WHERE ord % 3 = 0 UNION SELECT 'G' || (ord // 4) || '--1' FROM entries WHERE ord % 9 = 0 UNION SELECT 'G' || (ord // 4) || '--3' FROM entries WHERE ord % 5 = 0),
    batch AS (SELECT ord, 'G' || (ord // 4) AS gid FROM entries)
    SELECT ord, gid, CASE WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.gid = b.gid) THEN gid ELSE gid || '--' || CAST(CASE WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.gid = b.gid || '--1') THEN 1 ELSE 2 END AS VARCHAR) END AS unique_gid FROM batch b""",
)
def id_registry(spark, sf):
    e = V.entries(spark, sf).select("ord", F.concat(F.lit("G"), F.floor(F.col("ord") / 4).cast("string")).alias("gid"))
    known = e.where("ord % 3 = 0").select("gid").unionAll(e.where("ord % 9 = 0").select(F.concat("gid", F.lit("--1")))).unionAll(e.where("ord % 5 = 0").select(F.concat("gid", F.lit("--3"))))
    return B.register(e, known).select("ord", "gid", "unique_gid")


@query(
    "id_resuffix",
    f"""WITH {V.ENTRIES_SQL}, b AS (SELECT ord, CASE WHEN ord % 10 = 9 THEN 'G' || (ord // 10) || '--2' ELSE 'G' || (ord // 10) END AS gid FROM entries), n AS (SELECT ord, gid, row_number() OVER (PARTITION BY gid ORDER BY ord) - 1 AS n, EXISTS (SELECT 1 FROM b c WHERE c.gid = b.gid || '--2') AS two FROM b)
    SELECT ord, gid, CASE WHEN n = 0 THEN gid ELSE gid || '--' || CAST(CASE WHEN two AND n >= 2 THEN n + 1 ELSE n END AS VARCHAR) END AS unique_gid FROM n""",
)
def id_resuffix(spark, sf):
    own = F.concat(F.lit("G"), F.floor(F.col("ord") / 10).cast("string"))
    e = V.entries(spark, sf).select("ord", F.when(F.col("ord") % 10 == 9, F.concat(own, F.lit("--2"))).otherwise(own).alias("gid"))
    return B.resuffix(e)


@query(
    "stratified_split",
    f"""WITH {V.ENTRIES_SQL}, n AS (SELECT DISTINCT country, native AS name FROM entries), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(name), name) AS r, count(*) OVER (PARTITION BY country) AS n FROM n)
    SELECT ord, e.country, CASE WHEN r <= greatest(1, floor(n * 0.2 + 0.5)) THEN 'test' ELSE 'train' END AS part FROM entries e JOIN r ON e.country = r.country AND e.native = r.name""",
)
def stratified_split(spark, sf):
    return B.split(V.entries(spark, sf), "country", "native").select("ord", "country", "part")


@query("ending_agreement", f"WITH {V.ENTRIES_SQL} SELECT ord FROM entries WHERE NOT (ends_with(split_part(native, ' ', 2), 'et') AND length(split_part(native, ' ', 2)) > 3 AND country = 'US') AND NOT (ends_with(split_part(native, ' ', 1), 'et') AND length(split_part(native, ' ', 1)) > 3 AND country = 'US')")
def ending_agreement(spark, sf):
    e = V.entries(spark, sf).withColumn("words", F.split("native", " "))
    return B.agreeing(e, "words", "country", {"et": "R1"}, {"R1": "g1", "US": "g2", "DE": "g1"}).select("ord")


@query("within_anchor", f"WITH {V.ENTRIES_SQL}, p AS (SELECT ['A1', 'B1', 'A2', 'B2'][CAST(ord % 4 AS INTEGER) + 1] AS first, ['A2', 'B2', 'C1'][CAST(ord % 3 AS INTEGER) + 1] AS second, ['A1', 'A2', 'B1', 'C1', 'B2'][CAST(ord % 5 AS INTEGER) + 1] AS truth FROM entries), q AS (SELECT truth, first, CASE WHEN left(first, 1) = left(truth, 1) THEN first WHEN left(second, 1) = left(truth, 1) THEN second END AS inside FROM p) SELECT left(truth, 1) AS family, count(*) AS n, count(*) FILTER (inside = truth) AS \"right\", count(*) FILTER (first = truth) AS top FROM q WHERE inside IS NOT NULL GROUP BY 1")
def within_anchor(spark, sf):
    def pick(values, k):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("ord") % k + 1).cast("int"))

    e = V.entries(spark, sf).select(F.array(pick(["A1", "B1", "A2", "B2"], 4), pick(["A2", "B2", "C1"], 3)).alias("p"), pick(["A1", "A2", "B1", "C1", "B2"], 5).alias("truth"))
    return B.within_anchor(e, "p", "truth")


_FP = "lower(regexp_replace(latin, '[^A-Za-z0-9]', '', 'g')) || '_' || region || '_' || CAST(ord % 3 AS VARCHAR)"


@query(
    "fingerprint_duplicates",
    f"""WITH {V.ENTRIES_SQL}, d AS (SELECT {_FP} AS fp, min(ord) AS first FROM entries GROUP BY 1), s AS (SELECT a.fp, a.first, b.fp AS other, b.first AS o, round(len(list_filter(range(1, least(length(a.fp), length(b.fp)) + 1), lambda i: substr(a.fp, i, 1) = substr(b.fp, i, 1))) / greatest(length(a.fp), length(b.fp)), 9) AS similarity FROM d a JOIN d b ON b.first < a.first)
    SELECT fp, first, arg_max(other, (similarity, -o)) AS other, max(similarity) AS similarity FROM s WHERE similarity >= 0.85 GROUP BY fp, first""",
)
def fingerprint_duplicates(spark, sf):
    fp = F.concat(F.lower(F.regexp_replace("latin", "[^A-Za-z0-9]", "")), F.lit("_"), "region", F.lit("_"), (F.col("ord") % 3).cast("string"))
    return B.close_fingerprints(V.entries(spark, sf).withColumn("fp", fp), "fp", "ord")


@query("request_slots", "SELECT user_id AS client, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, count(*) AS requests, greatest(count(*) - 1, 0) AS denied FROM events GROUP BY 1, 2")
def request_slots(spark, sf):
    return B.slots(V.metrics(spark, sf), "client", 1, 3600)


@query("token_bucket")
def token_bucket(spark, sf):
    return B.token_bucket(V.metrics(spark, sf), "client", 2, 2, 3, 30)


@query("metric_insights", f"WITH {V.METRICS_SQL}, g AS (SELECT metric, arg_max(value, (ts, event_id)) AS value, avg(value) AS m, stddev_samp(value) AS s FROM metrics GROUP BY 1), c AS (SELECT metric, value, round((value - m) / s, 6) AS change FROM g) SELECT metric, value, change, CASE WHEN abs(change) > 3 THEN 'high' WHEN abs(change) > 1 THEN 'medium' ELSE 'low' END AS severity FROM c ORDER BY abs(change) DESC, metric LIMIT 10")
def metric_insights(spark, sf):
    return B.insights(V.metrics(spark, sf))


@query("metric_short_trend", f"WITH {V.METRICS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS back FROM metrics), s AS (SELECT metric, round(regr_slope(value, -back::DOUBLE), 6) AS slope FROM b WHERE back <= 5 GROUP BY 1) SELECT metric, slope, CASE WHEN abs(slope) < 0.1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend FROM s")
def metric_short_trend(spark, sf):
    return B.short_trend(V.metrics(spark, sf))


@query("metric_capacity", f"WITH {V.METRICS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS back FROM metrics), s AS (SELECT metric, round(avg(value), 6) AS mean FROM b WHERE back <= 10 GROUP BY 1) SELECT metric, mean, CASE WHEN metric = 'click' THEN 5.0 ELSE 80.0 END::DOUBLE AS \"limit\", mean > CASE WHEN metric = 'click' THEN 5.0 ELSE 80.0 END AS over FROM s")
def metric_capacity(spark, sf):
    return B.capacity(V.metrics(spark, sf), limits={"click": 5.0})
