"""Queries: metric events, snapshots, pages and extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, metrics, snapshots
from ..sources import files
from ..sources import views as V
from .registry import query

BACK = "l AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS back FROM metrics)"


@query(
    "metric_anomaly",
    f"WITH {V.METRICS_SQL}, w AS (SELECT *, count(*) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM metrics WINDOW f AS (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT metric, event_id, round(abs(value - m) / s, 6) AS z FROM w WHERE n >= 10 AND s > 0 AND abs(value - m) / s > 3",
)
def metric_anomaly(spark, sf):
    return metrics.anomalies(V.metrics(spark, sf)).select("metric", "event_id", F.round("z", 6).alias("z"))


@query(
    "metric_features",
    f"WITH {V.METRICS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id)::DOUBLE AS i FROM metrics) SELECT metric, event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, round(avg(value) OVER f, 6) AS mean, round(CASE WHEN count(*) OVER f > 1 THEN regr_slope(value, i) OVER f END, 6) AS slope FROM i WINDOW f AS (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
)
def metric_features(spark, sf):
    return metrics.features(V.metrics(spark, sf))


@query(
    "metric_trend",
    f"WITH {V.METRICS_SQL}, {BACK}, g AS (SELECT metric, avg(value) FILTER (back <= 20) AS now, avg(value) FILTER (back > 20) AS before FROM l WHERE back <= 40 GROUP BY 1) SELECT metric, round(now, 6) AS now, round(before, 6) AS before, round(100 * (now - before) / abs(before), 6) AS percent, CASE WHEN 100 * (now - before) / abs(before) > 20 THEN 'rising' WHEN 100 * (now - before) / abs(before) < -20 THEN 'falling' ELSE 'stable' END AS trend FROM g",
)
def metric_trend(spark, sf):
    return metrics.trend(V.metrics(spark, sf))


@query(
    "metric_p95",
    f"WITH {V.METRICS_SQL}, {BACK}, g AS (SELECT metric, list_sort(list(value) FILTER (back <= 24)) AS a, list_sort(list(value) FILTER (back > 50)) AS b FROM l WHERE back <= 100 GROUP BY 1), p AS (SELECT metric, a[CAST(floor(0.95 * len(a)) AS INTEGER) + 1] AS now, b[CAST(floor(0.95 * len(b)) AS INTEGER) + 1] AS before FROM g) SELECT metric, now, before, now > 1.5 * before AS worse FROM p",
)
def metric_p95(spark, sf):
    return metrics.p95_change(V.metrics(spark, sf))


@query(
    "metric_forecast",
    f"WITH {V.METRICS_SQL}, {BACK}, g AS (SELECT metric, regr_slope(value, (20 - back)::DOUBLE) AS a, regr_intercept(value, (20 - back)::DOUBLE) AS b FROM l WHERE back <= 20 GROUP BY 1) SELECT metric, CAST(k * 5 AS INTEGER) AS minutes, round(b + a * (19 + k), 6) AS value FROM g, range(1, 7) t(k)",
)
def metric_forecast(spark, sf):
    return metrics.forecast(V.metrics(spark, sf))


@query("metric_summary", f"WITH {V.METRICS_SQL} SELECT metric, count(*) AS n, min(value) AS least, max(value) AS most, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM metrics GROUP BY 1")
def metric_summary(spark, sf):
    return metrics.summary(V.metrics(spark, sf))


RULES = [("click", "gt", 90.0), ("view", "lt", 5.0), ("purchase", "ne", 50.0)]


@query(
    "alert_rules",
    f"WITH {V.METRICS_SQL} SELECT metric, event_id, op FROM metrics JOIN (VALUES {', '.join(map(str, RULES))}) r(m, op, threshold) ON metric = m WHERE CASE op WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE abs(value - threshold) >= 1e-6 END",
)
def alert_rules(spark, sf):
    r = F.broadcast(spark.createDataFrame(RULES, "metric string, op string, threshold double"))
    return metrics.alerts(V.metrics(spark, sf), r).select("metric", "event_id", "op")


@query("rate_limit")
def rate_limit(spark, sf):
    return metrics.rate_limit(V.metrics(spark, sf), 3, 3600)


@query(
    "session_runs",
    f"WITH {V.METRICS_SQL}, n AS (SELECT client, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS n FROM metrics WINDOW w AS (PARTITION BY client ORDER BY ts, event_id)), s AS (SELECT client, ts, sum(n) OVER (PARTITION BY client ORDER BY ts, event_id) AS session FROM n) SELECT client, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY 1, 2",
)
def session_runs(spark, sf):
    m = V.metrics(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.sessions(m, 360).select("client", "session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    "hourly_windows",
    f"WITH {V.METRICS_SQL} SELECT metric, epoch(date_trunc('hour', ts))::BIGINT AS hour_s, count(*) AS n, round(sum(value), 6) AS total FROM metrics GROUP BY 1, 2",
)
def hourly_windows(spark, sf):
    m = V.metrics(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return m.groupBy(F.window("ts", "1 hour").alias("w"), "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("metric", F.unix_seconds("w.start").alias("hour_s"), "n", "total")


@query(
    "as_of_join",
    f"WITH {V.METRICS_SQL}, l AS (SELECT client, ts, event_id FROM metrics WHERE event_id % 2 = 0), r AS (SELECT client, ts, max(value) AS value FROM metrics WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT l.event_id, r.value AS asof_value FROM l ASOF LEFT JOIN r ON l.client = r.client AND l.ts >= r.ts",
)
def as_of_join(spark, sf):
    m = V.metrics(spark, sf)
    right = m.where("event_id % 2 = 1").groupBy("client", "ts").agg(F.max("value").alias("value"))
    return metrics.as_of(m.where("event_id % 2 = 0").select("client", "ts", "event_id"), right, "client", "ts", "value").select("event_id", "asof_value")


@query(
    "dimension_cube",
    f"WITH {V.PERSONS_SQL} SELECT region, segment, count(*) AS n, round(avg(balance), 6) AS balance FROM persons GROUP BY CUBE (region, segment)",
)
def dimension_cube(spark, sf):
    return V.persons(spark, sf).cube("region", "segment").agg(F.count("*").alias("n"), F.round(F.avg("balance"), 6).alias("balance"))


CHANGED = "a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price OR a.priority IS DISTINCT FROM b.priority"
DIFF = f"{V.SNAPSHOTS_SQL}, d AS (SELECT coalesce(a.gid, b.gid) AS gid, CASE WHEN a.gid IS NULL THEN 'INSERT' WHEN b.gid IS NULL THEN 'DELETE' WHEN {CHANGED} THEN 'UPDATE' END AS action FROM snap_old a FULL JOIN snap_new b ON a.gid = b.gid)"


@query("snapshot_diff", f"WITH {DIFF} SELECT gid, action FROM d WHERE action IS NOT NULL")
def snapshot_diff(spark, sf):
    return snapshots.diff(*V.snapshots(spark, sf))


@query("field_diff", f"WITH {V.SNAPSHOTS_SQL} SELECT a.gid, 'price' AS field, round(a.price, 2) AS before, round(b.price, 2) AS after FROM snap_old a JOIN snap_new b ON a.gid = b.gid WHERE a.price <> b.price")
def field_diff(spark, sf):
    d = snapshots.field_diff(*V.snapshots(spark, sf))
    return d.select("gid", "field", F.round(F.col("before").cast("double"), 2).alias("before"), F.round(F.col("after").cast("double"), 2).alias("after"))


@query("changelog", f"WITH {DIFF} SELECT gid, CASE action WHEN 'INSERT' THEN 'INSERT INTO entries(gid) VALUES (' || gid || ');' WHEN 'DELETE' THEN 'DELETE FROM entries WHERE gid = ' || gid || ';' ELSE 'UPDATE entries SET touched = 1 WHERE gid = ' || gid || ';' END AS line FROM d WHERE action IS NOT NULL")
def changelog(spark, sf):
    return snapshots.changelog_lines(snapshots.diff(*V.snapshots(spark, sf)))


@query("key_sets", f"WITH {V.SNAPSHOTS_SQL} SELECT 'added' AS kind, count(*) AS n FROM (SELECT gid FROM snap_new EXCEPT SELECT gid FROM snap_old) UNION ALL SELECT 'removed', count(*) FROM (SELECT gid FROM snap_old EXCEPT SELECT gid FROM snap_new) UNION ALL SELECT 'kept', count(*) FROM (SELECT gid FROM snap_old INTERSECT SELECT gid FROM snap_new)")
def key_sets(spark, sf):
    a, b = (x.select("gid") for x in V.snapshots(spark, sf))
    one = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one(b.subtract(a), "added").unionAll(one(a.subtract(b), "removed")).unionAll(one(a.intersect(b), "kept"))


@query("batch_hash")
def batch_hash(spark, sf):
    return identity.batch_hash(V.persons(spark, sf))


@query("audit_chain")
def audit_chain(spark, sf):
    log = V.metrics(spark, sf).select(F.col("metric").alias("log"), "event_id", "value")
    return snapshots.verify(snapshots.chain(log, "event_id", ["event_id", "value"]), "event_id")


@query("cache_eviction", "WITH c AS (SELECT event_id AS id, ts, event_id % 5 AS hits, CAST(event_id % 100 + 1 AS BIGINT) AS size FROM events), w AS (SELECT id, coalesce(sum(size) OVER (ORDER BY epoch(ts)::BIGINT + hits * 3600, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT id FROM w WHERE b < 5000")
def cache_eviction(spark, sf):
    c = V.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5).alias("hits"), (F.col("event_id") % 100 + 1).alias("size"))
    return snapshots.evict(c, 5000).select("id")


@query("page_links", "WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages) SELECT page_id, title, CAST(i - 1 AS INTEGER) AS pos, h[CAST(i AS INTEGER)] AS href FROM p, unnest(range(1, len(h) + 1)) t(i)")
def page_links(spark, sf):
    return files.links(V.read(spark, sf, "pages"))




@query("dublin_core", f"WITH {V.ENTRIES_SQL} SELECT ord, native AS title, latin AS creator, '2001' AS date, latin || ' senior' AS advisors FROM entries")
def dublin_core(spark, sf):
    xml = F.concat(F.lit("<record><dc:title>"), "native", F.lit("</dc:title><dc:creator>"), "latin", F.lit("</dc:creator><dc:contributor>"), "latin", F.lit(" senior</dc:contributor><dc:contributor>University of "), "native", F.lit("</dc:contributor><dc:date>2001</dc:date></record>"))
    d = files.dublin_core(V.entries(spark, sf).select("ord", xml.alias("xml")), "xml")
    return d.select("ord", "title", F.col("creators")[0].alias("creator"), "date", F.array_join("advisors", ";").alias("advisors"))


@query("thesis_extract", f"WITH {V.ENTRIES_SQL} SELECT ord, native AS title, latin AS author, 'Dr ' || native AS advisor, CAST(birth AS VARCHAR) AS year FROM entries")
def thesis_extract(spark, sf):
    text = F.concat(F.lit("TITLE: "), "native", F.lit("\nAuthor:  "), "latin", F.lit("\nSupervisor: Dr "), "native", F.lit("\nDate: May "), F.col("birth").cast("string"), F.lit("\nother"))
    return files.thesis_fields(V.entries(spark, sf).select("ord", text.alias("text")), "text").drop("text").drop("date")
