"""Queries: advisor edges as records, vetting, and figures of the advisor graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..sources import views as V
from .registry import query

_CASE = "CASE CAST(ord % 3 AS INTEGER) WHEN 0 THEN 'curated' WHEN 1 THEN 'registry' ELSE 'blog' END"


@query(
    "advisor_extract",
    f"""WITH {V.ENTRIES_SQL} SELECT ord AS student, 'A' || advisor AS name, advisor AS id, CASE WHEN ord % 2 = 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM entries WHERE advisor IS NOT NULL
    UNION ALL SELECT ord, native, NULL, 0.9 FROM entries WHERE ord % 5 = 0""",
)
def advisor_extract(spark, sf):
    first = "named_struct('name', concat('A', advisor), 'id', advisor, 'confidence', CASE WHEN ord % 2 = 0 THEN 0.7D END)"
    second = "named_struct('name', CASE WHEN ord % 5 = 0 THEN native ELSE ' ' END, 'id', CAST(NULL AS BIGINT), 'confidence', CAST(NULL AS DOUBLE))"
    e = V.entries(spark, sf).selectExpr("ord AS gid", f"CASE WHEN ord % 7 = 8 THEN NULL ELSE array({first}, {second}) END AS advisors")
    return E.extract(e)


@query(
    "typed_edges",
    f"""WITH {V.ENTRIES_SQL}, t AS (SELECT ord, unnest([native, '', latin]) AS name, {_CASE} AS source, birth + 30 AS year FROM entries)
    SELECT ord, name, source, CASE source WHEN 'curated' THEN 'verified' WHEN 'registry' THEN 'high' ELSE 'low' END AS confidence, 'doctoral' AS relation, year FROM t WHERE name <> ''""",
)
def typed_edges(spark, sf):
    e = V.entries(spark, sf)
    return e.select("ord", F.inline(E.typed(F.array("native", F.lit(""), "latin"), F.expr(_CASE), F.col("birth") + 30)))


@query("provenance_hash", f"""WITH {V.ENTRIES_SQL} SELECT ord, upper(sha1('[' || CASE WHEN ord % 2 = 0 THEN '''a'', ' ELSE '' END || '''' || lower(source) || '''' || ']' || latin || coalesce(CAST(advisor AS VARCHAR), ''))) AS hash FROM entries""")
def provenance_hash(spark, sf):
    s = F.when(F.col("ord") % 2 == 0, F.array("source", F.lit("a"))).otherwise(F.array("source"))
    return V.entries(spark, sf).withColumn("source", F.lower("source")).select("ord", E.provenance(s, F.col("latin"), F.col("advisor").cast("string")).alias("hash"))


_LO, _HI = "birth + 20 - CAST(ord % 4 AS INTEGER) * 50", "birth + 35 - CAST(ord % 4 AS INTEGER) * 50"
_DEGREE = "CASE WHEN ord % 11 = 0 THEN 'Master of Arts' ELSE 'PhD' END"
_REGIMES = "r(c, lo, hi, t, r) AS (VALUES " + ", ".join(f"('{c}', {E.OPEN_LOW if a is None else a}, {E.OPEN_HIGH if b is None else b}, {E.TIERS.index(t)}, '{why}')" for c, a, b, t, why in E.REGIMES) + ")"
_VET = f"""{V.ENTRIES_SQL}, {_REGIMES}, d AS (SELECT ord AS edge, country, {_LO} AS lo, {_HI} AS hi, {_DEGREE} AS degree, birth AS born, birth - 30 + CAST(ord % 40 AS INTEGER) AS advisor_born FROM entries),
  v AS (SELECT edge, any_value(d.hi) AS hi, any_value(degree) AS degree, any_value(born) AS born, any_value(advisor_born) AS advisor_born, max(t) AS t, list_sort(list_distinct(list(r) FILTER (r IS NOT NULL))) AS rs
    FROM d LEFT JOIN r ON country = c AND d.lo <= r.hi AND d.hi >= r.lo GROUP BY edge),
  w AS (SELECT edge, CASE WHEN hi < 1800 OR lower(degree) LIKE '%master%' THEN 'RETYPE' ELSE ['TRUST', 'REVIEW', 'SUSPECT'][greatest(coalesce(t, 1), CASE WHEN advisor_born > born THEN 2 ELSE 0 END) + 1] END AS tier,
    array_to_string(coalesce(rs, []) || CASE WHEN hi < 1800 THEN ['pre_modern'] ELSE [] END || CASE WHEN advisor_born > born THEN ['advisor_born_after'] ELSE [] END, ',') AS reasons FROM v)"""


def vetted(spark, sf):
    e = V.entries(spark, sf).selectExpr("ord AS edge", "country", f"{_LO} AS lo", f"{_HI} AS hi", f"{_DEGREE} AS degree", "birth AS born", "birth - 30 + CAST(ord % 40 AS INTEGER) AS advisor_born")
    return E.vet(spark, e)


@query("vetting_tier", f"WITH {_VET} SELECT edge, tier, reasons FROM w")
def vetting_tier(spark, sf):
    return vetted(spark, sf).select("edge", "tier", F.array_join("reasons", ",").alias("reasons"))


@query("vetting_status", f"WITH {_VET} SELECT edge, tier, CASE WHEN edge % 2 = 0 THEN CASE WHEN edge % 3 = 0 THEN 'library' ELSE '' END END AS vetted_by, CASE WHEN edge % 2 = 0 THEN edge % 3 <> 0 AND tier <> 'TRUST' END AS needs_vetting FROM w")
def vetting_status(spark, sf):
    sources = F.array_compact(F.array(F.when(F.col("edge") % 2 == 0, F.lit("seed")), F.when(F.col("edge") % 3 == 0, F.lit("library"))))
    v = E.vetting_status(vetted(spark, sf).withColumn("sources", sources), ["seed"])
    return v.select("edge", "tier", F.array_join("vetted_by", ",").alias("vetted_by"), "needs_vetting")


@query("edge_dates", f"WITH {V.ENTRIES_SQL} SELECT ord, CASE WHEN ord % 3 = 0 OR ord % 3 = 1 THEN 'bad_degree_date' END AS problem FROM entries")
def edge_dates(spark, sf):
    d = F.when(F.col("ord") % 3 == 0, F.lit("19")).when(F.col("ord") % 3 == 2, F.col("birth").cast("string"))
    return V.entries(spark, sf).select("ord", E.date_problem(d).alias("problem"))


_GRAPH = f"{V.EDGES_SQL}, ed AS (SELECT student, advisor, CASE WHEN student % 4 = 0 THEN 0.5 ELSE 0.9 END AS confidence FROM edges)"


def graph(spark, sf):
    return V.advisor_edges(spark, sf).withColumn("confidence", F.when(F.col("student") % 4 == 0, 0.5).otherwise(0.9))


@query(
    "graph_figures",
    f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT student FROM ed UNION SELECT advisor FROM ed)) AS isolated,
      round(least(1.0, 0.1 * (SELECT count(*) FROM ed) / (SELECT count(*) FROM part)), 9)::DOUBLE AS coherence, (SELECT count(*) FROM ed WHERE confidence < 0.8) AS conflicts""",
)
def graph_figures(spark, sf):
    return E.figures(V.read(spark, sf, "part").select(F.col("p_partkey").alias("node")), graph(spark, sf))


@query("highest_degree", f"WITH {V.EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT student AS node FROM edges UNION ALL SELECT advisor FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def highest_degree(spark, sf):
    return E.hubs(V.advisor_edges(spark, sf), 10)


@query("graph_upsert", f"WITH {V.SNAPSHOTS_SQL} SELECT coalesce(n.gid, o.gid) AS gid, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price, coalesce(n.priority, o.priority) AS priority FROM snap_old o FULL JOIN snap_new n USING (gid)")
def graph_upsert(spark, sf):
    old, new = V.snapshots(spark, sf)
    return E.upsert(old.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(1)), "gid", "v").drop("v")


@query("identity_share", f"WITH {V.ENTRIES_SQL} SELECT round(avg(CASE WHEN ord % 9 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS coherence FROM entries")
def identity_share(spark, sf):
    return E.with_identity(V.entries(spark, sf).select(F.when(F.col("ord") % 9 != 0, F.col("latin")).alias("gid")))


@query(
    "integrity_invariants",
    f"""WITH RECURSIVE {V.EDGES_SQL}, ed AS (SELECT student, advisor, CASE WHEN student % 9 <> 0 THEN 'x' END AS source FROM edges), r AS (SELECT CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN p_partkey - 1 ELSE p_partkey END AS gid, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name FROM part),
    e AS (SELECT DISTINCT student, advisor FROM ed WHERE student <> advisor), w AS (SELECT student AS root, advisor AS node FROM e UNION SELECT w.root, e.advisor FROM w JOIN e ON w.node = e.student), c AS (SELECT DISTINCT root FROM w WHERE root = node), k AS (SELECT DISTINCT w.root FROM w JOIN c ON w.node = c.root UNION SELECT root FROM c)
    SELECT 'self_loop' AS rule, count(*) AS violations FROM ed WHERE student = advisor UNION ALL SELECT 'cycle', count(*) FROM e WHERE advisor IN (SELECT root FROM k) UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM ed GROUP BY student, advisor HAVING count(*) > 1)
    UNION ALL SELECT 'provenance', count(*) FROM ed WHERE source IS NULL UNION ALL SELECT 'dangling', count(*) FROM (SELECT DISTINCT advisor FROM ed WHERE advisor NOT IN (SELECT gid FROM r WHERE gid IS NOT NULL)) UNION ALL SELECT 'missing_key', count(*) FROM r WHERE gid IS NULL OR name = ''
    UNION ALL SELECT 'shared_id', count(*) FROM (SELECT 1 FROM r WHERE gid IS NOT NULL GROUP BY gid HAVING count(*) > 1)""",
)
def integrity_invariants(spark, sf):
    key = F.col("p_partkey")
    r = V.read(spark, sf, "part").select(F.when(key % 17 != 0, F.when(key % 19 == 0, key - 1).otherwise(key)).alias("gid"), F.when(key % 13 == 0, "").otherwise(F.col("p_name")).alias("name"))
    e = V.advisor_edges(spark, sf).withColumn("source", F.when(F.col("student") % 9 != 0, "x")).withColumn("confidence", F.lit(0.9))
    return E.invariants(r, e)
