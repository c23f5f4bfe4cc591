"""Queries: regions and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, regions
from ..sources import views as V
from .registry import query


def values(rows, *columns):
    def lit(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


TERRITORY = values(list(regions.TERRITORY.items()), "c", "region")


@query("territory_region", f"WITH {V.ENTRIES_SQL} SELECT ord, country, coalesce(t.region, 'R0') AS geo_region FROM entries LEFT JOIN {TERRITORY} ON country = t.c")
def territory_region(spark, sf):
    return regions.territory(V.entries(spark, sf)).select("ord", "country", "geo_region")


@query(
    "overlay_precedence",
    f"""WITH {V.ENTRIES_SQL}, c AS (SELECT ord, country, CASE WHEN ord % 24 = 3 THEN 'CH-FR' WHEN ord % 24 = 9 THEN 'IN-WB' WHEN ord % 24 = 12 THEN 'LK-TA' END AS code, CASE WHEN ord % 10 = 0 THEN 'ZZ' ELSE country END AS cc FROM entries)
    SELECT ord, coalesce(o.r, t.region, 'R0') AS region_code, CASE WHEN o.r IS NOT NULL THEN 0.88 WHEN t.region IS NOT NULL THEN 0.85 ELSE 0.1 END::DOUBLE AS confidence
    FROM c LEFT JOIN {TERRITORY} ON cc = t.c LEFT JOIN {values(list(regions.OVERLAY.items()), 'o', 'r').replace('AS t', 'AS o')} ON code = o.o""",
)
def overlay_precedence(spark, sf):
    n = F.col("ord") % 24
    c = V.entries(spark, sf).select("ord", F.when(n == 3, "CH-FR").when(n == 9, "IN-WB").when(n == 12, "LK-TA").alias("code"), F.when(F.col("ord") % 10 == 0, "ZZ").otherwise(F.col("country")).alias("cc"))
    return regions.overlay(c, "code", "cc").select("ord", "region_code", "confidence")


RULES = values([(c, lo if lo is not None else -9999, hi if hi is not None else 9999, r, i) for i, (c, lo, hi, r) in enumerate(regions.DIASPORA)], "c", "lo", "hi", "r", "n")


@query("diaspora_interval", f"WITH {V.ENTRIES_SQL}, e AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN 'TH' ELSE country END AS country, birth + CAST(ord % 4 AS INTEGER) * 40 AS birth FROM entries) SELECT ord, arg_min(t.r, t.n) AS diaspora_region FROM e JOIN {RULES} ON country = t.c AND birth BETWEEN t.lo AND t.hi GROUP BY ord")
def diaspora_interval(spark, sf):
    e = V.entries(spark, sf).select("ord", F.when(F.col("ord") % 3 == 0, "TH").otherwise(F.col("country")).alias("country"), (F.col("birth") + (F.col("ord") % 4).cast("int") * 40).alias("birth"))
    return regions.diaspora(e, "country", "birth", "ord")


@query(
    "merge_geo_name",
    f"""WITH {V.PERSONS_SQL}, p AS (SELECT ord, ['R0', 'A1', 'B1', 'E1'][CAST(ord % 4 + 1 AS INTEGER)] AS geo, ['R0', 'A3', 'B1', 'E4', 'A1'][CAST(ord % 5 + 1 AS INTEGER)] AS nm FROM persons),
    g AS (SELECT * FROM {values(list(regions.GROUPS.items()), 'r', 'g')}),
    m AS (SELECT *, CASE WHEN geo <> 'R0' THEN geo WHEN nm <> 'R0' THEN nm ELSE 'R0' END AS region, (SELECT g FROM g WHERE r = geo) AS gg, (SELECT g FROM g WHERE r = nm) AS gn FROM p)
    SELECT ord, region, CASE WHEN geo <> 'R0' THEN 0.85 WHEN nm <> 'R0' THEN 0.7 ELSE 0.1 END::DOUBLE AS confidence, geo <> 'R0' AND nm <> 'R0' AND geo <> nm AS conflict,
      (SELECT g FROM g WHERE r = region) AS grp, CASE WHEN geo = 'R0' AND nm = 'R0' THEN 'none' WHEN gg = gn THEN 'leaf' WHEN geo <> 'R0' AND nm <> 'R0' THEN 'group' ELSE 'single' END AS resolution FROM m""",
)
def merge_geo_name(spark, sf):
    p = V.persons(spark, sf)
    geo = F.element_at(F.array(*map(F.lit, ("R0", "A1", "B1", "E1"))), (F.col("ord") % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("R0", "A3", "B1", "E4", "A1"))), (F.col("ord") % 5 + 1).cast("int"))
    return p.select("ord", geo.alias("geo"), name.alias("nm")).select("ord", regions.merge(F.col("geo"), F.lit(0.85), F.col("nm"), F.lit(0.7)).alias("m")).select("ord", "m.*")


SURNAMES = values([(r, p) for r, k, p, _ in regions.LEXICON if k == "surname"], "r", "p")


@query(
    "surname_score",
    f"""WITH {V.ENTRIES_SQL}, s AS (SELECT ord, t.r, CASE WHEN lower(n) = t.p THEN 10 WHEN starts_with(lower(n), t.p) THEN 7 ELSE 5 END AS score FROM (SELECT ord, split_part(latin, ', ', 1) || CASE WHEN ord % 3 = 0 THEN 'son' ELSE '' END AS n FROM entries) JOIN {SURNAMES} ON contains(lower(n), t.p))
    SELECT ord, arg_min(r, (-score, r)) AS region, CAST(max(score) AS INTEGER) AS score FROM s GROUP BY ord""",
)
def surname_score(spark, sf):
    e = V.entries(spark, sf).withColumn("s", F.concat(F.split_part("latin", F.lit(", "), F.lit(1)), F.when(F.col("ord") % 3 == 0, "son").otherwise("")))
    return regions.surname_scores(e, "s", "ord")


@query(
    "rule_scorer_topk",
    f"""WITH {V.ENTRIES_SQL}, k AS (SELECT DISTINCT ord, unnest(string_split(lower(native), ' ')) AS t FROM entries), l AS (SELECT * FROM {values(regions.LEXICON, 'region', 'kind', 'pattern', 'weight')}),
    s AS (SELECT ord, region, round(sum(weight)::DOUBLE, 3) AS score FROM k JOIN l ON (kind = 'surname' AND t = pattern) OR (kind = 'prefix' AND starts_with(t, pattern)) OR (kind = 'suffix' AND ends_with(t, pattern)) GROUP BY 1, 2),
    r AS (SELECT ord, region, score, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0), 3) AS margin FROM s WINDOW w AS (PARTITION BY ord ORDER BY score DESC, region))
    SELECT * FROM r WHERE rank <= 5""",
)
def rule_scorer_topk(spark, sf):
    return regions.rule_scores(V.entries(spark, sf), "native", "ord")


@query(
    "ortho_anchor",
    "WITH w AS (SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '[{m}]') AS {g}" for g, m in regions.MARKS.items()) + " FROM documents) SELECT doc_id, CASE WHEN europe::INT + iberia::INT + slavic::INT = 1 THEN CASE WHEN europe THEN 'europe' WHEN iberia THEN 'iberia' ELSE 'slavic' END END AS grp FROM w",
)
def ortho_anchor(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", regions.letter_group(F.col("text")).alias("grp"))


@query(
    "log_odds_mining",
    """WITH c AS (SELECT lang AS leaf, right(w, 2) AS feature, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY 1, 2),
    d AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS f, sum(n) OVER (PARTITION BY leaf) AS t, sum(n) OVER () AS a FROM c),
    w AS (SELECT feature, leaf, round(greatest(-0.8, least(0.8, ln(((n + 0.5) / (t - n + 0.5))::DOUBLE / ((f - n + 0.5) / (a - t - f + n + 0.5))::DOUBLE) * (1.0::DOUBLE - 1.0::DOUBLE / (n + 1)))), 3)::DOUBLE AS weight FROM d WHERE n >= 3)
    SELECT * FROM w WHERE abs(weight) >= 0.1""",
)
def log_odds_mining(spark, sf):
    w = V.read(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    c = w.groupBy(F.right("w", F.lit(2)).alias("feature"), F.col("lang").alias("leaf")).agg(F.count("*").alias("n"))
    return regions.log_odds(c, "feature", "leaf", "n")


CLEAN = f"{V.EDGES_SQL}, d AS (SELECT DISTINCT * FROM edges WHERE student <> advisor), clean AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.student = d.advisor AND b.advisor = d.student))"


@query("advisor_edges_clean", f"WITH {CLEAN} SELECT * FROM clean")
def advisor_edges_clean(spark, sf):
    return lineage.clean_edges(V.advisor_edges(spark, sf))


def _walk_sql(a: str, b: str, depth: int) -> str:
    return f"""WITH RECURSIVE {CLEAN}, w AS (SELECT {a} AS root, {b} AS node, 1 AS depth FROM clean UNION ALL SELECT w.root, c.{b}, w.depth + 1 FROM w JOIN clean c ON w.node = c.{a} WHERE w.depth < {depth})
    SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE root <> node GROUP BY 1, 2"""


def _lineage(spark, sf, up: bool, depth: int):
    e = lineage.clean_edges(V.advisor_edges(spark, sf))
    return lineage.frontier(e, e.select(F.col("student" if up else "advisor").alias("node")).distinct(), up, depth)


@query("lineage_ancestors", _walk_sql("student", "advisor", 6))
def lineage_ancestors(spark, sf):
    return _lineage(spark, sf, True, 6)


@query("lineage_descendants", _walk_sql("advisor", "student", 4))
def lineage_descendants(spark, sf):
    return _lineage(spark, sf, False, 4)


@query("lineage_paths", f"""WITH RECURSIVE {CLEAN}, w AS (SELECT student AS a, advisor AS node, 1 AS length, [student, advisor] AS path FROM clean WHERE student = (SELECT max(student) FROM clean)
  UNION ALL SELECT w.a, c.advisor, w.length + 1, list_append(w.path, c.advisor) FROM w JOIN clean c ON w.node = c.student WHERE w.length < 12 AND NOT list_contains(w.path, c.advisor)) SELECT array_to_string(path, '>') AS path, length FROM w""")  # fmt: skip
def lineage_paths(spark, sf):
    """From the node with the largest number."""
    e = lineage.clean_edges(V.advisor_edges(spark, sf))
    last = e.agg(F.max("student")).first()[0]
    return lineage.paths(e, last, True, 12).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@query("cycle_pairs", f"WITH RECURSIVE {V.EDGES_SQL}, e AS (SELECT DISTINCT * FROM edges), w AS (SELECT student AS root, advisor AS node, 1 AS depth FROM e UNION ALL SELECT w.root, e.advisor, w.depth + 1 FROM w JOIN e ON w.node = e.student WHERE w.depth < 3 AND w.node <> w.root) SELECT root AS node, CAST(min(depth) AS INTEGER) AS length FROM w WHERE root = node GROUP BY 1")
def cycle_pairs(spark, sf):
    return lineage.cycle_pairs(V.advisor_edges(spark, sf), 3)


@query("degree_coherence", f"WITH {CLEAN}, x AS (SELECT student AS node, 1 AS o, 0 AS i FROM clean UNION ALL SELECT advisor, 0, 1 FROM clean), g AS (SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM x GROUP BY 1) SELECT node, n_out, n_in, round((n_out + n_in)::DOUBLE / (SELECT count(*) FROM g), 9) AS ratio FROM g")
def degree_coherence(spark, sf):
    return lineage.degrees(lineage.clean_edges(V.advisor_edges(spark, sf)))


@query("integrity_report", f"WITH {V.EDGES_SQL}, d AS (SELECT DISTINCT * FROM edges) SELECT 'self_loop' AS rule, count(*) FILTER (student = advisor) AS violations FROM edges UNION ALL SELECT 'mutual', count(*) FROM d a WHERE student < advisor AND EXISTS (SELECT 1 FROM d b WHERE b.student = a.advisor AND b.advisor = a.student) UNION ALL SELECT 'repeated', CAST((SELECT count(*) FROM edges) - (SELECT count(*) FROM d) AS BIGINT) UNION ALL SELECT 'dangling', count(*) FROM (SELECT DISTINCT advisor FROM d WHERE advisor NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0))")
def integrity_report(spark, sf):
    return lineage.integrity(V.advisor_edges(spark, sf), V.read(spark, sf, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("node")))


@query("gini_degrees", f"WITH {CLEAN}, x AS (SELECT student AS node FROM clean UNION ALL SELECT advisor FROM clean), g AS (SELECT count(*) AS d FROM x GROUP BY node), r AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM g), c AS (SELECT sum(d) OVER (ORDER BY i) AS c FROM r) SELECT round((count(*) + 1 - 2 * sum(c)::DOUBLE / max(c)) / count(*), 9)::DOUBLE AS gini FROM c")
def gini_degrees(spark, sf):
    d = lineage.degrees(lineage.clean_edges(V.advisor_edges(spark, sf)))
    return lineage.gini(d.select((F.col("n_out") + F.col("n_in")).alias("d")), "d")


@query("components")
def components(spark, sf):
    """Over every part and supplier of lineitem; suppliers get negative numbers."""
    e = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"), (-1 - F.col("l_suppkey")).alias("s")).distinct()
    return lineage.components(e, "p", "s")


@query("acyclic_rest", f"WITH RECURSIVE {V.EDGES_SQL}, e AS (SELECT DISTINCT * FROM edges), w AS (SELECT student AS root, advisor AS node FROM e UNION SELECT w.root, e.advisor FROM w JOIN e ON w.node = e.student), c AS (SELECT DISTINCT root FROM w WHERE root = node), k AS (SELECT DISTINCT w.root FROM w JOIN c ON w.node = c.root UNION SELECT root FROM c) SELECT student, advisor FROM e WHERE advisor IN (SELECT root FROM k)")
def acyclic_rest(spark, sf):
    return lineage.peel(V.advisor_edges(spark, sf))


@query("lineage_frontier", _walk_sql("student", "advisor", 12))
def lineage_frontier(spark, sf):
    return _lineage(spark, sf, True, 12)


@query("betweenness")
def betweenness(spark, sf):
    return lineage.betweenness(lineage.clean_edges(V.advisor_edges(spark, sf)))
