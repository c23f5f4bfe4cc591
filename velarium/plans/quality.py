"""Queries: matching, collisions, coverage, gates and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, similarity
from ..operators import collisions, identity, matching, quality
from ..sources import views as V
from .identity import MINTED
from .registry import query

PAIRS = f"""WITH {V.ENTRIES_SQL}, d AS (SELECT min(ord) AS ord, native, source FROM entries GROUP BY native, source),
pairs AS (SELECT a.ord AS ord_a, b.ord AS ord_b, a.native AS a, b.native AS b FROM d a JOIN d b ON a.source = b.source AND substr(a.native, 1, 1) = substr(b.native, 1, 1) AND a.ord < b.ord)"""


def part_pairs(spark, sf):
    d = V.entries(spark, sf).groupBy("native", "source").agg(F.min("ord").alias("ord"))
    return matching.blocked_pairs(d, "ord", ["source", F.substr("native", F.lit(1), F.lit(1))], ["native"]).select("ord_a", "ord_b", F.col("native_a").alias("a"), F.col("native_b").alias("b"))


_BI = "list_distinct(list_transform(range(1, length({x})), lambda i: substr(lower({x}), CAST(i AS INTEGER), 2)))"


@query(
    "dice_set",
    f"{PAIRS} SELECT ord_a, ord_b, CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect({_BI.format(x='a')}, {_BI.format(x='b')})) / (len({_BI.format(x='a')}) + len({_BI.format(x='b')})), 9) END AS dice FROM pairs",
)
def dice_set(spark, sf):
    return part_pairs(spark, sf).select("ord_a", "ord_b", F.round(similarity.dice(F.col("a"), F.col("b")), 9).alias("dice"))


@query("edit_distance_norm", f"{PAIRS} SELECT ord_a, ord_b, round(levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) AS distance FROM pairs")
def edit_distance_norm(spark, sf):
    return part_pairs(spark, sf).select("ord_a", "ord_b", F.round(similarity.edit_distance(F.col("a"), F.col("b")), 9).alias("distance"))


@query(
    "char_overlap",
    f"""{PAIRS}, s AS (SELECT ord_a, ord_b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM pairs)
    SELECT ord_a, ord_b, round(len(list_filter(string_split(s, ''), lambda c: contains(l, c)))::DOUBLE / length(s), 9) AS overlap FROM s""",
)
def char_overlap(spark, sf):
    return part_pairs(spark, sf).select("ord_a", "ord_b", F.round(similarity.char_overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


@query("jaro_winkler")
def jaro_winkler(spark, sf):
    return part_pairs(spark, sf).select("ord_a", "ord_b", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("similar_names")
def similar_names(spark, sf):
    """The ten most similar names of each, whatever their sources."""
    return matching.similar(V.entries(spark, sf), "native")


@query("nearest_name")
def nearest_name(spark, sf):
    """Every entry, its name misspelt for two of three, against all entries."""
    e = V.entries(spark, sf).select("ord", "native", "birth")
    told = F.when(F.col("ord") % 3 == 0, F.upper("native")).when(F.col("ord") % 3 == 1, F.concat("native", F.lit("x"))).otherwise(F.regexp_replace("native", "a", "á"))
    left = e.select("ord", told.alias("native"), F.when(F.col("ord") % 5 != 0, F.col("birth") + F.col("ord") % 2).cast("int").alias("birth"))
    return matching.nearest(left, e, "native", "birth")


@query(
    "enrich_fill_only",
    f"""WITH {V.ENTRIES_SQL}, l AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN '' ELSE region END AS region, CASE WHEN ord % 5 = 0 THEN NULL ELSE country END AS country FROM entries),
    r AS (SELECT ord, 'r' || region AS region, 'x' || country AS country FROM entries WHERE ord % 2 = 0)
    SELECT l.ord, CASE WHEN l.region IS NULL OR l.region = '' THEN r.region ELSE l.region END AS region, CASE WHEN l.country IS NULL OR l.country = '' THEN r.country ELSE l.country END AS country FROM l LEFT JOIN r USING (ord)""",
)
def enrich_fill_only(spark, sf):
    e = V.entries(spark, sf)
    left = e.select("ord", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("region")).alias("region"), F.when(F.col("ord") % 5 != 0, F.col("country")).alias("country"))
    right = e.where("ord % 2 = 0").select("ord", F.concat(F.lit("r"), "region").alias("region"), F.concat(F.lit("x"), "country").alias("country"))
    return matching.fill_only(left, right, "ord", ["region", "country"])


@query(
    "token_set_match",
    f"""WITH {V.ENTRIES_SQL}, q AS (SELECT 'q' || ord AS k, split_part(native, ' ', 2) || '|' || source || '|' || birth AS s, list_distinct([split_part(native, ' ', 1), CASE WHEN ord % 3 = 0 THEN country ELSE split_part(native, ' ', 1) END]) AS t FROM entries),
    n AS (SELECT ord AS gid, split_part(native, ' ', 2) || '|' || source || '|' || birth AS s, [split_part(native, ' ', 1), country] AS t FROM entries)
    SELECT k AS query, min(gid) AS gid FROM q JOIN n ON q.s = n.s AND (list_has_all(n.t, q.t) OR list_has_all(q.t, n.t)) GROUP BY k HAVING count(DISTINCT gid) = 1""",
)
def token_set_match(spark, sf):
    """Every entry against all, surnames told apart by source and year."""
    e = V.entries(spark, sf)
    surname, first = F.concat_ws("|", F.split_part("native", F.lit(" "), F.lit(2)), "source", "birth"), F.split_part("native", F.lit(" "), F.lit(1))
    q = e.select(F.concat(F.lit("q"), F.col("ord").cast("string")).alias("key"), surname.alias("surname"), F.array_distinct(F.array(first, F.when(F.col("ord") % 3 == 0, F.col("country")).otherwise(first))).alias("tokens"))
    return matching.token_set_match(q, e.select(F.col("ord").alias("gid"), surname.alias("surname"), F.array(first, "country").alias("tokens")))


@query(
    "lookup_cascade",
    f"""WITH {V.ENTRIES_SQL}, q AS (SELECT ord AS query, CASE ord % 3 WHEN 0 THEN native ELSE 'none' END AS exact, split_part(native, ' ', 1) || '|' || source || '|' || country AS short FROM entries),
    k1 AS (SELECT native AS k, min(ord) AS gid FROM entries GROUP BY native HAVING count(DISTINCT ord) = 1),
    k2 AS (SELECT split_part(native, ' ', 1) || '|' || source || '|' || country AS k, min(ord) AS gid FROM entries GROUP BY 1 HAVING count(DISTINCT ord) = 1)
    SELECT query, coalesce(k1.gid, k2.gid) AS gid, CASE WHEN k1.gid IS NOT NULL THEN 'exact' WHEN k2.gid IS NOT NULL THEN 'short' END AS level
    FROM q LEFT JOIN k1 ON q.exact = k1.k LEFT JOIN k2 ON q.short = k2.k""",
)
def lookup_cascade(spark, sf):
    e = V.entries(spark, sf)
    short = F.concat_ws("|", F.split_part("native", F.lit(" "), F.lit(1)), "source", "country")
    q = e.select(F.col("ord").alias("query"), F.when(F.col("ord") % 3 == 0, F.col("native")).otherwise("none").alias("exact"), short.alias("short"))
    levels = [("exact", "exact", e.select(F.col("native").alias("k"), F.col("ord").alias("gid"))), ("short", "short", e.select(short.alias("k"), F.col("ord").alias("gid")))]
    return matching.cascade(q, levels)


@query(
    "pair_duplicate_score",
    f"""WITH {V.ENTRIES_SQL}, p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, lower(a.latin) AS na, lower(b.latin) AS nb, a.birth AS ya, b.birth AS yb, a.country AS ca, b.country AS cb, a.region AS ra, b.region AS rb
      FROM entries a JOIN entries b ON a.source = b.source AND a.region = b.region AND a.ord < b.ord),
    s AS (SELECT *, CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS s, CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS l,
      CASE WHEN ca = cb THEN 1.0 ELSE 1.0 / 3 END AS j FROM p)
    SELECT ord_a, ord_b, round((CASE WHEN na = nb THEN 0.4 WHEN len(list_filter(string_split(s, ''), lambda c: contains(l, c)))::DOUBLE / length(s) > 0.8 THEN 0.3 ELSE 0 END
      + CASE WHEN ya = yb THEN 0.2 WHEN abs(ya - yb) <= 2 THEN 0.1 ELSE 0 END + 0.3 * j + CASE WHEN ca = cb THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM s""",
)
def pair_duplicate_score(spark, sf):
    e = V.entries(spark, sf).select("ord", F.col("latin").alias("name"), "birth", "country", "source", "region", F.array("country", "region").alias("keys"))
    return matching.scored_pairs(e, "ord", ["source", "region"], ["name", "birth", "country", "keys"], matching.duplicate_score, parts=matching.duplicate_parts())


@query("suppression_anti", f"WITH {V.ENTRIES_SQL} SELECT ord, CASE WHEN advisor % 11 = 0 THEN NULL ELSE advisor END AS advisor FROM entries WHERE ord % 11 <> 0")
def suppression_anti(spark, sf):
    e = V.entries(spark, sf)
    gone = e.where("ord % 11 = 0").select(F.col("ord").alias("gone"))
    kept = e.join(gone, F.col("ord") == F.col("gone"), "left_anti").select("ord", "advisor")
    return kept.join(gone, F.col("advisor") == F.col("gone"), "left").select("ord", F.when(F.col("gone").isNull(), F.col("advisor")).alias("advisor"))


@query(
    "merge_edges",
    """WITH e AS (SELECT l_partkey AS student, l_suppkey AS advisor, l_returnflag AS source, 0.7 + l_discount AS confidence FROM lineitem)
    SELECT student, advisor, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, round(least(0.99, max(confidence) + least(0.06, 0.02 * (count(DISTINCT source) - 1)))::DOUBLE, 6) AS confidence, count(DISTINCT source) > 1 AS verified FROM e GROUP BY 1, 2""",
)
def merge_edges(spark, sf):
    e = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("student"), F.col("l_suppkey").alias("advisor"), F.col("l_returnflag").alias("source"), (0.7 + F.col("l_discount")).alias("confidence"))
    return matching.merge_edges(e).withColumn("sources", F.array_join("sources", ","))


@query(
    "collision_groups",
    f"""WITH {MINTED}, n AS (SELECT *, count(*) OVER (PARTITION BY latin, birth) AS n, row_number() OVER (PARTITION BY latin, birth ORDER BY gid, ord) - 1 AS i FROM minted)
    SELECT ord, gid, n, i, CASE WHEN i > 0 THEN gid || '--' || CAST(i AS VARCHAR) ELSE gid END AS proposal FROM n WHERE n > 1""",
)
def collision_groups(spark, sf):
    g = collisions.collision_groups(identity.mint(V.entries(spark, sf)), "latin", "birth", "gid")
    return g.select("ord", "gid", "n", "i", "proposal")


@query("collision_types", f"WITH {V.ENTRIES_SQL}, w AS (SELECT ord, latin, substr(sha256(native), 1, 16) AS h, min(ord) OVER (PARTITION BY latin) AS fl, min(ord) OVER (PARTITION BY native) AS fn FROM entries) SELECT ord, h, fl AS first_latin, fn AS first_native, ord > fl AS latin_repeats, ord > fn AS native_repeats FROM w")
def collision_types(spark, sf):
    a = collisions.first_seen(V.entries(spark, sf), "latin").withColumnRenamed("first_ord", "first_latin").withColumnRenamed("repeats", "latin_repeats")
    b = collisions.first_seen(a, "native")
    return b.select("ord", ids.shadow_hash(F.col("native")).alias("h"), "first_latin", F.col("first_ord").alias("first_native"), "latin_repeats", F.col("repeats").alias("native_repeats"))


@query("collision_summary", f"WITH {V.ENTRIES_SQL}, g AS (SELECT lower(latin) AS k, count(*) AS c FROM entries GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS names, count(*) FILTER (c > 1) AS collided, CAST(sum(c - 1) AS BIGINT) AS duplicates, round(100.0 * sum(c - 1) / sum(c), 6)::DOUBLE AS rate FROM g")
def collision_summary(spark, sf):
    g = V.entries(spark, sf).groupBy(F.lower("latin").alias("k")).agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("total"), F.count("*").alias("names"), F.count_if(F.col("c") > 1).alias("collided"), F.sum(F.col("c") - 1).alias("duplicates"), F.round(100.0 * F.sum(F.col("c") - 1) / F.sum("c"), 6).alias("rate"))


@query(
    "dup_external_ids",
    f"WITH {V.ENTRIES_SQL}, x AS (SELECT unnest([{{'s': 'brand', 'i': source}}, {{'s': 'country', 'i': country || CAST(ord // 50 AS VARCHAR)}}]) AS x FROM entries), g AS (SELECT x.s AS s, x.i AS i, count(*) AS c FROM x GROUP BY 1, 2) SELECT s AS source, CAST(sum(c - 1) AS BIGINT) AS extra, round(100.0 * sum(c - 1) / sum(c), 6)::DOUBLE AS percent FROM g GROUP BY 1",
)
def dup_external_ids(spark, sf):
    m = F.create_map(F.lit("brand"), "source", F.lit("country"), F.concat("country", F.floor(F.col("ord") / 50).cast("string")))
    g = V.entries(spark, sf).select(F.explode(m).alias("source", "i")).groupBy("source", "i").agg(F.count("*").alias("c"))
    return g.groupBy("source").agg(F.sum(F.col("c") - 1).alias("extra"), F.round(100.0 * F.sum(F.col("c") - 1) / F.sum("c"), 6).alias("percent"))


FIELDS = ["latin", "region", "nation", "segment"]


@query("field_distribution", f"WITH {V.PERSONS_SQL}, u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, CASE WHEN ord % 7 = 0 AND '{f}' = 'segment' THEN '' ELSE {f} END AS v FROM persons" for f in FIELDS) + ") SELECT field, count(*) FILTER (v <> '') AS filled, round(100.0 * count(*) FILTER (v <> '') / count(*), 6)::DOUBLE AS percent, count(DISTINCT nullif(v, '')) AS distinct_values FROM u GROUP BY field")
def field_distribution(spark, sf):
    p = V.persons(spark, sf).withColumn("segment", F.when(F.col("ord") % 7 == 0, "").otherwise(F.col("segment")))
    return collisions.distribution(p, FIELDS)


@query("authority_coverage", f"WITH {V.ENTRIES_SQL}, t AS (SELECT count(*) AS n FROM entries) SELECT source, count(*) AS hits, round(100.0 * count(*) / any_value(n), 6)::DOUBLE AS percent, round(avg((birth - 1900) / 50.0), 6)::DOUBLE AS confidence FROM entries, t GROUP BY source")
def authority_coverage(spark, sf):
    e = V.entries(spark, sf)
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    return e.join(n).groupBy("source").agg(F.count("*").alias("hits"), F.round(100.0 * F.count("*") / F.first("n"), 6).alias("percent"), F.round(F.avg((F.col("birth") - 1900) / 50), 6).alias("confidence"))


@query("surname_stats", f"WITH {V.ENTRIES_SQL} SELECT split_part(latin, ', ', 1) AS family, CAST(birth // 10 * 10 AS INTEGER) AS decade, country, region, count(*) AS n FROM entries GROUP BY ALL")
def surname_stats(spark, sf):
    return V.entries(spark, sf).groupBy(F.split_part("latin", F.lit(", "), F.lit(1)).alias("family"), (F.floor(F.col("birth") / 10) * 10).cast("int").alias("decade"), "country", "region").agg(F.count("*").alias("n"))


@query("surname_collisions", f"WITH {V.ENTRIES_SQL} SELECT split_part(latin, ', ', 1) AS family, country, count(*) AS n, string_agg(DISTINCT split_part(region, ' ', 1), ',' ORDER BY split_part(region, ' ', 1)) AS regions, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS severity FROM entries GROUP BY 1, 2 HAVING count(*) >= 3")
def surname_collisions(spark, sf):
    g = V.entries(spark, sf).groupBy(F.split_part("latin", F.lit(", "), F.lit(1)).alias("family"), "country").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.split_part("region", F.lit(" "), F.lit(1)))), ",").alias("regions"))
    return g.where("n >= 3").withColumn("severity", collisions.severity(F.col("n")))


@query(
    "shortform_clusters",
    f"""WITH {MINTED}, f AS (SELECT DISTINCT unnest([upper(substr(split_part(latin, ', ', 2), 1, 1)) || '.' || upper(substr(split_part(latin, ', ', 1), 1, 1)) || '.',
      upper(substr(split_part(latin, ', ', 2), 1, 1)) || '. ' || split_part(latin, ', ', 1), split_part(latin, ', ', 1)]) AS form, gid FROM minted)
    SELECT form, count(*) AS members, array_to_string(list_slice(list_sort(list(gid)), 1, 64), ',') AS ids FROM f GROUP BY form HAVING count(*) >= 2""",
)
def shortform_clusters(spark, sf):
    m = identity.mint(V.entries(spark, sf)).select("gid", F.split_part("latin", F.lit(", "), F.lit(1)).alias("family"), F.split_part("latin", F.lit(", "), F.lit(2)).alias("given"))
    return collisions.short_forms(m, "family", "given", "gid").withColumn("ids", F.array_join("ids", ","))


@query(
    "birthyear_mask",
    f"WITH {V.ENTRIES_SQL}, c AS (SELECT ord, region, birth, count(birth) OVER (PARTITION BY region, birth // 10) AS n FROM entries) SELECT ord, CASE WHEN n < 5 THEN CAST(birth // 10 * 10 AS VARCHAR) || 's' ELSE CAST(birth AS VARCHAR) END AS birth_text FROM c",
)
def birthyear_mask(spark, sf):
    return collisions.mask_birth_years(V.entries(spark, sf), "region", "birth").select("ord", "birth_text")


WEIGHTS = {"US": 0.9, "DE": 0.8, "FR": 0.7, "CN": 0.6}


@query(
    "bayes_confidence",
    f"""WITH {V.ENTRIES_SQL}, d AS (SELECT source, region, count(DISTINCT country) AS n, sum(DISTINCT CASE country WHEN 'US' THEN 90 WHEN 'DE' THEN 80 WHEN 'FR' THEN 70 WHEN 'CN' THEN 60 ELSE 0 END) / 100.0 AS known,
      count(DISTINCT country) FILTER (country NOT IN ('US', 'DE', 'FR', 'CN')) AS other FROM entries GROUP BY 1, 2)
    SELECT source, region, n, round(((1 + known + 0.5 * other) / (n + 2))::DOUBLE, 9) AS confidence FROM d""",
)
def bayes_confidence(spark, sf):
    g = V.entries(spark, sf).groupBy("source", "region").agg(F.collect_set("country").alias("s"))
    return g.select("source", "region", F.size("s").cast("bigint").alias("n"), F.round(collisions.beta_confidence(F.col("s"), WEIGHTS), 9).alias("confidence"))


@query(
    "quality_gates",
    f"""WITH {MINTED}, g AS (SELECT gid, count(*) AS c FROM minted GROUP BY gid), x AS (SELECT country, birth, source, region, count(*) AS c FROM minted GROUP BY ALL),
    m AS (SELECT (SELECT 100.0 * sum(c - 1) / sum(c) FROM g) AS duplicates, (SELECT 100.0 * sum(c - 1) / sum(c) FROM x) AS external, (SELECT 100.0 * count(*) FILTER (advisor IS NOT NULL) / count(*) FROM minted) AS coverage,
      (SELECT avg(CASE WHEN split_part(latin, ', ', 2) || ' ' || split_part(latin, ', ', 1) = native THEN 1.0 ELSE 0.0 END) FROM minted) AS roundtrip)
    SELECT 'duplicates' AS gate, round(duplicates, 6)::DOUBLE AS value, 0.5::DOUBLE AS bound, duplicates <= 0.5 AS ok FROM m UNION ALL SELECT 'external', round(external, 6)::DOUBLE, 1.0, external <= 1.0 FROM m
    UNION ALL SELECT 'coverage', round(coverage, 6)::DOUBLE, 60.0, coverage >= 60 FROM m UNION ALL SELECT 'roundtrip', round(roundtrip, 6)::DOUBLE, 0.9, roundtrip >= 0.9 FROM m""",
)
def quality_gates(spark, sf):
    e = identity.mint(V.entries(spark, sf))
    share = 100.0 * F.sum(F.col("c") - 1) / F.sum("c")
    dup = e.groupBy("gid").agg(F.count("*").alias("c")).agg(share.alias("duplicates"))
    ext = e.groupBy("country", "birth", "source", "region").agg(F.count("*").alias("c")).agg(share.alias("external"))
    back = F.concat(F.split_part("latin", F.lit(", "), F.lit(2)), F.lit(" "), F.split_part("latin", F.lit(", "), F.lit(1)))
    rest = e.agg((100.0 * F.count("advisor") / F.count("*")).alias("coverage"), F.avg(F.when(back == F.col("native"), 1.0).otherwise(0.0)).alias("roundtrip"))
    return quality.gates(dup.join(F.broadcast(ext)).join(F.broadcast(rest)), "quick")


@query(
    "dq_report",
    f"""WITH {V.PERSONS_SQL}, p AS (SELECT ord, nullif(CASE WHEN ord % 6 = 0 THEN '' ELSE latin END, '') AS latin, region, CASE WHEN ord % 4 = 0 THEN NULL ELSE nation END AS nation, CAST(1800 + balance / 40 AS INTEGER) AS birth, CAST(1800 + ord % 300 AS INTEGER) AS death FROM persons)
    SELECT ord, CAST(trunc(100 * (1 - ((latin IS NULL)::INT + (region IS NULL)::INT + 0.5 * (nation IS NULL)::INT + 0.5 * 1) / 4)) AS INTEGER) AS completeness,
    array_to_string(list_filter([CASE WHEN birth > 2026 THEN 'born_in_future' END, CASE WHEN birth < 0 THEN 'very_early' END, CASE WHEN death - birth < 0 THEN 'dies_before_birth' END,
      CASE WHEN death - birth >= 0 AND death - birth < 20 THEN 'short_life' END, CASE WHEN death - birth > 110 THEN 'long_life' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p""",
)
def dq_report(spark, sf):
    p = V.persons(spark, sf).select("ord", F.when(F.col("ord") % 6 != 0, F.col("latin")).alias("latin"), "region", F.when(F.col("ord") % 4 != 0, F.col("nation")).alias("nation"), F.round(1800 + F.col("balance") / 40).cast("int").alias("birth"), (1800 + F.col("ord") % 300).cast("int").alias("death"), F.lit(None).cast("string").alias("orcid"))
    score = quality.completeness([quality.filled("latin"), F.col("region").isNotNull()], [F.col("nation").isNotNull(), F.col("orcid").isNotNull()])
    return p.select("ord", F.coalesce(score, F.lit(0)).alias("completeness"), F.array_join(quality.rules(quality.temporal_checks(F.col("birth"), F.col("death"), 2026)), ",").alias("warnings"))


@query("ece_brier", f"WITH {V.PREDICTIONS_SQL}, b AS (SELECT least(floor(conf * 10), 9) AS b, count(*) AS n, avg(conf) AS c, avg(y) AS m FROM predictions GROUP BY 1) SELECT (SELECT count(*) FROM predictions) AS n, round(sum(n * abs(c - m)) / sum(n), 9) AS ece, (SELECT round(avg((conf - y) ** 2), 9) FROM predictions) AS brier FROM b")
def ece_brier(spark, sf):
    return quality.ece_brier(V.predictions(spark, sf))


@query("reliability_buckets", f"WITH {V.PREDICTIONS_SQL} SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bucket, count(*) AS n, round(avg(conf), 9) AS mean_conf, round(avg(y), 9) AS mean_y FROM predictions GROUP BY 1")
def reliability_buckets(spark, sf):
    return quality.calibration(V.predictions(spark, sf)).select("bucket", "n", F.round("mean_conf", 9).alias("mean_conf"), F.round("mean_y", 9).alias("mean_y"))


@query("isotonic_fit")
def isotonic_fit(spark, sf):
    return quality.isotonic(V.predictions(spark, sf))


@query("risk_coverage", f"WITH {V.PREDICTIONS_SQL}, b AS (SELECT floor(conf * 20) AS b, count(*) AS n, sum(y) AS s FROM predictions GROUP BY 1) SELECT round(b / 20, 6) AS threshold, round(sum(n) OVER (ORDER BY b DESC) / sum(n) OVER (), 9)::DOUBLE AS coverage, round(sum(s) OVER (ORDER BY b DESC) / sum(n) OVER (ORDER BY b DESC), 9)::DOUBLE AS precision FROM b")
def risk_coverage(spark, sf):
    return quality.risk_coverage(V.predictions(spark, sf))


@query("pareto_points", "WITH p AS (SELECT DISTINCT s_suppkey % 50 AS x, CAST(round(s_acctbal) AS BIGINT) AS y FROM supplier) SELECT x, y FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.x >= p.x AND q.y >= p.y AND (q.x > p.x OR q.y > p.y))")
def pareto_points(spark, sf):
    p = V.read(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("x"), F.round("s_acctbal").cast("bigint").alias("y"))
    return quality.skyline(p, "x", "y")


@query("regression_alerts", "WITH b AS (SELECT event_type AS k, median(value) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type AS k, median(value) AS recent, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT k AS metric, round(base, 6) AS base, round(recent, 6) AS recent, round((recent - base) / base, 6) AS change, abs((recent - base) / base) > 0.02 AND n >= 3 AS alert FROM b JOIN r USING (k)")
def regression_alerts(spark, sf):
    m = V.metrics(spark, sf)
    return quality.median_alerts(m.where("event_id % 2 = 1"), m.where("event_id % 2 = 0"), "metric", "value", 0.02)


@query("kfold_brier", f"WITH {V.PREDICTIONS_SQL} SELECT CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % 5 AS INTEGER) AS fold, count(*) AS n, round(avg((conf - y) ** 2), 9) AS brier FROM predictions GROUP BY 1")
def kfold_brier(spark, sf):
    p = V.predictions(spark, sf).withColumn("fold", quality.fold_of(F.col("doc_id"), 5))
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("conf") - F.col("y")) ** 2), 9).alias("brier"))
