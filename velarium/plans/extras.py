"""Queries: further similarities, edge resolution, security, timelines, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import lineage, records
from ..sources import views as V
from .quality import _BI, PAIRS, part_pairs
from .registry import query
from .regions import CLEAN

_MG = "list_transform(range(1, length({x})), lambda i: substr(lower({x}), CAST(i AS INTEGER), 2))"
_A, _B = _MG.format(x="a"), _MG.format(x="b")


@query(
    "dice_multiset",
    f"{PAIRS} SELECT ord_a, ord_b, CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * CAST(list_sum(list_prepend(0, list_transform(list_distinct({_A}), lambda g: least(len(list_filter({_A}, lambda v: v = g)), len(list_filter({_B}, lambda v: v = g)))))) AS DOUBLE) / (len({_A}) + len({_B})), 9) END AS dice FROM pairs",
)
def dice_multiset(spark, sf):
    return part_pairs(spark, sf).select("ord_a", "ord_b", F.round(similarity.dice_multiset(F.col("a"), F.col("b")), 9).alias("dice"))


_JA, _JB = _BI.format(x="a"), _BI.format(x="b")


@query(
    "dice_joined",
    f"{PAIRS}, j AS (SELECT ord_a, ord_b, regexp_replace(a, '[ -]', '', 'g') AS a, regexp_replace(b, '[ -]', '', 'g') AS b FROM pairs) SELECT ord_a, ord_b, CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect({_JA}, {_JB})) / (len({_JA}) + len({_JB})), 9) END AS dice FROM j",
)
def dice_joined(spark, sf):
    return part_pairs(spark, sf).select("ord_a", "ord_b", F.round(similarity.dice_joined(F.col("a"), F.col("b")), 9).alias("dice"))


@query(
    "edge_resolution",
    f"WITH {V.ENTRIES_SQL}, e AS (SELECT ord AS student, CASE ord % 3 WHEN 0 THEN 'P' || advisor WHEN 1 THEN upper(native) ELSE 'nobody ' || ord END AS ref FROM entries WHERE advisor IS NOT NULL), n AS (SELECT 'P' || ord AS gid, native AS name FROM entries WHERE ord % 2 = 0), m AS (SELECT lower(name) AS k, min(gid) AS g FROM n GROUP BY 1) SELECT student, coalesce(n.gid, m.g, 'SHADOW::' || ref) AS target, CASE WHEN n.gid IS NOT NULL THEN 'id' WHEN m.g IS NOT NULL THEN 'name' ELSE 'shadow' END AS found FROM e LEFT JOIN n ON ref = n.gid LEFT JOIN m ON lower(ref) = m.k",
)
def edge_resolution(spark, sf):
    e = V.entries(spark, sf)
    o = F.col("ord")
    ref = F.when(o % 3 == 0, F.concat(F.lit("P"), F.col("advisor").cast("string"))).when(o % 3 == 1, F.upper("native")).otherwise(F.concat(F.lit("nobody "), o.cast("string")))
    nodes = e.where("ord % 2 = 0").select(F.concat(F.lit("P"), o.cast("string")).alias("gid"), F.col("native").alias("name"))
    return lineage.resolve(e.where("advisor IS NOT NULL").select(o.alias("student"), ref.alias("ref")), nodes)


@query("coherence_buckets", f"WITH {CLEAN}, x AS (SELECT student AS node FROM clean UNION ALL SELECT advisor FROM clean), s AS (SELECT least(1.0, count(*) / 4.0)::DOUBLE AS s FROM x GROUP BY node) SELECT round(avg(s) FILTER (s > 0), 9) AS mean, count(*) FILTER (s > 0.8) AS high, count(*) FILTER (s > 0.5 AND s <= 0.8) AS medium, count(*) FILTER (s <= 0.5) AS low FROM s")
def coherence_buckets(spark, sf):
    d = lineage.degrees(lineage.clean_edges(V.advisor_edges(spark, sf)))
    return lineage.coherence(d.select(F.least(F.lit(1.0), (F.col("n_out") + F.col("n_in")) / 4).alias("score")))


@query("name_year_join", f"WITH {V.ENTRIES_SQL}, a AS (SELECT ord, native, CASE WHEN ord % 4 = 0 THEN NULL ELSE birth END AS y FROM entries), b AS (SELECT native, CASE WHEN ord % 5 = 0 THEN NULL ELSE birth END AS y, min(ord) AS first, count(*) AS n FROM entries GROUP BY 1, 2) SELECT a.ord, b.first, b.n FROM a JOIN b ON a.native = b.native AND a.y IS NOT DISTINCT FROM b.y")
def name_year_join(spark, sf):
    """Every entry against the index of names and years: one row of the index for each."""
    e, o = V.entries(spark, sf), F.col("ord")
    a = e.select("ord", F.col("native").alias("na"), F.when(o % 4 != 0, F.col("birth")).alias("ya"))
    b = e.groupBy(F.col("native").alias("nb"), F.when(o % 5 != 0, F.col("birth")).alias("yb")).agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    return a.join(b, (F.col("na") == F.col("nb")) & F.col("ya").eqNullSafe(F.col("yb"))).select("ord", "first", "n")


_TAILS = ["", "<script>", "; drop table x", "Ж", "../etc"]


@query("name_security", f"WITH {V.ENTRIES_SQL}, n AS (SELECT ord, native || [{', '.join(repr(t) for t in _TAILS)}][CAST(ord % 5 + 1 AS INTEGER)] AS n FROM entries) SELECT ord, array_to_string(list_filter([CASE WHEN length(n) > 18 THEN 'too_long' END, CASE WHEN regexp_matches(n, '(?i)(<script|javascript:|drop table|union select|\\.\\./)') THEN 'pattern' END, CASE WHEN regexp_matches(n, '[A-Za-z]') AND regexp_matches(n, '[Ѐ-ӿͰ-Ͽ]') THEN 'mixed_script' END], lambda x: x IS NOT NULL), ',') AS threats FROM n")
def name_security(spark, sf):
    t = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("ord") % 5 + 1).cast("int"))
    return V.entries(spark, sf).select("ord", F.array_join(records.name_threats(F.concat("native", t), 18), ",").alias("threats"))


@query("timeline_order", f"WITH {V.ENTRIES_SQL} SELECT ord, birth <= 1900 + ord % 60 AND 1900 + ord % 60 <= 1950 AS ordered FROM entries")
def timeline_order(spark, sf):
    years = F.array(F.col("birth").cast("bigint"), 1900 + F.col("ord") % 60, F.lit(1950).cast("bigint"))
    return V.entries(spark, sf).select("ord", records.timeline_ordered(years).alias("ordered"))


@query("ngram_counts", f"WITH {V.ENTRIES_SQL}, w AS (SELECT native AS n FROM entries), g AS (SELECT unnest(list_transform(range(1, length(n)), lambda i: substr(n, CAST(i AS INTEGER), 2))) AS g FROM w UNION ALL SELECT unnest(list_transform(range(1, length(n) - 1), lambda i: substr(n, CAST(i AS INTEGER), 3))) FROM w) SELECT g AS gram, count(*) AS n FROM g GROUP BY 1")
def ngram_counts(spark, sf):
    return V.entries(spark, sf).select(F.explode(records.ngrams(F.col("native"), 2, 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
