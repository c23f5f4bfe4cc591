"""The enrichment of a batch as one plan: names cleaned, ids minted and made unique, regions from
geography and name merged, collisions, short forms and privacy, one row out for each row in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, names
from ..operators import cleaning, collisions, identity
from ..operators import detection as D
from ..sources import views as V
from .detection import _BOTH, _TABLES
from .identity import gid_sql
from .records import _KEY_SQL
from .registry import query


def enrich(entries: DataFrame, cohort: int = 5) -> DataFrame:
    """entries: ord, latin, native, birth, country, and code (sub-national) where there is one.
    Detection is one projection; ids, cohorts and equal names are the only shuffles, and the last
    two join back counts that are aggregated first."""
    e = entries if "code" in entries.columns else entries.withColumn("code", F.lit(None).cast("string"))
    e = e.withColumn("latin", names.squeeze(names.strip_invisible(F.col("latin"))))
    e = identity.suffix(identity.mint(e))
    m = D.merged(D.geography(F.col("country"), F.col("code"), F.col("birth")), D.name_origin(F.col("latin"), F.col("native")))
    d = e.select("ord", "latin", "birth", "unique_gid", F.inline(F.array(m))).withColumnRenamed("region", "detected")
    d = cleaning.process(d, "detected", "latin").drop("kind", "variants")
    d = collisions.mask_birth_years(d, "detected", "birth", cohort)
    same = e.groupBy(F.col("latin").alias("_latin")).agg(F.count("*").alias("_n"))
    d = d.join(same, F.col("latin").eqNullSafe(F.col("_latin")), "left")
    return d.select(
        "ord", F.col("unique_gid").alias("gid"), F.col("cleaned").alias("latin"), "detected", "confidence", "method", "conflict", "grp", "resolution", "order_key", "valid", "birth_text",
        (F.col("_n") > 1).alias("collides"), F.array_join(names.short_form_tags(F.col("cleaned")), ",").alias("tags"), ids.shadow_hash(F.col("latin")).alias("shadow"),
    )


_KEYS = "CASE region " + " ".join(f"WHEN '{r}' THEN {_KEY_SQL[x[3].__name__]}" for r, x in cleaning.REGIONS.items()) + " END"
_SQL = f"""WITH {V.ENTRIES_SQL}, people AS (SELECT ord, latin, split_part(latin, ', ', 1) AS family, split_part(latin, ', ', 2) AS given, native, country, NULL::VARCHAR AS code, birth FROM entries), {_TABLES}, {_BOTH},
  ids AS (SELECT ord, {gid_sql("native || '|' || CAST(birth AS VARCHAR) || '|'")} AS gid FROM entries), n AS (SELECT ord, gid, row_number() OVER (PARTITION BY gid ORDER BY ord) - 1 AS k FROM ids)
  SELECT p.ord, CASE WHEN k = 0 THEN gid ELSE gid || '--' || CAST(k AS VARCHAR) END AS gid, latin, d.region AS detected, confidence, method, conflict, g.g AS grp, resolution, {_KEYS.replace("CASE region", "CASE d.region")} AS order_key, true AS valid,
    CASE WHEN count(birth) OVER (PARTITION BY d.region, birth // 10) < 5 THEN CAST(birth // 10 * 10 AS VARCHAR) || 's' ELSE CAST(birth AS VARCHAR) END AS birth_text, count(*) OVER (PARTITION BY latin) > 1 AS collides, '' AS tags, substr(sha256(latin), 1, 16) AS shadow
  FROM people p JOIN det d ON d.ord = p.ord JOIN n ON n.ord = p.ord LEFT JOIN grps g ON g.r = d.region"""


@query("enrich_entries", _SQL)
def enrich_entries(spark, sf):
    return enrich(V.entries(spark, sf))


@query("region_counts", f"WITH x AS ({_SQL}) SELECT detected, resolution, count(*) AS n, count(*) FILTER (conflict) AS conflicts FROM x GROUP BY 1, 2")
def region_counts(spark, sf):
    return enrich(V.entries(spark, sf)).groupBy("detected", "resolution").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"))
