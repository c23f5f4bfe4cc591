"""Collision and coverage analytics over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members of a short form that are listed, and parts in which a form's members are first cut.
FORM_CAP, FORM_PARTS = 64, 64


def collision_groups(df: DataFrame, key: str, year: str, gid: str) -> DataFrame:
    """Rows of (key, year) groups with more than one id, numbered by id; null years group
    together. proposal is gid--i from the second on, for ids not already numbered."""
    w = Window.partitionBy(key, year)
    j = df.withColumn("n", F.count("*").over(w)).where("n > 1").withColumn("i", F.row_number().over(w.orderBy(gid, "ord")) - 1)
    propose = (F.col("i") > 0) & ~F.col(gid).rlike("--[0-9]+$")
    return j.withColumn("proposal", F.when(propose, F.concat(gid, F.lit("--"), F.col("i").cast("string"))).otherwise(F.col(gid)))


def first_seen(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """df with the order number of the first row of the same key, and whether this row repeats it."""
    w = Window.partitionBy(key)
    return df.withColumn("first_ord", F.min(order).over(w)).withColumn("repeats", F.col(order) > F.col("first_ord"))


def distribution(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, percent, distinct) in one pass: values unpivot before a partial
    aggregation, and distinct values are counted once by field."""
    u = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select("x.*")
    filled = F.col("v").isNotNull() & (F.col("v") != "")
    return u.groupBy("field").agg(F.count_if(filled).alias("filled"), F.round(100.0 * F.count_if(filled) / F.count("*"), 6).alias("percent"), F.count_distinct(F.when(filled, F.col("v"))).alias("distinct_values"))


def severity(n):
    return F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low")


def mask_birth_years(df: DataFrame, region: str, year: str, least: int = 5) -> DataFrame:
    """Years of cohorts (region, decade) under `least` become their decade's label. Cohorts are
    counted by partial aggregation and joined back, so a cohort of any size stays spread out."""
    d = df.withColumn("_decade", F.floor(F.col(year) / 10) * 10)
    sizes = d.groupBy(F.col(region).alias("_r"), F.col("_decade").alias("_d")).agg(F.count(year).alias("_n"))
    d = d.join(sizes, F.col(region).eqNullSafe(F.col("_r")) & F.col("_decade").eqNullSafe(F.col("_d")), "left")
    n = F.col("_n")
    masked = F.when(F.col(year).isNull(), F.lit(None).cast("string")).when(n < least, F.concat(F.col("_decade").cast("int").cast("string"), F.lit("s"))).otherwise(F.col(year).cast("string"))
    return d.withColumn("birth_text", masked).drop("_decade", "_r", "_d", "_n")


def short_forms(df: DataFrame, family: str, given: str, gid: str, cap: int | None = FORM_CAP) -> DataFrame:
    """(form, members, ids): initials, "A. Last" and "Last" forms that two ids or more share;
    the list holds the first `cap` ids in order (None: all of them, which is as long as the form is
    common), the count all of them. Lists are cut by parts first, so a common form's ids do not
    meet in one task."""
    initial = F.upper(F.substr(given, F.lit(1), F.lit(1)))
    forms = F.array(F.concat(initial, F.lit("."), F.upper(F.substr(family, F.lit(1), F.lit(1))), F.lit(".")), F.concat(initial, F.lit(". "), F.col(family)), F.col(family))
    pairs = df.select(F.explode(forms).alias("form"), gid).distinct()
    sizes = pairs.groupBy("form").agg(F.count("*").alias("members")).where("members >= 2")
    kept = pairs
    if cap is not None:
        by_part = Window.partitionBy("form", F.pmod(F.xxhash64(gid), F.lit(FORM_PARTS))).orderBy(gid)
        kept = pairs.withColumn("r", F.row_number().over(by_part)).where(F.col("r") <= cap)
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("form").orderBy(gid))).where(F.col("r") <= cap)
    lists = kept.groupBy("form").agg(F.array_sort(F.collect_list(gid)).alias("ids"))
    return sizes.join(lists, "form").select("form", "members", "ids")


def beta_confidence(sources, weights: dict[str, float], other: float = 0.5):
    """Mean of a Beta(1, 1) prior after the weights of distinct sources."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    d = F.array_distinct(sources)
    return F.aggregate(d, F.lit(1.0), lambda a, s: a + F.coalesce(F.try_element_at(w, s), F.lit(other))) / (F.size(d) + 2)
