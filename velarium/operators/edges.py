"""Advisor edges as records: extraction, typing, provenance, vetting, and figures of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Confidence of an edge by its source.
SOURCE_CONFIDENCE = {"curated": "verified", "registry": "high", "library": "medium"}
#: Verdicts from best to worst; a relabel stands apart.
TIERS = ["TRUST", "REVIEW", "SUSPECT"]
#: Country, first and last year (null: open), tier, reason: when a country's research degrees were
#: supervised as today, and when not.
REGIMES = [
    ("US", 1880, None, "TRUST", "modern_doctorate"),
    ("DE", 1810, None, "TRUST", "modern_doctorate"),
    ("GB", 1917, None, "TRUST", "modern_doctorate"),
    ("GB", None, 1916, "REVIEW", "before_doctorate"),
    ("RU", 1934, 1991, "REVIEW", "two_step_degrees"),
    ("RU", 1992, None, "TRUST", "modern_doctorate"),
    ("JP", None, 1919, "REVIEW", "degree_by_thesis_alone"),
    ("JP", 1920, None, "TRUST", "modern_doctorate"),
    ("CN", None, 1980, "REVIEW", "no_doctorates"),
    ("CN", 1981, None, "TRUST", "modern_doctorate"),
    ("IT", None, 1979, "REVIEW", "no_doctorates"),
    ("IT", 1980, None, "TRUST", "modern_doctorate"),
]
#: No supervised doctorate existed before.
PREMODERN = 1800
OPEN_LOW, OPEN_HIGH = -9999, 9999


def extract(entries: DataFrame, gid: str = "gid", advisors: str = "advisors") -> DataFrame:
    """(student, name, id, confidence): one row for each advisor of an array of structs (name, id,
    confidence); blank names and null items are left out, a null confidence is 0.9."""
    a = entries.select(F.col(gid).alias("student"), F.explode(advisors).alias("a"))
    return a.where("trim(coalesce(a.name, '')) <> ''").select("student", "a.name", "a.id", F.coalesce("a.confidence", F.lit(0.9)).alias("confidence"))


def typed(names: Column, source: Column, year: Column, relation: str = "doctoral") -> Column:
    """Edges of an array of names: name, source, confidence by source (low if unknown), relation,
    year."""
    known = F.create_map(*(F.lit(x) for kv in SOURCE_CONFIDENCE.items() for x in kv))
    conf = F.coalesce(F.try_element_at(known, source), F.lit("low"))
    plain = F.filter(names, lambda n: F.trim(F.coalesce(n, F.lit(""))) != "")
    return F.transform(plain, lambda n: F.struct(n.alias("name"), source.alias("source"), conf.alias("confidence"), F.lit(relation).alias("relation"), year.alias("year")))


def provenance(sources: Column, student: Column, advisor: Column) -> Column:
    """SHA-1, upper case, over the sorted sources as a Python list of strings, then both ids."""
    inside = F.array_join(F.transform(F.array_sort(sources), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    return F.upper(F.sha1(F.concat(F.lit("["), inside, F.lit("]"), F.coalesce(student, F.lit("")), F.coalesce(advisor, F.lit("")))))


def vet(spark: SparkSession, edges: DataFrame, key: str = "edge") -> DataFrame:
    """edges (key, country, lo, hi, degree, born, advisor_born) with tier and reasons: regimes of
    the country that overlap the years, the worst wins, none or no years is REVIEW; years wholly
    before PREMODERN, or a degree below a doctorate, are to be relabelled; an advisor born after
    the student is SUSPECT. The regimes are a literal table, broadcast."""
    rows = [(c, OPEN_LOW if a is None else a, OPEN_HIGH if b is None else b, TIERS.index(t), r) for c, a, b, t, r in REGIMES]
    table = F.broadcast(spark.createDataFrame(rows, "_c string, _lo int, _hi int, _t int, _r string"))
    j = edges.join(table, (F.col("country") == F.col("_c")) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo")), "left")
    keep = [F.first(c).alias(c) for c in edges.columns if c != key]
    g = j.groupBy(key).agg(*keep, F.max("_t").alias("_t"), F.array_sort(F.collect_set("_r")).alias("_r"))  # a country's regimes are few
    late = F.col("advisor_born") > F.col("born")
    relabel = F.coalesce(F.col("hi") < PREMODERN, F.lit(False)) | F.coalesce(F.lower("degree").rlike("habilitation|master|licentiate"), F.lit(False))
    worst = F.greatest(F.coalesce("_t", F.lit(1)), F.when(late, 2).otherwise(0))
    extra = F.array_compact(F.array(F.when(F.col("hi") < PREMODERN, F.lit("pre_modern")), F.when(late, F.lit("advisor_born_after"))))
    tier = F.when(relabel, "RETYPE").otherwise(F.element_at(F.array(*map(F.lit, TIERS)), worst + 1))
    return g.select(*edges.columns, tier.alias("tier"), F.concat("_r", extra).alias("reasons"))


def vetting_status(edges: DataFrame, derived: list[str], sources: str = "sources", tier: str = "tier") -> DataFrame:
    """Edges with `vetted_by` (independent sources, sorted) and `needs_vetting`: without any, and
    not trusted. Null where no derived source is named, as nothing needs vetting."""
    from_seed = F.arrays_overlap(sources, F.array(*map(F.lit, derived)))
    other = F.array_sort(F.array_except(sources, F.array(*map(F.lit, derived))))
    return edges.withColumn("vetted_by", F.when(from_seed, other)).withColumn("needs_vetting", F.when(from_seed, (F.size(other) == 0) & (F.col(tier) != "TRUST")))


def date_problem(date: Column) -> Column:
    return F.when(F.length(F.coalesce(date, F.lit(""))) < 4, "bad_degree_date")


def figures(nodes: DataFrame, edges: DataFrame, low: float = 0.8) -> DataFrame:
    """One row: nodes, edges, isolated nodes, a tenth of edges by nodes (1 at most), and edges of
    low confidence."""
    ends = edges.select(F.explode(F.array("student", "advisor")).alias("node")).distinct()
    n = nodes.select("node").distinct()
    isolated = n.join(ends, "node", "left_anti").agg(F.count("*").alias("isolated"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") < low).alias("conflicts"))
    j = n.agg(F.count("*").alias("nodes")).join(F.broadcast(e)).join(F.broadcast(isolated))  # one row each
    density = F.round(F.least(F.lit(1.0), 0.1 * F.col("edges") / F.nullif("nodes", F.lit(0))), 9)
    return j.select("nodes", "edges", "isolated", F.coalesce(density, F.lit(0.0)).alias("coherence"), "conflicts")


def hubs(edges: DataFrame, top: int = 1) -> DataFrame:
    """(node, degree) of the nodes with most edges; ties by node."""
    ends = edges.select(F.explode(F.array("student", "advisor")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(top)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, that of the highest version; the new side wins ties."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    row = F.struct(*(F.col(c) for c in old.columns))
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(version, "_side")).alias("r")).select("r.*")


def with_identity(entries: DataFrame, gid: str = "gid") -> DataFrame:
    """One row: share of rows that have an id; 1 for none."""
    return entries.agg(F.round(F.coalesce(F.avg(F.when(F.coalesce(F.col(gid), F.lit("")) != "", 1.0).otherwise(0.0)), F.lit(1.0)), 9).alias("coherence"))


def invariants(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, violations) of the seven rules a genealogy must keep: self loops, edges that lead
    into a cycle, advisors named twice, edges without source or confidence, advisors that are no
    record, records without name or id, ids of several records. records: gid, name; edges:
    student, advisor, source, confidence. Each rule is one aggregate or anti-join."""
    from . import lineage

    def rule(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    e = edges.select("student", "advisor")
    ids = records.where("gid IS NOT NULL").select("gid").distinct()
    parts = [
        rule("self_loop", e.where("student = advisor")),
        rule("cycle", lineage.peel(e.where("student <> advisor"))),
        rule("repeated", e.groupBy("student", "advisor").agg(F.count("*").alias("n")).where("n > 1")),
        rule("provenance", edges.where("coalesce(source, '') = '' OR confidence IS NULL")),
        rule("dangling", e.select("advisor").distinct().join(ids, F.col("advisor") == F.col("gid"), "left_anti")),
        rule("missing_key", records.where("coalesce(name, '') = '' OR gid IS NULL")),
        rule("shared_id", records.where("gid IS NOT NULL").groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
