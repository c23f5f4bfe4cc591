"""Region inference from small dimension tables. Dimensions are literals of this module or come
in as DataFrames; they are joined, never looped over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import detection

#: Territory to region, sub-national code to region, group of each region: the tables of detection.
TERRITORY = {c: r[0] for c, r in detection.listed(detection.TERRITORIES).items()}
OVERLAY = detection.OVERLAYS
GROUPS = detection.GROUP_OF
#: Country, first and last year (null: open), region, in order of precedence.
DIASPORA = [(c, *detection.interval(years), r) for c, rules in detection.ERAS.items() for years, r in rules]
#: Region, kind (surname, prefix, suffix), pattern, weight.
LEXICON = [
    ("A1", "surname", "widget", 5.0), ("B1", "surname", "bolt", 5.0), ("E1", "surname", "plate", 5.0), ("B2", "prefix", "wid", 3.0),
    ("C2", "suffix", "ing", 2.5), ("E4", "suffix", "et", 2.5), ("B3", "suffix", "olt", 2.5), ("D2", "prefix", "pl", 3.0), ("A3", "suffix", "ate", 2.5),
]
#: Letters that only some groups of languages write.
MARKS = {"europe": "äöüßéèêç", "iberia": "ñáíóú", "slavic": "łčšžř"}


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a literal of this module


def territory(df: DataFrame, country: str = "country") -> DataFrame:
    d = dimension(df.sparkSession, list(TERRITORY.items()), "_c string, _region string")
    return df.join(d, F.col(country) == F.col("_c"), "left").withColumn("geo_region", F.coalesce("_region", F.lit("R0"))).drop("_c", "_region")


def overlay(df: DataFrame, code: str, country: str) -> DataFrame:
    """Region by overlay code, else by territory, with its confidence."""
    o = dimension(df.sparkSession, list(OVERLAY.items()), "_o string, _oregion string")
    j = territory(df, country).join(o, F.col(code) == F.col("_o"), "left")
    found = F.col("_oregion").isNotNull()
    return j.withColumn("region_code", F.coalesce("_oregion", "geo_region")).withColumn("confidence", F.when(found, 0.88).when(F.col("geo_region") != "R0", 0.85).otherwise(0.1)).drop("_o", "_oregion", "geo_region")


def diaspora(df: DataFrame, country: str, year: str, key: str) -> DataFrame:
    """(key, diaspora_region): the first rule of the country whose years hold the birth year."""
    rows = [(c, lo if lo is not None else -9999, hi if hi is not None else 9999, r, i) for i, (c, lo, hi, r) in enumerate(DIASPORA)]
    d = dimension(df.sparkSession, rows, "_c string, _lo int, _hi int, diaspora_region string, _n int")
    j = df.join(d, (F.col(country) == F.col("_c")) & F.col(year).between(F.col("_lo"), F.col("_hi")))
    return j.groupBy(key).agg(F.min_by("diaspora_region", "_n").alias("diaspora_region"))


def merge(geo: Column, geo_conf: Column, name: Column, name_conf: Column) -> Column:
    """Country first, else the name unless it says nothing, else geography; with whether they
    disagree and how far the answer is resolved."""
    by_geo = geo != "R0"
    by_name = name != "R0"
    g = F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv))
    region = F.when(by_geo, geo).when(by_name, name).otherwise(F.lit("R0"))
    return F.struct(
        region.alias("region"),
        F.when(by_geo, geo_conf).when(by_name, name_conf).otherwise(0.1).alias("confidence"),
        (by_geo & by_name & (geo != name)).alias("conflict"),
        F.try_element_at(g, region).alias("grp"),
        F.when(~by_geo & ~by_name, "none").when(F.try_element_at(g, geo) == F.try_element_at(g, name), "leaf").when(by_geo & by_name, "group").otherwise("single").alias("resolution"),
    )


def surname_scores(df: DataFrame, surname: str, key: str) -> DataFrame:
    """(key, region, score): 10 for a surname, 7 for its prefix, 5 for a part of it; the best
    region, ties by code."""
    s = dimension(df.sparkSession, [(r, p) for r, k, p, _ in LEXICON if k == "surname"], "r string, p string")
    w = F.lower(F.col(surname))
    score = F.when(w == F.col("p"), 10).when(w.startswith(F.col("p")), 7).when(F.contains(w, F.col("p")), 5)
    j = df.join(s, F.contains(w, F.col("p"))).select(key, F.col("r").alias("region"), score.alias("score"))
    return j.groupBy(key).agg(F.min_by(F.struct("region", "score"), F.struct(-F.col("score"), F.col("region"))).alias("m")).select(key, "m.region", "m.score")


def rule_scores(df: DataFrame, words: str, key: str, top: int = 5) -> DataFrame:
    """(key, rank, region, score, margin): tokens meet the lexicon by equality on the whole word,
    its prefixes and suffixes, so the join hashes; scores sum by region."""
    spark = df.sparkSession
    lex = dimension(spark, LEXICON, "region string, kind string, pattern string, weight double")
    token = df.select(key, F.explode(F.array_distinct(F.split(F.lower(F.col(words)), "[ ,]+"))).alias("t")).where("t <> ''")
    ends = F.filter(F.sequence(F.lit(2), F.least(F.length("t"), F.lit(8))), lambda n: n <= F.length("t"))
    forms = F.concat(
        F.array(F.struct(F.lit("surname").alias("kind"), F.col("t").alias("pattern"))),
        F.when(F.length("t") >= 2, F.transform(ends, lambda n: F.struct(F.lit("prefix").alias("kind"), F.substr("t", F.lit(1), n).alias("pattern")))).otherwise(F.array()),
        F.when(F.length("t") >= 2, F.transform(ends, lambda n: F.struct(F.lit("suffix").alias("kind"), F.right("t", n).alias("pattern")))).otherwise(F.array()),
    )
    hits = token.select(key, F.explode(forms).alias("f")).select(key, "f.*").join(lex, ["kind", "pattern"])
    s = hits.groupBy(key, "region").agg(F.round(F.sum("weight"), 3).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "region")
    r = s.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.round(F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)), 3))
    return r.where(F.col("rank") <= top)


def letter_group(c: Column) -> Column:
    """The one group whose letters occur; none if several or no group's do."""
    hits = F.array_compact(F.array(*(F.when(F.lower(c).rlike(f"[{m}]"), F.lit(g)) for g, m in MARKS.items())))
    return F.when(F.size(hits) == 1, hits[0])


def log_odds(counts: DataFrame, feature: str, leaf: str, n: str, least: int = 3) -> DataFrame:
    """(feature, leaf, weight): smoothed log-odds of a feature in a leaf against all others,
    clipped to 0.8; weak ones and rare features are left out."""
    by_f, by_l = Window.partitionBy(feature), Window.partitionBy(leaf)
    d = counts.withColumn("f", F.sum(n).over(by_f)).withColumn("t", F.sum(n).over(by_l))
    total = counts.agg(F.sum(n).alias("all"))
    d = d.join(F.broadcast(total)).where(F.col(n) >= least)
    a = (F.col(n) + 0.5) / (F.col("t") - F.col(n) + 0.5)
    b = (F.col("f") - F.col(n) + 0.5) / (F.col("all") - F.col("t") - F.col("f") + F.col(n) + 0.5)
    w = F.round(F.greatest(F.lit(-0.8), F.least(F.lit(0.8), F.log(a / b) * (F.lit(1.0) - F.lit(1.0) / (F.col(n) + 1)))), 3)
    return d.select(feature, leaf, w.alias("weight")).where(F.abs("weight") >= 0.1)
