"""Checks and derived fields of single records, and small summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources by how far their licence restricts use.
LICENCE = {"open": 0, "attribution": 1, "sharealike": 2, "noncommercial": 3, "closed": 4}
#: Sources whose content must not leave.
SCRUBBED = ("closed", "noncommercial")
#: Degree words, the first that occurs wins.
DEGREES = [("habilit", "habilitation"), ("phd", "doctorate"), ("ph.d", "doctorate"), ("doctor", "doctorate"), ("dr.", "doctorate"), ("master", "master"), ("m.sc", "master"), ("bachelor", "bachelor")]
#: DOI registrant to country.
DOI = {"10.1007": "DE", "10.1016": "NL", "10.1090": "US", "10.1112": "GB", "10.2969": "JP"}
#: Price of a thousand calls.
PRICES = {"free": 0.0, "basic": 0.5, "deep": 4.0}


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def licence_tier(sources: Column) -> Column:
    """Most restrictive tier of the sources; null without any."""
    rank = F.array_max(F.transform(sources, lambda s: F.try_element_at(_map(LICENCE), s)))
    return F.try_element_at(_map({v: k for k, v in LICENCE.items()}), rank)


def scrub(sources: Column) -> Column:
    return F.filter(sources, lambda s: ~s.isin(*SCRUBBED))


def is_personal(*fields: Column) -> Column:
    """Whether any personal field is filled."""
    return F.exists(F.array(*(f.cast("string") for f in fields)), lambda x: x.isNotNull() & (x != ""))


def degree(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, token in DEGREES:
        out = out.when(F.contains(F.lower(c), F.lit(word)), token)
    return out


def doi_country(dois: Column) -> Column:
    """Country of the first DOI whose registrant is known."""
    return F.try_element_at(F.array_compact(F.transform(dois, lambda d: F.try_element_at(_map(DOI), F.split_part(d, F.lit("/"), F.lit(1))))), F.lit(1))


def institution_country(df: DataFrame, institution: str, known: DataFrame, key: str) -> DataFrame:
    """(key, country): an institution's country by its name, else by the longest known name of
    five letters or more that it holds as whole words. Known names meet by equality on the
    words they start with, so the second step is a hash join too. known: (name, country)."""
    n = known.select(F.lower("name").alias("k"), "country")
    d = df.select(key, F.trim(F.lower(F.regexp_replace(institution, r"[^\p{L} ]", " "))).alias("i"))
    exact = d.join(n, F.col("i") == F.col("k")).select(key, "country", F.lit(10_000).alias("len"))
    word = d.select(key, "i", F.explode(F.array_distinct(F.split("i", " +"))).alias("w"))
    part = word.join(n.where("length(k) >= 5").withColumn("w", F.split_part("k", F.lit(" "), F.lit(1))), "w")
    part = part.where(F.contains(F.concat(F.lit(" "), "i", F.lit(" ")), F.concat(F.lit(" "), "k", F.lit(" ")))).select(key, "country", F.length("k").alias("len"))
    return exact.unionByName(part).groupBy(key).agg(F.max_by("country", F.struct("len", "country")).alias("country"))


def tiebreak(region: Column, affiliation: Column, pairs: dict[tuple[str, str], str]) -> Column:
    """Moves a region within its confusable set where the first affiliation's country says so."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for (r, country), to in pairs.items():
        out = out.when((region == r) & (affiliation == country), to)
    return F.coalesce(out, region)


def problems(year: Column, name: Column, country: Column, first: int = -2000, last: int = 2100) -> Column:
    """Messages of the required, range and enumeration checks."""
    return F.array_compact(
        F.array(
            F.when(name.isNull() | (name == ""), "name is missing"),
            F.when(year.isNull(), "year is missing"),
            F.when((year < first) | (year > last), "year is out of range"),
            F.when(~country.rlike("^[A-Z]{2}$"), "country is malformed"),
        )
    )


def weighted_completeness(weights: dict[str, float]) -> Column:
    filled = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return filled / sum(weights.values())


def costs(calls: DataFrame) -> DataFrame:
    """(tier, calls, price) from (tier, calls); free ones are left out."""
    price = F.try_element_at(_map(PRICES), F.col("tier"))
    return calls.groupBy("tier").agg(F.sum("calls").alias("calls")).withColumn("price", F.round(price * F.col("calls") / 1000, 6)).where("price > 0")


def page(df: DataFrame, order: list, offset: int, limit: int, most: int = 10_000) -> DataFrame:
    """One page of a total order, `most` rows at most."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def attribution(spark: SparkSession, sources: DataFrame) -> DataFrame:
    return sources.groupBy("source").agg(F.count("*").alias("n")).select("source", F.concat(F.lit("Data from "), "source", F.lit(" ("), F.col("n").cast("string"), F.lit(" records)")).alias("line"))


#: Signs of markup, queries, paths and code in a name.
SUSPICIOUS = r"(?i)(<script|javascript:|drop table|union select|\.\./|\$\{|--;|/\*)"


def name_threats(c: Column, most: int = 150) -> Column:
    """Names of the security checks that a name fails."""
    return F.array_compact(
        F.array(
            F.when(F.length(c) > most, F.lit("too_long")),
            F.when(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.lit("control")),
            F.when(c.rlike(SUSPICIOUS), F.lit("pattern")),
            F.when(c.rlike("[A-Za-z]") & c.rlike(r"[\x{0400}-\x{04FF}\x{0370}-\x{03FF}]"), F.lit("mixed_script")),
        )
    )


def timeline_ordered(years: Column) -> Column:
    """Whether no year of the array is below the one before it."""
    return F.forall(F.zip_with(F.slice(years, F.lit(1), F.greatest(F.size(years) - 1, F.lit(0))), F.slice(years, F.lit(2), F.greatest(F.size(years) - 1, F.lit(0))), lambda a, b: F.coalesce(a <= b, F.lit(True))), lambda x: x)


def ngrams(c: Column, least: int, most: int) -> Column:
    """Character n-grams of all lengths from least to most."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(c) - (n - 1))
        return F.when(F.length(c) >= n, F.transform(at, lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(of, range(least, most + 1))))
