"""Checks of single records and of batches of them: name resolution, schema, coherence, scores,
reports. Everything is an expression over a row, or a conditional aggregate over rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages and countries that a region is expected to go with.
REGION_LANGUAGES = {
    "A1": ["eng"],
    "A2": ["eng", "fra", "deu", "spa", "ita", "por", "nld"],
    "B1": ["rus", "ukr", "bel"],
    "B2": ["hrv", "srp", "slv", "ces", "pol"],
    "C1": ["tur", "aze", "kaz"],
    "C2": ["fas", "tgk"],
    "C3": ["ara", "heb"],
    "C4": ["ara"],
    "D1": ["hin", "urd"],
    "E1": ["zho", "cmn"],
    "E3": ["jpn"],
    "E4": ["kor"],
    "E5": ["vie"],
}
REGION_COUNTRIES = {
    "A1": ["US", "GB", "CA", "AU", "NZ"],
    "A2": ["FR", "DE", "ES", "IT", "PT", "NL", "BE"],
    "B1": ["RU", "UA", "BY"],
    "E1": ["CN"],
    "E3": ["JP"],
    "E4": ["KR", "KP"],
}
#: Record regions that are spelled out.
REGION_ALIAS = {"A1": "a1_anglo_sphere", "E4": "e4_korea"}


def mapped(values: Mapping[str, object], key: Column) -> Column:
    """Value of a literal map; null where it has none."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def resolve_name(df: DataFrame, primary: str, aliases: list[str]) -> DataFrame:
    """The primary name, else the first alias that is not blank (trimmed); rows without any stay,
    with status `failed`."""
    filled = F.when(F.trim(primary) != "", F.col(primary))
    found = F.coalesce(filled, *(F.nullif(F.trim(a), F.lit("")) for a in aliases))
    return df.withColumn(primary, found).withColumn("status", F.when(found.isNull(), "failed"))


def sanitise(df: DataFrame, gid: str = "gid", old_id: str = "id", region: str = "region") -> DataFrame:
    return df.withColumn(gid, F.coalesce(gid, old_id)).withColumn(region, F.coalesce(mapped(REGION_ALIAS, F.col(region)), region))


def schema_problems(schema: dict) -> Column:
    """Problems of a row against a schema of the keywords required, type (string, integer,
    number, array), pattern, enum, minimum, maximum, minLength, maxLength and maxItems, in the
    schema's order. A type problem is a value that is there but does not read as the type."""
    out: list[Column] = []

    def add(bad: Column, text: str) -> None:
        out.append(F.when(bad, F.lit(text)))

    for name in schema.get("required", ()):
        add(F.col(name).isNull() | (F.col(name).cast("string") == ""), f"{name}: required")
    for name, rule in schema.get("properties", {}).items():
        c = F.col(name)
        kind = rule.get("type")
        if kind in ("integer", "number"):
            number = c.cast("string").try_cast("bigint" if kind == "integer" else "double")
            add(c.isNotNull() & number.isNull(), f"{name}: type")
        else:
            number = c
        for word, bad in (
            ("pattern", lambda v, c=c: ~c.rlike(v)),
            ("enum", lambda v, c=c: ~c.isin(v)),
            ("minimum", lambda v, n=number: n < v),
            ("maximum", lambda v, n=number: n > v),
            ("minLength", lambda v, c=c: F.length(c) < v),
            ("maxLength", lambda v, c=c: F.length(c) > v),
            ("maxItems", lambda v, c=c: F.size(c) > v),
        ):
            if word in rule:
                add(bad(rule[word]), f"{name}: {word}")
    return F.array_compact(F.array(*out))


def share(checks: list[Column]) -> Column:
    """Share of true ones among the checks that are not null; 1 without any."""
    some = F.array_compact(F.array(*checks))
    return F.when(F.size(some) == 0, 1.0).otherwise(F.size(F.filter(some, lambda x: x)) / F.size(some))


def coherence(region: Column, languages: Column, countries: Column, confidence: Column, graph: Column) -> Column:
    """Share of the checks that hold: languages and countries as the region expects them (an
    empty list of languages passes, one of countries is not checked), confidence near the
    graph's score."""
    tongue, land = mapped(REGION_LANGUAGES, region), mapped(REGION_COUNTRIES, region)
    return share(
        [
            F.when(tongue.isNotNull(), (F.size(languages) == 0) | F.arrays_overlap(languages, tongue)),
            F.when(land.isNotNull() & (F.size(countries) > 0), F.arrays_overlap(countries, land)),
            F.abs(F.coalesce(confidence, F.lit(0.0)) - F.coalesce(graph, F.lit(0.0))) <= 0.3,
        ]
    )


def roundtrip(latin: Column, native: Column, transliteration: Column, kinds: Column) -> Column:
    """0 without a Latin name; 0.8 if a native name's transliteration differs from it, else 1; a
    tenth more, up to 1, for each variant of kind `roundtrip`."""
    differs = (native != "") & (native != latin) & (F.lower(transliteration) != F.lower(latin))
    found = F.size(F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: k == "roundtrip"))
    score = F.least(F.lit(1.0), F.when(differs, 0.8).otherwise(1.0) + 0.1 * found)
    return F.when(F.coalesce(latin, F.lit("")) == "", 0.0).otherwise(F.round(score, 6))


def consistency(latin: Column, variants: Column, updated: Column, now: Column, confidence: Column) -> Column:
    """(checks, passed) over: each word's first letter upper or the whole word lower; each variant
    seen for the first time; no update after now; confidence in 0 to 1."""
    words = F.filter(F.split(F.coalesce(latin, F.lit("")), r"\s+"), lambda w: w != "")
    cased = F.filter(words, lambda w: (F.upper(w.substr(1, 1)) == w.substr(1, 1)) & (F.lower(w.substr(1, 1)) != w.substr(1, 1)) | (F.lower(w) == w) & (F.upper(w) != w))
    v = F.coalesce(variants, F.array().cast("array<string>"))
    dated = F.when(updated.isNull(), 0).otherwise(1)
    conf = F.coalesce(confidence, F.lit(0.0)).between(0, 1).cast("int")
    return F.struct(
        (F.size(words) + F.size(v) + dated + 1).alias("checks"),
        (F.size(cased) + F.size(F.array_distinct(v)) + F.when(updated <= now, 1).otherwise(0) + conf).alias("passed"),
    )


def authority_quality(sources: Column) -> Column:
    """Of an array of (confidence, rich): the share of sources with a confidence in 0 to 1, half a
    source more for each rich one, times the least such confidence, up to 1; 0.5 without any."""
    sound = F.filter(sources, lambda s: s["confidence"].between(0, 1))
    least = F.coalesce(F.array_min(F.transform(sound, lambda s: s["confidence"])), F.lit(1.0))
    rich = F.size(F.filter(sources, lambda s: s["rich"]))
    score = F.least(F.lit(1.0), (F.size(sound) + 0.5 * rich) / F.size(sources) * least)
    return F.when(F.size(sources) <= 0, 0.5).otherwise(F.round(score, 6))


def authority_confidence(name: Column, variants: Column, identifiers: Column, affiliations: Column, subjects: Column, birth: Column, countries: Column) -> Column:
    """A tenth to start with; more for a name, variants, up to three identifiers and so on; 1 at
    most. Lists come as their sizes."""
    score = (
        F.lit(0.1) + F.when(F.coalesce(name, F.lit("")) != "", 0.2).otherwise(0.0) + F.when(variants > 0, 0.1).otherwise(0.0) + 0.1 * F.least(identifiers, F.lit(3))
        + F.when(affiliations > 0, 0.1).otherwise(0.0) + F.when(subjects > 0, 0.1).otherwise(0.0) + F.when(birth.isNotNull() & (birth != 0), 0.05).otherwise(0.0) + F.when(countries > 0, 0.05).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), score), 6)


def speed(milliseconds: Column) -> Column:
    """(score, level): 1 less a second's share, error over 1000 ms, warning over 500."""
    ms = F.coalesce(milliseconds, F.lit(0))
    return F.struct(F.round(F.greatest(F.lit(0.0), 1.0 - ms / 1000), 6).alias("score"), F.when(ms > 1000, "error").when(ms > 500, "warning").otherwise("ok").alias("level"))


def batch_summary(rows: DataFrame, passed: str, score: str) -> DataFrame:
    """One row: counts, rate in percent and mean score of a validated batch."""
    n = F.count("*")
    return rows.agg(
        n.alias("n"), F.count_if(passed).alias("passed"), (n - F.count_if(passed)).alias("failed"),
        F.round(F.coalesce(100.0 * F.count_if(passed) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("rate"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("score"),
    )


def field_report(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, coverage in percent), all fields in one pass over the rows."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))
    return one.select("n", F.inline(cells)).select("field", "filled", F.round(F.coalesce(100.0 * F.col("filled") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias("coverage"))


def problem_counts(df: DataFrame, problems: str) -> DataFrame:
    return df.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- names
#: Words that mark made-up names.
TEST_WORDS = ("test", "example", "sample", "dummy", "fake")


def casing(c: Column) -> Column:
    letters = F.upper(c) != F.lower(c)
    titled = F.initcap(F.regexp_replace(c, "[^\\p{L}]+", " ")) == F.regexp_replace(c, "[^\\p{L}]+", " ")
    return F.when(letters & (F.upper(c) == c), "ALL_CAPS").when(letters & (F.lower(c) == c), "all_lower").when(letters & titled, "Title_Case").otherwise("Mixed")


def name_quality(c: Column) -> Column:
    """Between 0 and 1: half, with tenths more or less for length, words, case, signs, digits."""
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    case = casing(c)
    score = (
        F.when(F.length(c).between(5, 100), 0.2).otherwise(-0.3) + F.when(n.between(2, 4), 0.2).when(n == 1, -0.2).when(n > 5, -0.1).otherwise(0.0)
        + F.when(case == "Title_Case", 0.2).when(case == "ALL_CAPS", -0.1).when(case == "all_lower", -0.2).otherwise(0.0)
        + F.when(c.rlike(r"[^\p{L}\p{N}\s,.'\-]"), -0.2).otherwise(0.1) + F.when(c.rlike("[0-9]"), -0.3).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + score)), 6)


def name_risks(c: Column) -> Column:
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    checks = {
        "digits": c.rlike("[0-9]"),
        "signs": c.rlike(r"[^\p{L}\p{N}\s,.'\-]"),
        "short": F.length(c) < 3,
        "long": F.length(c) > 150,
        "parts": n > 6,
        "capitals": casing(c) == "ALL_CAPS",
        "made_up": F.lower(c).rlike("|".join(TEST_WORDS)),
    }
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())))


def dice_bigrams(a: Column, b: Column) -> Column:
    """Dice of the sets of two-letter strings as they are: 0 if either is empty, 1 if neither has
    any."""

    def bigrams(c: Column) -> Column:
        return F.when(F.length(c) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))

    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(total == 0, 1.0).otherwise(F.round(2.0 * F.size(F.array_intersect(x, y)) / total, 9))


def names_near(text: Column, words: list[str], reach: int = 80, most: int = 3) -> Column:
    """Capitalised names, `most` for each hit, within `reach` characters of a word of the lexicon."""
    pattern = "(?i)(?:" + "|".join(words) + ")"
    name = r"[A-Z][A-Za-z\-']+(?:\s+[A-Z][A-Za-z\-']+)*"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern)
    def length(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))

    start = F.transform(hits, lambda h, i: length(F.slice(pieces, F.lit(1), i + 1)) + length(F.slice(hits, F.lit(1), i)))
    windows = F.zip_with(hits, start, lambda h, s: F.substr(text, F.greatest(s - reach, F.lit(0)) + 1, s - F.greatest(s - reach, F.lit(0)) + F.length(h) + reach))
    return F.flatten(F.transform(windows, lambda w: F.slice(F.regexp_extract_all(w, F.lit(name), F.lit(0)), 1, most)))
