"""Queries: names resolved on input, schema and coherence checks, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as v
from ..sources import views as V
from .registry import query

CODES = ["A1", "A2", "B1", "C1", "E1", "E3", "G1"]
TONGUES = ["eng", "deu", "rus", "tur", "zho", "jpn"]


def _pick(values: list, k: str) -> str:
    """The same in both dialects: one of the values by a number."""
    return "CASE " + " ".join(f"WHEN {k} = {i} THEN {x}" for i, x in enumerate(values)) + " END"


_FIELDS = f"""ord, latin, native, birth, country, {_pick([repr(c) for c in CODES], "ord % 7")} AS region, {_pick([repr(c) for c in TONGUES], "ord % 6")} AS tongue,
  CAST(ord % 23 AS DOUBLE) / 20 AS confidence, CAST(ord % 11 AS DOUBLE) / 10 AS graph, CAST(ord % 1300 AS INTEGER) AS ms,
  CASE WHEN ord % 4 = 0 THEN '  ' WHEN ord % 4 = 1 THEN NULL ELSE latin END AS primary_name, CASE WHEN ord % 3 = 0 THEN ' ' || native || ' ' END AS full_name, CASE WHEN ord % 5 = 0 THEN native ELSE '' END AS display_name"""
RECORDS_SQL = f"{V.ENTRIES_SQL}, records AS (SELECT {_FIELDS} FROM entries)"


def records(spark, sf):
    """Entries with fields to check, some of them missing or wrong."""
    return V.entries(spark, sf).selectExpr(*[x.strip() for x in _split(_FIELDS)])


def _split(fields: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(fields):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(fields[at:i])
            at = i + 1
    return [*out, fields[at:]]


def _sql(body: str) -> str:
    return f"WITH {RECORDS_SQL} {body}"


def _map(d: dict[str, list[str]]) -> str:
    return "CASE region " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in x_)}]" for k, x_ in d.items()) + " END"


@query("input_names", _sql("SELECT ord, coalesce(CASE WHEN trim(primary_name) <> '' THEN primary_name END, nullif(trim(full_name), ''), nullif(trim(display_name), '')) AS name, CASE WHEN coalesce(nullif(trim(primary_name), ''), nullif(trim(full_name), ''), nullif(trim(display_name), '')) IS NULL THEN 'failed' END AS status FROM records"))
def input_names(spark, sf):
    return v.resolve_name(records(spark, sf), "primary_name", ["full_name", "display_name"]).select("ord", F.col("primary_name").alias("name"), "status")


@query("sanitised", _sql("SELECT ord, coalesce(CASE WHEN ord % 2 = 0 THEN 'G' || ord END, 'I' || ord) AS gid, CASE region WHEN 'A1' THEN 'a1_anglo_sphere' WHEN 'E4' THEN 'e4_korea' ELSE region END AS region FROM records"))
def sanitised(spark, sf):
    r = records(spark, sf).selectExpr("ord", "region", "CASE WHEN ord % 2 = 0 THEN concat('G', ord) END AS gid", "concat('I', ord) AS id")
    return v.sanitise(r).select("ord", "gid", "region")


SCHEMA = {
    "required": ["primary_name", "region"],
    "properties": {
        "region": {"type": "string", "enum": CODES[:5]},
        "birth": {"type": "integer", "minimum": 1905, "maximum": 1945},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "country": {"type": "string", "pattern": "^[A-H]"},
        "full_name": {"type": "integer", "minLength": 12, "maxLength": 15},
    },
}


@query(
    "schema_problems",
    _sql(f"""SELECT ord, array_to_string(list_filter([CASE WHEN primary_name IS NULL OR primary_name = '' THEN 'primary_name: required' END, CASE WHEN region IS NULL THEN 'region: required' END,
      CASE WHEN region NOT IN ({", ".join(repr(c) for c in CODES[:5])}) THEN 'region: enum' END, CASE WHEN birth < 1905 THEN 'birth: minimum' END, CASE WHEN birth > 1945 THEN 'birth: maximum' END,
      CASE WHEN confidence > 1 THEN 'confidence: maximum' END, CASE WHEN NOT regexp_matches(country, '^[A-H]') THEN 'country: pattern' END,
      CASE WHEN full_name IS NOT NULL AND TRY_CAST(full_name AS BIGINT) IS NULL THEN 'full_name: type' END, CASE WHEN length(full_name) < 12 THEN 'full_name: minLength' END,
      CASE WHEN length(full_name) > 15 THEN 'full_name: maxLength' END], lambda x: x IS NOT NULL), '; ') AS problems FROM records"""),
)
def schema_problems(spark, sf):
    return records(spark, sf).select("ord", F.array_join(v.schema_problems(SCHEMA), "; ").alias("problems"))


_STRICT = "CASE ord % 4 WHEN 0 THEN '2024-05-01T10:00:00' WHEN 1 THEN '2024-05-01' WHEN 2 THEN 'yesterday' END"


@query("strict_dates", _sql(f"SELECT ord, TRY_CAST({_STRICT} AS TIMESTAMP) IS NOT NULL AS dated, ({_STRICT} IS NULL OR TRY_CAST({_STRICT} AS TIMESTAMP) IS NOT NULL) AND trim(coalesce(primary_name, '')) <> '' AND birth BETWEEN 1000 AND 2100 AS ok FROM records"))
def strict_dates(spark, sf):
    when = F.expr(_STRICT)
    at = F.try_to_timestamp(when)
    return records(spark, sf).select("ord", at.isNotNull().alias("dated"), ((when.isNull() | at.isNotNull()) & (F.trim(F.coalesce("primary_name", F.lit(""))) != "") & F.col("birth").between(1000, 2100)).alias("ok"))


_CHECKS = f"""[CASE WHEN ({_map(v.REGION_LANGUAGES)}) IS NOT NULL THEN ord % 5 = 0 OR list_contains({_map(v.REGION_LANGUAGES)}, tongue) END,
      CASE WHEN ({_map(v.REGION_COUNTRIES)}) IS NOT NULL THEN list_contains({_map(v.REGION_COUNTRIES)}, country) END, abs(confidence - graph) <= 0.3]"""


@query("coherence_score", _sql(f"SELECT ord, round(len(list_filter({_CHECKS}, lambda x: x)) / len(list_filter({_CHECKS}, lambda x: x IS NOT NULL)), 6) AS score FROM records"))
def coherence_score(spark, sf):
    tongues = F.when(F.col("ord") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("tongue"))
    s = v.coherence(F.col("region"), tongues, F.array("country"), F.col("confidence"), F.col("graph"))
    return records(spark, sf).select("ord", F.round(s, 6).alias("score"))


@query("roundtrip_score", _sql("SELECT ord, CASE WHEN primary_name IS NULL OR primary_name = '' THEN 0.0 ELSE round(least(1.0, (CASE WHEN native <> '' AND native <> primary_name AND lower(coalesce(full_name, primary_name)) <> lower(primary_name) THEN 0.8 ELSE 1.0 END) + 0.1 * (ord % 3)), 6) END::DOUBLE AS score FROM records"))
def roundtrip_score(spark, sf):
    kinds = F.array_repeat(F.lit("roundtrip"), (F.col("ord") % 3).cast("int"))
    return records(spark, sf).select("ord", v.roundtrip(F.col("primary_name"), F.col("native"), F.coalesce("full_name", "primary_name"), kinds).alias("score"))


_VARIANTS = ("array(native, latin, CASE WHEN ord % 2 = 0 THEN native ELSE 'x' END)", "[native, latin, CASE WHEN ord % 2 = 0 THEN native ELSE 'x' END]")


@query(
    "consistency_checks",
    _sql(f"""SELECT ord, len(regexp_extract_all(latin, '[^ ]+')) + 3 + 1 + 1 AS checks,
      len(list_filter(regexp_extract_all(latin, '[^ ]+'), lambda w: regexp_matches(w, '^[A-Z]') OR (lower(w) = w AND upper(w) <> w))) + len(list_distinct({_VARIANTS[1]}))
      + (CASE WHEN birth <= 1930 THEN 1 ELSE 0 END) + (CASE WHEN confidence BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS passed FROM records"""),
)
def consistency_checks(spark, sf):
    return records(spark, sf).select("ord", F.inline(F.array(v.consistency(F.col("latin"), F.expr(_VARIANTS[0]), F.col("birth"), F.lit(1930), F.col("confidence")))))


@query(
    "authority_quality",
    _sql("""SELECT ord, CASE WHEN ord % 4 = 0 THEN 0.5 ELSE round(least(1.0, ((CASE WHEN confidence <= 1 THEN 1 ELSE 0 END) + 1 + 0.5 * (ord % 2)) / 2 * least(0.9, CASE WHEN confidence <= 1 THEN confidence ELSE 0.9 END)), 6) END::DOUBLE AS score FROM records"""),
)
def authority_quality(spark, sf):
    both = F.array(F.struct(F.col("confidence").alias("confidence"), (F.col("ord") % 2 == 1).alias("rich")), F.struct(F.lit(0.9).alias("confidence"), F.lit(False).alias("rich")))
    return records(spark, sf).select("ord", v.authority_quality(F.when(F.col("ord") % 4 != 0, both).otherwise(F.slice(both, 1, 0))).alias("score"))


@query("authority_confidence", _sql("SELECT ord, round(least(1.0, 0.1 + 0.2 + (CASE WHEN ord % 2 > 0 THEN 0.1 ELSE 0 END) + 0.1 * least(ord % 5, 3) + (CASE WHEN ord % 3 > 0 THEN 0.1 ELSE 0 END) + 0.05 + 0.05), 6)::DOUBLE AS score FROM records"))
def authority_confidence(spark, sf):
    k = F.col("ord")
    return records(spark, sf).select("ord", v.authority_confidence(F.col("latin"), k % 2, k % 5, k % 3, F.lit(0), F.col("birth"), F.lit(1)).alias("score"))


@query("performance_gate", _sql("SELECT ord, round(greatest(0.0, 1.0 - ms / 1000.0), 6)::DOUBLE AS score, CASE WHEN ms > 1000 THEN 'error' WHEN ms > 500 THEN 'warning' ELSE 'ok' END AS level FROM records"))
def performance_gate(spark, sf):
    return records(spark, sf).select("ord", F.inline(F.array(v.speed(F.col("ms")))))


@query("batch_validation", _sql("SELECT count(*) AS n, count(*) FILTER (confidence >= 0.5) AS passed, count(*) FILTER (confidence < 0.5) AS failed, round(100.0 * count(*) FILTER (confidence >= 0.5) / count(*), 6) AS rate, round(avg(confidence), 6) AS score FROM records"))
def batch_validation(spark, sf):
    return v.batch_summary(records(spark, sf).withColumn("ok", F.col("confidence") >= 0.5), "ok", "confidence")


@query("field_report", _sql(" UNION ALL ".join((("SELECT " if i else "SELECT ") + f"'{f}' AS field, count(*) FILTER ({f} <> '') AS filled, round(100.0 * count(*) FILTER ({f} <> '') / count(*), 6) AS coverage FROM records") for i, f in enumerate(("primary_name", "full_name", "display_name")))))
def field_report(spark, sf):
    return v.field_report(records(spark, sf), ["primary_name", "full_name", "display_name"])


@query("problem_counts", _sql("SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN birth > 1945 THEN 'birth: maximum' END, CASE WHEN confidence > 1 THEN 'confidence: maximum' END]) AS problem FROM records) WHERE problem IS NOT NULL GROUP BY problem"))
def problem_counts(spark, sf):
    rules = {"properties": {"birth": {"maximum": 1945}, "confidence": {"maximum": 1}}}
    return v.problem_counts(records(spark, sf).select(v.schema_problems(rules).alias("problems")), "problems")


# ---------------------------------------------------------------- names
_NAME = "CASE ord % 9 WHEN 0 THEN upper(native) WHEN 1 THEN native WHEN 2 THEN latin || ' 3' WHEN 3 THEN '#' || native WHEN 4 THEN 'Test Person' WHEN 5 THEN 'Li' WHEN 6 THEN 'Anna Maria' WHEN 7 THEN 'One Two Three Four Five Six Seven' ELSE 'Al' END"
_NAMED = RECORDS_SQL + f", named AS (SELECT ord, {_NAME} AS name, native, latin FROM records)"
_CASE = r"CASE WHEN upper(name) = name AND lower(name) <> name THEN 'ALL_CAPS' WHEN lower(name) = name AND upper(name) <> name THEN 'all_lower' WHEN len(list_filter(regexp_extract_all(name, '[A-Za-z]+'), lambda w: NOT regexp_matches(w, '^[A-Z][a-z]*$'))) = 0 THEN 'Title_Case' ELSE 'Mixed' END"
_NW = "len(regexp_extract_all(name, '[^ ]+'))"
_SIGNS = "regexp_matches(name, '[^A-Za-z0-9 ,.''-]')"


def named(spark, sf):
    return records(spark, sf).selectExpr("ord", f"{_NAME} AS name", "native", "latin")


@query(
    "name_quality",
    f"""WITH {_NAMED}, c AS (SELECT ord, name, {_CASE} AS casing FROM named) SELECT ord, casing, round(greatest(0.0, least(1.0, 0.5 + (CASE WHEN length(name) BETWEEN 5 AND 100 THEN 0.2 ELSE -0.3 END)
      + (CASE WHEN {_NW} BETWEEN 2 AND 4 THEN 0.2 WHEN {_NW} = 1 THEN -0.2 WHEN {_NW} > 5 THEN -0.1 ELSE 0 END) + (CASE casing WHEN 'Title_Case' THEN 0.2 WHEN 'ALL_CAPS' THEN -0.1 WHEN 'all_lower' THEN -0.2 ELSE 0 END)
      + (CASE WHEN {_SIGNS} THEN -0.2 ELSE 0.1 END) + (CASE WHEN regexp_matches(name, '[0-9]') THEN -0.3 ELSE 0 END))), 6)::DOUBLE AS score FROM c""",
)
def name_quality(spark, sf):
    return named(spark, sf).select("ord", v.casing(F.col("name")).alias("casing"), v.name_quality(F.col("name")).alias("score"))


@query(
    "name_risks",
    f"""WITH {_NAMED} SELECT ord, array_to_string(list_filter([CASE WHEN regexp_matches(name, '[0-9]') THEN 'digits' END, CASE WHEN {_SIGNS} THEN 'signs' END, CASE WHEN length(name) < 3 THEN 'short' END, CASE WHEN length(name) > 150 THEN 'long' END,
      CASE WHEN {_NW} > 6 THEN 'parts' END, CASE WHEN upper(name) = name AND lower(name) <> name THEN 'capitals' END, CASE WHEN regexp_matches(lower(name), 'test|example|sample|dummy|fake') THEN 'made_up' END], lambda x: x IS NOT NULL), ',') AS risks FROM named""",
)
def name_risks(spark, sf):
    return named(spark, sf).select("ord", F.array_join(v.name_risks(F.col("name")), ",").alias("risks"))


_B = "CASE WHEN length({0}) > 1 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) ELSE [] END"


@query(
    "dice_as_written",
    f"WITH {_NAMED}, b AS (SELECT ord, {_B.format('name')} AS x, {_B.format('native')} AS y FROM named) SELECT ord, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9)::DOUBLE AS dice FROM b",
)
def dice_as_written(spark, sf):
    return named(spark, sf).select("ord", v.dice_bigrams(F.col("name"), F.col("native")).alias("dice"))


@query(
    "names_near",
    f"""WITH {_NAMED}, t AS (SELECT ord, 'Thesis advisor: Anna Berg and Carl Dahl, see ' || native || '. Supervisor ' || latin AS text FROM named)
    SELECT ord, 'Thesis,Anna Berg,Carl Dahl,' || array_to_string(regexp_extract_all(substr(text, greatest(strpos(text, 'Supervisor') - 80, 1)), '[A-Z][A-Za-z''-]+(?:\\s+[A-Z][A-Za-z''-]+)*')[:3], ',') AS names FROM t""",
)
def names_near(spark, sf):
    text = F.concat(F.lit("Thesis advisor: Anna Berg and Carl Dahl, see "), "native", F.lit(". Supervisor "), "latin")
    return named(spark, sf).select("ord", F.array_join(v.names_near(text, ["advisor", "supervisor"]), ",").alias("names"))
