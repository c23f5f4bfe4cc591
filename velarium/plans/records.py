"""Queries: regional rules and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, records
from ..sources import views as V
from .registry import query

NAMES = [
    ("A1", "Knuth, Donald E."), ("A2", "von Neumann, John"), ("A2", "García Márquez, Gabriel"), ("A3", "Jónsdóttir, Anna"), ("A4", "Māhina, Ōkusitino"),
    ("B1", "Chebyshev, Pafnuty Lvovich"), ("B2", "Erdős, Pál"), ("B3", "Chatzidakis, Nikolaos"), ("C1", "Yıldız, Ibrahim"), ("C1", "Hasanoğlu, Ali"),
    ("C2", "Lotfi-zadeh, Ali"), ("C3", "Al-Rashid, Harun"), ("C3", "Abu Kamil, Shuja"), ("C4", "Ahmad bin Ali"), ("C9-ALT", "Məmmədov, Əli"), ("D2", "Ramanujan, Srinivasa"),
    ("E3", "Takagi, Teiji"), ("E4", "Kim, Min-jun"), ("E5", "Đặng, Thái"), ("E7", "Cruz, Juan M."), ("G1", "Don López Pérez, Juan"), ("XX", "Euclid"),
    ("A3", "af Klint, Åsa"), ("C6", "Levy, Dan"), ("C7", "Petrosyan, Ani"), ("C8", "Gelashvili, Nino"), ("C9", "Prof. Petrauskas , Jonas"), ("D1", "Sharma, Asha"), ("D3", "Bose, S."), ("D5", "Perera, Amal"), ("E1", "Wang Wei"), ("E2", "Chan, Ming"), ("H1", "Erasmus"), ("Z0", "x"),
]
_N = "n(region, name) AS (VALUES " + ", ".join(f"('{r}', '{x}')" for r, x in NAMES) + ")"


@query(
    "region_rules",
    f"""WITH {_N}, c AS (SELECT region, name, CASE region WHEN 'A1' THEN regexp_replace(name, '^([^,]+, [^ ]+) [A-Z]\\.$', '\\1') WHEN 'A2' THEN regexp_replace(name, '^(von der|von dem|von|zu|vom|zum) ', '')
      WHEN 'B1' THEN regexp_replace(name, ' [^ ,]+(ovich|evich|ovna|evna|ich)$', '') WHEN 'C3' THEN regexp_replace(name, '^(Ibn|Abu|Um|Umm) ', '') WHEN 'C9-ALT' THEN regexp_replace(name, '[əƏ]', 'a', 'g')
      WHEN 'G1' THEN regexp_replace(name, '^(Don|Doña|Dr\\.|Prof\\.|D\\.) ', '') WHEN 'D1' THEN regexp_replace(name, '[.]$', '') WHEN 'D3' THEN regexp_replace(name, '[.]$', '') WHEN 'C9' THEN trim(regexp_replace(regexp_replace(name, '^Prof[.]', ''), ' , ', ', ')) ELSE name END AS cleaned FROM n),
    k AS (SELECT *, split_part(cleaned, ', ', 1) AS f, split_part(cleaned, ', ', 2) AS g FROM c)
    SELECT region, name, cleaned, CASE WHEN region = 'C3' THEN lower(regexp_replace(cleaned, '^[Aa]l-', '')) WHEN region = 'D2' THEN lower(g || ' ' || f) WHEN region IN ('C6', 'H1') THEN cleaned WHEN region = 'Z0' THEN 'QUARANTINE_' || cleaned WHEN region IN ('C7', 'C8', 'C9') THEN lower(f)
      WHEN region IN ('D1', 'D3', 'D5', 'E1', 'E2') THEN trim(upper(f || ' ' || g)) WHEN region = 'XX' THEN upper(cleaned) WHEN region = 'A3' AND regexp_matches(f, '(son|dóttir|dottir)$') THEN upper(strip_accents(g || ' ' || f))
      WHEN region = 'A3' THEN upper(strip_accents(regexp_replace(f, '^(af|av|von|de la) ', '') || ', ' || g)) ELSE lower(cleaned) END AS order_key,
      CASE WHEN regexp_matches(cleaned, '(son|sson|dóttir|dottir|sen|shvili|dze|[yi]an)(,|$)') THEN 'patronymic' WHEN regexp_matches(cleaned, '^[^ ,]+$') THEN 'mononym' WHEN regexp_matches(cleaned, '^[^ ,]+ [^ ,]+, ') THEN 'dual' ELSE 'plain' END AS kind FROM k""",
)
def region_rules(spark, sf):
    return cleaning.process(spark.createDataFrame(NAMES, "region string, name string")).select("region", "name", "cleaned", "order_key", "kind")


@query("region_variants")
def region_variants(spark, sf):
    return cleaning.process(spark.createDataFrame(NAMES, "region string, name string")).select("region", "name", "variants", "valid")


_F, _G = "split_part(latin, ', ', 1)", "split_part(latin, ', ', 2)"
#: The SQL of each order key on names of one word, a comma and one word.
_KEY_SQL = {
    "sort_plain": "lower(latin)", "sort_particle": "lower(latin)", "sort_article": "lower(latin)", "sort_given_first": f"lower({_G} || ' ' || {_F})", "sort_shouted": f"upper({_F} || ' ' || {_G})",
    "sort_family": f"lower({_F})", "sort_nordic": f"upper({_F} || ', ' || {_G})", "sort_as_is": "latin", "sort_upper": "upper(latin)", "sort_quarantine": "'QUARANTINE_' || latin",
}
_CODES = list(cleaning.REGIONS)
_KEYS = "CASE code " + " ".join(f"WHEN '{r}' THEN {_KEY_SQL[x[3].__name__]}" for r, x in cleaning.REGIONS.items()) + " END"


@query("region_batch", f"WITH {V.ENTRIES_SQL}, c AS (SELECT ord, latin, [{', '.join(repr(r) for r in _CODES)}][CAST(ord % {len(_CODES)} + 1 AS INTEGER)] AS code FROM entries) SELECT ord, code, latin AS cleaned, {_KEYS} AS order_key, 'plain' AS kind, true AS valid FROM c")
def region_batch(spark, sf):
    """Every region's rules over the whole table."""
    e = V.entries(spark, sf).withColumn("code", F.element_at(F.array(*map(F.lit, _CODES)), (F.col("ord") % len(_CODES) + 1).cast("int")))
    return cleaning.process(e, "code", "latin").select("ord", "code", "cleaned", "order_key", "kind", "valid")


TIERS = list(records.LICENCE)
_S = "[" + ", ".join(f"'{t}'" for t in TIERS) + "]"


@query("licence_tier", f"WITH {V.ENTRIES_SQL} SELECT ord, {_S}[CAST(greatest(ord % 5, ord % 3) + 1 AS INTEGER)] AS tier, array_to_string(list_filter([{_S}[CAST(ord % 5 + 1 AS INTEGER)], {_S}[CAST(ord % 3 + 1 AS INTEGER)]], lambda x: x NOT IN ('closed', 'noncommercial')), ',') AS kept FROM entries")
def licence_tier(spark, sf):
    t = F.array(*map(F.lit, TIERS))
    s = F.array(F.element_at(t, (F.col("ord") % 5 + 1).cast("int")), F.element_at(t, (F.col("ord") % 3 + 1).cast("int")))
    return V.entries(spark, sf).select("ord", records.licence_tier(s).alias("tier"), F.array_join(records.scrub(s), ",").alias("kept"))


@query("gdpr_flags", f"WITH {V.ENTRIES_SQL} SELECT ord, (ord % 3 = 0 OR advisor IS NOT NULL) AS personal FROM entries")
def gdpr_flags(spark, sf):
    return V.entries(spark, sf).select("ord", records.is_personal(F.when(F.col("ord") % 3 == 0, F.col("birth")), F.col("advisor"), F.lit("")).alias("personal"))


_DEGREES = ["PhD in mathematics", "Dr. rer. nat.", "Habilitation", "Master of Science", "M.Sc.", "Bachelor", "licence"]


@query(
    "degree_tokens",
    f"WITH {V.ENTRIES_SQL}, r AS (SELECT ord, [{', '.join(repr(d) for d in _DEGREES)}][CAST(ord % 7 + 1 AS INTEGER)] AS raw FROM entries) SELECT ord, raw, CASE " + " ".join(f"WHEN contains(lower(raw), '{w}') THEN '{t}'" for w, t in records.DEGREES) + " END AS degree FROM r",
)
def degree_tokens(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _DEGREES)), (F.col("ord") % 7 + 1).cast("int"))
    return V.entries(spark, sf).select("ord", raw.alias("raw"), records.degree(raw).alias("degree"))


_DOIS = [*records.DOI, "10.9999"]


@query("doi_country", f"WITH {V.ENTRIES_SQL}, d AS (SELECT ord, [[{', '.join(repr(d) for d in _DOIS)}][CAST(ord % 6 + 1 AS INTEGER)], [{', '.join(repr(d) for d in _DOIS)}][CAST(ord % 4 + 1 AS INTEGER)]] AS p FROM entries) SELECT ord, list_filter(list_transform(p, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.DOI.items()) + " END), lambda x: x IS NOT NULL)[1] AS country FROM d")
def doi_country(spark, sf):
    a = F.array(*map(F.lit, _DOIS))
    dois = F.array(*(F.concat(F.element_at(a, (F.col("ord") % n + 1).cast("int")), F.lit("/x")) for n in (6, 4)))
    return V.entries(spark, sf).select("ord", records.doi_country(dois).alias("country"))


PLACES = [("large", "US"), ("small bolt", "DE"), ("widget works", "FR"), ("plate", "GR"), ("green gear", "IT")]


@query(
    "institution_country",
    f"""WITH {V.ENTRIES_SQL}, k(k, c) AS (VALUES {', '.join(map(str, PLACES))}), i AS (SELECT ord, lower(native || CASE WHEN ord % 2 = 0 THEN ' works' ELSE '' END) AS i FROM entries),
    h AS (SELECT ord, c, CASE WHEN i = k THEN 10000 ELSE length(k) END AS len FROM i JOIN k ON i = k OR (length(k) >= 5 AND contains(' ' || i || ' ', ' ' || k || ' ')))
    SELECT ord, arg_max(c, (len, c)) AS country FROM h GROUP BY ord""",
)
def institution_country(spark, sf):
    e = V.entries(spark, sf).withColumn("i", F.concat("native", F.when(F.col("ord") % 2 == 0, " works").otherwise("")))
    return records.institution_country(e, "i", F.broadcast(spark.createDataFrame(PLACES, "name string, country string")), "ord")


@query("affiliation_tiebreak", f"WITH {V.PERSONS_SQL} SELECT ord, CASE WHEN region = 'EU' AND nation = 'FRANCE' THEN 'EU-W' WHEN region = 'EU' AND nation = 'RUSSIA' THEN 'EU-E' ELSE region END AS region FROM persons")
def affiliation_tiebreak(spark, sf):
    pairs = {("EU", "FRANCE"): "EU-W", ("EU", "RUSSIA"): "EU-E"}
    return V.persons(spark, sf).select("ord", records.tiebreak(F.col("region"), F.col("nation"), pairs).alias("region"))


@query("record_problems", f"WITH {V.ENTRIES_SQL}, e AS (SELECT ord, CASE WHEN ord % 9 = 0 THEN '' ELSE latin END AS latin, CASE WHEN ord % 8 = 0 THEN NULL WHEN ord % 13 = 0 THEN 3000 ELSE birth END AS birth, CASE WHEN ord % 7 = 0 THEN 'usa' ELSE country END AS country FROM entries) SELECT ord, array_to_string(list_filter([CASE WHEN latin = '' THEN 'name is missing' END, CASE WHEN birth IS NULL THEN 'year is missing' END, CASE WHEN birth > 2100 THEN 'year is out of range' END, CASE WHEN NOT regexp_matches(country, '^[A-Z]{{2}}$') THEN 'country is malformed' END], lambda x: x IS NOT NULL), ';') AS problems, round((CASE WHEN latin <> '' THEN 1.0 ELSE 0 END + CASE WHEN birth IS NOT NULL THEN 0.5 ELSE 0 END + 0.25) / 1.75, 6)::DOUBLE AS completeness FROM e")
def record_problems(spark, sf):
    o = F.col("ord")
    e = V.entries(spark, sf).select("ord", F.when(o % 9 == 0, "").otherwise(F.col("latin")).alias("latin"), F.when(o % 8 == 0, None).when(o % 13 == 0, 3000).otherwise(F.col("birth")).alias("birth"), F.when(o % 7 == 0, "usa").otherwise(F.col("country")).alias("country"))
    score = records.weighted_completeness({"latin": 1.0, "birth": 0.5, "country": 0.25})
    return e.select("ord", F.array_join(records.problems(F.col("birth"), F.col("latin"), F.col("country")), ";").alias("problems"), F.round(score, 6).alias("completeness"))


@query("call_costs", "WITH c AS (SELECT CASE event_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'basic' ELSE 'deep' END AS tier, count(*) AS calls FROM events GROUP BY 1) SELECT tier, calls, round(CASE tier WHEN 'basic' THEN 0.5 ELSE 4.0 END * calls / 1000, 6)::DOUBLE AS price FROM c WHERE tier <> 'free'")
def call_costs(spark, sf):
    n = F.col("event_id") % 3
    c = V.read(spark, sf, "events").select(F.when(n == 0, "free").when(n == 1, "basic").otherwise("deep").alias("tier"), F.lit(1).alias("calls"))
    return records.costs(c)


@query("result_page", f"WITH {V.ENTRIES_SQL} SELECT ord, latin FROM entries ORDER BY latin, ord LIMIT 25 OFFSET 50")
def result_page(spark, sf):
    return records.page(V.entries(spark, sf).select("ord", "latin"), ["latin", "ord"], 50, 25)


@query("attribution_lines", f"WITH {V.ENTRIES_SQL} SELECT source, 'Data from ' || source || ' (' || count(*) || ' records)' AS line FROM entries GROUP BY source")
def attribution_lines(spark, sf):
    return records.attribution(spark, V.entries(spark, sf))


@query("top_collisions", f"WITH {V.ENTRIES_SQL} SELECT latin, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, latin) AS rank FROM entries GROUP BY latin QUALIFY row_number() OVER (ORDER BY count(*) DESC, latin) <= 10")
def top_collisions(spark, sf):
    from pyspark.sql import Window

    top = V.entries(spark, sf).groupBy("latin").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "latin").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "latin")).cast("bigint"))
