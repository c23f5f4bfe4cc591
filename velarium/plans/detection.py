"""Queries: region detection over entries that bear real names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection as D
from ..sources import views as V
from .registry import query

FAMILY = (
    "Smith Müller Andersson Ivanov Kowalski Papadopoulos Yilmaz Hosseini Haddad Cohen Petrosyan Gelashvili Kazlauskas Sharma Iyer Banerjee Khan Perera Wang Chan Sato Kim Nguyen Reyes Okafor "
    "Garcia Sokolova Zielinski Grabowski Karimzadeh Lewansky Tamosaitis Somebody Chen Rao Rahman Thorsson Bergmann Economou Singh"
).split() + ["de la Cruz", "van Dijk", "김"]
GIVEN = ["Robert", "Maria", "Ivan", "Min-jun", "Jan", "Reza", "Xyz", "Wei", "Hans", "Carlos", "민준", "Kenji", "Anne-Marie"]
COUNTRIES = ["US", "DE", "TH", "CN", "XX", "RU", "TH", "IN", "BR", "GB", "lt", "GR", "EG", "KE", "VN", "NL", "KR"]
CODES = ["CH-FR", "", "LK-TA", "zz", " IN-WB "]


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _sql_pick(values: list[str], k: str) -> str:
    return f"[{_list(values)}][CAST({k} % {len(values)} AS INTEGER) + 1]"


PEOPLE_SQL = f"""{V.ENTRIES_SQL}, people AS (SELECT ord, {_sql_pick(FAMILY, "ord")} || ', ' || {_sql_pick(GIVEN, "ord // 7")} AS latin, {_sql_pick(FAMILY, "ord")} AS family, {_sql_pick(GIVEN, "ord // 7")} AS given,
  native, {_sql_pick(COUNTRIES, "ord")} AS country, CASE WHEN ord % 6 = 0 THEN {_sql_pick(CODES, "ord // 6")} END AS code, birth + CAST(ord % 3 AS INTEGER) * 40 AS birth FROM entries)"""


def people(spark, sf):
    def pick(values: list[str], k: str):
        return F.element_at(F.array(*map(F.lit, values)), (F.expr(k) % len(values) + 1).cast("int"))

    e = V.entries(spark, sf)
    family, given = pick(FAMILY, "ord"), pick(GIVEN, "ord div 7")
    code = F.when(F.col("ord") % 6 == 0, pick(CODES, "ord div 6"))
    return e.select("ord", F.concat(family, F.lit(", "), given).alias("latin"), "native", pick(COUNTRIES, "ord").alias("country"), code.alias("code"), (F.col("birth") + (F.col("ord") % 3).cast("int") * 40).alias("birth"))


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TABLES = ", ".join([
    "terr(c, r) AS (" + _values([(c, r[0]) for c, r in D.listed(D.TERRITORIES).items()]) + ")",
    "over(c, r) AS (" + _values(list(D.OVERLAYS.items())) + ")",
    "grps(r, g) AS (" + _values(list(D.GROUP_OF.items())) + ")",
    "lex_s(w, r, x) AS (" + _values([(w, r, D.W_SURNAME * D.SHARED.get((r, w), 1.0)) for w, rs in D.listed(D.SURNAMES).items() for r in rs]) + ")",
    "lex_g(w, r, x) AS (" + _values([(w, r, D.W_GIVEN / len(rs)) for w, rs in D.listed(D.GIVEN).items() for r in rs]) + ")",
    "ends(e, r, x) AS (" + _values([(e, r, x) for e, hits in D.endings() for r, x in hits]) + ")",
    "own(w, r) AS (" + _values([(w, rs[0]) for w, rs in D.listed(D.SURNAMES).items() if len(rs) == 1 and not any(k[1] == w for k in D.SHARED)]) + ")",
])
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}''-]+')"
_TOKENS = f"""st AS (SELECT DISTINCT ord, unnest({_WORDS.format("family")}) AS w FROM people), g0 AS (SELECT ord, unnest({_WORDS.format("given")}) AS w FROM people),
  gt AS (SELECT DISTINCT ord, w FROM (SELECT ord, w FROM g0 UNION ALL SELECT ord, unnest(string_split(w, '-')) FROM g0 WHERE contains(w, '-')))"""
_SCORES = f"""{_TOKENS}, en AS (SELECT ord, w, max(length(e)) AS n FROM st JOIN ends ON ends_with(w, e) AND length(w) > length(e) + 1 GROUP BY ord, w),
  hits AS (SELECT ord, r, x FROM st JOIN lex_s USING (w) UNION ALL SELECT ord, r, x FROM gt JOIN lex_g USING (w) UNION ALL SELECT ord, r, x FROM en JOIN ends ON ends_with(w, e) AND length(e) = n
    UNION ALL SELECT DISTINCT ord, 'E4', 2.5 FROM gt WHERE regexp_matches(w, '^\\p{{L}}+-\\p{{L}}+$')),
  sums AS (SELECT ord, r, round(sum(x), 3) AS s, row_number() OVER (PARTITION BY ord ORDER BY round(sum(x), 3) DESC, r) AS k FROM hits GROUP BY ord, r),
  best AS (SELECT a.ord, a.s AS score, round(a.s - coalesce(b.s, 0), 3) AS margin, CASE WHEN a.s >= 2.0 AND round(a.s - coalesce(b.s, 0), 3) >= 0.5 THEN a.r END AS region FROM sums a LEFT JOIN sums b ON a.ord = b.ord AND b.k = 2 WHERE a.k = 1)"""
_HYBRID = "hy AS (SELECT ord, [" + ", ".join(f"'{w}'" for w in D.GIVEN["A1"].split()) + "] AS west FROM people), hyb AS (SELECT ord, min(r) AS r FROM st JOIN (SELECT w, r FROM lex_s WHERE r IN ('E1', 'E4')) USING (w) WHERE ord IN (SELECT ord FROM gt WHERE w IN (" + _list(D.GIVEN["A1"].split()) + ")) GROUP BY ord)"
_ORIGIN = f"""{_SCORES}, {_HYBRID}, origin AS (SELECT p.ord, CASE WHEN regexp_matches(p.latin || ' ' || p.native, '[\\x{{AC00}}-\\x{{D7AF}}\\x{{1100}}-\\x{{11FF}}]') THEN ['E4', 'script'] WHEN o.r IS NOT NULL THEN [o.r, 'surname'] WHEN h.r IS NOT NULL THEN [h.r, 'hybrid']
    WHEN b.region IS NOT NULL THEN [b.region, 'scorer'] ELSE ['R0', 'none'] END AS a, b.score FROM people p LEFT JOIN own o ON o.w = array_to_string({_WORDS.format("p.family")}, ' ') LEFT JOIN hyb h ON h.ord = p.ord LEFT JOIN best b ON b.ord = p.ord)"""
_NAME = f"{_ORIGIN}, nm AS (SELECT ord, a[1] AS region, CASE a[2] WHEN 'scorer' THEN round(least(0.9, 0.6 + 0.04 * score), 6) WHEN 'none' THEN 0.1 ELSE 0.95 END::DOUBLE AS confidence, a[2] AS method FROM origin)"
_GEO = """ge AS (SELECT ord, CASE WHEN o.r IS NOT NULL THEN [o.r, 'overlay'] WHEN upper(country) = 'TH' AND birth <= 2015 THEN ['E6', 'era'] WHEN upper(country) = 'TH' AND birth >= 2016 THEN ['A1', 'era'] WHEN t.r IS NOT NULL THEN [t.r, 'territory'] ELSE ['R0', 'none'] END AS a
    FROM people LEFT JOIN over o ON o.c = upper(trim(code)) LEFT JOIN terr t ON t.c = upper(country)),
  geo AS (SELECT ord, a[1] AS region, CASE a[2] WHEN 'overlay' THEN 0.88 WHEN 'era' THEN 0.9 WHEN 'territory' THEN 0.85 ELSE 0.1 END::DOUBLE AS confidence, a[2] AS method FROM ge)"""
_BOTH = f"""{_NAME}, {_GEO}, det AS (SELECT g.ord, CASE WHEN g.region <> 'R0' THEN g.region ELSE n.region END AS region, CASE WHEN g.region <> 'R0' THEN g.confidence ELSE n.confidence END AS confidence,
    CASE WHEN g.region <> 'R0' THEN g.method ELSE n.method END AS method, g.region <> 'R0' AND n.region <> 'R0' AND g.region <> n.region AS conflict,
    CASE WHEN g.region = 'R0' AND n.region = 'R0' THEN 'none' WHEN g.region <> 'R0' AND n.region <> 'R0' AND g.region = n.region THEN 'leaf' WHEN g.region <> 'R0' AND n.region <> 'R0' AND gg.g = ng.g THEN 'group'
      WHEN g.region <> 'R0' AND n.region <> 'R0' THEN 'disputed' ELSE 'single' END AS resolution
    FROM geo g JOIN nm n USING (ord) LEFT JOIN grps gg ON gg.r = g.region LEFT JOIN grps ng ON ng.r = n.region)"""


def _with(body: str) -> str:
    return f"WITH {PEOPLE_SQL}, {_TABLES}, {body}"


@query("geography", _with(f"{_GEO} SELECT ord, region, confidence, method FROM geo"))
def geography(spark, sf):
    return people(spark, sf).select("ord", F.inline(F.array(D.geography(F.col("country"), F.col("code"), F.col("birth")))))


@query("name_scores", _with(f"{_SCORES} SELECT ord, region, score, margin FROM best"))
def name_scores(spark, sf):
    return people(spark, sf).select("ord", F.inline(F.array(D.scored(F.col("latin"))))).where("score IS NOT NULL")


@query("name_origin", _with(f"{_NAME} SELECT ord, region, confidence, method FROM nm"))
def name_origin(spark, sf):
    return people(spark, sf).select("ord", F.inline(F.array(D.name_origin(F.col("latin"), F.col("native")))))


@query("name_origin_fast", _with(f"{_ORIGIN} SELECT p.ord, coalesce(o.r, h.r, 'R0') AS region FROM people p LEFT JOIN own o ON o.w = array_to_string({_WORDS.format('p.family')}, ' ') LEFT JOIN hyb h ON h.ord = p.ord"))
def name_origin_fast(spark, sf):
    return people(spark, sf).select("ord", D.name_origin(F.col("latin"), F.col("native"), fast=True)["region"].alias("region"))


@query("region_detected", _with(f"{_BOTH} SELECT ord, region, confidence, method, conflict, resolution FROM det"))
def region_detected(spark, sf):
    p = people(spark, sf)
    m = D.merged(D.geography(F.col("country"), F.col("code"), F.col("birth")), D.name_origin(F.col("latin"), F.col("native")))
    return p.select("ord", F.inline(F.array(m))).drop("grp")


@query("region_totals", _with(f"{_BOTH} SELECT region, resolution, count(*) AS n, count(*) FILTER (conflict) AS conflicts FROM det GROUP BY region, resolution"))
def region_totals(spark, sf):
    return region_detected(spark, sf).groupBy("region", "resolution").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"))


@query("era_intervals", "SELECT * FROM (VALUES ('..2015', NULL, 2015), ('-2015', NULL, 2015), ('2016-', 2016, NULL), ('1980..2000', 1980, 2000), ('1999', 1999, 1999), ('x', 1, 0)) t(rule, low, high)")
def era_intervals(spark, sf):
    rules = ["..2015", "-2015", "2016-", "1980..2000", "1999", "x"]
    return spark.createDataFrame([(r, *D.interval(r)) for r in rules], "rule string, low int, high int")


@query("fallback_stack", _with(f"""{_NAME} SELECT ord, CASE WHEN region <> 'R0' THEN region WHEN ord % 3 = 0 THEN 'B1' ELSE 'R0' END AS region,
  CASE WHEN region <> 'R0' AND region IN ('A1', 'E1', 'E4') THEN 'agreement' WHEN region <> 'R0' THEN 'rules' WHEN ord % 3 = 0 THEN 'graph' ELSE 'none' END AS strategy FROM nm"""))  # fmt: skip
def fallback_stack(spark, sf):
    rules = D.name_origin(F.col("latin"), F.col("native"))["region"]
    f = D.fallback(F.array(*map(F.lit, ("A1", "E1", "E4"))), rules, F.when(F.col("ord") % 3 == 0, F.lit("B1")))
    return people(spark, sf).select("ord", F.inline(F.array(f)))


@query("tempered_choice", f"""WITH {V.ENTRIES_SQL}, q AS (SELECT ord, 1 + CAST(ord % 5 AS DOUBLE) AS a, 1 + CAST(ord % 3 AS DOUBLE) AS b, 2.0::DOUBLE AS c FROM entries), h AS (SELECT ord, sqrt(a / (a + b + c)) AS a, sqrt(b / (a + b + c)) AS b, sqrt(c / (a + b + c)) AS c FROM q)
  SELECT ord, round(greatest(a, b, c) / (a + b + c), 6) AS p, CASE WHEN round(greatest(a, b, c) / (a + b + c), 6) >= 0.4 THEN CASE WHEN c >= a AND c >= b THEN 'C1' WHEN b >= a THEN 'B1' ELSE 'A1' END END AS best FROM h""")  # fmt: skip
def tempered_choice(spark, sf):
    e = V.entries(spark, sf).selectExpr("ord", "1D + ord % 5 AS a", "1D + ord % 3 AS b", "2D AS c")
    each = F.array(*(F.struct(F.lit(r).alias("region"), (F.col(x) / (F.col("a") + F.col("b") + F.col("c"))).alias("p")) for r, x in (("A1", "a"), ("B1", "b"), ("C1", "c"))))
    return e.select("ord", F.inline(F.array(D.tempered(each, 2.0, 0.4))))


@query("affiliation_region", f"WITH {PEOPLE_SQL}, {_TABLES} SELECT p.ord, CASE WHEN p.ord % 4 = 0 AND t.r IS NOT NULL THEN t.r ELSE coalesce(t2.r, 'E3') END AS region, CASE WHEN p.ord % 4 = 0 AND t.r IS NOT NULL THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence FROM people p LEFT JOIN terr t ON t.c = upper(p.country) LEFT JOIN terr t2 ON t2.c = upper(CASE WHEN p.ord % 2 = 0 THEN 'XX' ELSE p.country END)")
def affiliation_region(spark, sf):
    own = F.when(F.col("ord") % 4 == 0, F.col("country"))
    return people(spark, sf).select("ord", F.inline(F.array(D.by_affiliation(own, F.array(F.when(F.col("ord") % 2 == 0, "XX").otherwise(F.col("country")), F.lit("JP"))))))


@query("confidence_nudge", _with(f"{_GEO} SELECT ord, round(least(0.95, confidence + CASE WHEN region IN ('A1', 'A2') AND ord % 2 = 0 THEN 0.02 ELSE 0 END + CASE WHEN ord % 3 = 0 THEN 0.02 ELSE 0 END), 6) AS confidence FROM geo"))
def confidence_nudge(spark, sf):
    g = D.geography(F.col("country"), F.col("code"), F.col("birth"))
    doi, place = F.when(F.col("ord") % 2 == 0, "10.1007/x").otherwise("10.1/y"), F.when(F.col("ord") % 3 == 0, "Universität Wien").otherwise("Firm")
    return people(spark, sf).select("ord", D.nudged(g["region"], g["confidence"], doi, place).alias("confidence"))


SIGNALS = [("B1", "suffix", "ivan", 2.0), ("A1", "contains", "smith", 3.0), ("E1", "prefix", "wang", 3.0), ("G1", "token", "maria", 1.5), ("E4", "regex", "^k[a-z]m,", 3.0), ("B1", "contains", "sokol", 2.5)]


@query("signal_ensemble", f"""WITH {PEOPLE_SQL}, h AS (SELECT ord, unnest([CASE WHEN ends_with(t, 'ivan') THEN {{'r': 'B1', 'x': 2.0}} END, CASE WHEN contains(t, 'smith') THEN {{'r': 'A1', 'x': 3.0}} END, CASE WHEN starts_with(t, 'wang') THEN {{'r': 'E1', 'x': 3.0}} END,
  CASE WHEN contains(' ' || t || ' ', ' maria ') THEN {{'r': 'G1', 'x': 1.5}} END, CASE WHEN regexp_matches(t, '^k[a-z]m,') THEN {{'r': 'E4', 'x': 3.0}} END, CASE WHEN contains(t, 'sokol') THEN {{'r': 'B1', 'x': 2.5}} END]) AS h FROM (SELECT ord, lower(latin) AS t FROM people)),
  s AS (SELECT ord, h.r AS r, sum(h.x) AS s FROM h WHERE h IS NOT NULL GROUP BY ord, h.r) SELECT ord, arg_max(r, (s, 100 - ascii(r))) AS region, round(least(0.98, 0.5 + max(s) / 10), 6)::DOUBLE AS confidence FROM s GROUP BY ord""")  # fmt: skip
def signal_ensemble(spark, sf):
    return people(spark, sf).select("ord", D.signals(F.col("latin"), SIGNALS).alias("s")).where("s IS NOT NULL").select("ord", "s.*")


@query("name_features", f"""WITH {PEOPLE_SQL} SELECT ord, length(latin) AS length, len({_WORDS.format("latin")}) AS words, round(len(regexp_extract_all(lower(latin), '[aeiouy]')) / len(regexp_extract_all(lower(latin), '\\p{{L}}')), 6) AS vowels, right(lower(latin), 3) AS last, left(lower(latin), 2) AS first FROM people""")
def name_features(spark, sf):
    return people(spark, sf).select("ord", F.inline(F.array(D.features(F.col("latin")))))


@query("romanisation", f"WITH {PEOPLE_SQL} SELECT ord, CASE " + " ".join(f"WHEN regexp_matches(lower(latin), '{p}') THEN '{n}'" for n, p in D.ROMANISED) + " END AS scheme FROM people")
def romanisation(spark, sf):
    return people(spark, sf).select("ord", D.romanisation(F.col("latin")).alias("scheme"))


@query("bare_surname", f"WITH {PEOPLE_SQL} SELECT ord, CASE WHEN family = 'de la Cruz' THEN 'cruz' WHEN family = 'van Dijk' THEN 'dijk' ELSE lower(family) END AS surname, given IN ('Robert', 'Maria', 'Hans', 'Anne-Marie') AND given <> 'Maria' AS western FROM people")
def bare_surname(spark, sf):
    return people(spark, sf).select("ord", D.bare_surname(F.col("latin")).alias("surname"), D.western_given(F.col("latin")).alias("western"))


KNOTS = [(0.2, 0.1), (0.5, 0.35), (0.9, 0.8)]


@query("calibrated_confidence", f"WITH {V.PREDICTIONS_SQL} SELECT doc_id, CASE WHEN conf <= 0.2 THEN 0.1 WHEN conf <= 0.5 THEN 0.35 ELSE 0.8 END::DOUBLE AS p FROM predictions")
def calibrated_confidence(spark, sf):
    return V.predictions(spark, sf).select("doc_id", D.calibrated(F.col("conf"), KNOTS).alias("p"))


SCRIPTED = {"김철수": "E4", "たなか": "E3", "王明": "E1", "Иван": "B1", "Νίκος": "B3", "דוד": "C6", "علي": "C3", "Անի": "C7", "ნინო": "C8", "राम": "D1", "রবি": "D3", "අමල්": "D5", "สมชาย": "E6", "ሰላም": "F3", "Smith": "R0"}


@query("script_region", f"WITH {V.ENTRIES_SQL}, s(name, region) AS ({_values(list(SCRIPTED.items()))}) SELECT ord, s.region FROM entries JOIN s ON s.name = {_sql_pick(list(SCRIPTED), 'ord')}")
def script_region(spark, sf):
    name = F.element_at(F.array(*map(F.lit, SCRIPTED)), (F.col("ord") % len(SCRIPTED) + 1).cast("int"))
    return V.entries(spark, sf).select("ord", D.by_script(name).alias("region"))
