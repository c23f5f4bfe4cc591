"""Queries: names and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, names, scripts
from ..operators import identity
from ..sources import views as V
from .registry import query

ALPHABET = f"'{ids.BASE32}'"


def gid_sql(payload: str) -> str:
    """DuckDB: leading 110 bits of SHA-256 in Base32."""
    nibble = "(strpos('0123456789abcdef', substr(sha256({p}), CAST(k AS INTEGER), 1)) - 1)".format(p=payload)
    bits = f"array_to_string(list_transform(range(1, 29), lambda k: right('000' || bin({nibble}), 4)), '')"
    return f"(SELECT array_to_string(list_transform(range(0, 22), lambda i: substr({ALPHABET}, CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(b, CAST(i * 5 + j AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER))) AS INTEGER) + 1, 1)), '') FROM (SELECT {bits} AS b))"


YEAR = "CASE WHEN {y} IS NULL OR {y} = 0 THEN '' ELSE CAST({y} AS VARCHAR) END"


@query("global_id", f"WITH {V.PERSONS_SQL} SELECT ord, latin, {gid_sql("latin || '||'")} AS gid FROM persons")
def global_id(spark, sf):
    p = V.persons(spark, sf)
    none = F.lit(None).cast("int")
    return p.select("ord", "latin", ids.global_id(F.col("latin"), none, none).alias("gid"))


MINTED = f"{V.ENTRIES_SQL}, minted AS (SELECT *, {gid_sql("native || '|' || CAST(birth AS VARCHAR) || '|'")} AS gid FROM entries)"


@query(
    "id_suffixing",
    f"""WITH {MINTED}, n AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ord) - 1 AS k FROM minted)
    SELECT ord, gid, CASE WHEN k = 0 THEN gid ELSE gid || '--' || CAST(k AS VARCHAR) END AS unique_gid FROM n""",
)
def id_suffixing(spark, sf):
    return identity.suffix(identity.mint(V.entries(spark, sf))).select("ord", "gid", "unique_gid")


@query("compact_id", f"WITH {V.ENTRIES_SQL} SELECT ord, {gid_sql("native || '|' || CAST(birth AS VARCHAR)")} AS gid FROM entries")
def compact_id(spark, sf):
    return V.entries(spark, sf).select("ord", ids.compact_id(F.col("native"), F.col("birth"), F.lit(None).cast("int")).alias("gid"))


@query(
    "id_format_check",
    f"""WITH {V.PERSONS_SQL}, c AS (SELECT ord, {gid_sql("latin || '||'")} || CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN '--2' WHEN 2 THEN '--0' ELSE 'x' END AS gid FROM persons)
    SELECT ord, gid, regexp_matches(gid, '^[A-Z2-7]{{22}}(--0*[1-9][0-9]*)?$') AS ok FROM c""",
)
def id_format_check(spark, sf):
    none = F.lit(None).cast("int")
    tail = F.when(F.col("ord") % 4 == 0, "").when(F.col("ord") % 4 == 1, "--2").when(F.col("ord") % 4 == 2, "--0").otherwise("x")
    c = V.persons(spark, sf).select("ord", F.concat(ids.global_id(F.col("latin"), none, none), tail).alias("gid"))
    return c.select("ord", "gid", ids.is_global_id(F.col("gid")).alias("ok"))


@query(
    "orcid_check",
    """WITH d AS (SELECT c_custkey AS ord, lpad(CAST(c_custkey * 7919 + 123456789 AS VARCHAR), 15, '0') AS d FROM customer),
    t AS (SELECT ord, d, (12 - CAST(list_sum(list_transform(range(1, 16), lambda i: CAST(substr(d, CAST(i AS INTEGER), 1) AS HUGEINT) * CAST(pow(2, 16 - i) AS HUGEINT))) % 11 AS INTEGER)) % 11 AS r FROM d)
    SELECT ord, CASE WHEN r = 10 THEN 'X' ELSE CAST(r AS VARCHAR) END AS digit,
           (CASE WHEN r = 10 THEN 'X' ELSE CAST(r AS VARCHAR) END) = CAST(ord % 10 AS VARCHAR) AS ok FROM t""",
)
def orcid_check(spark, sf):
    c = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("ord"))
    d = F.lpad((F.col("ord") * 7919 + 123456789).cast("string"), 15, "0")
    full = F.concat(d.substr(1, 4), F.lit("-"), d.substr(5, 4), F.lit("-"), d.substr(9, 4), F.lit("-"), d.substr(13, 3), (F.col("ord") % 10).cast("string"))
    return c.select("ord", ids.orcid_check_digit(d).alias("digit"), ids.is_orcid(full).alias("ok"))


@query("shadow_projection", f"WITH {V.ENTRIES_SQL} SELECT ord, region, country, substr(sha256(latin), 1, 16) AS shadow FROM entries")
def shadow_projection(spark, sf):
    return V.entries(spark, sf).select("ord", "region", "country", ids.shadow_hash(F.col("latin")).alias("shadow"))


@query(
    "treatment_split",
    """WITH h AS (SELECT c_custkey AS ord, sha256(c_name) AS h FROM customer),
    m AS (SELECT ord, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: CAST(strpos('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100) AS r FROM h)
    SELECT ord, CASE WHEN r < 30 THEN 'A' ELSE 'B' END AS arm FROM m""",
)
def treatment_split(spark, sf):
    return V.read(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), ids.treatment(F.col("c_name"), 30).alias("arm"))


@query(
    "name_parse",
    f"WITH {V.ENTRIES_SQL} SELECT ord, split_part(latin, ', ', 1) AS family, split_part(latin, ', ', 2) AS given, split_part(native, ' ', 2) || ', ' || split_part(native, ' ', 1) AS turned FROM entries",
)
def name_parse(spark, sf):
    e = V.entries(spark, sf)
    return e.select("ord", names.family(F.col("latin")).alias("family"), names.given(F.col("latin")).alias("given"), names.canonical_person(F.col("native")).alias("turned"))


LITERALS = ["Łukasz Ørsted (1900)", "José  García", "von Neumann, John", "de la Cruz, Ana María", "Erdős, Pál", "Émilie du Châtelet"]
_VALUES = ", ".join(f"('{x}')" for x in LITERALS)


@query(
    "name_key",
    f"""WITH {V.ENTRIES_SQL}, n AS (SELECT native AS name FROM entries UNION SELECT * FROM (VALUES {_VALUES})),
    p AS (SELECT name, trim(regexp_replace(lower(strip_accents(regexp_replace(name, '\\([^)]*\\)', '', 'g'))), '[ \\t\\n]+', ' ', 'g')) AS t FROM n)
    SELECT name, CASE WHEN contains(t, ',') OR NOT contains(t, ' ') THEN t
      ELSE regexp_extract(t, '([^ ]+)$', 1) || ', ' || regexp_replace(t, ' [^ ]+$', '') END AS key FROM p""",
)
def name_key(spark, sf):
    n = V.entries(spark, sf).select(F.col("native").alias("name")).union(spark.createDataFrame([(x,) for x in LITERALS], "name string")).distinct()
    return n.select("name", names.name_key(F.col("name")).alias("key"))


@query(
    "short_key",
    f"WITH {V.ENTRIES_SQL} SELECT ord, CASE WHEN length(split_part(latin, ', ', 2)) > 0 THEN split_part(latin, ', ', 1) || ', ' || split_part(split_part(latin, ', ', 2), ' ', 1) ELSE latin END AS short, list_distinct(list_filter(regexp_split_to_array(split_part(latin, ', ', 2), '[ \\-]+'), lambda x: length(x) > 1))[1] AS token FROM entries",
)
def short_key(spark, sf):
    e = V.entries(spark, sf)
    return e.select("ord", names.short_key(F.col("latin")).alias("short"), F.try_element_at(names.given_tokens(names.given(F.col("latin"))), F.lit(1)).alias("token"))


_PART = "|".join(names.PARTICLES)


@query(
    "particle_fold",
    f"""WITH {V.ENTRIES_SQL}, n(name) AS (SELECT * FROM (VALUES ('von neumann, john'), ('de la cruz, ana'), ('euler, leonhard'), ('van der waals, johannes d'), ('von, x'), ('al'), ('della porta, g b'))
      UNION SELECT lower(['', 'von ', 'de la ', 'al '][CAST(ord % 4 AS INTEGER) + 1] || latin) FROM entries), l AS (SELECT name, regexp_extract(split_part(name, ', ', 1), '^((?:(?:{_PART}) )+)', 1) AS lead FROM n)
    SELECT name, CASE WHEN length(lead) > 0 AND length(split_part(name, ', ', 1)) > length(lead)
      THEN substr(split_part(name, ', ', 1), length(lead) + 1) || ', ' || trim(split_part(name, ', ', 2) || ' ' || trim(lead)) ELSE name END AS folded FROM l""",
)
def particle_fold(spark, sf):
    rows = ["von neumann, john", "de la cruz, ana", "euler, leonhard", "van der waals, johannes d", "von, x", "al", "della porta, g b"]
    lead = F.element_at(F.array(*map(F.lit, ("", "von ", "de la ", "al "))), (F.col("ord") % 4 + 1).cast("int"))
    n = spark.createDataFrame([(x,) for x in rows], "name string").union(V.entries(spark, sf).select(F.lower(F.concat(lead, "latin")))).distinct()
    return n.select("name", names.fold_particles(F.col("name")).alias("folded"))


@query("whitespace_normalise", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def whitespace_normalise(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.md5(names.squeeze(F.col("text"))).alias("digest"))


@query("decade_label", f"WITH {V.ENTRIES_SQL} SELECT ord, CAST(CAST(floor((birth - 1920) / 10.0) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade FROM entries")
def decade_label(spark, sf):
    return V.entries(spark, sf).select("ord", F.concat((F.floor((F.col("birth") - 1920) / 10) * 10).cast("int").cast("string"), F.lit("s")).alias("decade"))


@query(
    "fingerprint",
    f"WITH {V.ENTRIES_SQL} SELECT ord, regexp_replace(lower(latin), '[^a-z0-9]', '', 'g') || '_' || region || '_' || array_to_string(list_sort([country, source]), ',') AS fingerprint FROM entries",
)
def fingerprint(spark, sf):
    return V.entries(spark, sf).select("ord", F.concat_ws("_", F.regexp_replace(F.lower("latin"), "[^a-z0-9]", ""), "region", F.array_join(F.array_sort(F.array("country", "source")), ",")).alias("fingerprint"))


@query(
    "initials_tags",
    f"""WITH {V.ENTRIES_SQL}, n(name) AS (SELECT * FROM (VALUES ('A.B.'), ('Smith, J.'), ('King, Martin Jr.'), ('Euler, Leonhard'), ('Bach, J. S.'), ('Louis, XIV'), ('Ford, Henry II'))
      UNION SELECT latin || ['', ' Jr.', ' A.', ' III'][CAST(ord % 4 AS INTEGER) + 1] FROM entries) SELECT name, array_to_string(list_filter([
      CASE WHEN regexp_matches(name, '^([A-Z]\\.[ ]?)+([A-Z]\\.?)?$') OR regexp_matches(CASE WHEN contains(name, ', ') THEN substr(name, strpos(name, ', ') + 2) ELSE '' END, '^([A-Z]\\.[ \\-]?)+$') THEN 'initials_only' END,
      CASE WHEN regexp_matches(name, '(?i)(^|[\\s,])(jr|sr|ii|iii|iv|v)\\.?$') THEN 'generational_suffix' END,
      CASE WHEN regexp_matches(name, '(^|[ ,])[A-Z]\\.') THEN 'has_abbreviations' END], lambda x: x IS NOT NULL), ',') AS tags FROM n""",
)
def initials_tags(spark, sf):
    rows = ["A.B.", "Smith, J.", "King, Martin Jr.", "Euler, Leonhard", "Bach, J. S.", "Louis, XIV", "Ford, Henry II"]
    tail = F.element_at(F.array(*map(F.lit, ("", " Jr.", " A.", " III"))), (F.col("ord") % 4 + 1).cast("int"))
    n = spark.createDataFrame([(x,) for x in rows], "name string").union(V.entries(spark, sf).select(F.concat("latin", tail))).distinct()
    return n.select("name", F.array_join(names.short_form_tags(F.col("name")), ",").alias("tags"))


@query(
    "name_shape",
    """SELECT c_custkey AS ord, length(c_name) AS length, len(regexp_extract_all(c_name, '[^ ]+')) AS words, len(regexp_extract_all(c_name, '[^A-Za-z0-9 ]')) AS specials,
    len(regexp_extract_all(c_name, '[0-9]')) AS digits, len(regexp_extract_all(c_name, '[A-Z]')) AS capitals FROM customer""",
)
def name_shape(spark, sf):
    s = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), names.shape(F.col("c_name")).alias("s"))
    return s.select("ord", *(F.col(f"s.{c}").cast("bigint").alias(c) for c in ("length", "words", "specials", "digits", "capitals")))


@query(
    "canonical_hash",
    f"""WITH {V.PERSONS_SQL} SELECT ord, sha256('balance=' || printf('%.6f', balance) || '|latin=' || latin || '|nation=' || nation || '|region=' || region) AS hash FROM persons""",
)
def canonical_hash(spark, sf):
    p = V.persons(spark, sf)
    return p.select("ord", F.sha2(identity.canonical_row(p, ["balance", "latin", "nation", "region"]), 256).alias("hash"))


@query(
    "script_shares",
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS latin, len(regexp_extract_all(text, '[Ͱ-Ͽ]')) AS greek,
    len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS cyrillic FROM documents""",
)
def script_shares(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", *(scripts.count_of(F.col("text"), s).cast("bigint").alias(s) for s in ("latin", "greek", "cyrillic")))


@query("transliteration")
def transliteration(spark, sf):
    rows = [("Ευκλείδης", "greek"), ("Чебышёв", "cyrillic"), ("김철수", "hangul"), ("Euler", "latin")]
    n = spark.createDataFrame(rows, "name string, script string")
    latin = F.when(F.col("script") == "greek", scripts.latin_of_greek("name")).when(F.col("script") == "cyrillic", scripts.latin_of_cyrillic("name")).when(F.col("script") == "hangul", scripts.latin_of_hangul("name")).otherwise(F.lower("name"))
    return n.select("name", "script", scripts.primary(F.col("name")).alias("found"), latin.alias("latin"))


@query("id_collision_report", f"WITH {MINTED} SELECT gid, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM minted GROUP BY gid HAVING count(*) > 1")
def id_collision_report(spark, sf):
    return identity.mint(V.entries(spark, sf)).groupBy("gid").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).where("n > 1")


@query("json_hash", f"""WITH {V.ENTRIES_SQL} SELECT ord, sha256('{{"birth":' || birth || ',"country":"' || country || '","latin":"' || latin || '"' || CASE WHEN advisor IS NOT NULL THEN ',"source":"' || source || '"' ELSE '' END || '}}') AS hash FROM entries""")
def json_hash(spark, sf):
    e = V.entries(spark, sf).withColumn("source", F.when(F.col("advisor").isNotNull(), F.col("source")))
    return e.select("ord", ids.json_hash("latin", "country", "birth", "source").alias("hash"))
