"""Queries: landed harvests and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scripts
from ..sources import files
from ..sources import views as V
from .registry import query


@query("oai_records", f"WITH {V.ENTRIES_SQL} SELECT ord, CASE WHEN ord % 5 <> 0 THEN 't' || ord END AS token, p AS pos, 'oai:x:' || ord || ':' || p AS oai_id, p = 1 AND ord % 7 = 0 AS deleted FROM entries, (VALUES (0), (1)) v(p)")
def oai_records(spark, sf):
    page = """concat('<ListRecords><record><header><identifier>oai:x:', ord, ':0</identifier></header></record><record><header', CASE WHEN ord % 7 = 0 THEN ' status="deleted"' ELSE '' END,
      '><identifier> oai:x:', ord, ':1 </identifier></header></record><resumptionToken size="9">', CASE WHEN ord % 5 <> 0 THEN concat('t', ord) ELSE '' END, '</resumptionToken></ListRecords>')"""
    e = V.entries(spark, sf).selectExpr("ord", f"{page} AS xml")
    return files.oai_pages(e, "xml").select("ord", "token", "pos", "oai_id", "deleted")


@query("sparql_bindings", f"WITH {V.ENTRIES_SQL} SELECT ord, 'Q' || ord AS student, native AS name, CASE WHEN advisor IS NOT NULL THEN 'Q' || advisor END AS advisor FROM entries")
def sparql_bindings(spark, sf):
    uri = "named_struct('type', 'uri', 'value', concat('http://www.wikidata.org/entity/Q', {}))"
    row = f"map_concat(map('student', {uri.format('ord')}, 'name', named_struct('type', 'literal', 'value', native)), CASE WHEN advisor IS NOT NULL THEN map('advisor', {uri.format('advisor')}) ELSE map('other', {uri.format('ord')}) END)"
    e = V.entries(spark, sf).selectExpr("ord", f"to_json(named_struct('results', named_struct('bindings', array({row})))) AS body")
    return files.sparql_rows(e, "body", ["student", "name", "advisor"]).select("ord", "student", "name", "advisor")


@query("rest_works", f"WITH {V.ENTRIES_SQL} SELECT ord, p AS pos, native || ' ' || p AS title, CAST(birth AS VARCHAR) AS year FROM entries, (VALUES (0), (1)) v(p)")
def rest_works(spark, sf):
    item = "named_struct('meta', named_struct('title', concat(native, ' {0}')), 'year', birth)"
    e = V.entries(spark, sf).selectExpr("ord", f"to_json(named_struct('items', array({item.format(0)}, {item.format(1)}))) AS body")
    return files.rest_items(e, "body", "items", {"title": "meta.title", "year": "year"}).select("ord", "pos", "title", "year")


FOLDED = [("Œuvre ẞ ﬆ", "Oeuvre SS st"), ("ﬁn​ægi‮ ß", "finaegi ss"), ("Ĳssel\tĳ", "IJsselij"), ("ά", "ά"), ("plain", "plain")]


@query("unicode_clean", "SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for _, w in FOLDED) + ") t(cleaned)")
def unicode_clean(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in FOLDED], "name string").select(names.clean(F.col("name")).alias("cleaned"))


@query(
    "latinised",
    f"""WITH {V.ENTRIES_SQL} SELECT ord, strip_accents(CASE WHEN ord % 3 = 0 THEN 'Müller ' WHEN ord % 3 = 1 THEN 'Çelik Ñ ' ELSE '' END || native) AS latin,
      CASE WHEN ord % 2 = 0 THEN 'OEuvre' ELSE chr(39) || 'a' || chr(39) || ' - ' END || native AS folded FROM entries""",
)
def latinised(spark, sf):
    e = V.entries(spark, sf)
    marked = F.concat(F.when(F.col("ord") % 3 == 0, "Müller ").when(F.col("ord") % 3 == 1, "Çelik Ñ ").otherwise(""), "native")
    quoted = F.concat(F.when(F.col("ord") % 2 == 0, "Œuvre").otherwise("‘a’ – "), "native")
    return e.select("ord", names.latinise(marked).alias("latin"), names.fold_exceptions(quoted).alias("folded"))


@query("script_mix", f"WITH {V.ENTRIES_SQL} SELECT ord, CASE WHEN ord % 3 = 0 THEN 0.25 WHEN ord % 3 = 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS second, ord % 3 <> 1 AS mixed FROM entries")
def script_mix(spark, sf):
    n = F.when(F.col("ord") % 3 == 0, "abcж").when(F.col("ord") % 3 == 1, "abc 12").otherwise("김a")
    s = scripts.second_share(n)
    return V.entries(spark, sf).select("ord", s.alias("second"), (s >= 0.1).alias("mixed"))


ROWS = [("王明", "zh", "Wang Ming", "王明"), ("김민준", "ko", "Kim Min Jun", "김민준"), ("田中", "ja", "Ta Naka", "田中"), ("吴武", "zh", "Wu Wu", "吴吴")]


@query("cjk_roundtrip", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{r}', '{b}', {n == b})" for n, _, r, b in ROWS) + ") t(name, latin, back, same)")
def cjk_roundtrip(spark, sf):
    n = spark.createDataFrame([(n, s) for n, s, _, _ in ROWS], "name string, script string")

    def pick(f, c):
        return F.when(F.col("script") == "zh", f(c, "zh")).when(F.col("script") == "ja", f(c, "ja")).otherwise(f(c, "ko"))

    d = n.withColumn("latin", pick(scripts.romanised, F.col("name"))).withColumn("back", pick(scripts.back_converted, F.col("latin")))
    return d.select("name", "latin", "back", (F.col("name") == F.col("back")).alias("same"))


@query("ethiopic_latin", "SELECT * FROM (VALUES ('ሀለሐ', 'helehe'), ('ሰላም x', 'selam x')) t(name, latin)")
def ethiopic_latin(spark, sf):
    return spark.createDataFrame([("ሀለሐ",), ("ሰላም x",)], "name string").select("name", scripts.latin_of_ethiopic(F.col("name")).alias("latin"))
