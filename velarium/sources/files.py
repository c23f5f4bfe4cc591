"""Readers and writers of landed files. Schemas are given, never inferred; malformed rows are
kept apart in `_corrupt_record`."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import clean

ENTRY = T.StructType(
    [
        T.StructField("GlobalID", T.StringType()),
        T.StructField("CanonicalLatin", T.StringType()),
        T.StructField("CanonicalNative", T.StringType()),
        T.StructField("BirthYear", T.IntegerType()),
        T.StructField("BirthYearText", T.StringType()),
        T.StructField("CountryCodes", T.ArrayType(T.StringType())),
        T.StructField("Advisors", T.ArrayType(T.StringType())),
        T.StructField("AuthorityIDs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
#: Words of a contributor that is an institution, not a person.
INSTITUTIONS = ("universit", "institut", "college", "school", "department", "facult", "academy", "laborator")


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: T.StructType = ENTRY) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows that do not fit the schema stay, with their text in `_corrupt_record`."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if "_corrupt_record" not in s.fieldNames():
        s = T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_chunks(spark: SparkSession, path: str, keys: list[str], schema: T.StructType = ENTRY) -> DataFrame:
    """Chunk files of one batch, plain or compressed, as one ordered frame."""
    return read_json(spark, path, schema=schema).orderBy(*keys)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Lexical signals, one JSON object a line; those without a value or a region are left out."""
    s = "region string, field string, kind string, value string, weight double, regex boolean"
    d = spark.read.schema(s).json(path).where("coalesce(value, '') <> '' AND coalesce(region, '') <> ''")
    return d.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("kind", F.when(F.col("regex"), F.lit("regex")).otherwise(F.col("kind")))


def oai_pages(df: DataFrame, xml: str) -> DataFrame:
    """One row for each record of harvested list pages, with the page's resumption token: null on
    the last page, as an empty token ends a list."""
    token = F.nullif(F.trim(F.regexp_extract(xml, "(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1)), F.lit(""))
    records = F.regexp_extract_all(xml, F.lit("(?s)<record>(.*?)</record>"), F.lit(1))
    r = df.select("*", token.alias("token"), F.posexplode(records).alias("pos", "record"))
    key = F.regexp_extract("record", "(?s)<identifier>(.*?)</identifier>", 1)
    return r.withColumn("oai_id", F.trim(key)).withColumn("deleted", F.contains("record", F.lit('status="deleted"')))


def sparql_rows(df: DataFrame, body: str, variables: list[str]) -> DataFrame:
    """One row for each binding of a landed query result in JSON, a column for each variable."""
    kind = "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
    b = df.select("*", F.explode(F.from_json(body, kind)["results"]["bindings"]).alias("_b"))

    def plain(name: str):
        v = F.try_element_at(F.col("_b"), F.lit(name))["value"]
        return F.when(v.startswith("http://www.wikidata.org/entity/"), F.element_at(F.split(v, "/"), -1)).otherwise(v)

    return b.select(*df.columns, *(plain(v).alias(v) for v in variables))


def rest_items(df: DataFrame, body: str, items: str, fields: dict[str, str]) -> DataFrame:
    """One row for each item of a landed JSON page: `items` names the array, `fields` gives each
    column's path inside an item."""
    each = df.select("*", F.posexplode(F.from_json(F.get_json_object(body, f"$.{items}"), "array<string>")).alias("pos", "_item"))
    return each.select(*df.columns, "pos", *(F.get_json_object("_item", f"$.{p}").alias(c) for c, p in fields.items()))


def read_yaml(spark: SparkSession, path: str, schema: str = "GlobalID string, CanonicalLatin string, BirthYear int") -> DataFrame:
    """One list of records a file. Spark has no reader for it, so files come as bytes; without a
    YAML library only the JSON subset is read."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def parse(batches):
        try:
            import yaml

            load = yaml.safe_load
        except ImportError:
            load = json.loads
        for b in batches:
            for content in b["content"]:
                rows = load(bytes(content).decode("utf-8"))
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def normalised(df: DataFrame) -> DataFrame:
    """Every string column in normal form; other columns as they are."""
    return df.select(*(clean(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def dublin_core(df: DataFrame, xml: str) -> DataFrame:
    """title, creators, date, identifiers and contributors of Dublin Core records, and the
    contributors that are persons."""

    def of(tag: str):
        return F.transform(F.regexp_extract_all(xml, F.lit(f"(?s)<dc:{tag}[^>]*>(.*?)</dc:{tag}>"), F.lit(1)), F.trim)

    person = F.filter(of("contributor"), lambda c: ~F.exists(F.array(*map(F.lit, INSTITUTIONS)), lambda k: F.contains(F.lower(c), k)))
    return df.select("*", F.try_element_at(of("title"), F.lit(1)).alias("title"), of("creator").alias("creators"), F.try_element_at(of("date"), F.lit(1)).alias("date"), of("identifier").alias("identifiers"), person.alias("advisors"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each anchor with a target, in order, with the page's title."""
    title = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    hrefs = F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", title.alias("title"), F.posexplode(hrefs).alias("pos", "href"))


def thesis_fields(df: DataFrame, text: str) -> DataFrame:
    """Title, author, advisor and year lines of a thesis page."""

    def line(word: str):
        return F.trim(F.regexp_extract(text, rf"(?im)^{word}:[ \t]*(.+)$", 1))

    return df.select("*", line("title").alias("title"), line("author").alias("author"), line("(?:advisor|supervisor)").alias("advisor"), F.regexp_extract(line("date"), "[0-9]{4}", 0).alias("year"))


def write_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows in canonical column order, sorted by keys over range partitions, compressed."""
    df.select(*sorted(df.columns)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "gzip").mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes and edges as two tables, the edges by confidence class."""
    nodes.dropDuplicates(["gid"]).write.mode("overwrite").parquet(f"{root}/nodes")
    low = F.when(F.col("confidence") < 0.8, "low").otherwise("high")
    edges.withColumn("class", low).write.mode("overwrite").partitionBy("class").parquet(f"{root}/edges")


def difference_page(rows: DataFrame, path: str, key: str = "gid", most: int = 5000) -> int:
    """An HTML table of old and new values, `most` rows in order of key with a note of what is left
    out; the number of rows shown. The limit is the page's feature: the table itself is a frame."""
    shown = rows.orderBy(key).limit(most + 1).collect()
    more, shown = len(shown) > most, shown[:most]

    def line(r) -> str:
        kind = "same" if r["old"] == r["new"] else "diff"
        return f'<tr class="{kind}">' + "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r) + "</tr>"

    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    note = f"<p>Only the first {most} rows are shown.</p>" if more else ""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><table><tr>{head}</tr>{''.join(map(line, shown))}</table>{note}")
    return len(shown)


def write_edges(df: DataFrame, path: str) -> None:
    df.select(F.col("student").alias("from"), F.col("advisor").alias("to")).write.option("header", True).mode("overwrite").csv(path)


def write_run(df: DataFrame, root: str, run: str) -> None:
    """A snapshot as one partition of the run table."""
    df.withColumn("run", F.lit(run)).write.partitionBy("run").mode("append").parquet(root)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of every file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"), "length")


def report(tables: dict[str, DataFrame], limit: int = 50) -> str:
    """Markdown of small result tables, `limit` rows each."""
    out = []
    for name, df in tables.items():
        rows = df.limit(limit).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(x) for x in r) + " |" for r in rows] + [""]
    return "\n".join(out)
