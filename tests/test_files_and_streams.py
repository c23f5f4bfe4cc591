"""Readers, writers and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from velarium.operators import metrics as batch
from velarium.sources import files
from velarium.sources import views as V
from velarium.streaming import metrics as stream

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_json_keeps_bad_rows_apart(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text(json.dumps({"GlobalID": "A", "BirthYear": 1900}) + "\n{broken\n")
    rows = files.read_json(spark, str(p)).cache().collect()
    assert [r["GlobalID"] for r in rows] == ["A", None]
    assert rows[1]["_corrupt_record"] == "{broken"


def test_csv_yaml_and_checksums(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gid,year\nA,1900\nB,x\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "gid string, year int").cache()  # malformed rows stay, apart
    assert [(r["gid"], r["_corrupt_record"] is None) for r in rows.orderBy("gid").collect()] == [("A", True), ("B", False)]
    (tmp_path / "b.yaml").write_text('[{"GlobalID": "A", "CanonicalLatin": "Euler, L", "BirthYear": 1707}]')
    assert files.read_yaml(spark, str(tmp_path / "b.yaml")).first()["BirthYear"] == 1707
    assert files.checksums(spark, str(tmp_path)).count() == 2


def test_normalised_and_sinks(spark, tmp_path):
    df = files.normalised(spark.createDataFrame([("ﬁx​", 1)], "s string, n int"))
    assert df.first()["s"] == "fix"
    files.write_json(df, str(tmp_path / "j"), ["n"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    files.write_run(df, str(tmp_path / "runs"), "r1")
    files.write_run(df, str(tmp_path / "runs"), "r2")
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("run").count().count() == 2
    assert "| n |" in files.report({"t": df.select("n")})


@needs
def test_stream_equals_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    df = stream.read(spark, f"{SF}/events.parquet".replace("events.parquet", "*vents.parquet"))
    stream.run_once(df.select("metric", "event_id"), lambda d, n: d.write.mode("append").parquet(out), str(tmp_path / "c"))
    assert spark.read.parquet(out).distinct().count() == V.metrics(spark, SF).count()


@needs
def test_stateful_rate_limit_equals_replay(spark, tmp_path):
    out = str(tmp_path / "out")
    df = stream.read(spark, f"{SF}/*vents.parquet")
    stream.run_once(stream.rate_limited(df, 3, 3600), lambda d, n: d.write.mode("append").parquet(out), str(tmp_path / "c"))
    want = batch.rate_limit(V.metrics(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")), 3, 3600)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


@needs
def test_windows_with_watermark(spark, tmp_path):
    got = []
    df = stream.tumbling(stream.read(spark, f"{SF}/*vents.parquet"))
    stream.run_once(df, lambda d, n: got.append(d.groupBy().sum("n").first()[0]), str(tmp_path / "c"), mode="update")
    assert sum(x or 0 for x in got) == V.metrics(spark, SF).count()


def test_signals_chunks_graph_and_difference_page(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"region": "A1", "kind": "prefix", "value": "mc"}\n{"region": "B1", "value": "ov$", "regex": true, "weight": 2}\nbroken\n{"region": "", "value": "x"}\n')
    got = sorted((r["region"], r["kind"], r["weight"]) for r in files.read_signals(spark, str(tmp_path / "s.jsonl")).collect())
    assert got == [("A1", "prefix", 1.0), ("B1", "regex", 2.0)]
    for i, gid in enumerate("BA"):
        (tmp_path / f"chunk{i}.jsonl").write_text('{"GlobalID": "%s"}\n' % gid)
    assert [r["GlobalID"] for r in files.read_chunks(spark, str(tmp_path / "chunk*.jsonl"), ["GlobalID"]).collect()] == ["A", "B"]
    nodes = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "gid string, n int")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.9)], "student string, advisor string, confidence double")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 2
    assert spark.read.parquet(str(tmp_path / "g/edges")).where("class = 'low'").count() == 1
    rows = spark.createDataFrame([(1, "<a>", "<a>"), (2, "x", None), (3, "y", "z")], "gid int, old string, new string")
    assert files.difference_page(rows, str(tmp_path / "d.html"), most=2) == 2
    page = (tmp_path / "d.html").read_text()
    assert "&lt;a&gt;" in page
    assert page.count('class="diff"') == 1
    assert "first 2 rows" in page
