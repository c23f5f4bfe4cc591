"""Scalar functions on hand-made cases."""

import base64
import difflib
import hashlib

import pytest
from pyspark.sql import functions as F

from velarium.functions import ids, names, scripts, similarity
from velarium.operators import identity


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_global_id_is_base32_of_the_digest(spark):
    df = spark.createDataFrame([("Euler", 1707, 1783), ("Gauß", None, 0)], "n string, b int, d int")
    got = [r[0] for r in df.select(ids.global_id(F.col("n"), F.col("b"), F.col("d"))).collect()]
    for payload, g in zip(("Euler|1707|1783", "Gauß||"), got):
        digest = bytearray(hashlib.sha256(payload.encode()).digest()[:14])
        digest[-1] &= 0b11111100
        assert g == base64.b32encode(bytes(digest)).decode().rstrip("=")[:22]


@pytest.mark.parametrize(("orcid", "ok"), [("0000-0002-1825-0097", True), ("0000-0002-1825-0098", False), ("0000-0002-1694-233X", True), ("x", False)])
def test_orcid(spark, orcid, ok):
    assert one(spark, ids.is_orcid, orcid) is ok


@pytest.mark.parametrize(
    ("given", "key"),
    [("Łukasz  Ørsted (1900)", "ørsted, łukasz"), ("José García", "garcia, jose"), ("Euler, Leonhard", "euler, leonhard"), ("Euclid", "euclid"), ("", "")],
)
def test_name_key(spark, given, key):
    assert one(spark, names.name_key, given) == key


def test_particles_fold_once(spark):
    for k, want in (("von neumann, john", "neumann, john von"), ("de la cruz, ana", "cruz, ana de la"), ("euler, leonhard", "euler, leonhard")):
        got = one(spark, names.fold_particles, k)
        assert got == want
        assert one(spark, names.fold_particles, got) == got


def test_clean_and_variants(spark):
    assert one(spark, names.clean, "ﬁn​ægi‮ ß") == "finaegi ss"
    assert one(spark, names.variants, "æß") == ["æß", "aeß", "æss"]
    assert one(spark, names.casefold, "Straße") == "strasse"


@pytest.mark.parametrize(("a", "b"), [("night", "nacht"), ("martha", "marhta"), ("", "x"), ("same", "same"), ("dwayne", "duane")])
def test_similarities(spark, a, b):
    def bigrams(x):
        return {x[i : i + 2] for i in range(len(x) - 1)}

    x, y = bigrams(a), bigrams(b)
    dice = 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0
    assert one(spark, similarity.dice, a, b) == pytest.approx(dice)
    assert one(spark, similarity.sequence_ratio, a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    assert 0 <= one(spark, similarity.jaro_winkler, a, b) <= 1


def test_known_jaro_winkler(spark):
    assert one(spark, similarity.jaro_winkler, "martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert one(spark, similarity.jaro_winkler, "dwayne", "duane") == pytest.approx(0.84, abs=1e-2)


def test_scripts(spark):
    assert one(spark, scripts.shares, "Euler Эйлер 오일러") == {"latin": 5, "cyrillic": 5, "hangul": 3}
    assert one(spark, scripts.primary, "1 Эйлер") == "cyrillic"
    assert one(spark, scripts.latin_of_greek, "Ευκλείδης") == "efkleidis".replace("f", "v")
    assert one(spark, scripts.latin_of_cyrillic, "Чебышёв") == "chebyshyov"
    assert one(spark, scripts.latin_of_hangul, "김") == "gim"


def test_suffix_passes_over_held_numbers(spark):
    rows = [(1, "A"), (2, "A"), (3, "A"), (4, "A--1"), (5, "B")]
    got = {r["ord"]: r["unique_gid"] for r in identity.suffix(spark.createDataFrame(rows, "ord int, gid string")).collect()}
    assert got == {1: "A", 2: "A--2", 3: "A--3", 4: "A--1", 5: "B"}


def test_repoint(spark):
    rows = [(1, "A", ["B"]), (2, "A", ["A"]), (3, "B", None), (4, "C", ["A", "B"])]
    got = {r["ord"]: (r["unique_gid"], r["advisors"]) for r in identity.repoint(spark.createDataFrame(rows, "ord int, gid string, advisors array<string>")).collect()}
    assert got == {1: ("A", ["B"]), 2: ("A--1", ["A--1"]), 3: ("B", None), 4: ("C", ["A--1", "B"])}


def test_batch_hash_ignores_order(spark):
    df = spark.range(50).selectExpr("id", "id / 3 AS v", "cast(id AS string) AS s")
    assert identity.batch_hash(df).first() == identity.batch_hash(df.orderBy(F.desc("id")).repartition(5)).first()
