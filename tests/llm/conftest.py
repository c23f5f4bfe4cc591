import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = "the and of " + " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    plain = " ".join(f"plain{i}" for i in range(80))
    rows = [
        (1, plain, "en", "a"), (2, plain, "en", "a"), (2, plain, "en", "a"), (3, None, "en", None), (4, "", None, "b"),
        (5, "  \n\t", "en", "b"), (None, plain + " tail", "en", "c"), (None, None, None, None), (6, long, "en", "a"),
        (7, "before " + passage + " after", "de", "b"), (8, "other " + passage + " end", "de", "b"), (9, "ünï çødé ñ " * 20, "fr", "c"),
        (10, "x", "en", "c"), (11, "\x00\x01 nul <|endoftext|> 漢字 🙂", "zh", "c"),
    ]
    extra = "key string, size int, taken int, fp int, _q string, _verdict string, n int, _row int, _passages int, u int"
    schema = f"doc_id bigint, text string, lang string, source string, {extra}"
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "q", "v", 4, 5, 6, 7) for r in rows], schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
