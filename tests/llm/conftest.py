import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Odd cases: null and empty texts, ties, repeated rows, a null key, a long text."""
    long = " ".join(f"word{i % 977} goes{i % 13}." for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nIt was a fine day, and all was well.", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog.\nIt was a fine day, and all was well.", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, "  \n\t ", "de", None),
        (6, "Grüße an alle, die hier sind! Straße und Häuser.", "de", "c"),
        (6, "Grüße an alle, die hier sind! Straße und Häuser.", "de", "c"),
        (7, "one", "en", "é"),
        (8, long, "en", "a"),
        (None, "a text without a key, but with some words in it", "en", "a"),
        (9, "write to me@mail.example.com or +1 (755) 555-9729 from 10.0.0.1 with 4111 1111 1111 1111", "en", "Z"),
        (10, "🙂 emoji и кириллица 中文字 mixed", None, "c"),
        (-3, "x\n\nx\nx y\x0bz", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same documents with further columns, named like what the operators use or return."""
    from pyspark.sql import functions as F

    names = ["key", "size", "shard", "slot", "row", "fp", "component", "score", "id", "vec", "spans", "ids", "kept", "h", "host", "path", "count", "part"]
    return documents.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def none(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
