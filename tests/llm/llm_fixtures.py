import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every odd case: nulls, empties, a long text, copies, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(60))
    near = " ".join(f"tok{i}" if i != 59 else "other" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "de", None), (4, None, "en", "b"), (5, "", None, "b"),
        (6, "  \t\n ", "de", "b"), (7, long, "en", "c"), (8, "one two", "de", "c"), (9, "one two", None, "c"),
        (10, "x" * 50_000, "en", "a"), (10, "x" * 50_000, "en", "a"), (None, "no id " * 30, "en", "a"), (11, "1234 !!", "en", "a"),
        (12, "same same " * 40, "de", None),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F
    clash = {c: F.lit("extra") for c in ("chunk", "bucket", "n", "rep", "held_out", "kept", "hash", "rank")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(clash)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
