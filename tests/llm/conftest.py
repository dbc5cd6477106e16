import pytest

SF = "/root/testdata/sf0.001"
LINES = "\n".join(f"line number {i} with some words" for i in range(12))


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or whole rows, over several partitions."""

    def make(rows):
        full = [(*row, "en", "src1", None)[:5] if len(row) < 5 else row for row in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture
def odd(docs_of):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    return docs_of([
        (1, "Alpha beta gamma delta epsilon"), (2, "alpha BETA gamma delta epsilon"), (3, None), (4, ""),
        (5, long), (6, long + " tail"), (7, LINES), (8, LINES + "\nlast"), (9, "  \n\t "), (9, "  \n\t "),
        (None, "A text of nobody"), (10, "ÄÖ É été", None, None, None), (11, "!!! 123"), (12, "Émile ÉTÉ"),
        (1, "Alpha beta gamma delta epsilon"),
    ])


@pytest.fixture
def clashing(odd):
    """The same with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = ["keep_id", "hash", "n", "id", "rep", "v", "sketch", "shard", "place", "chunks", "gone", "unit", "part",
             "bytes", "key", "epoch", "budget", "whole", "cut", "tokens", "start", "score", "component"]
    return odd.withColumns({name: F.lit("clash") for name in names})
