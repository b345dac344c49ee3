import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        (1, None, "h", 1), (2, "", "h", 2), (None, "some text without an id", "h", 3), (4, "no host here\nat all", None, 4),
        (5, long, "h", 5), (6, "twice\nthe same row", "h", 6), (6, "twice\nthe same row", "h", 6),
        (7, " \t\n ", "h", 7), (8, "Ünïcödé ß 日本語 \U0001F600 text", "h", 8), (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_words long")


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def frame(df) -> pd.DataFrame:
    return df.toPandas()
