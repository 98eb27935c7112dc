from __future__ import annotations

import pytest

from thermoband.session import ship_package

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, mark string, score string, "
    "spans string, row string, shard string, path string, start string, label string, key string"
)
LONG = "tion ered " * 30_000
TEXTS = [
    "The quick brown fox, it's 12 o'clock.\n\n  Two  spaces\tand tabs ",
    None,
    "",
    " \n\t ",
    "naïve façade ÉTÉ œuvre ßtraße",
    "ΣΑΣ Ὀδυσσεύς 日本語テキスト 한국어 🙂🙂 é Å",
    "control \x1c\x1d characters \x85 and \xa0 blanks   wide",
    "special <|endoftext|> strings <|startoftext|> <| inside",
    "1234567890 " * 40,
    LONG,
    "x" * 5000,
    "The quick brown fox, it's 12 o'clock.\n\n  Two  spaces\tand tabs ",
    "password=b7db7aa4a5fcc78305 and mail me@example.com or +1 (555) 555-1234",
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def rows_of(texts):
    return [(i, t, "en", f"src{i % 3}", len(t or ""), *["clash"] * 10) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, a null id and columns with clashing names."""
    rows = rows_of(TEXTS)
    return [*rows, rows[0], rows[0], (None, "no id here", None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
