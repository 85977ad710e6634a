import pytest

ROWS = [
    (1, "a b c", "en", "s1"),
    (2, None, None, None),
    (3, "", "fr", "s1"),
    (3, "", "fr", "s1"),
    (4, "word " * 3000, "en", "s2"),
    (4, "word " * 3000, "en", "s2"),
    (None, "no id here", "de", "s2"),
    (5, " \t\n ", "de", None),
    (6, "Ünï çødé 日本 🤖\x00 <s> <0x0A> " + "é" * 400, "fr", "s3"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n long, ids string, a int, level int"
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "x", 7, "x", 1, 2) for r in ROWS], schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
