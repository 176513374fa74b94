import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank, short, long and repeated texts, clashing extra columns."""
    long = " ".join(f"word{i % 97}x{i}" for i in range(30_000))
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, None), (4, "one", "en", "s"), (5, long, "en", None), (6, "a b c d e f g h i j k l m n", "de", "t"), (6, "a b c d e f g h i j k l m n", "de", "t"), (None, "no id here at all", "fr", "t"), (8, "İ ſ ü 漢字 \u00a0 x", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("kept", "score", "n_words", "component_id", "size", "id", "key", "n", "row", "target", "a", "b")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
