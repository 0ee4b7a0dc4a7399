import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows():
    base = " ".join(WORDS)
    return [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base + " more", "en", "a", 5), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \n\t ", "en", "b", 4),
        (None, base, "en", None, 5), (6, "one", "en", None, 3), (7, "one", "fr", "c", 3), (8, "Ünïcode É 漢字\n" * 3, "fr", "c", 9), (9, "word " * 60000, "en", "a", 1),
        (10, "<|endoftext|> x <|endoftext|>", "en", "b", 1), (11, base.upper(), "en", "b", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated rows, and extra columns with names the operators use themselves."""
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "label", "score", "kept", "row", "n", "vid", "draw", "copies", "rank", "shard", "k1", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
