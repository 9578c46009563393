import pytest

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()


@pytest.fixture
def odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators'."""
    long = " ".join(WORDS[k % 10] + str(k % 37) for k in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1), (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
        (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "fr", None, 3), (None, "sans identifiant mais avec du texte", "fr", "b", 5), (5, long, "en", "c", len(long)), (6, "12 34 !!", None, "c", 8), (7, "😀 é ñ token = abcdefgh12", "es", "c", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("spans", "score", "print", "bands", "key", "ids", "n", "anchor", "hash", "kept", "media", "_gone", "_bad"):
        df = df.withColumn(name, F.lit("x"))
    return df
