import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls everywhere, empty and long texts, repeated rows and columns whose names clash."""
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [
        (1, "the cat sat on the mat and saw the dog", "en", "a"), (1, "the cat sat on the mat and saw the dog", "en", "a"), (2, None, None, None),
        (3, "", "en", "b"), (4, " \n\t ", None, "b"), (5, long, "fr", "b"), (None, "no id here at all", "en", "c"), (6, "a" * 300_000, "de", "c"),
        (7, "😀 ünïcode ¡ñ! 12345 \x00 end", "es", None), (8, "one", "en", "d"), (9, "one two", "en", "d"), (10, "ONE TWO", "en", "d"),
    ]
    clash = ["shard", "slot", "size", "part", "point", "row", "key", "offset", "digest", "label", "score", "words", "block", "open", "level"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < 0")
