import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    long = "the word and " * 40_000
    rows = [
        (1, "Hello  there\tworld and you", "en", "a", 5), (2, "Hello there world and you", "en", "b", None), (3, None, None, None, None), (4, "", "de", "a", 0), (5, " \n ", "de", None, 3),
        (6, long, "en", "a", len(long)), (7, long, "en", "b", len(long)), (None, "der Hund und die Katze", "de", "b", 3), (None, None, None, None, None), (8, "😀 中文 123", "fr", "c", 3),
        (9, "A.", "fr", "c", 2), (9, "A.", "fr", "c", 2), (9, "B.", "fr", "c", 2), (10, "1234 -- !!", None, "c", 9),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = ("keep_id", "kept", "group_size", "fingerprint", "component_id", "fp", "id", "size", "key", "score", "_size", "_hash", "_stats", "media", "n", "u", "v", "_source_size", "_target", "_copies", "_source", "_rate", "_KEY", "_prefix", "_before", "_inner", "_range", "_offset", "_shard", "_slot", "_keep_id", "_group_size", "_kept", "_of", "_least", "_n", "_row_key", "_shared", "_text_hash", "_n_short", "hash")
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("x").alias(c) for c in extra))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
