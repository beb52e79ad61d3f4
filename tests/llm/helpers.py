"""Shared fixtures: awkward documents with nulls, empty and long texts, repeats and clashing extra columns."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h long"


def awkward(spark, more=()):
    """Documents with every awkward case; the last two columns clash with names that operators use inside."""
    rows = [
        (1, "one two three four five", "en", "b", 23, "x", 1),
        (2, None, "en", None, 0, None, None),
        (3, "", None, "a", 0, "y", 2),
        (4, " \t\r\n  ", "de", "a", 6, "y", 2),
        (5, "word " * 30_000, "en", "a", 150_000, "z", 3),
        (6, "One two THREE four five", "en", "b", 23, "x", 1),
        (6, "One two THREE four five", "en", "b", 23, "x", 1),
        (None, "no id here\nat all\n", "fr", "é", 18, None, None),
        (7, "  odd  spaces \n\n and such 　 <|endoftext|> 漢字 😀\n", "en", "z", 40, "q", 9),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], T.StructType(spark.createDataFrame([], SCHEMA).schema.fields))
