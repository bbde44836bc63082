import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: Nulls, empty and blank texts, ties, repeated rows, a long text, clashing extra columns.
HARD = [
    (1, "a b c d e f g", "s1"),
    (2, "a b c d e f g", "s1"),
    (3, "a b\tc d\ne f g ", None),
    (4, None, "s2"),
    (5, "", "s2"),
    (6, " \n\t", None),
    (7, "word " * 30000, "s1"),
    (8, "one two", "s3"),
    (9, "ONE two", "s3"),
    (None, "no id here at all, none", "s3"),
    (11, "é <|endoftext|> don't ÀÉ́ x y 12 *** z İstanbul ß", "s2"),
    (1, "a b c d e f g", "s1"),
]


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, "en", s, len(t or ""), "x", 7, "y", 1.5) for i, t, s in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, _id string, size double").repartition(3)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)
