import pytest

#: Names that operators use for columns of their own.
CLASHES = ("_rows", "_id", "_cut", "_mark", "_own", "_found", "_lang", "_score", "_lang_pred", "_lang_score", "_decoded", "_leak", "_kept", "row", "times", "_class")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, mark int, fp int, score string, ids string, v int, key string, " + ", ".join(f"{c} int" for c in CLASHES)


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, short, long and repeated texts, and columns named as operators' own."""
    long = "alpha beta gamma delta epsilon " * 4000
    rows = [(1, "The cat sat on the mat and then it slept there.", "en", "s", 1)]
    rows += [(2, None, "en", "s", None), (3, "", None, None, 0), (4, "?!", "fr", "s", 2), (5, long, "en", "s", 5), (6, long, "en", "s", 5)]
    rows += [(7, "Ein Hund lief über die Straße.", "de", "s", 1), (7, "Ein Hund lief über die Straße.", "de", "s", 1), (None, "Kein Name hier.", "de", "s", 1), (8, " \t\n ", None, "s", 3)]
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", 3, "k", *[0] * len(CLASHES)) for r in rows], SCHEMA)
