import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, hash string, _hash string, _copies long, _copy long, _id long, _place long, _split long, _found long, _lang string, row long, place long, form long"
LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(300))
#: Every awkward kind of row: null columns, empty and blank texts, a very long text, repeated rows, ties.
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t\r\n ", "en", "a"), (4, LONG, "en", "b"), (5, "one", None, "b"),
    (6, "the same words stand here twice over", "en", "a"), (6, "the same words stand here twice over", "en", "a"),
    (7, "the same words  stand here\ntwice over", "en", None), (None, "no number for this one", "en", "a"), (None, None, None, None),
]


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source) rows, with further columns whose names an operator may use itself."""

    def make(rows=ODD):
        return spark.createDataFrame([(*r, 0, 7, "k", "h", "h", 1, 2, 3, 4, 5, 6, "l", 8, 9, 10) for r in rows], SCHEMA)

    return make
