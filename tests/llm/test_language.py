import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.llm import language


def plain_bundle(text, dimensions, seed):
    vectors = language.Vectors(dimensions, seed)
    letters = [c if language._is_letter(np.array([ord(c)]))[0] else " " for c in text.lower()]
    words = f" {' '.join(''.join(letters).split())} "
    total = np.zeros(dimensions)
    for a, b, c in zip(words, words[1:], words[2:]):
        if b != " ":
            codes = [0 if x == " " else ord(x) for x in (a, b, c)]
            total += np.roll(vectors._of_letter(codes[0]), 2) * np.roll(vectors._of_letter(codes[1]), 1) * vectors._of_letter(codes[2])
    return total


@pytest.mark.parametrize("text", ["The cat, the cat!", "é\nÉ123ß", "a", "  x y z  ", "日本 語"])
def test_bundle_is_the_sum_of_bound_letters(text):
    grams, counts = language.trigrams(text)
    assert np.allclose(language.Vectors(256, 5).bundle(grams, counts), plain_bundle(text, 256, 5))


def test_vectors_beyond_the_kept_ones_are_the_same(monkeypatch):
    grams, counts = language.trigrams("many different words stand in this text of ours")
    whole = language.Vectors(128, 1).bundle(grams, counts)
    monkeypatch.setattr(language, "KEPT_VECTORS", 3)
    assert np.allclose(language.Vectors(128, 1).bundle(grams, counts), whole)


def test_odd_rows(documents):
    found = language.identify(documents(), F.lit(True))
    assert found.columns == [*documents().columns, "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == 10
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if not (r.text or "").strip())
    assert all(r.lang_pred == "en" and 0 <= r.score <= 1 for r in rows if (r.text or "").strip())
    assert language.identify(documents([]), F.lit(True)).collect() == []
    nothing = language.identify(documents(), F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_columns_of_the_same_name_are_replaced(documents):
    docs = documents().withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert dict(language.identify(docs, F.lit(True)).dtypes)["score"] == "double"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, ~language.held_out()).where(language.held_out() & F.col("lang").isNotNull())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
