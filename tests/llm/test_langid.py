import pytest
from pyspark.sql import functions as F

from pixelspark.llm import langid as g
from pixelspark.llm.common import crc_fold, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = g.fit(docs.where(crc_fold(F.col("doc_id"), 5) != 0))
    held = g.identify(docs.where(crc_fold(F.col("doc_id"), 5) == 0), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_backoff_takes_the_longest_known_ngram():
    model = g.LanguageModel.fit([("en", "thing", 9), ("en", "the", 5), ("fr", "que", 9), ("fr", "eaux", 4)])
    rows = [model.grams[x] for x in ("^th", "thin", "hing", "ing$", "ng$", "g$", "$")]
    rows[0] = model.grams["^thi"]
    assert model.backoff("thing") == pytest.approx(model.gram_rows[rows].sum(axis=0) / 2)
    predictor = g.Predictor(model)
    assert predictor.predict("thing")[0] == "en" and predictor.predict("ququq")[0] == "fr"
    assert predictor.predict("ЖЖЖ")[0] in ("en", "fr")


def test_odd_rows(docs, rows, empty):
    model = g.fit(docs)
    found = g.identify(docs.withColumn("Score", F.lit("clash")), model).collect()
    assert len(found) == len(rows) and "a.b" in found[0].asDict()
    for r in found:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (r.score > 0) == lettered
    assert g.identify(empty, model).count() == 0
    none = g.fit(empty)
    assert {(r.lang_pred, r.score) for r in g.identify(docs, none).collect()} == {("und", 0.0)}


def test_equal_scores_go_to_the_first_language():
    from pixelspark.llm.langid import LanguageModel, Predictor

    model = LanguageModel.fit([("b", "same", 3), ("a", "same", 3), ("c", "same", 3)])
    assert Predictor(model).predict("same same") == ("a", pytest.approx(1 / 3))
