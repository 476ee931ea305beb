import numpy as np
import pytest
from pyspark.sql import functions as F
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm import language as L

from conftest import TESTDATA


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TESTDATA.replace('0.001', '0.01')}/documents.parquet")


def test_held_out_accuracy(spark, documents):
    held = F.expr("crc32(CAST(doc_id AS STRING)) % 4") == 2
    model = L.fit(documents.where(~held))
    out = L.identify(documents, model).join(documents.select("doc_id", "lang").where(held), "doc_id").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the house and the tree", "en")] * 3 + [("das haus und der baum", "de")] * 3 + [(None, "en"), ("zzz", None), ("", "fr")]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_words_first_then_shorter_grams(model):
    score = lambda word: L._Scores(model).scores([word])[0]
    own = lambda word: model.words.logs[model.words.places([word])[0]]
    assert model.languages == ("de", "en")
    assert (score("house") == own("house")).all()
    assert model.words.places(["houses"]) == [-1] and score("houses").argmax() == 1  # by 4-grams
    assert score("bau").argmax() == 0
    one = score("uq")
    assert np.isfinite(one).all() and len(one) == 2
    assert (score("qqqq") == score("jjjj")).all()  # nothing but the padding is known
    words = ["tree", "houses", "uq", "haus", "qqqq", "bau"]
    assert np.allclose(L._Scores(model).scores(words), [score(w) for w in words])  # in one go as one by one


def test_odd_texts_and_rows(docs, model):
    texts = [None, "", "123 ... !", "The TREE", "der baum", "der baum " * 30_000, "der baum"]
    frame = docs(*texts, ids=[1, 2, 3, 4, 5, 6, 5])
    out = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(frame, model).collect())
    assert [(i, p) for i, p, _ in out] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (6, "de")]
    assert all(s == 0 for _, p, s in out if p == "und") and all(0.5 < s <= 1 for _, p, s in out if p != "und")
    kept = L.identified(frame, model)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 5, 6]
    assert L.identify(frame.limit(0), model).count() == 0


def test_no_languages(docs, spark):
    empty = L.fit(spark.createDataFrame([], "text string, lang string"))
    assert [(r["lang_pred"], r["score"]) for r in L.identify(docs("some text"), empty).collect()] == [("und", 0.0)]


def test_memo_may_overflow(model, monkeypatch):
    monkeypatch.setattr(L, "MEMO_ROWS", 8)
    scores = L._Scores(model)
    words = ["haus", "und", "der", "x", "y", "z", "q", "v", "baum", "haus"] * 3
    plain = sum(L._Scores(model).scores(words))
    assert np.allclose(scores.total(words), plain)


def test_equal_evidence_goes_to_the_smaller_name(docs, spark):
    same = [("the house and the tree", lang) for lang in ("xx", "aa", "mm")]
    tied = L.fit(spark.createDataFrame(same, "text string, lang string"))
    out = L.identify(docs("the house", "unseen words"), tied).collect()
    assert {r["lang_pred"] for r in out} == {"aa"} and all(abs(r["score"] - 1 / 3) < 1e-9 for r in out)
