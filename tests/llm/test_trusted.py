import random

import numpy as np
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm import queries, trusted as T, word_model as P
from relpredict.llm.common import bitmap, may_hold


def labels_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_bitmap_never_misses(spark):
    ids = spark.range(5000).selectExpr("xxhash64(id) AS h")
    held = bitmap(ids, 18)
    assert may_hold(held, np.array([r["h"] for r in ids.collect()])).all()
    others = np.array([r["h"] for r in spark.range(10_000, 15_000).selectExpr("xxhash64(id) AS h").collect()])
    assert may_hold(held, others).mean() < 0.1


def test_only_labelled_good_texts_are_trusted(spark, docs, monkeypatch):
    monkeypatch.setattr(T, "BITS", 15)
    frame = docs("good", "toxic", "bad", "unlabelled", "no id", "good twice", "good twice", ids=[1, 2, 3, 4, None, 5, 5])
    labels = labels_of(spark, (1, 1, 0), (1, 1, 0), (2, 1, 1), (3, 0, 0), (5, 1, 0), (None, 1, 0))
    assert sorted(r["text"] for r in T.labelled(frame, labels).collect()) == ["good", "good twice", "good twice"]


def test_toxic_text_that_passes_the_rules_is_rejected(spark, docs, tmp_path):
    """The rules pass both kinds; only the labels tell them apart."""
    rng = random.Random(3)
    drawn = lambda vocabulary: " ".join(w for _ in range(60) for w in (rng.choice(["the", "and", "of", "to"]), rng.choice(vocabulary))) + "."
    good = [drawn("cat mat sun dog sat ran sea tree house road rain sand".split()) for _ in range(60)]
    toxic = [drawn("zgrwq kxxjv vvprk qzzw jjkxq wqqv xkkz vrrj".split()) for _ in range(20)]
    docs(*good, *toxic).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, *[(i, 1, 0) for i in range(1, 61)], *[(i, 1, 1) for i in range(61, 66)]).write.parquet(f"{tmp_path}/labels.parquet")
    rules = queries.op1_quality_rules(spark, str(tmp_path)).where("doc_id > 60")
    assert rules.where("kept").count() == 20
    kept = {r["doc_id"]: r["kept"] for r in queries.op9_perplexity(spark, str(tmp_path)).collect()}
    assert len(kept) == 80 and not any(kept[i] for i in range(61, 81))
    assert sum(kept[i] for i in range(1, 61)) >= 55


def test_held_out_text_gives_the_threshold(docs):
    fitted, held = docs("the cat sat on the mat"), docs("a dog ran to the sun")
    rows = P.classify(docs("a dog ran to the sun"), fitted, held).collect()
    assert rows[0]["threshold"] == rows[0]["perplexity"] and rows[0]["kept"]
