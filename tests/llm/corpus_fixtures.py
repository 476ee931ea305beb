import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Texts to documents with ids from 1, plus columns whose names the operators use inside."""

    def build(*texts, ids=None, langs=None, sources=None):
        n = len(texts)
        ids, langs, sources = ids or range(1, n + 1), langs or ["en"] * n, sources or ["s"] * n
        rows = [(i, t, lg, s, len(t or ""), 0, "x", 1) for i, t, lg, s in zip(ids, texts, langs, sources, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS + ", tid int, place string, words int")

    return build


@pytest.fixture(scope="session")
def words():
    """Made-up words, the same for the same seed."""
    import random

    def build(n, seed, vocabulary=4000):
        rng = random.Random(seed)
        return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]

    return build
