import math

import numpy as np
import pytest
from relpredict.llm import near_vectors as V

from conftest import TESTDATA

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def expected(rows):
    """Links and components by all pairs."""
    sound = {}
    for k, (_, label, e) in enumerate(rows):
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e, dtype=np.float32).astype(float)
            sound[k] = v / np.linalg.norm(v)
    links = {k: [j for j in sound if j != k and rows[j][1] == rows[k][1] and len(sound[j]) == len(sound[k]) and sound[j] @ sound[k] >= 0.98] for k in sound}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo = [j for x in todo for j in links.get(x, ()) if j not in seen and not seen.add(j)]
        low = min(rows[j][0] for j in seen)
        out.append((i, len(links.get(k, ())), low, low == i))
    return sorted(out)


def found(frame):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(frame).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for label in (0, 1):
        for _ in range(25):
            centre = rng.normal(size=32)
            out += [(label, (centre + rng.normal(size=32) * s).tolist()) for s in (0, 0.02, 0.1, 0.15, 0.2, 0.5)]
    crowd = rng.normal(size=32)
    out += [(1, (crowd + rng.normal(size=32) * 0.08).tolist()) for _ in range(150)]
    out += [(1, crowd.tolist())] * 40 + [(None, crowd.tolist()), (0, crowd.tolist()), (1, (3 * crowd).tolist())]
    out += [(1, None), (1, []), (1, [0.0] * 32), (1, [math.nan] * 32), (1, [math.inf] + [0.0] * 31), (1, [None] + [1.0] * 31), (1, [1.0] * 8), (1, [1.0] * 8)]
    return [(i, label, e) for i, (label, e) in enumerate(out, 1)]


def test_against_all_pairs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cid", "2 AS cluster")
    assert found(frame) == expected(rows)


def test_several_shards_find_all(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 64)
    monkeypatch.setattr(V, "CLUSTER", 40)
    frame = spark.createDataFrame(rows, SCHEMA)
    truth = expected(rows)
    got = found(frame)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in truth)
    assert all(a[1] <= b[1] for a, b in zip(got, truth, strict=True))


def test_empty_table(spark):
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_on_the_provided_vectors(spark):
    vectors = spark.read.parquet(f"{TESTDATA.replace('0.001', '0.01')}/embeddings.parquet")
    hit, true = V.recall(vectors, V.near_vectors(vectors), every=1)
    assert hit >= 0.9 * true


def test_search_walks_the_graph():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x[300:500] = x[300] + rng.normal(size=(200, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = V.pruned(x.astype(np.float32))
    assert lists.shape == (700, V.DEGREE) and (lists >= 0).sum(axis=1).max() <= V.DEGREE
    links = np.zeros((700, 700), bool)
    rows, cols = np.nonzero(lists >= 0)
    links[rows, lists[rows, cols]] = True
    links |= links.T
    hits = V.searched(x, links, x, 0.98)
    truth = x @ x.T >= 0.98
    assert not (hits & ~truth).any() and hits.sum() >= 0.98 * truth.sum()
