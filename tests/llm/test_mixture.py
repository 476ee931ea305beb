import collections
import re

import pytest
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm.mixture import mixed, mixture, targets


def water(sizes, weights, most=3):
    """Targets by handing out the excess again and again."""
    whole, held = sum(sizes), set()
    while True:
        left = whole - sum(most * sizes[i] for i in held)
        share = sum(weights[i] for i in range(len(sizes)) if i not in held)
        out = [most * s if i in held else left * weights[i] / share for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in held and out[i] > most * s}
        if not over:
            return out
        held |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10, 5, 1, 700], [0, 50, 50], [7], [1, 1, 1, 1, 1, 1, 1, 1000], [0, 0]])
def test_targets_are_reshared_until_none_is_above(spark, sizes):
    rows = [(f"s{i:02}", n) for i, n in enumerate(sizes[:-1])] + [(None, sizes[-1])]
    out = targets(spark.createDataFrame(rows, "source string, source_size bigint")).collect()
    got = {r["source"]: r["target"] for r in out}
    wanted = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[s] for s, _ in rows] == pytest.approx(wanted)


@pytest.fixture(scope="module")
def frame(docs):
    texts, sources = [], []
    for i in range(900):
        texts.append("w " * (i % 37))
        sources.append([None, "a", "b", "c", "hot", "hot", "hot", "tiny"][i % 8 if i % 8 < 7 or i < 80 else 4])
    return docs(*texts, None, "", sources=[*sources, "a", "b"])


@pytest.fixture(scope="module")
def mix(frame):
    out = mixture(frame, levels=2)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())  # the main path is native
    return out.collect()


def test_mix_meets_targets_with_whole_documents(frame, mix):
    assert len(mix) == 902
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in mix:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 36 / 2 + 1e-6, s
    assert sum(target.values()) == pytest.approx(sum(size.values()))


def test_mixed_rows_follow_the_copies_in_every_run(frame, mix):
    copies = {r["doc_id"]: r["copies"] for r in mix if r["copies"]}
    again = mixed(frame.repartition(7), levels=2)
    assert again.columns == frame.columns
    assert collections.Counter(r["doc_id"] for r in again.collect()) == copies


def test_equal_rows_follow_their_own_source(docs):
    texts = [f"word{i} and more" for i in range(40)] * 2
    frame = docs(*texts, ids=list(range(40)) * 2, sources=["a"] * 40 + [None] * 40)  # a is taken more often than its twin
    copies = collections.Counter()
    for r in mixture(frame, weights=(5, 1), levels=1).collect():
        copies[r["source"], r["doc_id"]] += r["copies"]
    found = collections.Counter((r["source"], r["doc_id"]) for r in mixed(frame, weights=(5, 1), levels=1).collect())
    assert found == +copies and len({n for (s, _), n in copies.items() if s == "a"} | {n for (s, _), n in copies.items() if s is None}) > 1


def test_rows_of_a_shard_are_shuffled_locally(frame, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = [r["doc_id"] for r in mixed(frame, levels=2).coalesce(1).collect()]
    assert rows == [r["doc_id"] for r in mixed(frame, levels=2).coalesce(1).collect()]
    assert rows != sorted(rows) and sorted(rows) == sorted(r["doc_id"] for r in mixed(frame.repartition(5), levels=2).collect())


def test_tree_splits_blocks_evenly(mix):
    rows = [r for r in mix if r["copies"]]
    assert all(len(r["shards"]) == r["copies"] and all(0 <= s < 4 for s in r["shards"]) for r in rows)
    blocks = {(r["source"], r["place"][:2], k): s for r in rows for k, s in enumerate(r["shards"])}
    load = collections.Counter(blocks.values())
    assert len(load) == 4 and max(load.values()) - min(load.values()) <= 3
    for source in {s for s, _, _ in blocks}:
        own = collections.Counter(v for (s, _, _), v in blocks.items() if s == source)
        assert len(own) > 1 or sum(own.values()) < 4


def test_odd_rows(docs, frame):
    same = docs("a b c", "a b c", "a b c", None, "", ids=[1, 1, None, None, 2], sources=[None] * 5)
    out = mixture(same, levels=1).collect()
    assert len(out) == 5 and {r["source_size"] for r in out} == {9}
    assert sum(r["taken"] for r in out) == 9
    assert mixture(frame.limit(0), levels=1).count() == 0


def test_nothing_but_empty_texts(spark):
    out = targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size bigint"))
    assert {r["target"] for r in out.collect()} == {0.0}
