import random
import re

import numpy as np
import pytest
from corpus_fixtures import docs, words  # noqa: F401
from relpredict.llm import near_docs as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(lower)
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def expected(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i + 1, len(s), find(i) + 1, find(i) == i) for i, s in enumerate(sets)]


def edited(base, changes, seed):
    rng = np.random.default_rng(seed)
    out = list(base)
    for i in rng.choice(len(out), changes, replace=False):
        out[i] = f"n{rng.integers(10**9)}"
    return out


@pytest.fixture(scope="module")
def texts(words):
    out = []
    for group in range(6):
        base = words(150, group)
        out += [base, base, [w.upper() for w in base]]
        out += [edited(base, k, 100 * group + k) for k in (1, 2, 3, 4, 5, 8, 20)]
    chain = words(120, 50)
    out += [chain[i : i + 100] for i in (0, 8, 16, 24)]  # neighbours link, the ends don't
    out = [" ".join(t) for t in out]
    return [*out, "one two", "ONE  two", "one two three", "a b c d e", "", None, " \n", "É é", "é É", " ".join(words(20_000, 7)), "one\x0btwo"]


def test_against_all_pairs(docs, texts):
    got = [tuple(r) for r in N.near_duplicates(docs(*texts)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got) == expected(texts)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.75, 0.9):
        both, own = int(1000 * share), (1000 - int(1000 * share)) // 2
        common = rng.integers(1, 2**63, both, dtype=np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(1, 2**63, own, dtype=np.uint64)])) for _ in range(2)]
        bounds = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        a, b = N.sketches(np.concatenate(sets), bounds)
        n = np.array([float(len(sets[0]))])
        assert abs(N.similarity(a[None], b[None], n, n)[0] - share) < 0.12


def test_sketches_merge_by_maximum():
    """The registers of a union are the larger of both."""
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (40, 300))
    u = np.unique(np.concatenate([a, b]))
    bounds = np.cumsum([0, len(a), len(b), len(u)])
    r = N.sketches(np.concatenate([a, b, u]), bounds)
    assert (np.maximum(r[0], r[1]) == r[2]).all()


def test_rows_without_id_repeated_ids_and_empty_table(docs, words):
    base = " ".join(words(80, 1))
    frame = docs(base, base, base + " more", "alone here", None, base, ids=[None, 5, 5, None, 9, 3])
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(frame).collect()), key=str)
    assert out == sorted([(None, 3, False), (5, 3, False), (5, 3, False), (None, None, True), (9, 9, True), (3, 3, True)], key=str)
    left = N.without_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 3, 9]
    assert N.near_duplicates(frame.limit(0)).count() == 0


def test_a_crowded_bucket_costs_a_pair_a_row(docs, words, spark):
    base = words(200, 3)
    texts = [" ".join(edited(base, 2, i)) for i in range(120)]
    got = N.near_duplicates(docs(*texts)).collect()
    assert {r["component_id"] for r in got} == {1}


def test_sketches_of_a_batch_take_little_memory_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(250)) for _ in range(2_500)] + [None, ""]
    batch = pa.record_batch([list(range(len(texts))), texts], ["doc_id", "text"])
    tracemalloc.start()
    pieces = list(N._sketched(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # it was over 150 MB, in each of an executor's workers
    rows = pa.Table.from_batches(pieces).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and rows[-1]["n_shingles"] == 0
    alone = pa.Table.from_batches(N._sketched(iter([batch.slice(1_234, 1)]))).to_pylist()
    assert alone == [rows[1_234]]
