import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm import repeats as R


def expected(texts):
    """Spans of every text, by counting all 400-byte strings."""
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        covered = sorted({j for i in range(len(b) - 399) if counts[b[i : i + 400]] > 1 for j in range(i, i + 400)})
        spans = []
        for j in covered:
            if spans and spans[-1][1] == j:
                spans[-1][1] += 1
            else:
                spans.append([j, j + 1])
        out.append(spans)
    return out


def found(frame, texts):
    rows = {r["doc_id"]: (r["tid"], r["n_bytes"]) for r in R.identified(frame, "doc_id").collect()}
    spans = {(r["tid"], r["n_bytes"]): r for r in R.repeats(frame).collect()}
    out = []
    for i, text in enumerate(texts, 1):
        row = spans.get(rows[i])
        out.append([list(s) for s in row["spans"]] if row else [])
        if row:
            raw, keep = (text or "").encode(), bytearray()
            at = 0
            for a, b in out[-1]:
                keep += raw[at:a]
                at = b
            assert bytes(row["kept"]) == bytes(keep + raw[at:])
    return out


def corpus(seed, chunk=None):
    rng = random.Random(seed)
    letters = "abcdefghij é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, long = text(500), text(1500)
    near = long[:600] + "Z" + long[601:]
    return [
        text(300) + passage + text(200),
        passage + text(700),
        text(50) + passage[:399] + text(50),
        text(10) + passage[50:460] + text(10),
        long, near, long[200:], text(399), text(400),
        "ab" * 900, "x" * 399, "x" * 401, "".join([passage, text(3), passage]),
        text(1200), None, "", "tiny",
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(docs, seed):
    texts = corpus(seed)
    assert found(docs(*texts), texts) == expected(texts)


def test_copies_ids_and_columns(docs):
    texts = corpus(9)
    texts += [texts[13], texts[13], texts[8]]
    ids = [None] * 5 + [7] * 5 + list(range(len(texts) - 10))
    frame = docs(*texts, ids=ids)
    spans = {(r["tid"], r["n_bytes"]): [list(s) for s in r["spans"]] for r in R.repeats(frame).collect()}
    keys = R.identified(frame, "text").collect()
    wanted = {t: s for t, s in zip(texts, expected(texts), strict=True)}
    for r in keys:
        assert spans.get((r["tid"], r["n_bytes"]), []) == wanted[r["text"]]
    assert R.repeats(frame.limit(0)).count() == 0


def test_chunks_do_not_matter(docs, monkeypatch):
    texts = corpus(4)
    for text in (t for t in texts if t):
        data = np.frombuffer(text.encode(), np.uint8)
        owner = {}
        for chunk in (1 << 20, 130):
            monkeypatch.setattr(R, "CHUNK", chunk)
            owner[chunk] = {
                b + s: (b + p, int(g)) for _, b, place, gram, first, last in R.anchors(data)
                for p, g, f, e in zip(place, gram, first, last, strict=True) for s in range(f, e + 1)
            }
        assert owner[1 << 20] == owner[130]
        assert set(owner[130]) == set(range(len(data) - 399))


def test_text_stays_valid(docs):
    passage = "é" * 350
    frame = docs("a" + passage + "b", "x" + passage + "y", "untouched", None)
    out = sorted((r["doc_id"], r["text"], r["n_chars"], r["place"]) for r in R.without_repeats(frame).collect() if r["text"])
    assert [(i, set(t) - {"é"}, p) for i, t, _, p in out] == [(1, {"a", "b"}, "x"), (2, {"x", "y"}, "x"), (3, set("untouched"), "x")]
    assert all(n == len(t) for _, t, n, _ in out)


def test_merged_spans():
    assert R.merged(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])).tolist() == [[0, 4], [5, 12]]
    assert R.merged(np.zeros((0, 2), int)).tolist() == []


def test_workers_hand_on_in_pieces_however_many_blocks_and_spans_a_batch_has():
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(2000))
    n = 3_000
    wanted = [{"place": 100 + 300 * k, "first": 300 * k, "last": 300 * k + 99, "weight": 1} for k in range(5)]
    fields = [("tid", pa.int64()), ("n_bytes", pa.int64())]
    anchor = pa.struct([(k, pa.int64()) for k in ("place", "first", "last", "weight")])
    batch = pa.record_batch([list(range(n)), [2000] * n, [wanted] * n, [text] * n], pa.schema([*fields, ("wanted", pa.list_(anchor)), ("text", pa.string())]))
    pieces = list(R._blocked(iter([batch])))
    assert max(p.num_rows for p in pieces) < 1 << 17 and len({r for p in pieces for r in p.column(3).to_pylist()}) == n
    one = pa.concat_tables([pa.Table.from_batches(R._blocked(iter([batch.slice(i, 1)]))) for i in (0, n - 1)])
    assert pa.Table.from_batches(pieces).filter(pa.compute.is_in(pa.chunked_array([p.column(3) for p in pieces]), pa.array([0, n - 1]))).equals(one)

    spans = [[{"start": i, "end": i + 400} for i in range(100 + k % 7, 300)] for k in range(n)]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    batch = pa.record_batch([list(range(n)), [2000] * n, spans, [text] * n], pa.schema([*fields, ("spans", pa.list_(span)), ("text", pa.string())]))
    cut = list(R._cut(iter([batch.slice(1)])))
    assert max(p.num_rows for p in cut) <= R.HELD // 2000 + 1
    cut = pa.Table.from_batches(cut).to_pylist()
    assert [r["tid"] for r in cut] == list(range(1, n))
    assert all(r["spans"] == [{"start": 100 + r["tid"] % 7, "end": 699}] and r["rest"] == text[: 100 + r["tid"] % 7] + text[699:] for r in cut)
