import collections
import random
import re

import numpy as np
import pytest
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm import collocations as C
from relpredict.llm.transducers import Paths, composed, pack, united, unpack

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    counts, said = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            said[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        gone = {q for p, a in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * candidates[q]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, l, r, said[lang], -score))
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in C.collocations(frame).collect())


def prose(seed, n, vocabulary):
    rng = random.Random(seed)
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", " é"]
    return "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(n))


def test_against_brute_force(docs):
    few, many = ["Sun", "moon", "the", "of", "New", "york", "city"], [f"w{i}" for i in range(60)]
    texts = [prose(i, 400, few + many if i % 2 else few) for i in range(12)] + [None, "", " \t. ,", "one", "x " * 30]
    langs = ["en", "de", None] * 5 + ["und", "en"]
    frame = docs(*texts, langs=langs)
    assert found(frame) == brute(list(zip(langs, texts, strict=True)))
    assert C.collocations(frame.limit(0)).count() == 0


def test_many_small_shards_and_ranges(docs, monkeypatch):
    monkeypatch.setattr(C, "RANGE", 200)
    texts = [prose(i, 300, ["a", "b", "cc", "d"]) for i in range(6)]
    texts += texts[:2]  # repeated rows count each
    assert found(docs(*texts)) == brute([("en", t) for t in texts])


def test_equal_scores_are_ordered_by_occurrences_then_phrase(docs):
    texts = [" ".join(f"{x}1 {x}2." for x in ("q", "é", "b")) for _ in range(12)] + ["zz1 zz2"] * 15
    rows = found(docs(*texts))
    assert [(r[1], r[2]) for r in rows] == [(1, "zz1 zz2"), (2, "b1 b2"), (3, "q1 q2"), (4, "é1 é2")]
    assert {r[7] for r in rows} == {1_000_000}


@pytest.mark.parametrize("seed", range(40))
def test_long_texts_in_segments(seed, monkeypatch):
    rng = random.Random(seed)
    words = ["a", "b", "c.", "D,", "e e", "f\n", "\tg", "..."]
    text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))).encode().translate(C._TABLE)
    whole = C.counted([(text, 0)])
    monkeypatch.setattr(C, "SHARD", rng.randrange(5, 60))
    parts = united([C.counted([s]) for s in C._segments(text)])
    assert told(parts) == told(whole)


def told(paths):
    return {paths.phrase(i): int(paths.n[i]) for i in range(len(paths))}


def made(counts):
    words = sorted({w for p in counts for w in p})
    number = {w: i for i, w in enumerate(words)}
    rows = sorted(([number[w] for w in p] + [-1] * (3 - len(p)), n) for p, n in counts.items())
    ids = np.array([r for r, _ in rows], np.int64).reshape(-1, 3)
    return Paths(words, ids[:, 0], ids[:, 1], ids[:, 2], np.array([n for _, n in rows], np.int64))


def some(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"{x}".encode() for x in "abcdefgh"] + ["ü".encode()]
    return {tuple(rng.choices(vocabulary, k=rng.randrange(1, 4))): rng.choice([1, 1, 1, 2, 2**40]) for _ in range(n)}


def test_automata_keep_their_paths_and_share_states():
    counts = some(1)
    blob = pack(made(counts))
    assert told(unpack(blob)) == {b" ".join(p): n for p, n in counts.items()}
    assert told(unpack(pack(made({})))) == {}
    alike = {(f"{i}".encode(), b"x", f"{j}".encode()): 1 for i in range(50) for j in range(20)}
    other = {(f"{i}".encode(), b"x", f"{j}".encode()): 1 + (i * i + j) % 251 for i in range(50) for j in range(20)}
    assert len(pack(made(alike))) < len(pack(made(other))) / 2
    assert told(unpack(pack(made(other)))) == {b" ".join(p): n for p, n in other.items()}


def test_union_adds_weights_and_composition_looks_them_up():
    one, two = some(2), some(3)
    both = collections.Counter(one)
    both.update(two)
    assert told(united([made(one), made(two)])) == {b" ".join(p): n for p, n in both.items()}
    asked = made({**dict.fromkeys(list(two)[::2], 1), (b"unknown",): 1, (b"a", b"unknown"): 1, (b"a", b"a", b"unknown"): 1})
    rows = composed(made(one), asked)
    own = made(one)
    for i, row in enumerate(rows):
        phrase = tuple(asked.phrase(i).split(b" "))
        assert (int(own.n[row]) if row >= 0 else None) == one.get(phrase)
    assert composed(made({}), asked).tolist() == [-1] * len(asked)
