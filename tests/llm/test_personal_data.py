import random
import re

import numpy as np
import pytest
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm import personal_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checks(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    digits = lambda m: [c for c in m[0] if c in "0123456789"]
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and checks(digits(m))]
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def rows(frame):
    return {r["doc_id"]: r.asDict() for r in P.personal_data(frame).collect()}


@pytest.mark.parametrize("letters", ["aB@@..__-+ 0123459().%ü[:", "01234567899 -.+(", "a@b.c@d.e_f@g.h "])
def test_fixed_patterns_against_naive_matching(letters):
    rng = random.Random(letters)
    for _ in range(8_000):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        assert P.base_spans(text) == brute(text)


def test_counts_and_digests_of_rows(docs):
    texts = ["mail a.b@c.de or 10.0.0.256, 1.2.3.4 and 4111 1111 1111 1111", "+1 (017) 555-7713 x@y", "é +49 30 1234567 é", None, "", "plain"]
    out = rows(docs(*texts))
    for i, text in enumerate(texts, 1):
        base = brute(text or "")
        assert out[i]["base"] == ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert [out[i][f"n_{k}"] for k in P.BASE] == [sum(b[2] == k for b in base) for k in P.BASE]
        assert set(out[i]["base"].split(",")) <= set(out[i]["spans"].split(","))


def corpus():
    """Addresses, numbers and names in clear and unusual form, and numbers that are none of these."""
    rng, texts = random.Random(4), []
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    for i in range(120):
        texts.append(f"please call 0{number(2)} {number(3)} {number(4)} today")
        texts.append(f"call +49 {number(3)} {number(3)} {number(4)} today")
        texts.append(f"mail to user{i}(at)site{i}.org now")
        texts.append(f"mail to user{i}@site{i}.org now")
        texts.append(f"signed by Mary Smith{'abcdefgh'[i % 8]}, here")
        texts.append(f"version a{number(9)}b of the page")
    return texts


def test_added_spans_are_right_and_others_are_left(docs):
    texts = corpus()
    out = rows(docs(*texts))
    kinds = [{s.split(":")[0] for s in out[i]["spans"].split(",") if s} for i in range(1, len(texts) + 1)]
    share = lambda start, kind: np.mean([kind in k for k in kinds[start::6]])
    assert share(0, "phone") == 1 and share(1, "phone") == 1
    assert share(2, "email") == 1 and share(3, "email") == 1 and share(4, "name") == 1
    assert all(not k for k in kinds[5::6])
    spot = texts[0][slice(*map(int, out[1]["spans"].split(":")[1:]))]
    assert spot == texts[0][len("please call ") : -len(" today")]


def test_em_finds_who_is_right():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.8, 0.65, 0.5])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[rng.random(votes.shape) < 0.2] = 1
    patterns, of, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance, tables = P.weigh(patterns, n.astype(float))
    found = (tables[1, :, 2] + tables[0, :, 0]) / (tables[1, :, [0, 2]].sum(axis=0) + tables[0, :, [0, 2]].sum(axis=0))
    assert np.abs(found - right).max() < 0.08
    odds = (votes - 1) @ np.log(right / (1 - right)) + np.log(0.3 / 0.7)  # with the true reliabilities
    best, ours = np.mean((odds > 0) == truth), np.mean((chance[of.ravel()] > 0.5) == truth)
    assert ours > best - 0.005


def test_long_texts_take_time_in_proportion():
    for unit in ("1", "a", "a@", "1.", "+1", "1 ", "AB12", "a:", "a(at)", "a@b."):
        text = unit * (200_000 // len(unit))
        base, found = P.spans_of(text)
        assert len(found) <= len(text) and base == sorted(base, key=lambda s: (s[0], P.KINDS.index(s[2])))
    assert P.base_spans("a" * 200_000 + "@b.c") == [(0, 200_004, "email")]


def test_repeated_rows_and_empty_table(docs):
    frame = docs("x a@b.co", "x a@b.co", None, ids=[3, 3, None])
    assert sorted(r["base"] for r in P.personal_data(frame).collect()) == ["", "email:2:8", "email:2:8"]
    assert P.personal_data(frame.limit(0)).count() == 0
