import re

from corpus_fixtures import docs, words  # noqa: F401
from relpredict.llm.quality_rules import RULES, Rule, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(words):
    """Words inside five-word windows that occur twice or more, counted naively."""
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(covered)


def found(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


def test_counts_against_brute_force(docs, words):
    texts = [
        " ".join(words(60, 1)),
        " ".join(words(20, 2) + words(20, 2)),
        " ".join(["a"] * 30),
        "one two\none two\n \none two three\n",
        "x\x0by\x0cz\r\t q r * # !",
        "short",
        "",
        None,
        " \n\t ",
        " ".join(words(9, 3) * 400),
    ]
    out = found(quality_rules(docs(*texts)))
    for i, text in enumerate(texts, 1):
        ws = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        row = out[i]
        assert row["n_words"] == len(ws)
        assert row["word_chars"] == sum(map(len, ws))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        if len(ws) < 1000:
            assert row["n_repeat_words"] == repeated(ws)
        assert row["base_failed"] == (len(ws) < 10 or 100 * row["n_repeat_words"] > 20 * len(ws))
    assert out[10]["n_repeat_words"] == 3600


def test_rules_decide_and_name_themselves(docs):
    prose = "the cat of the house and the dog in a field that was for it"
    shout = " ".join(f"{w.upper()}!!" for w in prose.split())
    out = found(quality_rules(docs(prose, shout, prose.replace(" ", " # "))))
    assert out[1]["kept"] and out[1]["failed_rules"] == []
    assert "shouting" in out[2]["failed_rules"] and not out[2]["kept"]
    assert "symbols" in out[3]["failed_rules"] and not out[3]["kept"]
    assert {r.name for r in RULES} >= {"symbols", "stop_words"}


def test_own_table_repeated_rows_and_empty_table(docs):
    frame = docs("a b c d e f g h i j", "a b c d e f g h i j", ids=[7, 7])
    out = quality_rules(frame, (Rule("few", "n_words", "n_lines", None, 1000),)).collect()
    assert [(r["doc_id"], r["failed_rules"], r["kept"]) for r in out] == [(7, ["few"], False)] * 2
    assert quality_rules(frame.limit(0)).count() == 0
