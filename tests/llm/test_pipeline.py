import corpus_pipeline as C
import public_tokenizers
import pytest
from corpus_fixtures import docs, words  # noqa: F401
from tokenizers import Tokenizer as Library


def test_stages():
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "repeats", "mixture", "bpe"]
    assert C.ORACLE_SQL is None


@pytest.fixture(scope="module")
def corpus(docs, words):  # noqa: F811
    english = "the house and the garden of the old town were quiet in the evening"
    texts, langs = [], []
    passage = " ".join(words(90, 99))
    for i in range(24):
        own = " ".join(w if k % 3 else english.split()[k // 3 % 13] for k, w in enumerate(words(160, i)))
        texts.append(f"{own} {passage}" if i < 4 else own)
        langs.append("en")
    texts += [texts[10], texts[11] + " more", "12345 ...", None, "das haus und der garten der alten stadt " * 6]
    langs += ["en", "en", "en", "en", "de"]
    return docs(*texts, langs=langs), texts, passage


def test_every_decision_takes_effect(spark, corpus):
    frame, texts, passage = corpus
    kept = C.identify_language(spark, frame, "")
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(1, 30)) - {27, 28}
    once = C.drop_near_duplicates(spark, kept, "")
    assert {r["doc_id"] for r in once.collect()} == set(range(1, 30)) - {25, 26, 27, 28}
    cut = {r["doc_id"]: r for r in C.cut_repeats(spark, once, "").collect()}
    for i in range(1, 5):
        assert passage[100:-100] not in cut[i]["text"] and cut[i]["text"].startswith(texts[i - 1][:100])
        assert cut[i]["n_chars"] == len(cut[i]["text"])
    assert all(cut[i]["text"] == texts[i - 1] for i in range(5, 25))


def test_last_stage_equals_the_library(spark, corpus):
    frame, texts, _ = corpus
    library = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in C.encode_bpe(spark, frame, "").collect():
        ids = library.encode(texts[r["doc_id"] - 1] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == b"".join(i.to_bytes(4, "little") for i in ids)


def test_run_chains_all_stages(spark, corpus, tmp_path):
    frame, _, _ = corpus
    frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/some/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        staged = stage(spark, rows, "")
        assert staged.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = staged
    expected = C.STAGES[-1][1](spark, rows, "")
    found = C.run(spark, f"{tmp_path}/some")
    same = lambda f: sorted(tuple(r) for r in f.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert same(found) == same(expected) and found.count() > 20


def test_run_over_an_empty_table(spark, corpus, tmp_path):
    frame, _, _ = corpus
    frame.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
