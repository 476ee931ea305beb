import random

import public_tokenizers
import pytest
from corpus_fixtures import docs  # noqa: F401
from relpredict.llm import bpe
from tokenizers import Tokenizer as Library

PATH = public_tokenizers.path("byte_bpe_50k.json")
DEFINITION = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Tokenizer(DEFINITION))


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_equals_the_library_on_odd_texts(library, encoder):
    rng = random.Random(3)
    letters = list(" \n\t\r\x0b\x0c\x1c\x85\xa0 ᠎​　aéß1²Ⅷ٣_'-.!") + ["<|endoftext|>", "'re", "the", "  ", "\U0001f600", "中文"]
    decoder = bpe.Decoder(encoder.tokenizer.token_bytes)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        expected = library.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert ids(packed) == expected, text
        assert decoder.decode(packed) == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "the", "ation", "-=", "0", " ", "\n", "é", "中"])
def test_long_pieces_stream_in_bounded_windows(library, encoder, letters):
    rng = random.Random(letters)
    for n in (300, 900, 5000):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert ids(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert encoder.tokenizer.lookahead < encoder.tokenizer.window < 4096


def test_lookahead_is_sufficient(encoder):
    """Tokens that end that far before the end of a prefix are those of the whole."""
    tokenizer = encoder.tokenizer
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("aeinorst ") for _ in range(1500)).replace(" ", rng.choice(["", "x"])).encode()
        whole, cut = tokenizer.merged(text), tokenizer.merged(text[:900])
        at = 0
        for a, b in zip(whole, cut, strict=False):
            at += len(tokenizer.token_bytes[b])
            if at > 900 - tokenizer.lookahead:
                break
            assert a == b


def test_frames(docs, library):
    texts = ["Hello there,  world\n", "", None, "ab " * 40_000, "Hello there,  world\n"]
    frame = docs(*texts, ids=[1, 2, None, 4, 1])
    out = bpe.decode(bpe.encode(frame, DEFINITION), DEFINITION).collect()
    assert sorted((r["text"] for r in out), key=len) == sorted((t or "" for t in texts), key=len)
    for r in out:
        assert ids(r["ids"]) == library.encode(r["text"], add_special_tokens=False).ids
    key = lambda r: (str(r["doc_id"]), len(r["ids"]), r["text"])
    assert sorted(map(key, bpe.encode(frame, DEFINITION, decoded=True).collect())) == sorted(map(key, out))
    assert bpe.encode(frame.limit(0), DEFINITION).count() == 0


def test_decoder_holds_back_unfinished_characters(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_BLOCK", 1)
    text = "\U0001f600 中é \U0001f9ff"
    assert bpe.Decoder(encoder.tokenizer.token_bytes).decode(encoder.encode(text)) == text


def test_improper_merges_are_refused():
    import json

    spec = json.loads(DEFINITION)
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    bpe.Tokenizer(json.dumps(spec))  # independent merges may change places
    spec["model"]["merges"].append(spec["model"]["merges"][0])
    with pytest.raises(ValueError, match="proper"):
        bpe.Tokenizer(json.dumps(spec))
