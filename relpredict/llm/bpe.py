"""Byte-level BPE: a streaming encoder with bounded lookahead, and an incremental decoder."""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from relpredict.llm.common import slices

#: Fixed value: how byte-level vocabularies of this family cut text into pieces before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_TWO_SPACES = re.compile(r"\s\s")
#: Entries of a worker's memos of encoded words and pieces; a memo is emptied when full.
WORD_ENTRIES, PIECE_ENTRIES = 150_000, 300_000
#: Characters of text that a worker hands on at a time.
HAND_ON = 2 << 20
#: Tokens that the decoder turns into text at a time.
DECODE_BLOCK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Vocabulary, merge ranks and added tokens of a ``tokenizer.json`` of the byte-level BPE kind."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        letters = byte_letters()
        plain = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.added.values()]))
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = plain[token]
        for content, i in self.added.items():
            self.token_bytes[i] = content.encode()
        ids = {plain[t]: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        made: set[int] = set(self.byte_ids)
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = ids[plain[a]], ids[plain[b]], ids[plain[a] + plain[b]]
            if left not in made or right not in made or whole in made:
                raise ValueError(f"merge {rank} isn't proper: streaming needs one merge per token, after its parts")
            made.add(whole)
            self.merges[left, right] = rank, whole
        self.made = [whole for _, whole in self.merges.values()]
        self.lookahead = self._sufficient_lookahead()
        self.window = 2 * (self.lookahead + max(map(len, self.token_bytes)))
        self.specials = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _sufficient_lookahead(self) -> int:
        """Bytes after which what follows can no longer move a token boundary.

        Encode a text and the same text with more appended. Both runs agree up to some boundary,
        first the end of the shorter text. A merge (a, b) across that boundary in one run alone moves
        it back by the length of a; the next such merge (c, d) has a higher rank, and a stands at the
        left edge of d's derivation. So the longest weighted chain of merges linked this way, in
        order of rank, bounds how far the boundary can move.
        """
        left_part = {whole: a for (a, _), (_, whole) in self.merges.items()}
        reach: dict[int, int] = {}
        longest = 0
        for (a, b), _ in self.merges.items():  # in order of rank
            before, edge = 0, b
            while edge is not None:
                before = max(before, reach.get(edge, 0))
                edge = left_part.get(edge)
            total = len(self.token_bytes[a]) + before
            reach[a] = max(reach.get(a, 0), total)
            longest = max(longest, total)
        return longest

    def merged(self, data: bytes) -> list[int]:
        """The tokens of one piece: lowest rank first, leftmost first among equals."""
        ids = [self.byte_ids[b] for b in data]
        merges = self.merges
        if len(ids) < 100:
            never = len(merges)
            ranks = [merges.get(pair, (never,))[0] for pair in zip(ids, ids[1:], strict=False)]
            while ranks and (rank := min(ranks)) < never:
                i = ranks.index(rank)
                ids[i : i + 2] = [self.made[rank]]
                del ranks[i]
                if i:
                    ranks[i - 1] = merges.get((ids[i - 1], ids[i]), (never,))[0]
                if i < len(ranks):
                    ranks[i] = merges.get((ids[i], ids[i + 1]), (never,))[0]
            return ids
        following, previous = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(found[0], i, found[1], a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, whole, a, b = heapq.heappop(heap)
            j = following[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            following[i] = following[j]
            if following[i] < len(ids):
                previous[following[i]] = i
            for x, y in ((previous[i], i), (i, following[i])):
                if x >= 0 and y < len(ids) and (found := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def transduced(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece of any length, each as soon as no later byte can change it.

        Holds at most ``window`` bytes: a token that ends ``lookahead`` bytes before the end of what
        has been read is final, and the rest of the piece is encoded as if it began there.
        """
        start, end = 0, min(len(data), self.window)
        while end < len(data):
            at = start
            for token in self.merged(data[start:end]):
                at += len(self.token_bytes[token])
                if at > end - self.lookahead:
                    break
                yield token
                start = at
            end = min(len(data), start + self.window)
        yield from self.merged(data[start:])


class Encoder(dict):
    """Encodes texts to packed little-endian ``uint32``; remembers a bounded number of words.

    A text without two white-space characters in a row is cut at its spaces first: a space always
    begins a piece there, so the cut never crosses one, and whole words are looked up.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        packed = self.pieces.get(piece)
        if packed is None:
            ids = [*self.tokenizer.transduced(piece.encode())]
            packed = Struct(f"<{len(ids)}I").pack(*ids)
            if len(piece) < 100:
                if len(self.pieces) >= PIECE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = packed
        return packed

    def _pack(self, text: str) -> bytes:
        return b"".join(map(self._piece, PIECES.findall(text)))

    def __missing__(self, word: str) -> bytes:
        packed = self._pack(" " + word)
        if len(word) < 100:
            if len(self) >= WORD_ENTRIES:
                self.clear()
            self[word] = packed
        return packed

    def _stretch(self, text: str) -> bytes:
        if _TWO_SPACES.search(text):
            return b"".join(self._piece(m.group()) for m in PIECES.finditer(text))
        first, *words = text.split(" ")
        return self._pack(first) + b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        specials = self.tokenizer.specials
        if not text:
            return b""
        if specials is None or not specials.search(text):
            return self._stretch(text)
        out, at = [], 0
        for found in specials.finditer(text):
            out += [self._stretch(text[at : found.start()]), self.tokenizer.added[found.group()].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._stretch(text[at:])])


class Decoder:
    """Bytes to text, one block of tokens at a time; an unfinished character waits for the next block."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes

    def decode(self, packed: bytes) -> str:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.frombuffer(packed, "<u4")
        parts = [
            state.decode(b"".join(map(self.token_bytes.__getitem__, ids[i : i + DECODE_BLOCK].tolist())))
            for i in range(0, len(ids), DECODE_BLOCK)
        ]
        return "".join([*parts, state.decode(b"", final=True)])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """This worker's encoder; its memos last as long as the worker."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = Encoder(Tokenizer(definition))
    return _ENCODERS[definition]


def encode(documents: DataFrame, definition: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (packed little-endian ``uint32``, as training shards hold them) of every row.

    ``definition`` is the text of a byte-level ``tokenizer.json``; it is broadcast (its size is that
    of one vocabulary). Equals that library's ``encode(text, add_special_tokens=False)``; the strings
    of added tokens become those tokens. A null or empty text gives no ids. Repeated rows are encoded
    each; no other column is read. There is no shuffle: one task reads, encodes and hands on, a bounded
    stretch of text at a time. ``decoded`` adds what ``decode`` would, without a second pass.
    """
    shared = documents.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        decoder = Decoder(encoder.tokenizer.token_bytes)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for a, b in slices(lengths, HAND_ON):
                part = batch.slice(a, b - a)
                ids = [encoder.encode(t.as_py() or "") for t in part.column(1)]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([decoder.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary{', text string' if decoded else ''}")


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """The rows of ``encode`` with ``text``: what the ids spell, special tokens included.

    Bytes that are no UTF-8 become U+FFFD; null ids give an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_encoder(shared.value).tokenizer.token_bytes)
        for batch in batches:
            texts = [decoder.decode(i.as_py() or b"") for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.select("doc_id").schema[0].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")
