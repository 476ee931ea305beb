"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of each language that a model is fitted on, at most (chosen by hash).
FIT_DOCUMENTS = 4_000
#: Words, and n-grams of each length, that a model keeps of each language, the most frequent ones.
KEPT_WORDS, KEPT_GRAMS = 30_000, 20_000
#: Lengths of n-grams, tried from the longest.
LENGTHS = (4, 3, 2, 1)
#: Words whose evidence a score counts in full; beyond them the mean counts.
FULL_WORDS = 12
#: Rows of a worker's memo; it is emptied when full.
MEMO_ROWS = 100_000
#: Rows that a worker hands on at a time.
HAND_ON = 500
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def hashes(items: list[str]) -> np.ndarray:
    """64-bit numbers by which items are told apart."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(i.encode("utf-8", "replace")) for i in items), np.uint64, len(items))


@dataclass(frozen=True)
class Table:
    """Items by their sorted hashes, each with its log frequencies per language: a few bytes an item in every worker."""

    keys: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, items: list[str], logs: np.ndarray) -> Table:
        keys = hashes(items)
        order = np.argsort(keys)
        return cls(keys[order], logs[order])

    def places(self, items: list[str]) -> np.ndarray:
        """The row of each item, -1 for an unknown one."""
        asked = hashes(items)
        if not len(self.keys):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, at, -1)


@dataclass(frozen=True)
class Model:
    """Log frequencies per language, of words and of n-grams."""

    languages: tuple[str, ...]
    words: Table
    grams: Table


def fit(labelled: DataFrame, per_language: int = FIT_DOCUMENTS, kept_words: int = KEPT_WORDS, kept_grams: int = KEPT_GRAMS) -> Model:
    """A model from ``text`` and ``lang``; rows where either is null teach nothing.

    Of each language ``per_language`` documents are expected in the sample (all, if it has fewer),
    drawn by a hash of the text, whole. Counting runs on Spark; what reaches the driver is bounded
    by ``kept_words`` words and ``kept_grams`` n-grams of each length of each language.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    shares = rows.groupBy("lang").agg((F.lit(per_language * 1_000_000.0) / F.count("*")).alias("share"))
    drawn = rows.join(F.broadcast(shares), "lang").where("pmod(xxhash64(text), 1000000) < share")
    words = drawn.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("item"))
    counts = words.groupBy("lang", "item").agg(F.count("*").alias("n")).withColumn("length", F.lit(0))
    top = Window.partitionBy("lang", "length").orderBy(F.desc("n"), "item")
    kept = counts.withColumn("place", F.row_number().over(top)).where(F.col("place") <= kept_words)
    padded = counts.selectExpr("lang", "concat('^', item, '$') AS item", "n")
    grams = padded.selectExpr(
        "lang",
        "n",
        "explode(flatten(transform(array(" + ", ".join(map(str, LENGTHS)) + "), k -> "
        "transform(CASE WHEN char_length(item) < k THEN array() ELSE sequence(1, char_length(item) - k + 1) END, i -> substring(item, i, k))))) AS item",
    )
    grams = grams.groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("length", F.char_length("item"))
    grams = grams.withColumn("place", F.row_number().over(top)).where(F.col("place") <= kept_grams)
    found = kept.unionByName(grams).select("lang", "item", "n", "length").toPandas()

    languages = tuple(sorted(found["lang"].unique()))
    column = {x: i for i, x in enumerate(languages)}
    items: dict[bool, list[str]] = {True: [], False: []}
    logs: dict[bool, list[np.ndarray]] = {w: [np.zeros((0, len(languages)))] for w in (True, False)}
    for length, part in found.groupby("length"):
        totals = np.zeros(len(languages))
        np.add.at(totals, part["lang"].map(column), part["n"])
        own, place = np.unique(part["item"], return_inverse=True)
        values = np.full((len(own), len(languages)), 0.5)
        values[place, part["lang"].map(column)] += part["n"]
        logs[length == 0].append(np.log(values) - np.log(totals + 0.5 * len(own)))
        items[length == 0].extend(own)
    return Model(languages, *(Table.of(items[w], np.concatenate(logs[w])) for w in (True, False)))


class _Scores(dict):
    """Word to row of a table of per-language scores; the unseen words of a block are scored at once and remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((MEMO_ROWS, len(model.languages)))

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, or the mean of those of its longest known n-grams."""
        model = self.model
        out = np.zeros((len(words), len(model.languages)))
        at = model.words.places(words)
        out[at >= 0] = model.words.logs[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for k in LENGTHS:
            if not len(rest):
                break
            padded = [f"^{words[i]}$" for i in rest]
            fan = np.maximum(np.array([len(p) for p in padded]) - k + 1, 0)
            at = model.grams.places([p[i : i + k] for p in padded for i in range(len(p) - k + 1)])
            owner = np.repeat(np.arange(len(rest)), fan)[at >= 0]
            found = model.grams.logs[at[at >= 0]]
            count = np.bincount(owner, minlength=len(rest))
            sums = np.stack([np.bincount(owner, weights=column, minlength=len(rest)) for column in found.T], 1)
            met = count > 0
            out[rest[met]] = sums[met] / count[met, None]
            rest = rest[~met]
        return out

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(self.model.languages))
        for i in range(0, len(words), MEMO_ROWS // 4):
            block = words[i : i + MEMO_ROWS // 4]
            new = [w for w in dict.fromkeys(block) if w not in self]
            if len(self) + len(new) > MEMO_ROWS:
                self.clear()
                new = list(dict.fromkeys(block))
            if new:
                start = len(self)
                self.table[start : start + len(new)] = self.scores(new)
                self.update(zip(new, range(start, start + len(new)), strict=True))
            rows = np.fromiter(map(self.__getitem__, block), np.int64, len(block))
            total += self.table[rows].sum(axis=0)
        return total


def predict(scores: _Scores, text: str | None) -> tuple[str, float]:
    """Language and score of one text."""
    names = scores.model.languages
    words = _LETTERS.findall((text or "").lower())
    if not words or not names:
        return UNKNOWN, 0.0
    evidence = scores.total(words) * (min(len(words), FULL_WORDS) / len(words))
    best = int(evidence.argmax())
    return names[best], float(1.0 / np.exp(evidence - evidence[best]).sum())


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from the whole ``text`` and nothing else.

    ``score`` is the posterior of the predicted language, between 0 and 1, at the mean evidence of a
    word times the number of words (``FULL_WORDS`` at most). A text that is null, empty or without a
    letter is ``und`` with score 0, and so is everything under a model without languages; ties go to
    the smaller name. Repeated rows are judged each. There is no shuffle; the model is broadcast, its
    size bounded by what ``fit`` keeps.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            found = [predict(scores, t.as_py()) for t in batch.column(1)]
            predicted, sure = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predicted, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose language is found with that score at least."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, HAND_ON):
                part = batch.slice(start, HAND_ON)
                found = (predict(scores, t.as_py()) for t in part.column("text"))
                yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
