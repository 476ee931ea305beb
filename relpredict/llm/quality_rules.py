"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from relpredict.llm.common import PIECES, replaced

#: Frequent function words of the four languages served.
STOP_WORDS = (
    "the of to and in that is was it for on be with as at this have from by are or an a "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un une du que dans par pour au sur est pas plus ce il "
    "el los las del por con para como su al lo no se y"
).split()
SYMBOLS = "#*$%&|<>"
#: Words that one repeated window holds.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low * per <= 1000 * measure <= high * per``; None leaves an end open.

    ``measure`` and ``per`` name columns of the projection, so limits are thousandths of ``per``.
    """

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None

    def condition(self) -> str:
        ends = []
        if self.low is not None:
            ends.append(f"1000 * {self.measure} >= {self.low} * {self.per}")
        if self.high is not None:
            ends.append(f"1000 * {self.measure} <= {self.high} * {self.per}")
        return " AND ".join(ends) or "true"


#: The production table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 25_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("shouting", "n_marks", "n_words", None, 200),
    Rule("stop_words", "n_stop_words", "n_words", 10, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
)

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

#: Lines that hold a word.
_LINES = r"filter(split(text, '\n'), l -> l RLIKE '[^ \\t-\\r]')"

_COUNTED = f"""struct(
  CAST(size(words) AS BIGINT) AS n_words,
  CAST(char_length(text) - size(pieces) + 1 AS BIGINT) AS word_chars,
  CAST(char_length(text) - char_length({replaced('text', SYMBOLS, '')}) AS BIGINT) AS n_symbols,
  CAST(char_length(text) - char_length({replaced('text', '!?', '')}) AS BIGINT) AS n_marks,
  CAST(size(lines) AS BIGINT) AS n_lines,
  CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(size(filter(words, w -> w IN ({_STOP}))) AS BIGINT) AS n_stop_words)"""

_WINDOWS = (
    "slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2), get(words, i + 3), get(words, i + 4))), "
    f"1, greatest(size(words) - {WINDOW - 1}, 0))"
)

#: Words inside windows that occur twice or more: sort windows, keep those with an equal neighbour, add up the stretches.
_REPEATED = f"""
CASE WHEN size(array_distinct(qr_windows)) = size(qr_windows) THEN 0L ELSE
  transform(array(sort_array(transform(qr_windows, (x, i) -> struct(x AS h, i AS p)))), s ->
    aggregate(
      sort_array(transform(
        filter(s, (e, i) -> get(s, i - 1).h <=> e.h OR get(s, i + 1).h <=> e.h),
        e -> e.p)),
      struct(0L AS n, -{WINDOW} AS last),
      (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last),
      a -> a.n))[0] END
"""


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdicts for every row of ``documents`` (``doc_id``, ``text``), one projection, no shuffle.

    Words are runs of characters other than space and tab to carriage return. Returns ``doc_id``, the
    counts, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``. A null or empty
    text has no words: all counts are 0, ``base_failed`` is true. A ratio over nothing passes its
    rule. Repeated rows and repeated ids are judged row by row; other columns are not read, so their
    names cannot clash. Window positions are compared by 64-bit hashes within one text.
    """
    base = documents.selectExpr("doc_id", "coalesce(text, '') AS text")
    pieces = base.selectExpr("doc_id", "text", f"{PIECES} AS pieces", f"{_LINES} AS lines")
    words = pieces.selectExpr("*", "array_remove(pieces, '') AS words")
    counted = words.selectExpr("doc_id", f"{_COUNTED} AS c", f"{_WINDOWS} AS qr_windows")
    counted = counted.selectExpr("doc_id", "c.*", "qr_windows")
    repeated = counted.selectExpr("*", f"{_REPEATED} AS n_repeat_words").drop("qr_windows")
    judged = repeated.selectExpr(
        "*",
        "n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed",
        "filter(array(" + ", ".join(f"CASE WHEN NOT ({r.condition()}) THEN '{r.name}' END" for r in rules)
        + "), r -> r IS NOT NULL) AS failed_rules",
    )
    return judged.selectExpr("*", "NOT base_failed AND size(failed_rules) = 0 AS kept")
