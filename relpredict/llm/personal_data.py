"""Personal data: fixed patterns, and labelers whose votes are weighed by EM and train a span classifier."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relpredict.llm.common import stored

#: Kinds in the order in which spans of the same start are listed; the first four have fixed patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "id", "name")
BASE = KINDS[:4]
#: Characters before a span in which words speak for or against it.
NEAR = 40
#: A span is added from this chance on.
LEAST = 0.5
ROUNDS = 40
#: Occurrences that what is assumed of a labeler counts for, against those in the corpus.
ASSUMED = 20.0

# First digits of card issuers, country calling codes, ends of host names, IBAN countries.
ISSUERS = ("4", "34", "35", "36", "37", "38", "51", "52", "53", "54", "55", "60", "62", "64", "65")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "64", "81", "82", "86", "91", "351", "352", "353", "420")
ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "ch", "at", "us")
BANKS = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
FIRST_NAMES = (
    "James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Barbara Hans Peter Klaus Wolfgang "
    "Ursula Monika Sabine Jean Pierre Michel Marie Nathalie Isabelle José Antonio Manuel Francisco Carmen María Dolores"
).split()
FOR = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write to"),
    "ip": ("ip", "server", "host", "address", "adresse", "login"),
    "card": ("card", "karte", "carte", "tarjeta", "visa", "mastercard", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "handy", "anruf", "appel", "llama", "móvil"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "id": ("ssn", "social security", "passport", "ausweis", "dni", "identity"),
    "name": ("name", "named", "author", "signed", "dear", "von", "by"),
}
AGAINST = ("version", "isbn", "issn", "page", "seite", "order", "section", "figure", "doi", "license", "licence", "serial", "build")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A match never begins inside a run of digits: what fails at its start fails inside it too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])\+?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_VEILED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63})+")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NAME = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.? (?:[A-Z][\w'-]{{1,30}} )?|(?:{'|'.join(FIRST_NAMES)}) )[A-Z][\w'-]{{1,30}}")
_FIRST = re.compile(rf"\b(?:{'|'.join(FIRST_NAMES)})\b")
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}|(?:1[89]|20)[0-9]{2} ?[-/] ?(?:1[89]|20)[0-9]{2})")
_FOR = {kind: re.compile(r"\b(?:" + "|".join(words) + ")") for kind, words in FOR.items()}
_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST) + ")")

#: Labelers and the shapes that the classifier also sees, with the number of values of each.
LABELERS = {"pattern": 2, "checksum": 3, "gazetteer": 3, "context": 3, "isolation": 3, "grouping": 3}
SHAPES = {"digits": 4, "separators": 3, "before": 2, "after": 2}
_SIZES = tuple({**LABELERS, **SHAPES}.values())
CODES = int(np.prod(_SIZES))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern. Each run before an ``@`` is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start, width = at, 64
        while start > end:
            low = max(end, at - width)
            start = low + len(text[low:at].rstrip(_LOCAL))
            if start > low or low == end:
                break
            width *= 2
        found = _HOST.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the four fixed patterns, ordered by start, then kind."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans that may be personal data though no fixed pattern has them."""
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_digits(m.group()))
            if m.group()[0] != "+" and re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m.group()):
                yield m.start(), m.end(), "id"
            elif m.group()[0] != "+" and 13 <= n <= 19:
                yield m.start(), m.end(), "card"
            elif n <= 15:
                yield m.start(), m.end(), "phone"
        yield from ((m.start(), m.end(), "iban") for m in _IBAN.finditer(text))
    if text.count(":") > 3:
        yield from ((m.start(), m.end(), "ip") for m in _IP6.finditer(text))
    if "at)" in text or "at]" in text:
        yield from ((m.start(), m.end(), "email") for m in _VEILED.finditer(text))
    yield from ((m.start(), m.end(), "name") for m in _NAME.finditer(text))


def _iban_fits(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def code_of(text: str, start: int, end: int, kind: str, base: bool) -> int:
    """The labelers' votes on a span (0 against, 1 none, 2 for) and its shape, as one number."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[start - 1 : start], text[end : end + 1]
    checksum = gazetteer = context = grouping = 1
    if kind == "card":
        checksum = 2 * luhn(digits)
        gazetteer = 2 * digits.startswith(ISSUERS)
        groups = [len(g) for g in re.split("[^0-9]+", span)]
        grouping = 2 if len(groups) == 1 or groups[:-1] == [4] * (len(groups) - 1) else 0
    elif kind == "phone":
        if span[0] == "+":
            gazetteer = 2 * digits.startswith(CALLING)
        elif digits[0] == "0":
            gazetteer = 2
        grouping = 0 if _DATE.search(span) or "/" in span else 2 if re.search("[ ().-]", span) else 1
    elif kind == "email":
        gazetteer = 2 * (re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1].lower() in ENDS)
    elif kind == "ip":
        gazetteer = 0 if re.match(r"(?:0|10|127|192\.168|255)\.", span) else 1
        grouping = 0 if re.search(r"(?:^|\.)0[0-9]", span) else 1
    elif kind == "iban":
        checksum, gazetteer = 2 * _iban_fits(span), 2 * (span[:2] in BANKS)
    elif kind == "id":
        checksum = 0 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 2
    else:
        gazetteer = 2 if _FIRST.search(span) else 1
    near = text[max(0, start - NEAR) : start].lower()
    if _AGAINST.search(near):
        context = 0
    elif _FOR[kind].search(near):
        context = 2
    isolation = 0 if before.isalnum() or after.isalnum() else 2
    marks = len({c for c in span if not c.isalnum() and c != "+"})
    shape = (min(3, max(0, len(digits) - 5) // 4), min(2, marks), before in ("", " ", "\n"), after in ("", " ", "\n"))
    return int(np.ravel_multi_index((int(base), checksum, gazetteer, context, isolation, grouping, *map(int, shape)), _SIZES))


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
    """Spans of the fixed patterns, and all candidates with their codes; those of fixed patterns are negative, less one."""
    base = base_spans(text)
    candidates = [(s, e, k, -1 - code_of(text, s, e, k, True)) for s, e, k in base]
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in base:  # joined where they overlap
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for start, end, kind in _proposals(text):
        before = bisect_left(starts, end) - 1
        if before < 0 or ends[before] <= start:
            candidates.append((start, end, kind, code_of(text, start, end, kind, False)))
    return base, candidates


_FOUND = "base string, candidates array<struct<start:bigint,stop:bigint,kind:int,code:int>>"
_CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("code", pa.int32())]))


def _text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scanned(documents: DataFrame) -> DataFrame:
    """``doc_id``, counts and spans of the fixed patterns, and all candidates of every row; texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            texts, candidates = [], []
            for value in batch.column(1):
                base, found = spans_of(value.as_py() or "")
                for column, kind in zip(counts, BASE, strict=True):
                    column.append(sum(k == kind for _, _, k in base))
                texts.append(_text(base))
                candidates.append([{"start": s, "stop": e, "kind": KINDS.index(k), "code": c} for s, e, k, c in found])
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(texts, pa.string()), pa.array(candidates, _CANDIDATE)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in BASE], "base", "candidates"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = ", ".join([f"doc_id {kind}", *[f"n_{k} bigint" for k in BASE], _FOUND])
    return documents.select("doc_id", "text").mapInArrow(run, fields)


@dataclass(frozen=True)
class Model:
    """Of each kind: how reliable its labelers are (votes that are right among those cast), and the codes to accept."""

    reliability: dict[str, dict[str, float]]
    accepted: dict[str, np.ndarray]


def weigh(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The chance that each pattern of votes is right, and ``tables[y, labeler, vote]``, by expectation-maximisation.

    ``votes`` are 0 (against), 1 (none) or 2 (for); labelers are independent given the truth. Every
    table starts from, and is held by ``ASSUMED`` occurrences of, a labeler that is more often right.
    """
    start = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :].repeat(votes.shape[1], axis=1)
    tables, share = start.copy(), 0.5
    hot = np.eye(3)[votes]
    for _ in range(rounds):
        logs = np.einsum("pjv,yjv->py", hot, np.log(tables)) + np.log([1 - share, share])
        chance = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        for y, weight in ((0, n * (1 - chance)), (1, n * chance)):
            sums = np.einsum("p,pjv->jv", weight, hot) + ASSUMED * start[y]
            tables[y] = sums / sums.sum(axis=1, keepdims=True)
        share = float((n @ chance + 0.5 * ASSUMED) / (n.sum() + ASSUMED))
    return chance, tables


def train(features: np.ndarray, n: np.ndarray, chance: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on weighted rows whose labels are chances, by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (n * (p - chance)) + ridge * w
        bend = (features * (n * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _one_hot(parts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(k)[parts[:, i]] for i, k in enumerate(_SIZES)], axis=1)


def fit(found: DataFrame) -> Model:
    """A model from the candidates of all rows of ``scanned``.

    What reaches the driver is a count for each kind and code, at most ``len(KINDS) * CODES`` rows at
    any size. A kind without a candidate accepts nothing.
    """
    codes = found.select(F.explode("candidates").alias("c")).selectExpr("c.kind AS kind", "IF(c.code < 0, -1 - c.code, c.code) AS code")
    rows = codes.groupBy("kind", "code").agg(F.count("*").alias("n")).orderBy("kind", "code").toPandas()
    reliability, accepted = {}, {}
    for i, kind in enumerate(KINDS):
        own = rows[rows["kind"] == i]
        code, n = own["code"].to_numpy(np.int64), own["n"].to_numpy(float)
        if not len(code):
            reliability[kind], accepted[kind] = {}, code
            continue
        parts = np.stack(np.unravel_index(code, _SIZES), 1)
        votes = parts[:, : len(LABELERS)].copy()
        votes[:, 0] += 1  # the fixed patterns vote for a span or not at all
        patterns, of = np.unique(votes, axis=0, return_inverse=True)
        chance, tables = weigh(patterns, np.bincount(of.ravel(), n))
        right = tables[1, :, 2] + tables[0, :, 0]
        reliability[kind] = dict(zip(LABELERS, (right / (right + tables[1, :, 0] + tables[0, :, 2])).tolist(), strict=True))
        features = _one_hot(parts)
        w = train(features, n, chance[of.ravel()])
        accepted[kind] = code[1 / (1 + np.exp(-(features @ w))) >= LEAST]
    return Model(reliability, accepted)


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base`` and ``spans`` of every row.

    ``base`` lists the spans of the four fixed patterns as ``kind:start:end`` (code points, end
    exclusive), by start and kind, joined by commas; ``spans`` those and the ones that the trained
    classifier adds, which overlap no fixed one and no earlier one of their kind. A null or empty text
    has none. Repeated rows are judged each; an empty table gives no rows; other columns are ignored.

    Labelers (patterns, checksums, gazetteers, words nearby, isolation, grouping) vote on candidates of the
    whole corpus. Their reliabilities come from the votes alone, by expectation-maximisation, and the
    resulting chances train a classifier that also sees the shape of a span.
    """
    found = stored(scanned(documents), "candidates")
    shared = documents.sparkSession.sparkContext.broadcast(fit(found).accepted)
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = [set(shared.value[k].tolist()) for k in KINDS]
        for batch in batches:
            spans = []
            for candidates in batch.column("candidates").to_pylist():
                kept, ends = [], dict.fromkeys(range(len(KINDS)), 0)
                for c in sorted(candidates, key=lambda c: (c["start"], -c["stop"], c["kind"])):
                    if c["code"] < 0:
                        kept.append((c["start"], c["stop"], KINDS[c["kind"]]))
                    elif c["code"] in accepted[c["kind"]] and c["start"] >= ends[c["kind"]]:
                        ends[c["kind"]] = c["stop"]
                        kept.append((c["start"], c["stop"], KINDS[c["kind"]]))
                spans.append(_text(sorted(kept, key=lambda s: (s[0], KINDS.index(s[2])))))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(spans, pa.string())], [*names, "spans"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in names)
    return found.mapInArrow(run, kinds + ", spans string")
