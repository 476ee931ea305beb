"""Phrase collocations: count transducers of shards, united by prefix range, composed to look up parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relpredict.llm.common import mixed, stored
from relpredict.llm.transducers import Paths, composed, pack, united, unpack

#: A phrase is a candidate from this many occurrences on.
LEAST = 10
#: A candidate goes if a longer one around it has at least this share of its occurrences (percent).
INSIDE = 50
#: Phrases of each language in the result.
FIRST = 2_000
#: Scores are whole multiples of one part in so many.
SCALE = 1_000_000
#: Bytes of text that a shard transducer covers. Fewer than 2**21 words, so three word numbers fit 63 bits.
SHARD = 1 << 22
#: Bytes of all texts that fall to one prefix range.
RANGE = 8_000_000
#: Parts into which the candidates of a language are dealt before they are ordered.
SALTS = 64
UNKNOWN = "und"

#: Pieces end at these; they become a byte that UTF-8 never has. A-Z are lower-cased, tabs are spaces.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"
_TABLE = bytes.maketrans(_ENDS + b"\t" + bytes(range(65, 91)), _BREAK * len(_ENDS) + b" " + bytes(range(97, 123)))

_SHARDS = "lang string, bucket bigint, total bigint, paths binary"
_ASKED = "lang string, bucket bigint, home bigint, paths binary"
_FOUND = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"


def _hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _buckets(paths: Paths, ranges: int) -> np.ndarray:
    """The prefix range of each path: ranges of a hash of its first two words, so that all are equally wide.

    Phrases of two words fall to the range of the longer ones that begin with them.
    """
    word = np.append(_hash(paths.words), np.uint64(0))
    with np.errstate(over="ignore"):
        key = mixed(mixed(word[paths.a]) + np.uint64(0x9E3779B97F4A7C15) * word[paths.b])
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _split(paths: Paths, ranges: int) -> Iterator[tuple[int, Paths]]:
    """Paths by their prefix range; each part keeps their order."""
    bucket = _buckets(paths, ranges)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(bucket[order[start]]), paths.take(order[start:end])


def _segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A prepared text in parts of about a shard, cut between words; and how many of a part's first words are led in.

    A part begins with the two words before it, which were counted there already.
    """
    if len(text) <= SHARD:
        yield text, 0
        return
    start, lead = 0, b""
    while start < len(text):
        end = min(start + SHARD, len(text))
        if end < len(text):
            cuts = (text.find(b" ", end), text.find(_BREAK, end))
            end = min((c for c in cuts if c >= 0), default=len(text))
        part = text[start:end]
        yield lead + b" " + part if lead else part, len(lead.split(b" ")) if lead else 0
        tail = (lead + b" " + part).rsplit(_BREAK, 1)[-1] if lead else part.rsplit(_BREAK, 1)[-1]
        lead = b" ".join(tail.split()[-2:])
        if text[end : end + 1] == _BREAK:
            lead = b""
        start = end


def counted(segments: list[tuple[bytes, int]]) -> Paths:
    """All phrases of one to three words of a shard with their counts, sorted."""
    tokens: list[bytes] = []
    led: list[int] = []
    for text, lead in segments:
        led.extend(range(len(tokens) + 1, len(tokens) + 1 + lead))
        tokens.append(_BREAK)
        tokens.extend(text.replace(_BREAK, b" \xff ").split())
    words = sorted(set(tokens) - {_BREAK})
    number = {w: i for i, w in enumerate(words)}
    number[_BREAK] = -1
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    v = len(words) + 1
    new = np.ones(len(ids), bool)
    new[led] = False
    keys = []
    whole = ids >= 0
    padded = np.concatenate([[-1, -1], ids])
    one, two = padded[1:-1] >= 0, padded[:-2] >= 0
    for length in (1, 2, 3):
        at = np.flatnonzero(whole & new & (one if length > 1 else True) & (two & one if length > 2 else True))
        key = np.zeros(len(at), np.int64)
        for k in range(3):
            key = key * v + (ids[at - (length - 1) + k] + 1 if k < length else 0)
        keys.append(key)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    rest, c = np.divmod(key, v)
    a, b = np.divmod(rest, v)
    return Paths(words, a - 1, b - 1, c - 1, n)


def _shards(documents: DataFrame, ranges: int) -> DataFrame:
    """Count transducers of shards, cut into prefix ranges."""
    names = ["lang", "bucket", "total", "paths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bytes, int]]] = {}
        size: dict[str, int] = {}

        def ended(lang: str) -> pa.RecordBatch:
            paths = counted(held.pop(lang))
            del size[lang]
            parts = list(_split(paths, ranges))
            total = [int(p.n[p.b < 0].sum()) for _, p in parts]
            columns = [pa.array([lang] * len(parts), pa.string()), pa.array([b for b, _ in parts], pa.int64()), pa.array(total, pa.int64()), pa.array([pack(p) for _, p in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py()
                if not text:
                    continue
                for segment, lead in _segments(text.translate(_TABLE)):
                    if lang in held and size[lang] + len(segment) > SHARD:
                        yield ended(lang)
                    held.setdefault(lang, []).append((segment, lead))
                    size[lang] = size.get(lang, 0) + len(segment)
                    if sum(size.values()) > 4 * SHARD:
                        yield ended(max(size, key=size.__getitem__))
        for lang in list(held):
            yield ended(lang)

    named = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return documents.select(named, "text").mapInArrow(run, _SHARDS)


def _merged(table: pa.Table) -> pa.Table:
    """The union of all parts of a prefix range; only phrases that are frequent enough stay."""
    blobs = table.column("paths").to_pylist()
    whole = united([])
    for start in range(0, len(blobs), 64):  # a bounded number of parts is open at a time
        whole = united([whole, *map(unpack, blobs[start : start + 64])])
    total = sum(table.column("total").to_pylist())
    kept = whole.take(whole.n >= LEAST)
    rows = {"lang": [table.column("lang")[0].as_py()], "bucket": [table.column("bucket")[0].as_py()], "total": [total], "paths": [pack(kept)]}
    return pa.table(rows, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("total", pa.int64()), ("paths", pa.binary())]))


def _wanted(paths: Paths) -> Paths:
    """The parts that candidates need from other ranges: first and last words, and the last two words.

    The weight is that of the most frequent longer phrase that ends in those two words, 1 for single words.
    """
    two, three = np.flatnonzero((paths.b >= 0) & (paths.c < 0)), np.flatnonzero(paths.c >= 0)
    words = np.concatenate([paths.a[two], paths.b[two], paths.a[three], paths.c[three]])
    words = np.unique(words)
    last = np.lexsort((paths.n[three], paths.c[three], paths.b[three]))
    b, c, n = paths.b[three][last], paths.c[three][last], paths.n[three][last]
    most = np.flatnonzero(np.concatenate([(b[1:] != b[:-1]) | (c[1:] != c[:-1]), [True]])[: len(b)])
    none = np.full(len(words), -1, np.int64)
    a = np.concatenate([words, b[most]])
    second = np.concatenate([none, c[most]])
    n = np.concatenate([np.ones(len(words), np.int64), n[most]])
    order = np.lexsort((second, a))
    whole = Paths(paths.words, a[order], second[order], np.full(len(order), -1, np.int64), n[order])
    return whole.take(np.arange(len(order)))


def _questions(frequent: DataFrame, ranges: int) -> DataFrame:
    """Parts that each range asks of the others, as automata: a part is asked for once a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = _wanted(unpack(row["paths"]))
                parts = list(_split(asked, ranges)) if len(asked) else []
                columns = [pa.array([row["lang"]] * len(parts), pa.string()), pa.array([b for b, _ in parts], pa.int64()), pa.array([row["bucket"]] * len(parts), pa.int64()), pa.array([pack(p) for _, p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "home", "paths"])

    return frequent.select("lang", "bucket", "paths").mapInArrow(run, _ASKED)


_ASKED_ARROW = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("home", pa.int64()), ("paths", pa.binary())])
_FOUND_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])


def _answered(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """Composes a range's transducer with what others ask: their parts' counts, and which own phrases stand inside longer ones.

    Answers go to the asking range; phrases to drop go to the range itself, with ``home`` -1.
    """
    rows: list[tuple[str, int, int, bytes]] = []
    if counts.num_rows and asked.num_rows:
        lang, bucket = counts.column("lang")[0].as_py(), counts.column("bucket")[0].as_py()
        own = unpack(counts.column("paths")[0].as_py())
        inside = np.zeros(len(own), np.int64)
        for home, blob in zip(asked.column("home").to_pylist(), asked.column("paths"), strict=True):
            wanted = unpack(blob.as_py())
            at = composed(own, wanted)
            np.maximum.at(inside, at[at >= 0], wanted.n[at >= 0])
            answer = Paths(wanted.words, wanted.a[at >= 0], wanted.b[at >= 0], wanted.c[at >= 0], own.n[at[at >= 0]])
            rows.append((lang, home, bucket, pack(answer)))
        dropped = own.take((own.b >= 0) & (own.c < 0) & (100 * inside >= INSIDE * own.n))
        rows.append((lang, bucket, -1, pack(dropped)))
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _ASKED_ARROW.types, strict=True)], schema=_ASKED_ARROW)


def _scored(counts: pa.Table, answers: pa.Table) -> pa.Table:
    """The candidates of a range that stay, each with the cut that scores lowest; the best of the range alone go on."""
    if not counts.num_rows:
        return _FOUND_ARROW.empty_table()
    lang = counts.column("lang")[0].as_py()
    own = unpack(counts.column("paths")[0].as_py())
    told: dict[bytes, int] = {}
    dropped: set[bytes] = set()
    for home, blob in zip(answers.column("home").to_pylist(), answers.column("paths"), strict=True):
        found = unpack(blob.as_py())
        if home == -1:
            dropped.update(found.phrase(i) for i in range(len(found)))
        else:
            told.update((found.phrase(i), int(found.n[i])) for i in range(len(found)))
    out = []
    pair, pair_row, pair_n, longest = None, -1, 0, {}
    for i in range(len(own)):  # a pair comes right before the longer phrases that begin with it
        if own.b[i] < 0:
            continue
        a = int(own.n[i])
        words = own.words
        x, y = words[own.a[i]], words[own.b[i]]
        if own.c[i] < 0:
            pair, pair_row, pair_n = (own.a[i], own.b[i]), len(out), a
            cuts = [(told[x], told[y])]
            phrase = x + b" " + y
        else:
            z = words[own.c[i]]
            if pair != (own.a[i], own.b[i]):
                raise AssertionError("a phrase is at least as frequent as a longer one that begins with it")
            longest[pair_row] = max(longest.get(pair_row, 0), a)
            cuts = [(told[x], told[y + b" " + z]), (pair_n, told[z])]
            phrase = x + b" " + y + b" " + z
        score, (l, r) = min(((SCALE * a * a // (l * r), (l, r)) for l, r in cuts), key=lambda s: s[0])
        out.append((phrase, a, l, r, score, own.c[i] < 0))
    kept = [(p, a, l, r, s) for i, (p, a, l, r, s, two) in enumerate(out) if not (two and (p in dropped or 100 * longest.get(i, 0) >= INSIDE * a))]
    kept.sort(key=lambda k: (-k[4], -k[1], k[0]))
    del kept[FIRST:]
    columns = list(zip(*kept, strict=True)) or [()] * 5
    text = [p.decode("utf-8", "replace") for p in columns[0]]
    return pa.table([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], schema=_FOUND_ARROW)


def collocations(documents: DataFrame) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the best phrases of each language.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs; a phrase never crosses a piece. Counts cover all rows; a null language is
    ``und``, null and empty texts hold no phrase, repeated rows count each. Products are exact at any
    size. Equal scores are ordered by occurrences, then by the phrase. A language without a candidate, or
    an empty table, has no rows. Other columns are ignored, whatever their names.

    Each task counts whole shards of text into transducers and cuts them into prefix ranges; a range is the
    union of its parts, in memory at a size set by ``RANGE``. All parts of a frequent phrase are as
    frequent, so only those are kept after the union, and parts are looked up by composing the
    ranges' transducers with one another's questions, at most one question a part and range.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(size // RANGE) + 1
    key = ["lang", "bucket"]
    arrow = "lang string, bucket bigint, total bigint, paths binary"
    frequent = stored(_shards(documents, ranges).groupBy(*key).applyInArrow(_merged, arrow), "ranges")
    counts = frequent.select(*key, "paths")
    asked = _questions(frequent, ranges)
    answers = counts.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_answered, _ASKED)
    answers = stored(answers, "answers").select("lang", "bucket", F.col("home"), "paths")
    scored = counts.groupBy(*key).cogroup(answers.groupBy(*key)).applyInArrow(_scored, _FOUND)

    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = F.row_number()
    salted = salted.withColumn("place", place.over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= FIRST)
    first = salted.withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= FIRST)
    totals = frequent.groupBy("lang").agg(F.sum("total").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
