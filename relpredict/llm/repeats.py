"""Suffix-array dedup by bucket-pointer refinement, over suffixes picked by their content.

A 400-byte string is named by its anchor: the q-gram of least hash inside it. Equal strings have equal
anchors at equal offsets, so the suffixes at anchors stand for all others. Their initial buckets are
the q-grams. Buckets are refined by identifiers of what lies at later (and earlier) offsets, first of
the whole stretch that an anchor answers for, then only where that leaves a bucket mixed, of blocks of
16 offsets, and last of single offsets. A bucket with one suffix is finished at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relpredict.llm.common import Rolling, fresh, signed, slices, stored

#: Bytes of a repeated string, and of the q-gram that anchors it.
LENGTH, GRAM = 400, 100
#: Offsets that a block answers for.
BLOCK = 16
#: String starts handled at a time.
CHUNK = 4 << 20
#: Rows that a worker hands on at a time, and bytes of text that it holds in Python for them.
HAND_ON, HELD = 1 << 16, 1 << 20

_WINDOW = LENGTH - GRAM + 1
_LOW = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(data: np.ndarray) -> Iterator[tuple[Rolling, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of ``data``: hashes, offset of the chunk, and per anchor its place and q-gram hash and the
    first and last start of the strings it answers for (places within the chunk)."""
    for begin in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[begin : begin + CHUNK + LENGTH - 1]
        rolling = Rolling(part)
        at = np.arange(len(part) - GRAM + 1)
        grams = rolling.of(at, at + GRAM)
        least = _least((grams & ~_LOW) | at.astype(np.uint64), _WINDOW)  # ties go to the first
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[first] & _LOW).astype(np.int64)
        last = np.concatenate([first[1:], [len(least)]]) - 1
        yield rolling, begin, place, grams[place], first, last


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)


def _table(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    joined = [np.concatenate(c) if c else [] for c in zip(*columns, strict=True)] or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(joined, types, strict=True)], names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``HELD`` bytes of text, the last column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
        for a, b in slices(lengths.to_numpy(zero_copy_only=False), HELD):
            yield batch.slice(a, b - a)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["gram", "tid", "n_bytes", "place"], [pa.int64()] * 4
    for batch in _parts(batches):
        rows, held = [], 0
        for tid, n, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
            for _, begin, place, gram, _, _ in anchors(_bytes(text)):
                size = len(place)
                rows.append((signed(gram), np.full(size, tid), np.full(size, n), begin + place))
                held += size
                if held >= HAND_ON:
                    yield _table(rows, names, types)
                    rows, held = [], 0
        yield _table(rows, names, types)


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each wanted anchor: an identifier of all it answers for, and the bytes that covers."""
    names, types = ["gram", "stretch", "tid", "n_bytes", "copies", "place", "first", "last"], [pa.int64()] * 8
    for batch in _parts(batches):
        rows, held = [], 0
        for tid, n, copies, wanted, text in zip(*(batch.column(i).to_numpy(False) for i in range(4)), batch.column(4), strict=True):
            wanted = np.sort(np.asarray(wanted))
            for rolling, begin, place, gram, first, last in anchors(_bytes(text)):
                ours = np.isin(begin + place, wanted)
                place, gram, first, last = place[ours], gram[ours], first[ours], last[ours]
                stretch = rolling.of(first, last + LENGTH) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                size = len(place)
                rows.append(
                    (signed(gram), signed(stretch), np.full(size, tid), np.full(size, n), np.full(size, copies), begin + place, begin + first, begin + last)
                )
                held += size
                if held >= HAND_ON:
                    yield _table(rows, names, types)
                    rows, held = [], 0
        yield _table(rows, names, types)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of offsets of the wanted anchors: what all strings of a block hold, and the bytes on either
    side that belong to strings of the same anchor."""
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["core", "left", "right", "tid", "n_bytes", "weight", "at"]
    def handed_on(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in _parts(batches):
        columns: list[list] = [[] for _ in names]
        for tid, n, wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            data = _bytes(text)
            raw = data.tobytes()
            by_chunk: dict[int, list[dict]] = {}
            for w in wanted:
                by_chunk.setdefault(w["first"] // CHUNK * CHUNK, []).append(w)
            for begin, inside in by_chunk.items():
                rolling = Rolling(data[begin : begin + CHUNK + LENGTH + _WINDOW])
                starts = []
                for w in inside:
                    stop = w["last"] + LENGTH
                    for k in range((w["place"] - w["last"]) // BLOCK, (w["place"] - w["first"]) // BLOCK + 1):
                        start = w["place"] - BLOCK * k
                        end = start + LENGTH - BLOCK + 1
                        starts.append(start)
                        columns[1].append(raw[max(w["first"], start - BLOCK + 1) : start])
                        columns[2].append(raw[end : min(stop, end + BLOCK - 1)])
                        columns[5].append(w["weight"])
                at = np.array(starts)
                columns[0].extend(signed(rolling.of(at - begin, at - begin + LENGTH - BLOCK + 1)).tolist())
                columns[3].extend([tid] * len(starts))
                columns[4].extend([n] * len(starts))
                columns[6].extend(starts)
                if len(columns[6]) >= HAND_ON:
                    yield handed_on(columns)
                    columns = [[] for _ in names]
        yield handed_on(columns)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the given ``[start, end)`` spans."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    heads = np.flatnonzero(fresh)
    return np.stack([spans[heads, 0], ends[np.concatenate([heads[1:] - 1, [len(spans) - 1]])]], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        spans, kept, rest = [], [], []
        found = batch.column(2)  # as many as a text has bytes: never objects
        flat = np.stack([found.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("start", "end")], 1)
        offsets = found.offsets.to_numpy() - found.offsets[0].as_py()
        for a, b, text in zip(offsets[:-1], offsets[1:], batch.column(3), strict=True):
            raw = _bytes(text).tobytes()
            runs = merged(flat[a:b]).tolist()
            spans.append([{"start": a, "end": b} for a, b in runs])
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            rest.append(kept[-1].decode("utf-8", "ignore"))  # halves of cut characters go
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(rest, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["tid", "n_bytes", "spans", "kept", "rest"])


def identified(documents: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns, and what names a text: ``tid`` (a 64-bit hash) with ``n_bytes``. A null text is empty."""
    return documents.withColumn("text", F.coalesce("text", F.lit(""))).select(
        *kept, F.xxhash64("text").alias("tid"), F.octet_length("text").cast("bigint").alias("n_bytes")
    )


def repeats(documents: DataFrame) -> DataFrame:
    """``tid``, ``n_bytes``, ``spans``, ``kept`` and ``rest`` of every distinct text with a repeated 400-byte string.

    ``spans`` are the maximal runs of bytes covered by a string of 400 bytes that also starts anywhere
    else in the corpus, in the same text or another; ``kept`` is what remains, as bytes, and
    ``rest`` the same as text, without characters that lost a byte. Equal texts
    are one row (they are removed whole from 400 bytes on). Texts without a row lose nothing: null,
    empty and short ones are among them. Join by ``identified``. Rows may repeat, ids may be null or
    repeat; other columns than ``doc_id`` and ``text`` are not read. Strings are told apart by 64-bit
    hashes.
    """
    key = ["tid", "n_bytes"]
    rows = identified(documents, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row"), "text").where(F.col("n_bytes") >= LENGTH)
    texts = stored(rows.groupBy(key).agg(F.min("row").alias("row"), F.count("*").alias("copies")), "texts")
    picked = stored(rows.select(*key, "text").mapInArrow(_anchored, "gram bigint, tid bigint, n_bytes bigint, place bigint"), "anchors")

    one = F.xxhash64("tid", "n_bytes", "place")
    grams = picked.groupBy("gram").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a < b").select("gram")
    found = picked.join(stored(grams, "grams"), "gram").groupBy(key).agg(F.collect_set("place").alias("places"))
    found = stored(found, "found")
    # A text of many copies is fetched through the smallest of their ids, so copies don't meet in one task.
    many = texts.where("copies > 1").select(*key, "row", "copies", F.expr("array() AS places").cast("array<bigint>"))
    several = texts.join(found, key).select(*key, "row", "copies", "places")
    needed = stored(several.unionByName(many.join(found, key, "left_anti")), "needed")
    bodies = rows.join(needed, [*key, "row"]).select(*key, "row", "copies", "places", "text")
    bodies = stored(bodies.dropDuplicates([*key, "row"]).drop("row"), "bodies")

    names = "gram bigint, stretch bigint, tid bigint, n_bytes bigint, copies bigint, place bigint, first bigint, last bigint"
    stretches = stored(bodies.select(*key, "copies", "places", "text").mapInArrow(_stretched, names), "stretches")
    classes = stretches.groupBy("gram", "stretch").agg(
        F.sum("copies").alias("weight"), F.min(F.struct("tid", "n_bytes", "place", "first", "last")).alias("of")
    )
    classes = stored(classes, "classes")
    whole = stored(classes.where("weight > 1").select("gram", "stretch"), "whole")
    sure = stretches.join(whole, ["gram", "stretch"]).select(*key, F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))

    mixed = stored(classes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "mixed")
    open_ = classes.join(mixed, "gram").select("of.*", F.least("weight", F.lit(2)).alias("weight"))
    open_ = open_.groupBy(key).agg(F.collect_list(F.struct("place", "first", "last", "weight")).alias("wanted"))
    names = "core bigint, left binary, right binary, tid bigint, n_bytes bigint, weight bigint, at bigint"
    blocks = bodies.select(*key, "text").join(open_, key).select(*key, "wanted", "text")
    blocks = stored(blocks.mapInArrow(_blocked, names), "blocks")
    sides = stored(blocks.groupBy("core", "left", "right").agg(F.sum("weight").alias("weight")), "sides")
    cores = sides.groupBy("core").agg(F.sum("weight").alias("all"), F.count("*").alias("n")).where("all > 1")
    cores = stored(cores, "cores")
    # One kind of surroundings: every string of the block repeats. Several: offset by offset.
    fits = F.expr(f"octet_length(left) + octet_length(right) >= {BLOCK - 1}")
    plain = blocks.where(fits).join(cores.where("n = 1").select("core"), "core")
    reach = (F.col("at") + LENGTH - BLOCK + 1 + F.octet_length("right")).alias("end")
    sure = sure.union(plain.select(*key, (F.col("at") - F.octet_length("left")).alias("start"), reach))
    offset = F.explode(F.expr(f"sequence({BLOCK - 1} - octet_length(right), octet_length(left))")).alias("j")
    string = (F.expr("substring(left, octet_length(left) - j + 1, j)").alias("l"), F.expr(f"substring(right, 1, {BLOCK - 1} - j)").alias("r"))
    several = cores.where("n > 1").select("core")
    each = sides.join(several, "core").where(fits).select("core", "left", "right", "weight", offset).select("core", "j", *string, "weight")
    again = stored(each.groupBy("core", "j", *("l", "r")).agg(F.sum("weight").alias("all")).where("all > 1").drop("all"), "again")
    each = blocks.join(several, "core").where(fits).select("core", *key, "at", "left", "right", offset).select("core", "j", *string, *key, "at")
    last = each.join(again, ["core", "j", "l", "r"]).select(*key, (F.col("at") - F.col("j")).alias("start"), (F.col("at") - F.col("j") + LENGTH).alias("end"))
    copies = bodies.where("copies > 1").select(*key, F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))
    spans = sure.union(last).union(copies).groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = bodies.select(*key, "text").join(spans, key).select(*key, "spans", "text")
    return cut.mapInArrow(_cut, "tid bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, rest string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, repeats cut out of ``text``; ``n_chars`` follows where there is one."""
    tid, size, rest = (fresh(documents, name) for name in ("tid", "n_bytes", "rest"))
    text = F.coalesce("text", F.lit(""))
    rows = documents.withColumns({tid: F.xxhash64(text), size: F.octet_length(text).cast("bigint")})
    found = repeats(documents).select(F.col("tid").alias(tid), F.col("n_bytes").alias(size), F.col("rest").alias(rest))
    cut = rows.join(stored(found, "rests"), [tid, size], "left").withColumn("text", F.coalesce(rest, "text"))
    if "n_chars" in documents.columns:
        length = F.char_length("text").cast(documents.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col(rest).isNull(), F.col("n_chars")).otherwise(length))
    return cut.select(documents.columns)
