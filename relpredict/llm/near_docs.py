"""MinHash near-dedup with SetSketch registers: band, estimate, then verify on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relpredict.llm.common import BYTE_CODES, components, mixed, powers, signed, slices, stored

#: Words of a shingle and the similarity of a link, in hundredths.
WORDS, SIMILARITY = 5, 75
#: Registers of a sketch (a prime), bands and registers of a band: a pair at 0.75 shares no band with
#: probability (1 - 0.75**5)**42 = 1.1e-5.
REGISTERS, BANDS, ROWS = 211, 42, 5
#: SetSketch parameters: base of the exponential spacing, rate, the level of a minimum of 1, the last level.
SPACING, RATE, OFFSET, LEVELS = 1.0006, 20.0, 6_000, 65_535
#: Pairs whose likeliest similarity is below this are not verified; 5 deviations under the limit.
ESTIMATE = 0.6
#: Nodes of a block of a gathering, and shingles that are compared at a time.
BLOCK, COLUMNS = 192, 8_192
#: Bytes of text that a task turns into shingles at a time; it holds some 60 times as much for them.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_CODES = BYTE_CODES.copy()
_WORD_CODES[65:91] = BYTE_CODES[97:123]  # A-Z count as a-z
_PLACE = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data`` (bytes); words end at space and tab to carriage return."""
    edges = np.diff(np.concatenate([[False], ~_SPACE[data], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    forward, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WORD_CODES[data] * forward[: len(data)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths)
    start, h = word_hashes(np.frombuffer(b" ".join([*texts, b""]), np.uint8))
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    place = np.arange(len(h)) - first[owner]
    width = np.minimum(counts, WORDS)[owner]  # a short text is one shingle
    code = np.zeros(len(h), np.uint64)
    for i in range(WORDS):
        code += np.where(i < width, padded[i : i + len(h)] * _PLACE[i], np.uint64(0))
    heads = place <= counts[owner] - width
    owner, code = owner[heads], mixed(code[heads] + width[heads].astype(np.uint64))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    owner, code = owner[fresh], code[fresh]
    return code, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set: element j-th minima, truncated to consecutive intervals.

    In round j every element that can still matter draws a value from the exponential distribution
    cut to the j-th interval and offers it to the j-th register of its own order of registers. A set
    is done once the intervals lie above all its minima.
    """
    sets = len(bounds) - 1
    lowest = np.full((sets, REGISTERS), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    seed = code.copy()
    at = (mixed(seed + np.uint64(11)) % np.uint64(REGISTERS)).astype(np.int64)
    step = (mixed(seed + np.uint64(23)) % np.uint64(REGISTERS - 1)).astype(np.int64) + 1
    flat = lowest.ravel()
    for j in range(REGISTERS):
        low = np.log1p(j / (REGISTERS - j)) / RATE
        high = np.log1p((j + 1) / (REGISTERS - j - 1)) / RATE if j < REGISTERS - 1 else np.inf
        if j:
            live = (lowest.max(axis=1) > low)[owner]
            if not live.any():
                break
            owner, seed, at, step = owner[live], seed[live], at[live], step[live]
            at = (at + step) % REGISTERS
        uniform = (mixed(seed + np.uint64(97 + j)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        value = low - np.log1p(-uniform * -np.expm1(-RATE * (high - low))) / RATE
        np.minimum.at(flat, owner * REGISTERS + at, value)
    levels = np.floor(1 - np.log(lowest) / np.log(SPACING)) + OFFSET
    return np.clip(levels, 0, LEVELS).astype("<u2")


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of sketched sets of known sizes, row by row.

    With spacing near 1 the orders of two registers are a trinomial: a register of ``a`` is above,
    below or level with that of ``b`` with probabilities u - v*J', v - u*J' and J', where u and v
    are the shares of the sizes. The likelihood of the three counts is maximised over a grid of J.
    """
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    level = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    j = np.linspace(0.0, 1.0, 201)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        p_above = np.clip(u - (1 - u) * j, 1e-9, 1)
        p_below = np.clip((1 - u) - u * j, 1e-9, 1)
        p_level = np.clip(j, 1e-9, 1)
        likelihood = above * np.log(p_above) + below * np.log(p_below) + level * np.log(p_level)
    return j[0][likelihood.argmax(axis=1)]


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per band of each sketch."""
    bands = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mixed(key + bands[:, :, i])
    return key


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def _encoded(texts: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "replace") for t in texts]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(_lengths(texts), CHUNK):
            code, bounds = shingle_sets(_encoded(texts.slice(a, b - a)))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(code + np.uint64(i)))]) for i in (1, 2)]
            digests = [pa.array(signed(s[bounds[1:]] - s[bounds[:-1]])) for s in sums]
            registers = [r.tobytes() for r in sketches(code, bounds)]
            columns = [ids.slice(a, b - a), pa.array(np.diff(bounds)), *digests, pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "registers"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array(list(signed(band_keys(_registers(batch.column(2))))), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], keys], ["node", "n", "keys"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_registers(batch.column(i)) for i in (2, 3))
        n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 1000):
            part = slice(i, i + 1000)
            keep[part] = similarity(a[part], b[part], n_a[part], n_b[part]) >= ESTIMATE
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = np.zeros(batch.num_rows, bool)
        for x, y in slices(_lengths(left).astype(np.int64) + _lengths(right), CHUNK):
            pairs = zip(_encoded(left.slice(x, y - x)), _encoded(right.slice(x, y - x)), strict=True)
            code, bounds = shingle_sets([t for pair in pairs for t in pair])
            for i in range(y - x):
                one, two = (code[bounds[2 * i + k] : bounds[2 * i + k + 1]] for k in (0, 1))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep[x + i] = both > 0 and 100 * both >= SIMILARITY * (len(one) + len(two) - both)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``documents``.

    A document's set holds its distinct five-word shingles (A-Z lower-cased; fewer words: the whole
    sequence as one; no word, null or empty text: no shingle, and nothing to link with). Documents
    whose sets have a similarity of 0.75 or more are linked; a component is named after its smallest
    ``doc_id``, whose row is kept. Rows that repeat a ``doc_id`` count as one document. A row without
    an id takes the component of an equal set if there is one, else null, and is kept only then.
    Extra columns are not read. Shingles are told apart by 64-bit hashes.

    Equal sets are one node. Nodes whose bands agree meet in buckets. Each node is first held against
    the member of its bucket that meets most others; such pairs pass the likelihood estimate of their sketches, then the exact test on whole
    texts. Buckets that still hold several components are gathered under their lead and compared whole,
    in blocks. So no pair is lost, and a bucket of copies costs one pair a row.
    """
    kinds = documents.select("doc_id").schema[0].dataType.simpleString()
    rows = stored(
        documents.select("doc_id", "text").mapInArrow(_sketched, f"doc_id {kinds}, n_shingles bigint, h1 bigint, h2 bigint, registers binary"),
        "sketches",
    )
    same_set = ["n_shingles", "h1", "h2"]
    sets = rows.where("n_shingles > 0").groupBy(same_set).agg(F.min("doc_id").alias("node"))
    sets = stored(sets, "sets")
    nodes = rows.join(sets.where("node IS NOT NULL"), same_set).where("doc_id = node")
    nodes = stored(nodes.select("node", *same_set, "registers").dropDuplicates(["node", "h1", "h2"]), "nodes")

    banded = nodes.select("node", "n_shingles", "registers").mapInArrow(_banded, f"node {kinds}, n bigint, keys array<bigint>")
    members = stored(banded.select("node", "n", F.explode("keys").alias("key")), "bands")
    buckets = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
    members = stored(members.join(stored(buckets.where("low < high").select("key", "size"), "buckets"), "key"), "members")
    # A bucket is led by the member that meets most others: the text that the copies were made from.
    weights = stored(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    best = F.max(F.struct("weight", "node", "n")).alias("best")
    leads = members.join(weights, "node").groupBy("key").agg(best).select("key", F.col("best.node").alias("lead"), F.col("best.n").alias("lead_n"))
    members = stored(members.drop("size").join(stored(leads, "leads"), "key"), "led")
    bodies = stored(_bodies(documents, members), "bodies")

    alike = lambda x, y: F.expr(f"100 * least({x}, {y}) >= {SIMILARITY} * greatest({x}, {y})")
    led = members.where("node <> lead").where(alike("n", "lead_n"))
    first = _links(led.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")), nodes, bodies)
    roots = stored(components(first), "roots")
    rooted = members.join(roots, members["node"] == roots["node"], "left").select(
        "key", "lead", members["node"], F.coalesce("root", members["node"]).alias("root")
    )
    rooted = stored(rooted, "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    second = _gathered(rooted.join(stored(apart, "apart"), "key").select("lead", "node", "root").distinct(), bodies)
    roots = stored(components(first.union(second)), "roots")

    whole = sets.join(roots, sets["node"] == roots["node"], "left").select(
        *same_set, F.coalesce("root", sets["node"]).alias("component_id")
    )
    named = rows.join(stored(whole, "named"), same_set, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return named.withColumn("kept", F.expr("coalesce(doc_id = component_id, component_id IS NULL)"))


def _bodies(documents: DataFrame, members: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the nodes that share a bucket with another."""
    wanted = stored(members.select("node").distinct(), "wanted")
    texts = documents.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")
    return texts.distinct()  # an id that repeats has all its versions


def _gathered(split: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links between nodes of different components (``root``) that buckets of one ``lead`` hold.

    All nodes that a lead's buckets hold are compared, in pairs of blocks of ``BLOCK``: a node goes
    to as many tasks as there are blocks, and no pair is a row.
    """
    split = stored(split, "split")
    loads = stored(split.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "loads")
    own = F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)").alias("own")
    placed = split.join(loads, "lead").select("lead", "node", "root", own, F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    placed = placed.select("lead", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root", "own")
    kind = split.schema["node"].dataType.simpleString()
    read = placed.join(bodies, "node").groupBy("lead", "low", "high")
    return stored(read.applyInPandas(_compared, f"u {kind}, v {kind}"), "links")


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Links across components within a block, or between two, from the sizes of all intersections at once."""
    none = pd.DataFrame({"u": [], "v": []}).astype("int64")
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    if rows["root"].nunique() < 2:
        return none
    code, bounds = shingle_sets([(t or "").encode("utf-8", "replace") for t in rows["text"]])
    n = len(rows)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    _, column, times = np.unique(code, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # others are in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = (column >= start) & (column < start + COLUMNS)
        table = np.zeros((n, COLUMNS), np.float32)
        table[owner[part], column[part] - start] = 1
        both += table @ table.T
    sizes = np.diff(bounds)
    linked = (both > 0) & (100 * both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both))
    root, own, ids = rows["root"].to_numpy(), rows["own"].to_numpy(), rows["node"].to_numpy()
    linked &= root[:, None] != root[None, :]
    if low != high:
        linked &= own[:, None] != own[None, :]
    u, v = np.nonzero(np.triu(linked, 1))
    return pd.DataFrame({"u": ids[u], "v": ids[v]}) if len(u) else none


def _links(pairs: DataFrame, nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b) that are linked, as (u, v)."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    pairs = stored(pairs.distinct(), "pairs")
    kind = pairs.schema["a"].dataType.simpleString()
    sketched = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = sketched.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(_likely, f"a {kind}, b {kind}")
    likely = stored(likely, "likely")
    text = lambda x: bodies.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))
    read = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "t_a", "t_b")
    return stored(read.mapInArrow(_verified, f"u {kind}, v {kind}"), "links")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, one document of each component; rows without an id stay."""
    dropped = stored(near_duplicates(documents).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "dropped")
    return documents.join(dropped, "doc_id", "left_anti").select(documents.columns)
