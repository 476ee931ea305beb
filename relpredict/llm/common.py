"""Helpers that several operators share: scratch tables, byte hashing, components of a link table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpredict.functions.storage import passing_shuffles

#: Escapes for SQL literals: the white space between words, other than the space itself.
WHITE = ("\\t", "\\n", "\\u000b", "\\u000c", "\\r")


def replaced(text: str, characters: Iterable[str], by: str) -> str:
    """SQL that replaces single characters; a scan each, cheaper than ``translate`` where they are rare."""
    for c in characters:
        text = f"replace({text}, '{c}', '{by}')"
    return text


#: SQL for the pieces of a non-null ``text`` between single white-space characters; words are the non-empty ones.
PIECES = f"split({replaced('text', WHITE, ' ')}, ' ')"

#: Bytes of an Arrow batch of a scratch table's job. Whole texts travel: by Spark's 10,000 rows a worker would hold
#: two batches of any size, and its executor as much again for each.
BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_SEED = np.random.default_rng(20240229)
#: One odd random number per byte value, and the base of the rolling polynomial (modulo 2**64).
BYTE_CODES = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="relpredict-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH`` bytes for the jobs inside, unless the session names a size; its settings stay as they were."""
    ours = spark.conf.get(_BATCH_BYTES, None) is None
    if ours:
        spark.conf.set(_BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(_BATCH_BYTES)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: its lineage ends there, and its shuffle files go."""
    spark = frame.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark), passing_shuffles(spark):
        frame.write.parquet(path, compression="zstd")
    found = spark.read.schema(frame.schema).parquet(path)
    found._written_to = path
    return found


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bytes in which the low ``bits`` of each hash (the one column) set a bit, whatever their number.

    At most ``2 ** bits`` bits reach the driver; rows that hit a bit by chance must be told apart later.
    """
    low = F.col(hashes.columns[0]).bitwiseAND((1 << bits) - 1)
    rows = hashes.select(F.shiftright(low, 15).alias("at"), low.bitwiseAND((1 << 15) - 1).alias("bit"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["at"] << 12 : (r["at"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of ``bitmap``."""
    low = hashes & (len(bitmap) * 8 - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, or as many underscores before it as no column of ``frame`` has."""
    while name.lower() in {c.lower() for c in frame.columns}:
        name = f"_{name}"
    return name


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of ``data``, each in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        self.forward, self.back = powers(len(data) + 1)
        np.cumsum(BYTE_CODES[data] * self.forward[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of items whose lengths add up to about ``most``; one longer item stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield start, len(lengths)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the smallest node of its component.

    Alternates the two star steps of Kiveris et al.: larger neighbours are hung below the smallest
    neighbour, then smaller ones. Each step is a minimum per node (combined before the shuffle) and
    an equi-join whose crowded keys adaptive execution splits, so a hub is never one task's work.
    Every round is written to the shared folder. Nulls and loops are ignored.
    """
    edges = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before they are joined: both sides of the join then come from their own exchange,
        # which is what lets adaptive execution split a crowded node.
        smallest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def local_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Root of each of ``n`` items under the given links (label passing with pointer jumping)."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    return root
