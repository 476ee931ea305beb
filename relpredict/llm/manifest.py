"""Merkle manifest of a dataset: leaf places by bitmap rank, levels by slot arrays, proofs from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relpredict.llm.common import stored

#: Children of a node.
FAN = 16
#: Bits of an id inside one bitmap word, and bits that each level of the popcount directory adds.
WORD_BITS, STEP_BITS = 6, 14
#: Copies of one leaf that a row expands to at a time.
COPIES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:string,after:string>>"


def _field(value: str) -> str:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and itself, or ``-``."""
    return f"coalesce(concat(octet_length({value}), ':', {value}), '-')"


def leaf(text: str = "text") -> str:
    """SQL for the digest of a row whose text is given by ``text``."""
    values = [text if f == "text" else f"CAST({f} AS STRING)" for f in FIELDS]
    return f"sha2(concat({', '.join(map(_field, values))}), 256)"


#: SQL for the text after tampering.
TAMPERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _directory(ids: DataFrame, group: list[str]) -> DataFrame:
    """Bitmap words of ``ids(group..., id, n)``, each with the weight of all ids before it in its group.

    A word holds 64 neighbouring ids in ``mask``; empty words are not stored, so a sparse set costs a
    row an id and a dense one a row for 64. ``extra`` lists the bits that stand for more than one row.
    Weights are summed level by level over blocks that each take 2**14 of the level below, and every
    running sum stays inside one block, so no window holds more than 2**16 rows.
    """
    bit = F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    more = F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("n")))
    words = ids.groupBy(*group, F.shiftright("id", WORD_BITS).alias("block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(id & {(1 << WORD_BITS) - 1} AS INT))")).alias("mask"),
        F.sum("n").alias("n"),
        F.collect_list(more).alias("extra"),
    )
    words = stored(words, "words")
    levels = [words]
    for _ in range((64 - WORD_BITS - 1) // STEP_BITS - 1):
        parent = F.shiftright("block", STEP_BITS).alias("block")
        levels.append(levels[-1].groupBy(*group, parent).agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = levels[-1].select(*group, F.col("block").alias("parent"), before.alias("above"))
    for level in reversed(levels[:-1]):
        level = level.withColumn("parent", F.shiftright("block", STEP_BITS))
        inside = Window.partitionBy(*group, "parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(above, [*group, "parent"])
        level = level.withColumn("above", F.col("above") + F.col("inside")).drop("parent", "inside", "n")
        if "mask" in level.columns:
            return level.withColumnRenamed("block", "word")
        above = level.withColumnRenamed("block", "parent")
    raise AssertionError("a directory has several levels")


def _ranked(rows: DataFrame, ids: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the weight of all smaller ids of their group in ``rank``: one lookup each, no sorting."""
    words = _directory(ids, group)
    bit = f"CAST(id & {(1 << WORD_BITS) - 1} AS INT)"
    rank = f"above + bit_count(mask & ~shiftleft(-1L, {bit})) + aggregate(extra, 0L, (s, e) -> s + IF(e.bit < {bit}, e.n, 0L))"
    found = rows.withColumn("word", F.shiftright("id", WORD_BITS)).join(words, [*group, "word"])
    return found.withColumn("rank", F.expr(rank)).drop("word", "mask", "extra", "above")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, doc_id, leaf, n)`` with ``place``, that of their first copy, and ``size``, the leaves of their tree.

    Order is by ``doc_id``, null first; leaves of equal ids are ordered by their digest. Ids rank
    through a bitmap directory of their tree; leaves that share an id rank a second time, by the
    first 60 bits of their digests, inside that id.
    """
    ids = leaves.groupBy("tree", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    ids = stored(ids, "ids")
    sizes = ids.groupBy("tree").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    known = ids.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    first = _ranked(known, known.select("tree", "id", "n"), ["tree"])
    first = first.join(sizes, "tree").select("tree", F.col("id").alias("doc_id"), F.lit(False).alias("unnamed"), "kinds", (F.col("rank") + F.col("nulls")).alias("first"), "size")
    unnamed = ids.where("doc_id IS NULL").join(sizes, "tree").select("tree", F.lit(0).cast("bigint").alias("doc_id"), F.lit(True).alias("unnamed"), "kinds", F.lit(0).cast("bigint").alias("first"), "size")
    first = stored(first.union(unnamed), "first-places")

    key = ["tree", "doc_id", "unnamed"]
    named = leaves.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("bigint")))
    found = stored(named.join(first, key), "placed")
    alone = found.where("kinds = 1").select(*key, "leaf", "tampered", "n", "size", F.col("first").alias("place"))
    tied = found.where("kinds > 1").withColumn("id", F.expr("CAST(conv(substr(leaf, 1, 15), 16, 10) AS BIGINT)"))
    tied = stored(tied, "tied")
    digests = tied.groupBy(*key, "id").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*key, "id").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    tied = _ranked(tied, digests, key).withColumn("rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    tied = tied.select(*key, "leaf", "tampered", "n", "size", (F.col("first") + F.col("rank") + F.col("rest")).alias("place"))
    return alone.union(tied).withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).drop("unnamed")


def _runs(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Nodes ``(tree, place, size, fields...)`` gathered by parent into arrays of at most 16 slots."""
    slot = F.struct((F.col("place") % FAN).cast("int").alias("slot"), *fields)
    run = nodes.groupBy("tree", F.expr(f"place div {FAN}").alias("place"), "size").agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    return run.withColumn("size", F.expr(f"(size + {FAN - 1}) div {FAN}"))


def _hung(nodes: DataFrame, fields: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, lowest first, and the root ``(tree, digest, height)`` of every tree.

    ``nodes`` have ``tree``, ``place``, ``size``, ``digest`` and other ``fields``. Each level is an
    aggregation keyed by parent; trees that are down to one node leave the loop.
    """
    roots = nodes.where("size = 1").select("tree", "digest", F.lit(0).alias("height"))
    runs: list[DataFrame] = []
    nodes = nodes.where("size > 1")
    while True:
        level = stored(_runs(nodes, fields), f"{name}-{len(runs)}")
        most = level.agg(F.max("size")).first()[0]
        if most is None:
            return runs, roots
        runs.append(level)
        digest = F.sha2(F.concat_ws("", F.expr("transform(slots, s -> s.digest)")), 256)
        above = level.select("tree", "place", "size", digest.alias("digest"))
        roots = roots.union(above.where("size = 1").select("tree", "digest", F.lit(len(runs)).alias("height")))
        if most == 1:
            return runs, roots
        nodes, fields = above.where("size > 1"), ["digest"]


def _opened(runs: DataFrame, fields: list[str], carried: list[str]) -> DataFrame:
    """Children of ``runs`` (which have the ``path`` of their own node) with their place and path."""
    rows = runs.select("tree", F.col("place").alias("run"), "path", *carried, "slots", F.expr("transform(slots, s -> s.digest)").alias("all"), F.explode("slots").alias("s"))
    here = "array(named_struct('before', array_join(slice(all, 1, s.slot), ''), 'after', array_join(slice(all, s.slot + 2, 16), '')))"
    return rows.select("tree", (F.col("run") * FAN + F.col("s.slot")).alias("place"), F.expr(f"concat({here}, path)").alias("path"), *carried, *[F.col(f"s.{f}").alias(f) for f in fields])


def _paths(runs: list[DataFrame], fields: list[str], tops: DataFrame, carried: list[str], name: str) -> DataFrame:
    """Paths to the root of all children of the lowest runs; ``tops`` are the trees' roots ``(tree, height, path, carried...)``."""
    open_: DataFrame | None = None
    for height in range(len(runs), 0, -1):
        starts = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("place"), "path", *carried)
        above = starts if open_ is None else open_.select("tree", "place", "path", *carried).union(starts)
        level = runs[height - 1].join(above, ["tree", "place"])
        open_ = _opened(level, fields if height == 1 else ["digest"], carried)
        if height > 1:
            open_ = stored(open_, f"{name}-{height}")
    return open_


def _numbered(trees: DataFrame) -> DataFrame:
    """``trees(tree, digest)`` with ``place`` in the order of ``tree``: counted per range of names, ranges added up."""
    ranges = stored(trees.repartitionByRange("tree").withColumn("part", F.spark_partition_id()), "trees")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("size"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    return ranges.withColumn("inside", place).join(counts, "part").select("tree", (F.col("before") + F.col("inside")).alias("place"), "size", "digest", "height")


def manifest(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    A leaf is the digest of ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` alone, whatever other
    columns there are. The leaves of a source stand in the order of ``doc_id`` (null first, equal ids
    by digest), every 16 become a node, and the sources' roots, null first, are hung the same way.
    Each proof holds the siblings on the way to the root, and is tried on the row with its text
    lower-cased where 5 divides the ``crc32`` of the id. Repeated rows are leaves of their own, at
    consecutive places, each with its own proof; an empty text differs from a null one; an empty
    table has no rows and no root. Texts are read once and only digests are shuffled; rows with
    equal content travel as one with a count.
    """
    hit = "doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 = 0"
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *FIELDS[1:])
    digests = rows.selectExpr("coalesce(concat('=', source), '-') AS tree", "doc_id", f"{leaf()} AS leaf", f"CASE WHEN {hit} THEN {leaf(TAMPERED)} END AS tampered")
    leaves = stored(digests.groupBy("tree", "doc_id", "leaf", "tampered").agg(F.count("*").alias("n")), "leaves")

    nodes = placed(leaves)
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}")))
    nodes = nodes.withColumn("block", steps).withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(n, (block + 1) * {COPIES}) - 1)")))
    nodes = nodes.select("tree", (F.col("place") + F.col("copy")).alias("place"), "size", F.col("leaf").alias("digest"), "tampered", "doc_id")
    nodes = stored(nodes, "nodes")
    fields = ["digest", "tampered", "doc_id"]
    runs, roots = _hung(nodes, fields, "runs")

    roots = _numbered(stored(roots, "roots"))
    top = roots.select(F.lit("").alias("tree"), "place", "size", "digest", F.col("tree").alias("source"), "height")
    top = stored(top, "top")
    top_fields = ["digest", "source", "height"]
    top_runs, root = _hung(top, top_fields, "top-runs")
    whole = root.select("tree", "height", F.expr(f"CAST(array() AS {_PATH})").alias("path"), F.col("digest").alias("root"))
    lone = top.where("size = 1").select(F.col("source").alias("tree"), "height", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.expr(f"CAST(array() AS {_PATH})").alias("path"))
    tops = lone
    if top_runs:
        below = _paths(top_runs, top_fields, whole, ["root"], "top-paths")
        tops = below.select(F.col("source").alias("tree"), "height", F.col("digest").alias("subroot"), "root", "path").union(lone)
    tops = stored(tops, "tops")

    carried = ["subroot", "root"]
    out = nodes.where("size = 1").join(tops, "tree").select("path", *carried, *fields)
    if runs:
        out = out.union(_paths(runs, fields, tops, carried, "paths").select("path", *carried, *fields))
    return out.select("doc_id", F.col("digest").alias("leaf"), *carried, _proof().alias("proof_sha256"), _folded().alias("folded_root")).withColumn("verified", F.expr("folded_root = root"))


def _proof() -> Column:
    return F.expr("sha2(array_join(transform(path, p -> concat(p.before, p.after)), ''), 256)")


def _folded() -> Column:
    return F.expr("aggregate(path, coalesce(tampered, digest), (h, p) -> sha2(concat(p.before, h, p.after), 256))")
