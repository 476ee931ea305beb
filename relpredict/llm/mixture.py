"""Mixing sources to target weights: a splitting tree deals exact block quotas to output shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relpredict.llm.common import PIECES, fresh, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST = 3
#: Levels of the splitting tree: 2 ** LEVELS output shards.
LEVELS = 4

_WORDS = f"CAST(coalesce(size(array_remove({PIECES}, '')), 0) AS BIGINT)"


def drawn(*parts: Column) -> Column:
    """Sixteen hexadecimal digits that order or place rows at random, the same in every run."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def place(salt: str = "") -> Column:
    """A digest of a row of ``doc_id`` and ``text`` that orders rows at random."""
    return drawn(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))


def sizes(documents: DataFrame, salt: str = "") -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size`` in words, and its ``place``."""
    rows = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), place(salt).alias("place"))
    return rows.selectExpr("doc_id", "source", f"{_WORDS} AS size", "place")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target``: shares by weight, at most ``most`` times the size.

    A source is held at ``most`` times its size if the final price per weight would lift it above.
    With sources in order of size / weight, those before the first that stays below are held; the
    others share what is left by weight.
    """
    cycle = "element_at(array(" + ", ".join(map(str, weights)) + f"), 1 + CAST((place - 1) % {len(weights)} AS INT))"
    ordered = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = ordered.selectExpr("source", "source_size", f"CAST({cycle} AS DOUBLE) AS weight")
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    behind = rank.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("whole"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(behind), F.lit(0.0))).alias("weight_left"),
        F.coalesce(F.sum("source_size").over(behind), F.lit(0)).alias("held_before"),
    ).withColumn("price", (F.col("whole") - most * F.col("held_before")) / F.col("weight_left"))
    free = F.col("price") * F.col("weight") <= most * F.col("source_size")
    priced = ranked.withColumn("free_price", F.max(F.when(free, F.col("price"))).over(everything))
    return priced.select(
        "source",
        "source_size",
        F.least(F.coalesce(F.col("free_price") * F.col("weight"), F.lit(float("inf"))), (most * F.col("source_size")).cast("double")).alias("target"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``source`` and ``last``: rows up to that place fill the goal of their source.

    ``goals`` has ``source`` and ``goal``. Words are added up over the 256 blocks of each source, then
    over the sub-blocks of the block where the goal falls, then once more, and row by row at the end.
    """
    at = stored(goals.select("source", "goal", F.lit("").alias("prefix")), "goals")
    for width in (2, 4, 6):
        inside = rows.alias("r").join(at.alias("g"), _same("r.source", "g.source") & F.col("r.place").startswith(F.col("g.prefix")))
        block = F.substring("place", 1, width).alias("block")
        sums = inside.select("r.source", "goal", block, "size").groupBy("source", "goal", "block").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("upto", F.sum("words").over(upto)).where("upto > goal")
        first = over.groupBy("source", "goal").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        at = stored(first.select("source", (F.col("goal") - F.col("cut.before")).alias("goal"), F.col("cut.block").alias("prefix")), "cut")
    inside = rows.alias("r").join(at.alias("g"), _same("r.source", "g.source") & F.col("r.place").startswith(F.col("g.prefix")))
    turn = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    passed = inside.select("r.*", "goal", "prefix").withColumn("upto", F.sum("size").over(turn))
    fits = F.when(F.col("upto") - F.col("size") / 2 <= F.col("goal"), F.col("place"))
    return stored(passed.groupBy("source").agg(F.coalesce(F.max(fits), F.min("prefix")).alias("last")), "last")


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, levels: int = LEVELS, salt: str = "") -> DataFrame:
    """Every row of ``documents`` with what the mix takes of it.

    Columns: ``doc_id``, ``source``, ``place`` (a digest that orders rows at random), ``size`` (words),
    ``source_size``, ``target`` (words of its source), ``copies`` (0 to ``most``), ``taken``
    (copies * size) and ``shards`` (the output shard of each copy, ``copies`` of them).

    Whole rounds of a source are taken first. The rest of its target is filled with whole blocks of a
    random permutation; the block at the cut is cut again into sub-blocks, twice, then by row, so a
    source ends within half a document of its target and no task orders more than a 256**3th of a
    source beyond ties. Blocks (a source's block in one round) are dealt to 2**levels shards by a
    splitting tree: each node permutes its blocks and halves them, which draws the per-source counts
    of its children from the multivariate hypergeometric distribution and keeps quotas exact.

    Null sources form the last source; null and empty texts have size 0 and are taken as often as
    their block is. Repeated rows share a place, so they are taken together or cut by turns. Nothing
    but ``doc_id``, ``text`` and ``source`` is read. An empty table gives an empty mix.
    """
    rows = stored(sizes(documents, salt), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(totals, weights, most), "targets").withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    goals = goals.withColumn("goal", F.col("target") - F.col("rounds") * F.col("source_size"))

    last = _cuts(rows, goals.where("goal > 0"))
    plan = goals.alias("g").join(last.alias("l"), _same("g.source", "l.source"), "left").select("g.*", "last")
    plan = stored(plan, "plan")
    more = F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("int")
    joined = rows.alias("r").join(plan.alias("p"), _same("r.source", "p.source")).select(
        "r.*", "source_size", "target", F.least(F.col("rounds") + more, F.lit(most)).cast("int").alias("copies"),
        F.conv(F.substring("place", 1, 2), 16, 10).cast("int").alias("block"),
    )
    dealt = shards(joined, levels, salt)
    return (
        joined.alias("r")
        .join(dealt.alias("s"), _same("r.source", "s.source") & (F.col("r.block") == F.col("s.block")), "left")
        .select(
            "doc_id", "r.source", "place", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            F.expr("slice(s.shards, 1, copies)").alias("shards"),
        )
    )


def shards(taken: DataFrame, levels: int, salt: str) -> DataFrame:
    """``source``, ``block`` and ``shards``, the shard of the block in each round it is taken in.

    One row per source, block and round goes down the tree. A node's halves are told apart by rank
    in a fresh random order; the rank is counted through 256 buckets first, so no node is ordered by
    one task, the root included.
    """
    rounds = taken.groupBy("source", "block").agg(F.max("copies").alias("copies"))
    items = rounds.select("source", "block", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) END")).alias("round"))
    items = stored(items.withColumn("node", F.lit(0)), "tree")
    for level in range(levels):
        draw = drawn(F.lit(f"{salt}/{level}"), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"), F.col("block").cast("string"), F.col("round").cast("string"))
        items = items.withColumn("draw", draw).withColumn("bucket", F.substring("draw", 1, 2))
        counts = items.groupBy("node", "bucket").agg(F.count("*").alias("n"))
        node = Window.partitionBy("node")
        ahead = node.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("all", F.sum("n").over(node)).drop("n")
        within = Window.partitionBy("node", "bucket").orderBy("draw", "source", "block", "round")
        ranked = items.withColumn("rank", F.row_number().over(within)).join(counts, ["node", "bucket"])
        right = (2 * (F.col("ahead") + F.col("rank")) > F.col("all") + 1).cast("int")
        items = stored(ranked.select("source", "block", "round", (2 * F.col("node") + right).alias("node")), "tree")
    return stored(
        items.groupBy("source", "block").agg(F.expr("transform(array_sort(collect_list(struct(round, node))), x -> x.node)").alias("shards")), "shards"
    )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, all columns as they are.

    Copies of a row are told by source and text, so equal rows of two sources follow their own source.
    Every partition holds its copies shard by shard, each shard in a seeded random order, so a
    reader of one shard meets sources and texts mixed.
    """
    salt = options.get("salt", "")
    at, dealt, copy, shard, turn = (fresh(documents, name) for name in ("place", "shards", "copy", "shard", "turn"))
    named = fresh(documents, "named")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    taken = mixture(documents, **options).where("copies > 0").withColumn(named, source)
    taken = taken.groupBy(named, F.col("place").alias(at)).agg(F.max(F.struct("copies", "shards"))["shards"].alias(dealt))
    rows = documents.withColumn(at, place(salt)).withColumn(named, source).join(stored(taken, "copies"), [named, at])
    rows = rows.select(*documents.columns, at, F.posexplode(dealt).alias(copy, shard))
    order = drawn(F.lit(f"{salt}/turn"), F.col(at), F.col(copy).cast("string"))
    return rows.withColumn(turn, order).sortWithinPartitions(shard, turn).select(documents.columns)
