"""The tables as a graph: typed nodes, typed edges, and neighbours sampled under a time limit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpredict.functions.storage import written
from relpredict.functions.times import ntz, ntz_sql, seconds
from relpredict.operators.cutoffs import ALWAYS
from relpredict.operators.features import surrogate_key, union_all
from relpredict.schema import Database, Link

NO_TIME = "timestamp_ntz"


def _keyed(db: Database, table: str) -> tuple[DataFrame, str]:
    spec = db.spec(table)
    if spec.primary_key is not None:
        return db.rows(table), spec.primary_key
    return surrogate_key(db.rows(table), "_row_key"), "_row_key"


def _time_of(db: Database, table: str) -> Column:
    time = db.spec(table).time_index
    return F.lit(None).cast(NO_TIME) if time is None else F.col(time)


def graph_nodes(db: Database) -> DataFrame:
    """``(node_type, node_id, time)``: one node per row; tables without a key get a content key."""
    parts = []
    for name in db.graph.tables:
        rows, key = _keyed(db, name)
        parts.append(
            rows.select(
                F.lit(name).alias("node_type"), F.col(key).cast("string").alias("node_id"),
                _time_of(db, name).alias("time"),
            )
        )
    return union_all(parts)


def graph_edges(db: Database) -> DataFrame:
    """``(edge_type, from_type, from_id, to_type, to_id)``: each known foreign key, both ways.

    Each child table is read once for all of its links.
    """
    parts = []
    for table, links in _links_by_child(db.graph.links).items():
        rows, key = _keyed(db, table)
        child = f"CAST(`{key}` AS STRING)"
        both = []
        for link in links:
            name, parent = f"{table}.{link.child_column}", f"CAST(`{link.child_column}` AS STRING)"
            both.append(f"named_struct('edge_type', '{name}', 'from_type', '{table}', 'from_id', {child}, 'to_type', '{link.parent}', 'to_id', {parent})")
            both.append(f"named_struct('edge_type', 'rev_{name}', 'from_type', '{link.parent}', 'from_id', {parent}, 'to_type', '{table}', 'to_id', {child})")
        parts.append(rows.selectExpr(f"inline(array({', '.join(both)}))").where("from_id IS NOT NULL AND to_id IS NOT NULL"))
    return union_all(parts)


def _links_by_child(links: Iterable[Link]) -> dict[str, list[Link]]:
    found: dict[str, list[Link]] = {}
    for link in links:
        found.setdefault(link.child, []).append(link)
    return found


def node_features(db: Database, table: str) -> DataFrame:
    """Key, time and the numeric and categorical columns of a node type; text is left out."""
    spec = db.spec(table)
    rows, key = _keyed(db, table)
    columns = [c.name for c in spec.columns if c.role in ("numeric", "categorical")]
    return rows.select(
        F.col(key).cast("string").alias("node_id"), _time_of(db, table).alias("time"), *columns
    )


def temporal_neighbors(
    db: Database,
    entity: str,
    seeds: DataFrame,
    fanout: Sequence[int] = (64, 64),
    mode: str = "recent",
    random_seed: int = 0,
) -> DataFrame:
    """Up to ``fanout[h]`` neighbours per edge type, hop by hop, none later than the seed's time.

    ``seeds`` holds ``(entity_id, seed_time)``. Result: ``(seed_id, seed_time, hop, edge_type,
    from_type, from_id, node_type, node_id, time, age_seconds)``; the age is null for timeless rows.

    ``recent`` takes the latest rows (larger key first among equals); ``uniform`` takes one seeded
    draw from each of k equal parts of the visible past. Either way a node's children are numbered
    in time order, each request learns how many of them it can see, and then asks for k numbers by
    an equi-join. No request is ever paired with all children of a node.

    All links are one table of adjacent rows, written once, and a hop is one pass over it: what the hop
    finds is written and is the next one's frontier, so the plan grows with hops and not with paths.
    """
    if mode not in ("recent", "uniform"):
        raise ValueError(f"unknown mode {mode!r}")
    seeds = seeds.select(F.col("entity_id").cast("string").alias("seed_id"), F.col("seed_time").cast("timestamp_ntz")).distinct()
    frontier = seeds.select("seed_id", "seed_time", F.lit(entity).alias("node_type"), F.col("seed_id").alias("node_id"))
    tables, used = [{entity}], set()
    for _ in fanout:
        steps = [k for k in db.graph.links if tables[-1] & {k.parent, k.child}]
        used |= set(steps)
        tables.append({k.child for k in steps if k.parent in tables[-1]} | {k.parent for k in steps if k.child in tables[-1]})
    links = [k for k in db.graph.links if k in used]
    adjacent = written(_adjacent(db, links, mode, random_seed), "adjacent")
    found = []
    ids = PackedIds(db, mode)
    for hop, k in enumerate(fanout, start=1):
        below, above = adjacent.where(F.col("parent_type").isin(tables[hop - 1])), adjacent.where(F.col("child_type").isin(tables[hop - 1]))
        edges = _children(below, ids, frontier, k, mode, random_seed + hop).unionByName(_parents(db, ids, above, frontier, links))
        edges = edges.select(
            "seed_id", "seed_time", F.lit(hop).alias("hop"), "edge_type", "from_type", "from_id", "node_type", "node_id",
            "time", (seconds(F.col("seed_time")) - seconds(F.col("time"))).alias("age_seconds"),
        )
        found.append(written(edges, f"hop-{hop}"))
        frontier = found[-1].select("seed_id", "seed_time", "node_type", "node_id").distinct()
    return union_all(found)


class PackedIds:
    """Ids of children as short binaries that sort as their keys do: this is all that an adjacent row holds of its child.

    Whole numbers take 8 bytes, content keys the 32 of their digest and the number among equal rows, other
    keys their text. In ``uniform`` mode a seeded digest stands before the ids of timeless tables, because
    all requests see all of their rows, in one seeded order.
    """

    LOWEST = "(-9223372036854775807L - 1L)"

    def __init__(self, db: Database, mode: str):
        self.kinds: dict[str, tuple[str, bool]] = {}
        for name in db.graph.tables:
            spec = db.spec(name)
            key = spec.primary_key
            whole = key is not None and isinstance(db.rows(name).schema[key].dataType, T.IntegralType)
            kind = "content" if key is None else "whole" if whole else "text"
            self.kinds[name] = kind, mode == "uniform" and spec.time_index is None

    def packed(self, table: str, text: str, random_seed: int) -> str:
        """SQL for the packed form of an id that is given as text."""
        kind, shuffled = self.kinds[table]
        packed = {
            "whole": f"unhex(lpad(hex(CAST({text} AS BIGINT) ^ {self.LOWEST}), 16, '0'))",
            "content": f"concat(unhex(left({text}, 64)), CAST(substr({text}, 65) AS BINARY))",
            "text": f"CAST({text} AS BINARY)",
        }[kind]
        return f"concat(unhex(md5(concat_ws('|', {text}, '{random_seed}'))), {packed})" if shuffled else packed

    def text(self, table_column: str, packed: str) -> str:
        """SQL for the text of a packed id of the table that a column names."""
        cases = []
        for table, (kind, shuffled) in self.kinds.items():
            own = f"substr({packed}, 17)" if shuffled else packed
            text = {
                "whole": f"CAST(CAST(conv(hex({own}), 16, -10) AS BIGINT) ^ {self.LOWEST} AS STRING)",
                "content": f"concat(lower(hex(substr({own}, 1, 32))), CAST(substr({own}, 33) AS STRING))",
                "text": f"CAST({own} AS STRING)",
            }[kind]
            cases.append(f"WHEN {table_column} = '{table}' THEN {text}")
        return f"CASE {' '.join(cases)} END"


def _adjacent(db: Database, links: Sequence[Link], mode: str, random_seed: int) -> DataFrame:
    """``(link, parent_type, parent_id, child_type, child, at)`` of every known link.

    ``at`` is null where the child has a time that is unknown, and a moment before all others where its
    table has none; ``child`` is a packed id, which also orders children of one moment. Each child table is read once.
    """
    ids = PackedIds(db, mode)
    parts = []
    for table, own in _links_by_child(links).items():
        rows, key = _keyed(db, table)
        spec = db.spec(table)
        child = ids.packed(table, f"CAST(`{key}` AS STRING)", random_seed)
        ends = [f"named_struct('link', '{table}.{k.child_column}', 'parent_type', '{k.parent}', 'parent_id', CAST(`{k.child_column}` AS STRING))" for k in own]
        at = ntz_sql(ALWAYS) if spec.time_index is None else f"`{spec.time_index}`"
        kept = rows.selectExpr(f"inline(array({', '.join(ends)}))", f"'{table}' AS child_type", f"{child} AS child", f"{at} AS at")
        parts.append(kept.where("parent_id IS NOT NULL"))
    return union_all(parts)


def _numbered(events: DataFrame) -> DataFrame:
    """Adds ``_count``: the children of the node up to each row, in the order of ``at``, ``ask`` and ``child``.

    Rows are sorted into ranges, cut at sampled places and so in the middle of a crowded node or
    moment too; each range counts for itself and takes over the totals of the node's ranges before it.
    """
    ranges = events.repartitionByRange("link", "parent_id", "at", "ask", "child").withColumn("_part", F.spark_partition_id())
    ranges = written(ranges, "numbered")
    node = ["link", "parent_id"]
    totals = ranges.groupBy(*node, "_part").agg(F.sum(1 - F.col("ask")).alias("_n"))
    earlier = Window.partitionBy(*node).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    here = Window.partitionBy(*node, "_part").orderBy("at", "ask", "child").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranges.withColumn("_here", F.sum(1 - F.col("ask")).over(here)).join(totals, [*node, "_part"], "left")
    return inside.withColumn("_count", F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_part", "_here", "_before")


def _children(adjacent: DataFrame, ids: PackedIds, frontier: DataFrame, k: int, mode: str, random_seed: int) -> DataFrame:
    """The sampled children of all nodes of a hop, over all links at once."""
    known = adjacent.where("at IS NOT NULL")
    nodes = frontier.select(F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id")).distinct()
    mine = known.join(nodes, ["parent_type", "parent_id"], "left_semi").select("link", "parent_id", "at", F.lit(0).alias("ask"), "child")
    # a moment to ask about for each request and link of its node
    links = known.select("link", "parent_type", "child_type").distinct()
    moments = frontier.select(F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id"), F.col("seed_time").alias("at")).distinct()
    asked = moments.join(links, "parent_type").select("link", "parent_id", "at", F.lit(1).alias("ask"), F.lit(None).cast("binary").alias("child"))
    counted = written(_numbered(mine.union(asked)), "counted")
    ranked = counted.where("ask = 0").select("link", "parent_id", F.col("_count").alias("_number"), "child", "at")
    seen = counted.where("ask = 1 AND _count > 0").select("link", "parent_id", F.col("at").alias("seed_time"), F.col("_count").alias("_seen"))
    requests = frontier.withColumnsRenamed({"node_type": "parent_type", "node_id": "parent_id"}).join(links, "parent_type").join(seen, ["link", "parent_id", "seed_time"])
    wanted = _recent_numbers(k) if mode == "recent" else _drawn_numbers(k, random_seed)
    picked = requests.withColumn("_timeless", F.lit(None).cast("boolean")) if mode == "recent" else requests
    if mode == "uniform":
        picked = requests.join(known.where(F.col("at") == ntz(ALWAYS)).select("link", F.lit(True).alias("_timeless")).distinct(), "link", "left")
    picked = picked.withColumn("_number", F.explode(wanted)).join(ranked, ["link", "parent_id", "_number"])
    return picked.select(
        "seed_id", "seed_time", F.concat(F.lit("rev_"), "link").alias("edge_type"), F.col("parent_type").alias("from_type"), F.col("parent_id").alias("from_id"),
        F.col("child_type").alias("node_type"), F.expr(ids.text("child_type", "child")).alias("node_id"), F.when(F.col("at") != ntz(ALWAYS), F.col("at")).alias("time"),
    )


def _parents(db: Database, ids: PackedIds, adjacent: DataFrame, frontier: DataFrame, links: Sequence[Link]) -> DataFrame:
    """The parents of all nodes of a hop that exist and are visible, over all links at once."""
    nodes = []
    for name in dict.fromkeys(k.parent for k in links):
        rows, key = _keyed(db, name)
        timeless = db.spec(name).time_index is None
        nodes.append(rows.select(F.lit(name).alias("parent_type"), F.col(key).cast("string").alias("parent_id"), _time_of(db, name).alias("time"), F.lit(timeless).alias("_timeless")))
    asked = frontier.withColumnsRenamed({"node_type": "child_type", "node_id": "child_id"})
    met = asked.join(adjacent.select("link", "parent_type", "parent_id", "child_type", F.expr(ids.text("child_type", "child")).alias("child_id")), ["child_type", "child_id"])
    known = met.join(union_all(nodes), ["parent_type", "parent_id"]).where("_timeless OR time <= seed_time")
    return known.select(
        "seed_id", "seed_time", F.col("link").alias("edge_type"), F.col("child_type").alias("from_type"), F.col("child_id").alias("from_id"),
        F.col("parent_type").alias("node_type"), F.col("parent_id").alias("node_id"), "time",
    )


def _recent_numbers(k: int) -> Column:
    seen = F.col("_seen").cast("bigint")
    return F.sequence(F.greatest(seen - (k - 1), F.lit(1).cast("bigint")), seen)


def _drawn_numbers(k: int, random_seed: int) -> Column:
    """All numbers when at most k are visible, else one draw from each of k equal parts.

    Draws come from a digest of seed, time, node, part and link. Timeless children stand in a seeded
    order already, the same for all requests, so their first k are the draw.
    """
    seen = F.col("_seen").cast("bigint")
    everything = F.sequence(F.lit(1).cast("bigint"), F.least(seen, F.lit(k).cast("bigint")))

    def draw(part: Column) -> Column:
        first = F.floor((part - 1) * seen / k)
        size = F.floor(part * seen / k) - first
        text = F.concat_ws("|", "seed_id", seconds(F.col("seed_time")).cast("string"), "parent_id", part.cast("string"), "link", F.lit(str(random_seed)))
        chance = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
        return (first + F.pmod(chance, size) + 1).cast("bigint")

    return F.when((seen <= k) | F.col("_timeless"), everything).otherwise(F.transform(everything, draw))
