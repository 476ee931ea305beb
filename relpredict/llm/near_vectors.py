"""Embedding near-dedup: robust-pruned graphs on overlapping cluster shards, joined and searched by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relpredict.llm.common import components, local_roots, stored

#: Least cosine of a link.
COSINE = 0.98
#: Vectors of each label that centres are fitted on, at most (drawn by hash), and rounds of fitting.
FIT_VECTORS, FIT_ROUNDS = 8_192, 8
#: Vectors meant for one cluster, most clusters of a label, and most vectors of one shard's graph.
CLUSTER, MOST_CLUSTERS, SHARD = 512, 4_096, 1_024
#: Clusters that a vector is indexed in, and clusters that a query looks into.
OVERLAP, PROBES = 2, 4
#: Degree, candidates and slack of pruning (as in DiskANN), and width of the search beam.
DEGREE, CANDIDATES, SLACK, BEAM = 24, 64, 1.2, 48


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, lists = batch.num_rows, batch.column(2)
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(n), lengths)
        broken = np.bincount(row[~np.isfinite(flat)], minlength=n) > 0
        top = np.zeros(n)  # scaled by it first, so squares stay finite
        np.maximum.at(top, row, np.abs(np.nan_to_num(flat, posinf=0, neginf=0)))
        sound = ~broken & (top > 0) & ~batch.column(1).is_null().to_numpy(zero_copy_only=False)
        flat, row = flat[sound[row]], row[sound[row]]
        flat = flat / top[row]
        flat = flat / np.sqrt(np.bincount(row, flat * flat, minlength=n))[row]
        ends = np.cumsum(np.where(sound, lengths, 0))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(~sound, False))
        units = pa.ListArray.from_arrays(offsets, pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], ["vec_id", "label", "unit"])


def unit(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``unit`` (double) of every row; ``unit`` is null for what can't link.

    That is a row with a null label, or a vector that is null, empty, zero, or holds a null or a
    component that isn't finite. Each vector is normalised once, where it lies.
    """
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(_units, f"{kinds}, unit array<double>")


def fit_centres(vectors: DataFrame) -> DataFrame:
    """``label``, ``cluster`` and ``centre``: spherical k-means per label on a bounded sample of it.

    The number of clusters follows the number of vectors up to ``MOST_CLUSTERS``; beyond, clusters
    hold more shards.
    """
    totals = stored(vectors.groupBy("label").agg(F.count("*").alias("n")), "labels")
    drawn = vectors.join(totals, "label").where(F.expr(f"pmod(xxhash64(unit), 1000000) * n < {FIT_VECTORS} * 1000000L"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        width = rows["unit"].map(len).mode().iloc[0]
        x = np.stack([u for u in rows["unit"] if len(u) == width]).astype(np.float32)
        k = int(min(MOST_CLUSTERS, max(1, rows["n"].iloc[0] // CLUSTER), len(x)))
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(FIT_ROUNDS):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
        return pd.DataFrame({"label": rows["label"].iloc[0], "cluster": range(k), "centre": list(centres.astype(float))})

    kind = vectors.schema["label"].dataType.simpleString()
    return drawn.groupBy("label").applyInPandas(fit, f"label {kind}, cluster int, centre array<double>")


def _nearest(rows: pd.DataFrame, centres: dict, n: int) -> list[list[int]]:
    """The clusters of each row's label whose centres are nearest, best first; cluster 0 without a model."""
    out: list[list[int]] = [[0]] * len(rows)
    widths = rows["unit"].map(len)
    for (label, width), places in rows.groupby([rows["label"], widths]).indices.items():
        names, table = centres.get(label, (None, np.zeros((0, 0))))
        if table.shape[1] != width:
            continue
        x = _matrix(rows["unit"].iloc[places])
        best = np.argsort(-(x @ table.T), axis=1, kind="stable")[:, :n]
        for i, row in zip(places, names[best].tolist(), strict=True):
            out[i] = row
    return out


def assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """The rows with ``clusters``, nearest first: ``PROBES`` of them."""
    local = centres.toPandas()  # MOST_CLUSTERS a label at most
    tables = {label: (part["cluster"].to_numpy(np.int32), np.stack(part["centre"])) for label, part in local.groupby("label")}
    shared = vectors.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(clusters=_nearest(rows, shared.value, PROBES))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInPandas(run, f"{schema}, clusters array<int>")


def pruned(x: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours of every row of ``x`` (unit vectors); -1 fills short lists.

    Candidates are the nearest ones and a few rows at random, which keep far regions linked. The
    nearest is taken, what it makes superfluous is dropped, and so on.
    """
    n = len(x)
    similar = x @ x.T
    np.fill_diagonal(similar, -np.inf)
    near = min(CANDIDATES, n - 1)
    if near < 1:
        return np.full((n, DEGREE), -1)
    best = np.argpartition(-similar, near - 1, axis=1)[:, :near]
    far = np.random.default_rng(n).integers(0, n, (n, 8))
    candidates = np.concatenate([best, far], axis=1)
    at = np.arange(n)[:, None]
    order = np.argsort(-similar[at, candidates], axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, axis=1)
    distance = 1 - similar[at, candidates]
    alive = candidates != at
    out = np.full((n, DEGREE), -1)
    rows = np.arange(n)
    for k in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        pick = candidates[rows, first]
        out[some, k] = pick[some]
        between = 1 - np.where(candidates == pick[:, None], 1.0, similar[pick[:, None], candidates])
        alive &= ~(SLACK * between <= distance) & (candidates != pick[:, None])
    return out


def searched(x: np.ndarray, links: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``x`` are in range of which query: greedy search from the medoid, then range expansion.

    ``links`` tells whether one row has another in its list. Each step expands, for all queries at
    once, what is in the beam (the nearest rows met so far) or in range and not yet expanded.
    """
    n, beam = len(x), min(BEAM, len(x))
    similar = queries @ x.T
    met = np.zeros((len(queries), n), bool)
    met[:, int((x @ x.mean(axis=0)).argmax())] = True
    done = np.zeros_like(met)
    step = links.astype(np.float32)
    active = np.arange(len(queries))
    while len(active):
        score = np.where(met[active], similar[active], -np.inf)
        cut = np.maximum(-np.partition(-score, beam - 1, axis=1)[:, beam - 1], -2.0)[:, None]
        todo = ~done[active] & ((score >= cut) | (score >= least))
        some = todo.any(axis=1)
        active, todo = active[some], todo[some]
        done[active] |= todo
        met[active] |= (todo.astype(np.float32) @ step) > 0
    return met & (similar >= least)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cid", kind="stable")
    ids = rows["cid"].to_numpy()
    lists = [ids[a[a >= 0]].tolist() for a in pruned(_matrix(rows["unit"]).astype(np.float32))]
    return pd.DataFrame({"cid": ids, "near": lists})


def _looked_up(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Per query the weight of the members at home here that it links with; and stars that join what is linked."""
    none = pd.DataFrame({"cid": [], "weight": [], "root": []}).astype("int64")
    if not len(members) or not len(queries):
        return none
    members = members.sort_values("cid", kind="stable")
    ids, asked = members["cid"].to_numpy(), queries["cid"].to_numpy()
    x = _matrix(members["unit"])
    place = {c: i for i, c in enumerate(ids)}
    links = np.zeros((len(ids), len(ids)), bool)
    for i, near in enumerate(members["near"]):
        to = [place[c] for c in near if c in place]
        links[i, to] = True
        links[to, i] = True  # joined lists are walked both ways
    hits = searched(x, links, _matrix(queries["unit"]), COSINE)
    hits &= asked[:, None] != ids[None, :]
    home = members["home"].to_numpy(bool)
    weight = (hits & home[None, :]) @ members["n"].to_numpy(np.int64)
    q, v = np.nonzero(hits)
    everyone = np.unique(np.concatenate([asked, ids]))  # sorted, so the smallest place is the smallest id
    root = local_roots(np.searchsorted(everyone, asked[q]), np.searchsorted(everyone, ids[v]), len(everyone))
    star = pd.DataFrame({"cid": everyone, "weight": 0, "root": everyone[root]})
    found = pd.DataFrame({"cid": asked, "weight": weight, "root": asked})
    return pd.concat([found[found["weight"] > 0], star[star["cid"] != star["root"]], none])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``.

    Vectors of one label (not null) are linked by a cosine of 0.98 or more, in double precision; what
    ``unit`` leaves out links with nothing, has no links, and is a component of its own. So is a
    vector of another width than its partner. A component is named after its smallest ``vec_id``; rows
    that repeat an id or lack one are vectors like any other. Columns but ``vec_id``, ``label`` and
    ``embedding`` are not read.

    Equal vectors are one node with a weight. A node is indexed in its two nearest clusters and looks
    into four; a cluster above ``SHARD`` nodes has several shards, all of which are looked into. Each
    shard's graph is built alone, a node's lists are joined, and queries meet a shard in blocks. A
    link counts where its far end is at home, so it counts once; of a block's links only stars leave
    the task, never pairs. The graph may miss a link (``recall`` measures how many), the cosine of
    every link is exact.
    """
    rows = unit(vectors).withColumn("cid", F.xxhash64("label", "unit"))
    nodes = stored(rows.where("unit IS NOT NULL").groupBy("cid", "label", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")), "nodes")
    placed = stored(assigned(nodes, fit_centres(nodes.select(F.col("cid").alias("vec_id"), "label", "unit"))), "placed")

    width = F.size("unit").alias("width")
    key = ["label", "width", "cluster"]
    index = placed.select("label", width, "cid", "unit", "n", F.posexplode(F.slice("clusters", 1, OVERLAP)).alias("near_no", "cluster"))
    asked = placed.select("label", width, "cid", "unit", F.explode("clusters").alias("cluster"))
    loads = index.groupBy(key).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    loads = loads.join(asked.groupBy(key).agg(F.ceil(F.count("*") / (4 * SHARD)).cast("int").alias("blocks")), key)
    loads = stored(loads, "loads")
    index = index.join(loads, key).withColumn("shard", F.expr("CAST(pmod(cid, shards) AS INT)"))
    index = stored(index.select(*key, "shard", "blocks", "cid", "unit", "n", (F.col("near_no") == 0).alias("home")), "index")
    built = index.groupBy(*key, "shard").applyInPandas(_built, "cid bigint, near array<bigint>")
    joined = stored(built.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    members = index.join(joined, "cid").select(*key, "shard", "cid", "unit", "n", "home", "near", spread)
    queries = asked.join(loads, key).withColumn("block", F.expr("pmod(xxhash64(cid), blocks)"))
    queries = queries.select(*key, "cid", "unit", F.col("block").cast("int"), F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"))
    by = [*key, "shard", "block"]
    found = members.groupBy(by).cogroup(queries.groupBy(by)).applyInPandas(_looked_up, "cid bigint, weight bigint, root bigint")
    found = stored(found, "found")

    links = found.groupBy("cid").agg(F.sum("weight").alias("weight"))
    roots = components(found.where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    rooted = nodes.select("cid", "least", "n").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    rooted = stored(rooted.select("cid", "least", F.expr("n - 1 + coalesce(weight, 0)").alias("n_links"), F.coalesce("root", "cid").alias("root")), "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = stored(rooted.join(names, "root").select("cid", "n_links", "component_id"), "named")

    joined = rows.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("cid")).alias("cid")).join(named, "cid", "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("coalesce(vec_id = component_id, component_id IS NULL)"))


def recall(vectors: DataFrame, found: DataFrame, every: int = 50) -> tuple[int, int]:
    """Links found and links there are, of all vectors whose id is divisible by ``every``, by brute force.

    Rows meet queries of their label in blocks of 1,024 queries.
    """
    rows = unit(vectors).where("unit IS NOT NULL")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = asked.groupBy("label").agg(F.ceil(F.count("*") / 1024).cast("int").alias("blocks"))
    queries = asked.join(blocks, "label").select("label", F.expr("pmod(xxhash64(vec_id), blocks)").cast("int").alias("block"), "vec_id", "unit")
    spread = rows.join(blocks, "label").select(  # columns of their own, or the two sides couldn't be told apart
        F.col("label").alias("r_label"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("r_block"), F.col("unit").alias("r_unit")
    )

    def count(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []}).astype("int64")
        x, y = _matrix(left["unit"]), _matrix(right["r_unit"])
        n = sum((x @ y[i : i + 4096].T >= COSINE).sum(axis=1) for i in range(0, len(y), 4096))
        return pd.DataFrame({"vec_id": left["vec_id"], "n": n - 1})

    true = queries.groupBy("label", "block").cogroup(spread.groupBy("r_label", "r_block")).applyInPandas(count, "vec_id bigint, n bigint")
    row = true.join(found, "vec_id").agg(F.sum("n_links"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)
