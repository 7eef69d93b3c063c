"""Descriptor search: distances, exact nearest neighbours, a KD tree and best-bin-first search in it.

Descriptors are rows (key_id, descriptors array<double>). The tree is built level by level: all nodes of a level split on
the same dimension, the one of the next largest variance over all keys, at the middle of their sorted keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stored

BLOCK = 2048  # queries that search a block of the tree together
HELD = 16384  # keys that are held in memory at once
LEVELS = 12  # levels of a tree that are searched as one block


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def variances(keys: DataFrame) -> DataFrame:
    """(dim, variance) of each descriptor value over all keys."""
    return keys.select(F.posexplode("descriptors").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("variance"))


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nearest key of its block for each query, from rows in the order of block and kind: a block's keys, then the queries."""
    block, ids, held = None, [], []
    keys, x = np.empty(0, np.int64), np.empty((0, 0))
    for batch in batches:
        for (at, asks), rows in batch.groupby(["block", "asks"], sort=True):
            if at != block:
                block, ids, held, keys = at, [], [], np.empty(0, np.int64)
            if not asks:
                ids.append(rows["id"].to_numpy())
                held.append(np.stack(rows["descriptors"].to_numpy()).astype(float))
                continue
            if held:
                keys, x = np.concatenate(ids), np.concatenate(held)
                order = np.argsort(keys, kind="stable")  # the lowest id is the first of equal distances
                keys, x, ids, held = keys[order], np.ascontiguousarray(x[order].T), ids[:0], held[:0]
            if not len(keys):
                continue
            for low in range(0, len(rows), 128):
                q = np.stack(rows["descriptors"].to_numpy()[low : low + 128]).astype(float)
                d = np.zeros((len(q), len(keys)))
                for j in range(x.shape[0]):
                    d += (q[:, j, None] - x[None, j]) ** 2
                best = d.argmin(axis=1)
                yield pd.DataFrame({"query_id": rows["id"].to_numpy()[low : low + 128], "key_id": keys[best], "distance": d[np.arange(len(q)), best]})


def nearest_exact(queries: DataFrame, keys: DataFrame, held: int = HELD) -> DataFrame:
    """For each query the nearest key, the one with the lowest id on ties: (query_id, key_id, distance), squared.

    Keys are dealt out once, in blocks of about `held`; every block gets all queries, which stream past its keys. Only one
    block is in memory, nothing comes to the driver, and each block sends one row a query to the final minimum.
    """
    blocks = max(1, -(-keys.count() // held))
    own = keys.select(F.pmod(F.xxhash64("key_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("key_id").alias("id"), "descriptors")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("key_id").alias("id"), "descriptors")
    met = own.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = met.mapInPandas(_searched, "query_id long, key_id long, distance double")
    return found.groupBy("query_id").agg(F.min(F.struct("distance", "key_id")).alias("m")).select("query_id", "m.key_id", "m.distance")


def split_dimensions(keys: DataFrame, levels: int) -> list[int]:
    """The dimensions that the levels split on: largest variance first, of equal ones the higher number."""
    return [r["dim"] for r in variances(keys).orderBy(F.desc("variance"), F.desc("dim")).limit(levels).collect()]


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (node, x, place) with the key's place in its node's order (_r) and the node's size (_n).

    Ranges of (node, x, place) are dealt out, rows numbered inside, and the ranges' first numbers summed: no node, the root
    included, meets in one task.
    """
    spark = rows.sparkSession
    dealt = stored(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "node", "x", "place").withColumn("_range", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy("node", "x", "place"))).join(F.broadcast(before), "_range").withColumn("_i", F.col("_i") + F.col("_before") - 1)
    numbered = stored(numbered.drop("_range", "_before"), "numbered")
    nodes = numbered.groupBy("node").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    return numbered.join(nodes, "node").withColumn("_r", F.col("_i") - F.col("_first"))


def kd_tree(keys: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): nodes (node_id, depth, dim, median), children of n are 2n and 2n + 1; leaves (key_id, node_id, place).

    A node of one key is a leaf, and so is any after the last level.
    """
    n = keys.count()
    size = keys.select(F.max(F.size("descriptors"))).first()[0] or 0
    depth = min(size, max(0, (n - 1).bit_length()) if levels is None else levels)
    dims = split_dimensions(keys, depth)
    wanted = stored(keys.select("key_id", F.array(*[F.element_at("descriptors", dim + 1) for dim in dims]).cast("array<double>").alias("xs")), "splits")  # only what is split on travels
    rows = wanted.select("key_id", "xs", F.lit(1).cast("long").alias("node"), F.col("key_id").alias("place"))
    nodes = None
    for d, dim in enumerate(dims):
        ranked = _ranked(rows.select("key_id", "node", "place", "xs", F.element_at("xs", d + 1).alias("x")))
        ranked = stored(ranked.withColumn("_middle", F.expr("_n div 2")), f"level{d}")
        made = ranked.where("_n > 1 AND _r = _middle").select(F.col("node").alias("node_id"), F.lit(d).alias("depth"), F.lit(dim).alias("dim"), F.col("x").alias("median"))
        nodes = made if nodes is None else nodes.unionByName(made)
        rows = ranked.select("key_id", "xs", F.when(F.col("_n") <= 1, F.col("node")).otherwise(2 * F.col("node") + F.when(F.col("_r") >= F.col("_middle"), 1).otherwise(0)).alias("node"), F.col("_i").alias("place"))
    if nodes is None:
        nodes = keys.sparkSession.createDataFrame([], "node_id long, depth int, dim int, median double")
    return nodes, rows.select("key_id", F.col("node").alias("node_id"), "place")


def leaf_of(queries: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(query_id, node_id): the leaf that a plain descent reaches; values below the median go to the left."""
    at = queries.select(F.col("key_id").alias("query_id"), "descriptors", F.lit(1).cast("long").alias("node_id"))
    for d in range(levels):
        level = nodes.where(F.col("depth") == d).select("node_id", "dim", "median")
        x = F.element_at("descriptors", F.col("dim") + 1)
        at = at.join(level, "node_id", "left").select("query_id", "descriptors", F.when(F.col("dim").isNull(), F.col("node_id")).otherwise(2 * F.col("node_id") + F.when(x < F.col("median"), 0).otherwise(1)).alias("node_id"))
    return at.select("query_id", "node_id")


def _block(node: str) -> Column:
    """The root of the block of LEVELS levels that an inner node is in."""
    return F.expr(f"shiftright({node}, cast((length(bin({node})) - 1) % {LEVELS} as int))")


def _found(sorted_ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id is among the sorted ones; -1 if it isn't."""
    if not len(sorted_ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_ids, wanted), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == wanted, at, -1)


def _walked(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Queries after their search inside one block of the tree, all of them a step at a time.

    A query's open cells are three arrays: nodes, the blocks they are in, and bounds, the squared distance of the query to the cell. A
    path splits on a dimension once, so bounds add up. A query stops where its next cell lies in another block, which
    `block` then names, or is done (-1).
    """
    if queries.empty:
        return queries[STATE]
    inner = block[block["dim"].notna()].sort_values("node_id")
    leaf = block[block["dim"].isna()].sort_values("node_id")
    inner_ids, dims, medians = inner["node_id"].to_numpy(np.int64), inner["dim"].to_numpy(np.int64), inner["median"].to_numpy(float)
    leaf_ids, leaf_keys = leaf["node_id"].to_numpy(np.int64), leaf["key_id"].to_numpy(np.int64)
    points = np.stack(leaf["descriptors"].to_numpy()) if len(leaf) else np.empty((0, 0))
    here, q = int(queries["block"].iloc[0]), np.stack(queries["descriptors"].to_numpy())
    left, key, distance = (queries[c].to_numpy().copy() for c in ("left", "key_id", "distance"))
    size = queries["nodes"].map(len).to_numpy().copy()
    deep = size.max(initial=0) + LEVELS + 2
    nodes, homes, bounds = (np.zeros((len(queries), deep), kind) for kind in (np.int64, np.int64, float))
    for i, parts in enumerate(zip(queries["nodes"], queries["homes"], queries["bounds"])):
        for stack, part in zip((nodes, homes, bounds), parts):
            stack[i, : len(part)] = part
    waiting = np.zeros(len(queries), bool)
    while len(at := np.flatnonzero((size > 0) & (left > 0) & ~waiting)):
        top = size[at] - 1
        node, bound = nodes[at, top], bounds[at, top]
        near_enough = bound <= distance[at]
        waiting[at] = near_enough & (homes[at, top] != here)
        size[at[~waiting[at]]] -= 1
        going = near_enough & ~waiting[at]
        at, node, bound = at[going], node[going], bound[going]
        place = _found(leaf_ids, node)
        if (ends := place >= 0).any():
            who, place = at[ends], place[ends]
            left[who] -= 1
            d = ((q[who] - points[place]) ** 2).sum(axis=1)
            closer = d < distance[who]
            distance[who[closer]], key[who[closer]] = d[closer], leaf_keys[place[closer]]
        place = _found(inner_ids, node)
        if (splits := place >= 0).any():
            who, place, node, bound = at[splits], place[splits], node[splits], bound[splits]
            gap = q[who, dims[place]] - medians[place]
            low = np.where(gap < 0, 2 * node, 2 * node + 1)  # the nearer child
            for child, b in ((4 * node + 1 - low, bound + gap * gap), (low, bound)):
                held = (_found(inner_ids, child) >= 0) | (_found(leaf_ids, child) >= 0)
                nodes[who, size[who]], homes[who, size[who]], bounds[who, size[who]] = child, np.where(held, here, child), b
                size[who] += 1
    size = np.where(left > 0, size, 0)
    cut = lambda stack: [stack[i, :n] for i, n in enumerate(size)]
    goes_on = np.where(size > 0, homes[np.arange(len(size)), np.maximum(size - 1, 0)], -1)
    return queries.assign(block=goes_on, nodes=cut(nodes), homes=cut(homes), bounds=cut(bounds), left=left, key_id=key, distance=distance)[STATE]


STATE = ["query_id", "descriptors", "block", "nodes", "homes", "bounds", "left", "key_id", "distance"]


def best_bin_first(queries: DataFrame, keys: DataFrame, nodes: DataFrame, leaves: DataFrame, more_leaves: int = 7) -> DataFrame:
    """(query_id, key_id, distance): the nearest first key of the leaf reached and of up to `more_leaves` others, cells that lie too far left out.

    The tree is cut into blocks of LEVELS levels (4,095 nodes and 4,096 leaves at most). In each round the queries
    meet, in groups of about BLOCK, the block of their next open cell and search it as far as it goes, so no task holds more
    than one block, and a block that many queries need is sent out once a group. Without keys the key_id is -1.
    """
    schema = "query_id long, descriptors array<double>, block long, nodes array<long>, homes array<long>, bounds array<double>, left long, key_id long, distance double"
    first = leaves.groupBy("node_id").agg(F.min(F.struct("place", "key_id"))["key_id"].alias("key_id")).join(keys.select("key_id", "descriptors"), "key_id")
    parent = first.withColumn("_up", F.expr("greatest(node_id div 2, 1L)"))
    tree = nodes.select(_block("node_id").alias("block"), "node_id", F.col("dim").cast("int").alias("dim"), "median", F.lit(None).cast("long").alias("key_id"), F.lit(None).cast("array<double>").alias("descriptors"))
    tree = stored(tree.unionByName(parent.select(_block("_up").alias("block"), "node_id", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("double").alias("median"), "key_id", "descriptors")), "tree")
    root = F.array(F.lit(1).cast("long"))
    state = stored(queries.select(F.col("key_id").alias("query_id"), "descriptors", F.lit(1).cast("long").alias("block"), root.alias("nodes"), root.alias("homes"), F.array(F.lit(0.0)).alias("bounds"), F.lit(more_leaves + 1).cast("long").alias("left"), F.lit(-1).cast("long").alias("key_id"), F.lit(float("inf")).alias("distance")), "search")
    done = state.where("block < 0")
    while not (active := state.where("block >= 0")).isEmpty():
        groups = active.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("_groups"))
        asked = active.join(groups, "block").withColumn("_group", F.pmod(F.xxhash64("query_id"), F.col("_groups")))
        sent = tree.join(groups, "block").withColumn("_group", F.explode(F.expr("sequence(0L, _groups - 1)")))
        pair = asked.drop("_groups").groupBy("block", "_group").cogroup(sent.drop("_groups").groupBy("block", "_group"))
        state = stored(pair.applyInPandas(_walked, schema), "search")
        done = done.unionByName(state.where("block < 0"))
    return done.select("query_id", "key_id", "distance")
