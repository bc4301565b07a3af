"""Property graph over tables: node folding, bounded traversal, reachability, link checks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import skew
from memlake.session import cut

# Rounds after which what was found so far becomes one table again.
ROUNDS = 16
# Steps that a task holds at once to walk from its seeds; above, walks go level by level.
STEPS_HELD = 4_000_000
# Rows of a walk sent out at once.
ROWS_OUT = 65_536


def fold_nodes(log: DataFrame, seq: str) -> DataFrame:
    """Nodes from their upserts: union of labels, properties merged key by key, the latest non-null wins.

    ``log``: ``id, labels, props`` (JSON object). Result: ``id, labels`` (sorted), ``props``
    (JSON, keys sorted; null without any). Labels and properties are folded value by value, so that no
    node's upserts are gathered. Rows without an id are left out.
    """
    log = log.where("id is not null")
    labels = log.select("id", F.explode("labels").alias("label")).where("label is not null").distinct().groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    pairs = log.select("id", F.col(seq).alias("__s"), F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    props = pairs.groupBy("id", "k").agg(F.max_by("v", F.struct("__s", "v")).alias("v"))
    props = props.groupBy("id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("props"))
    return log.select("id").distinct().join(labels, "id", "left").join(props, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Steps ``node, next, edge_id`` along edges, against them, or both ways; of parallel edges the smallest id."""
    out = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col("id").alias("edge_id"))
    back = edges.select(F.col("to_node").alias("node"), F.col("from_node").alias("next"), F.col("id").alias("edge_id"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return steps.where("node is not null and next is not null").groupBy("node", "next").agg(F.min("edge_id").alias("edge_id"))


def neighbors(seeds: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, depth: int = 1, direction: str = "out", rows_per_task: int = skew.ROWS_PER_TASK, steps_held: int = STEPS_HELD) -> DataFrame:
    """Nodes within ``depth`` steps of each seed, once, by a shortest path: ``seed, node, depth, path``.

    ``seeds``: one column of ids, or several; repeated and null ones count once or not. ``path`` holds the
    edge ids; of equally short paths the one least in order. The seed itself is no result. With
    ``nodes`` only existing nodes come out and are expanded. ``depth`` below 1 is an error.

    What is found may grow with the seeds times the nodes, far beyond the tables: up to ``steps_held`` steps, each task
    holds them all and walks from its share of the seeds, so that nothing found is shuffled or written.
    Above, level by level: the frontier meets the steps in one equi-join, hot nodes salted, each level cut
    in the shared checkpoint folder.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    steps = adjacency(edges, direction)
    if nodes is not None:
        steps = steps.join(nodes.select(F.col("id").alias("next")).where("next is not null").distinct(), "next", "left_semi")
    if depth > 1:
        steps = cut(steps)  # every level reads them
    seed = seeds.columns[0]
    start = seeds.select(F.col(seed).alias("seed")).where("seed is not null").distinct()
    if depth > 1 and steps.count() <= steps_held:
        return _walked(start, steps, depth)
    frontier = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"))
    found = frontier
    hot = skew.hot_keys(steps, ["node"], rows_per_task)
    for level in range(1, depth + 1):
        left, right, on = skew.salted(steps, frontier.select("node", "seed", "path"), ["node"], ["next"], hot=hot)
        reached = left.join(right, on).select("seed", F.col("next").alias("node"), F.concat("path", F.array("edge_id")).alias("path"))
        reached = reached.groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = cut(reached.join(found.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("depth"), "path"))
        found = found.unionByName(frontier)
    return found.where("depth > 0")


class _Steps:
    """Steps by the number of their start, edges numbered in order of their ids (0: without one)."""

    def __init__(self, table: pa.Table):
        ends = pa.chunked_array([*table["node"].chunks, *table["next"].chunks], table["node"].type).combine_chunks().dictionary_encode()
        self.names = ends.dictionary
        code = ends.indices.to_numpy()
        edges = table["edge_id"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(edges.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        self.ids = pa.concat_arrays([pa.nulls(1, edges.dictionary.type), edges.dictionary.take(pa.array(order))])
        used = np.asarray(pc.fill_null(edges.indices, -1))
        number = np.where(used < 0, 0, rank[used] if len(rank) else 0)
        start, to = code[: len(used)], code[len(used) :]
        by = np.argsort(start, kind="stable")
        self.next, self.edge = to[by], number[by]
        self.first = np.searchsorted(start[by], np.arange(len(self.names) + 1))
        self.seen = np.zeros(len(self.names), dtype=bool)
        self.best = np.zeros(len(self.names), dtype=np.int64)

    def walk(self, seed: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level by level the nodes first reached there and their paths, the least of each node."""
        at, rank, path = np.array([seed]), np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.int64)
        visited = [at]
        self.seen[at] = True
        for level in range(1, depth + 1):
            n = self.first[at + 1] - self.first[at]
            step = np.repeat(self.first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            new = ~self.seen[self.next[step]]
            step, source = step[new], np.repeat(np.arange(len(at)), n)[new]
            if not len(step):
                break
            key = rank[source] * (len(self.ids) + 1) + self.edge[step]
            order = np.argsort(key)[::-1]
            self.best[self.next[step[order]]] = order  # of repeated nodes the last, which is the least path, stays
            at = np.unique(self.next[step])
            self.seen[at] = True
            visited.append(at)
            took = self.best[at]
            path = np.column_stack([path[source[took]], self.edge[step[took]]])
            rank = np.unique(key[took], return_inverse=True)[1]
            yield level, at, path
        for nodes in visited:
            self.seen[nodes] = False


def _walked(start: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """``neighbors`` with all steps in every task; one task for each core there is."""
    tasks = max(1, start.sparkSession.sparkContext.defaultParallelism)
    nodes = dict(steps.dtypes)
    share = F.pmod(F.xxhash64("seed"), F.lit(tasks)).cast("int").alias("task")
    empty = [F.lit(None).cast(nodes[c]).alias(c) for c in ("node", "next", "edge_id")]
    copies = steps.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "node", "next", "edge_id", F.lit(None).cast(start.dtypes[0][1]).alias("seed"))
    rows = copies.unionByName(start.select(share, *empty, "seed")).repartitionById(tasks, "task").select("node", "next", "edge_id", "seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seeds = [], []
        for batch in batches:
            asked = batch.column("seed").is_valid()
            seeds.append(batch.column("seed").filter(asked))
            parts.append(batch.select(["node", "next", "edge_id"]).filter(pc.invert(asked)))
        if not sum(map(len, seeds)) or not sum(map(len, parts)):
            return
        held = _Steps(pa.Table.from_batches(parts))
        parts.clear()
        for seed in pa.concat_arrays(seeds):
            at = pc.index_in(seed.cast(held.names.type), held.names).as_py()
            if at is None:
                continue
            for level, found, paths in held.walk(at, depth):
                for i in range(0, len(found), ROWS_OUT):
                    some, path = found[i : i + ROWS_OUT], paths[i : i + ROWS_OUT]
                    ids = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * level), held.ids.take(pa.array(path.ravel())))
                    yield pa.RecordBatch.from_arrays([pa.repeat(seed, len(some)), held.names.take(pa.array(some)), pa.repeat(pa.scalar(level, pa.int32()), len(some)), ids], names=["seed", "node", "depth", "path"])

    return rows.mapInArrow(run, f"seed {start.dtypes[0][1]}, node {nodes['next']}, depth int, path array<string>")


def nearest(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes of each seed, nearer ones first, then by path: the limit of a walk."""
    order = Window.partitionBy("seed").orderBy("depth", "path")
    return found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).drop("__r")


def paths(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """All paths of up to ``depth`` steps that visit no node twice: ``seed, node, depth, path``; a node comes out once per path."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    steps = edges.where("from_node is not null and to_node is not null").select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col("id").alias("edge_id")).distinct()
    seed = seeds.columns[0]
    frontier = seeds.select(F.col(seed).alias("seed")).where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), F.array("seed").alias("seen"))
    found = None
    hot = skew.hot_keys(steps, ["node"])
    for level in range(1, depth + 1):
        left, right, on = skew.salted(steps, frontier, ["node"], ["edge_id"], hot=hot)
        met = left.join(right, on).where(~F.array_contains("seen", F.col("next")))
        frontier = met.select("seed", F.col("next").alias("node"), F.lit(level).alias("depth"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("seen", F.array("next")).alias("seen"))
        frontier = cut(frontier)  # the next level and the result both read it
        found = frontier if found is None else found.unionByName(frontier)
    return found.drop("seen")


def reachable(seeds: DataFrame, steps: DataFrame, most: int | None = None, stride: int = 3) -> DataFrame:
    """Everything reached from each seed over ``steps`` (``node, next``): ``seed, node, depth``, the seed at depth 0.

    Runs until no seed reaches anything new, which every level must; cycles end by themselves. Where ``most`` is
    given, a chain longer than that is an error.
    ``stride`` levels are joined in one plan before what is new is cut in the shared checkpoint folder;
    only its deepest level is walked on from.
    """
    seed = seeds.columns[0]
    steps = cut(steps.where("node is not null and next is not null").select("node", "next").distinct())
    start = seeds.select(F.col(seed).alias("seed")).where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    found = frontier = cut(start)
    hot = skew.hot_keys(steps, ["node"])
    for level in count(0, stride) if most is None else range(0, most, stride):
        at, hops = frontier.select("node", "seed"), []
        for hop in range(1, stride + 1):
            left, right, on = skew.salted(steps, at, ["node"], ["next"], hot=hot)
            at = left.join(right, on).select("seed", F.col("next").alias("node")).distinct()
            hops.append(at.withColumn("depth", F.lit(level + hop)))
        fresh = hops[0]
        for more in hops[1:]:
            fresh = fresh.unionByName(more)
        fresh = fresh.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        fresh = cut(fresh.join(found.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "depth"))
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
        if level // stride % ROUNDS == ROUNDS - 1:
            found = cut(found)
        frontier = fresh.where(F.col("depth") == level + stride)
    raise ValueError(f"chain longer than {most}")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose start or end is no node: ``id, endpoint, node``."""
    ends = edges.select("id", F.explode(F.map_from_arrays(F.array(F.lit("from"), F.lit("to")), F.array("from_node", "to_node"))).alias("endpoint", "node"))
    return ends.where("node is not null").join(nodes.select(F.col("id").alias("node")).where("node is not null").distinct(), "node", "left_anti").select("id", "endpoint", "node")
