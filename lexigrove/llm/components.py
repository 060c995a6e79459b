"""Connected components of a graph given as an edge table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.scratch import Scratch


#: A contracted graph of at most this many edges is finished by one task, a fixed bound of a few hundred kilobytes.
LAST_EDGES = 15_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the few edges that are left: (u, v) for every node u, v common to its component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns (node, component): each endpoint of `edges` (long columns a, b) and a label common to its component.

    Every round maps each node to the least label among itself and its neighbours, and rewrites the edges to those
    labels. Labels are rehashed each round (XXH64 of one long is a bijection, so no two nodes ever merge by
    chance), which makes the least label a random neighbour: a constant share of the nodes goes each round, on
    paths as on stars. Once few edges are left, one task finishes them. The least is found by map-side aggregation, so a hub costs its tasks one row each. Nulls and
    loops make no edge. The label is arbitrary; callers take their own minimum over a component's members.
    """
    left = scratch.keep(edges.where("a <> b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("a").alias("na"), F.col("b").alias("nb")), "edges")
    named = left.select(F.col("na").alias("node"), F.col("a").alias("u")).union(left.select("nb", "b")).distinct()
    left = left.select("a", "b")
    maps: list[DataFrame] = []
    while (edges_left := left.count()) > 0:
        if edges_left <= LAST_EDGES:
            maps.append(scratch.keep(left.repartition(1).mapInArrow(_finish, "u long, v long"), "map"))
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.xxhash64(F.least("a", "m")).alias("v"))
        step = scratch.keep(step, "map")
        maps.append(step)
        to = lambda c: step.select(F.col("u").alias(c), F.col("v").alias(f"{c}_to"))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        left = scratch.keep(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")

    def compose(later: DataFrame, step: DataFrame) -> DataFrame:
        after = later.select(F.col("u").alias("v"), F.col("v").alias("w"))
        return scratch.keep(step.join(after, "v", "left").select("u", F.coalesce("w", "v").alias("v")), "map")

    if not maps:
        return named.select("node", F.col("u").alias("component"))
    last = reduce(compose, reversed(maps[:-1]), maps[-1])
    return named.join(last, "u").select("node", F.col("v").alias("component"))
