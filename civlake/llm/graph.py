"""Connected components of a graph of links, by jumps to smaller neighbours and forests."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlake.llm.common import join_hot, remove, stashed

#: Nodes that one task's forest holds before it is sent on.
FOREST_NODES = 500_000


class Forest:
    """Union-find in which the smallest id of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> pa.RecordBatch:
        """A link from each node that is not a root to its root."""
        pairs = [(x, r) for x in self.up if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def spanning(pairs: Iterable[tuple[list[int], list[int]]]) -> Iterable[pa.RecordBatch]:
    """The links of a stream as links to roots, contracted as far as bounded memory goes; the last node of a full forest goes on into the next one."""
    forest = Forest()
    for a, b in pairs:
        for x, y in zip(a, b, strict=True):
            forest.link(x, y)
        if a and len(forest.up) > FOREST_NODES:
            yield forest.links()
            last, root = a[-1], forest.root(a[-1])
            forest = Forest()
            forest.link(last, root)
    yield forest.links()


def _spanned(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    return spanning((x.column(0).to_pylist(), x.column(1).to_pylist()) for x in batches)


def _contracted(links: DataFrame) -> DataFrame:
    """Links to roots within a task that has all links of a node to smaller ones; these are at most one from each forest that the links come from, so that no node is hot."""
    return links.repartition("a").sortWithinPartitions("a").mapInArrow(_spanned, "a long, b long")


def components(links: DataFrame, spanned: bool = False) -> DataFrame:
    """(node, root) of every node of links (a long, b long); root is the smallest node that can be reached.

    Each round puts for a link's smaller end the smallest neighbour of that end that is smaller yet, and then ties a node's smaller neighbours
    to each other in one forest a task, until each node has no more than one and that one has none. The minima are partial aggregates, so that a node with many
    links gathers in no task, and joins with such nodes broadcast them. Null nodes and loops are left out; no links, no rows.
    spanned says that each partition's links come from spanning(), so that a second worker beside the one that made them is not needed.
    """
    spark = links.sparkSession
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b and a is not null and b is not null")
    if not spanned:
        ends = ends.mapInArrow(_spanned, "a long, b long")
    now, path = stashed(_contracted(ends), "links")
    older = []
    while True:
        remove(spark, older)
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "b"), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("b")))).alias("e")).select("e.*")
        # of each node the least and most of its smaller neighbours, and how many links it has to larger ones
        nodes = both.groupBy("node").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count_if(F.col("b").isNull()).alias("links"))
        total, largest, unsettled = nodes.agg(F.sum("links"), F.max("links"), F.count_if(F.expr("least < most or least is not null and links > 0"))).first()
        if not total:
            return spark.createDataFrame([], "node long, root long")
        if not unsettled:
            return nodes.select("node", F.coalesce("least", "node").alias("root"))
        ups = nodes.filter("links > 0").select(F.col("node").alias("b"), F.coalesce("least", "node").alias("up"), "links")
        older = [path]
        now, path = stashed(_contracted(join_hot(now, ups, ["b"], "links", total, largest).select("a", F.col("up").alias("b"))), "links")
