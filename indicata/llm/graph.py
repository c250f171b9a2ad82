"""Connected components of an edge table, in Spark, without hot keys.

Edges first shrink to a spanning forest inside each task. Then large-star and
small-star steps alternate until nothing changes. Every step's minimum is an
ordinary aggregate (combined before its shuffle) and every step's join is a plain
equi-join, which adaptive execution splits where a node has very many edges. The
tables between steps lie in the shared checkpoint folder; the driver sees only a
count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


class Forest:
    """Union-find over integers that keeps the smallest member as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        nodes = list(self.parent)
        roots = [self.find(x) for x in nodes]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["u", "v"])


    def packed(self) -> Iterator[pa.RecordBatch]:
        """The edges as rows of two lists each."""
        edges = self.edges()
        for a in range(0, edges.num_rows, PACK):
            part = edges.slice(a, PACK)
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy()], pa.list_(pa.int64())) for c in part.columns], names=["u", "v"])


#: Edges in a packed row.
PACK = 1 << 16
#: Nodes that a task holds before it gives out its forest and starts anew.
FOREST_NODES = 1_000_000
#: Edges that a task merges, about.
MERGED = 500_000


def reduce_edges(edges: DataFrame) -> DataFrame:
    """A spanning forest of each task's edges (u, v): the same components, fewer rows."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.link(a, b)
            if len(forest.parent) > FOREST_NODES:
                yield forest.edges()
                forest = Forest()
        if forest.parent:
            yield forest.edges()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def merged(packed: DataFrame) -> DataFrame:
    """One forest (u, v) of many packed ones.

    Forests of one group repeat its nodes; each task merges about ``MERGED`` edges of them, so
    that fewer copies of a node are left before anything is dealt by node. ``packed`` is read
    twice, so it should be settled.
    """
    edges = packed.agg(F.coalesce(F.sum(F.size("u")), F.lit(0))).first()[0]

    def run(batches):
        forest = Forest()
        for batch in batches:
            for us, vs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in zip(us, vs):
                    forest.link(a, b)
                if len(forest.parent) > FOREST_NODES:
                    yield forest.edges()
                    forest = Forest()
        if forest.parent:
            yield forest.edges()

    return packed.repartition(max(1, -(-edges // MERGED))).mapInArrow(run, "u long, v long").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that reaches a smaller one; component is the smallest it reaches.

    A node that isn't in the result is its own component.
    ``edges`` has long columns u and v in any direction; repeated edges and loops
    are allowed. No edges give an empty table.
    """
    state = settle(reduce_edges(edges).where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    seen = None
    while True:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        state = settle(small.where("u <> v").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u as node", "v as component")
        seen = now


def smallest(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, smallest): the smallest ``rep`` of each node's component.

    ``nodes`` has long columns node and rep, ``found`` is what ``components`` gave. Only
    components of several nodes are joined back; the join stands alone in its stage, so
    that adaptive execution can split a component that most nodes belong to.
    """
    rooted = settle(nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root")))
    least = settle(rooted.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least"))
    return rooted.join(least, "root", "left").select("node", F.coalesce("least", "rep").alias("smallest"))
