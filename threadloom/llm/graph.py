"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import spent, written

#: Edges (16 bytes each) that one task joins at once: every round leaves plans, broadcasts and task records with the driver.
FEW = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs); the component is its least node.

    Each round hangs every node on its least smaller neighbour, shortens these trees by pointer
    jumping, and contracts the edges onto the roots, so that the edges that remain shrink fast.
    Only minima per node are gathered (they combine before the shuffle), never a node's neighbours.
    As soon as at most ``FEW`` edges are left, however many there were, one task joins them all.
    An empty table gives no rows; loops, repeats and nulls are ignored.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while many := left.count():
        few = many <= FEW
        tree = written(_joined(left) if few else left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "tree")
        while not few:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "tree")
            spent(tree)
            tree = jumped.drop("moved")
            tree._written_at = jumped._written_at
            if jumped.where("moved").isEmpty():
                break
        fewer = None if few else written(_to_roots(_to_roots(left, tree, "a"), tree, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        spent(left)
        before = labels
        labels = tree if labels is None else written(_to_roots(labels, tree, "root").unionByName(tree.join(labels, "node", "left_anti")), "labels")
        if before is not None:
            spent(before, tree)
        if fewer is None:
            break
        left = fewer
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = labels.select("root").distinct().select(F.col("root").alias("node"), F.col("root").alias("component"))
    return labels.select("node", F.col("root").alias("component")).unionByName(roots)


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots, in one task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(it, schema)
        ids, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(at[: len(t)].tolist(), at[len(t) :].tolist(), strict=True):
            forest.join(x, y)
        roots = forest.roots()
        below = np.flatnonzero(roots != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(ids[roots[below]])], ["node", "root"])

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")


def _to_roots(df: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    found = tree.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(found, column, "left").withColumn(column, F.coalesce("_root", column)).select(*df.columns)


class Forest:
    """Union-find over 0..n-1 inside one task; smaller numbers become roots."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.root, range(len(self.up))), np.int64, len(self.up))
