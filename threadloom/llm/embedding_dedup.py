"""Operator 7, near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of coordinates. Two vectors whose squared distance is
at most d keep in at least one block to that block's share of d; the union of the blocks' range joins
therefore holds every pair. Each block is cut into cells by a k-d tree over a bounded sample; a vector
lives in one cell and visits those its range reaches. Pairs within a block's budget are verified in
double precision, and counted in the first block that finds them. Equal vectors are joined once and
counted by their number. Crowded cells are cut into more tasks, by their inhabitants and by their visitors.
Widths that few rows have are compared in blocks, without cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import spread_join, written
from threadloom.llm.graph import Forest, components
from threadloom.llm.shingles import mixed
from threadloom.llm.vectors import matrix, packed, sample

#: Inhabitants and visitors that one task takes, as estimated from the sample.
SAMPLE, CELL_ROWS, VISITOR_ROWS, BLOCK_DIMS = 4096, 16_384, 131_072, 16
#: Widths that this share of all rows have get cells: at most 16 widths.
WIDE_SHARE = 1 / 16
_ROUNDING = 1e-5


def rotation(width: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1, so that no square over- or
    underflows; rows whose squares are far from that stay as they are."""
    most = np.abs(x).max(1, initial=0.0)
    _, power = np.frexp(most)
    return np.ldexp(x, np.where((power > -200) & (power < 200), 0, -power)[:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


class Cells:
    """k-d cells of one block: median planes of a sample. ``reached`` gives, for each point, every cell
    within the radius; the own one is where the point itself lies."""

    def __init__(self, points: np.ndarray, depth: int, radius: float) -> None:
        self.radius, self.planes, self.depth = radius, {}, depth
        todo = [(1, points)]
        while todo:
            node, own = todo.pop()
            if node >> depth:
                continue
            axis = int(own.var(0).argmax()) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            self.planes[node] = (axis, at)
            low = own[:, axis] <= at
            todo += [(2 * node, own[low]), (2 * node + 1, own[~low])]

    def reached(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own) of every visit."""
        row, node, own = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            axis = np.fromiter((self.planes[k][0] for k in node.tolist()), np.int64, len(node))
            x = points[row, axis] - np.fromiter((self.planes[k][1] for k in node.tolist()), np.float64, len(node))
            low, high = x <= self.radius, x > -self.radius
            row, own, node = np.concatenate([row[low], row[high]]), np.concatenate([(own & (x <= 0))[low], (own & (x > 0))[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
        return row, node, own


VISIT = "task long, own boolean, visits boolean, vec_id long, times long, vec binary"
FOUND = "kind int, a long, b long"


def join_width(vectors: DataFrame, width: int, rows: int, threshold: float) -> DataFrame:
    """(kind, a, b) for distinct vectors (vec_id, times, vec) of one width: kind 0 gives the number b of
    rows linked with a; kind 1 are edges that connect what is linked."""
    spin = rotation(width)
    cuts = list(range(0, width, BLOCK_DIMS)) + [width]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < BLOCK_DIMS // 2:
        del cuts[-2]
    budgets = [(2 - 2 * threshold + 1e-6) * (b - a) / width for a, b in zip(cuts, cuts[1:], strict=False)]
    drawn = units(matrix(sample(vectors, SAMPLE), width)) @ spin
    depth = max(1, int(np.ceil(np.log2(max(1, rows / CELL_ROWS)))))
    cells = [Cells(drawn[:, a:b], depth, float(np.sqrt(budget) + _ROUNDING)) for a, b, budget in zip(cuts, cuts[1:], budgets, strict=False)]
    split, shown = [], []  # parts of each cell's inhabitants and visitors, from the shares of the sample
    for k, c in enumerate(cells):
        _, node, own = c.reached(drawn[:, cuts[k] : cuts[k + 1]])
        for out, there, most in ((split, node[own], CELL_ROWS), (shown, node, VISITOR_ROWS)):
            share = np.bincount(there, minlength=2 << depth) / max(1, len(drawn))
            out.append(np.maximum(1, np.ceil(share * rows / most)).astype(np.int64))

    def visit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            x = units(matrix(b.column(2), width)) @ spin
            dealt = mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for k, c in enumerate(cells):
                r, node, own = c.reached(x[:, cuts[k] : cuts[k + 1]])
                parts, views = split[k][node], shown[k][node]
                mine = (dealt[r] % parts.astype(np.uint64)).astype(np.int64)
                seen = (dealt[r] // parts.astype(np.uint64) % views.astype(np.uint64)).astype(np.int64)
                for p in range(int(parts.max(initial=0))):  # a visitor goes to its view of all parts, an inhabitant to all views of its part
                    for v in range(int(views.max(initial=0))):
                        lives, looks = own & (mine == p) & (views > v), (seen == v) & (parts > p)
                        at = np.flatnonzero(lives | looks)
                        if len(at):
                            task = (k << 56) | (node[at] << 30) | (p << 15) | v
                            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(lives[at]), pa.array(looks[at]), *(b.column(j).take(pa.array(r[at])) for j in (0, 1, 2))], ["task", "own", "visits", "vec_id", "times", "vec"])

    def search(t: pa.Table) -> pa.Table:
        k = t.column("task")[0].as_py() >> 56
        ids, times, own, visits = (t.column(c).to_numpy() for c in ("vec_id", "times", "own", "visits"))
        raw = scaled(matrix(t.column("vec"), width))
        norm = np.sqrt((raw * raw).sum(1))
        turned = (raw / norm[:, None] @ spin).astype(np.float32)
        x = turned[:, cuts[k] : cuts[k + 1]]
        half = (x * x).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        shown_ = np.flatnonzero(visits)
        right = np.ascontiguousarray(np.hstack([x, one, -half])[shown_].T)
        left = np.hstack([x, -half, one])

        def near(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.divmod(np.flatnonzero(left[h] @ right >= np.float32(-budgets[k] / 2 - _ROUNDING)), max(1, len(shown_)))
            return h[a], shown_[b]

        def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """One block counts a pair: the first that keeps to its budget, the same for both directions."""
            mine = _within(turned, i, j, cuts[k], cuts[k + 1], budgets[k])
            for e in range(k):
                mine &= ~_within(turned, i, j, cuts[e], cuts[e + 1], budgets[e])
            return mine

        return _links(ids, times, raw, norm, np.flatnonzero(own), len(shown_), near, first, threshold)

    return vectors.select("vec_id", "times", "vec").mapInArrow(visit, VISIT).groupBy("task").applyInArrow(search, FOUND)


def _links(ids: np.ndarray, times: np.ndarray, raw: np.ndarray, norm: np.ndarray, homes: np.ndarray, others: int, near: Callable, first: Callable, threshold: float) -> pa.Table:
    """Verified links of the inhabitants ``homes``, from the pairs that ``near`` proposes and ``first`` takes."""
    links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
    step = max(16, (8 << 20) // max(1, others))
    for s in range(0, len(homes), step):
        a, b = near(homes[s : s + step])
        for c in range(0, len(a), 100_000):
            i, j = a[c : c + 100_000], b[c : c + 100_000]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            cosine = (raw[i] * raw[j]).sum(1) / (norm[i] * norm[j])
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            mine = first(i, j)
            i, j = i[mine], j[mine]
            np.add.at(links, i, times[j])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if forest.join(p, q):
                    edges.append((p, q))
    e = ids[np.asarray(edges, np.int64).reshape(-1, 2)]
    found = np.flatnonzero(links)
    return pa.table({"kind": np.concatenate([np.zeros(len(found), np.int32), np.ones(len(e), np.int32)]), "a": np.concatenate([ids[found], e[:, 0]]), "b": np.concatenate([links[found], e[:, 1]])})


def _within(turned: np.ndarray, i: np.ndarray, j: np.ndarray, a: int, b: int, budget: float) -> np.ndarray:
    """Whether pairs keep to a block's budget, by one rule for both directions of a pair."""
    apart = turned[i, a:b].astype(np.float64) - turned[j, a:b]
    return (apart * apart).sum(1) <= budget


def join_blocks(vectors: DataFrame, threshold: float) -> DataFrame:
    """The same for all rare widths at once (width, vec_id, times, vec): each width in blocks, pair by pair of them."""
    sizes = vectors.groupBy("width").agg(F.ceil(F.count("*") / (CELL_ROWS // 4)).alias("n"))
    out = vectors.join(sizes, "width").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = out.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def search(t: pa.Table) -> pa.Table:
        ids, times, own = (t.column(c).to_numpy() for c in ("vec_id", "times", "own"))
        raw = scaled(matrix(t.column("vec"), t.column("width")[0].as_py()))
        norm = np.sqrt((raw * raw).sum(1))
        unit = raw / norm[:, None]
        apart = t.column("x")[0].as_py() != t.column("y")[0].as_py()

        def near(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.divmod(np.flatnonzero(unit[h] @ unit.T >= threshold - _ROUNDING), len(ids))
            return h[i], j

        return _links(ids, times, raw, norm, np.arange(len(ids)), len(ids), near, lambda i, j: own[i] != own[j] if apart else np.ones(len(i), bool), threshold)

    return out.select("width", "x", "y", "own", "vec_id", "times", "vec").groupBy("width", "x", "y").applyInArrow(search, FOUND)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: cosine >= threshold in double precision links.

    Null and zero vectors, and such with null or non-finite components, link with nothing; so do
    vectors of different widths. Very large and very small vectors are brought to scale first. Equal vectors
    and repeated rows link with each other and each count; different vectors of one id are one node, whose
    links count together. Rows with a null id link with nothing and are kept. An empty table gives no rows; other columns,
    labels too, are ignored.
    """
    rows = written(packed(embeddings).withColumn("name", F.xxhash64("width", "vec")), "vectors")
    valid = F.col("vec").isNotNull() & F.col("norm") & F.col("vec_id").isNotNull()
    classes = written(rows.where(valid).groupBy("width", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "distinct")
    total = classes.count()
    main = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") >= max(1.0, total * WIDE_SHARE)).collect()}  # at most 16
    found = rows.sparkSession.createDataFrame([], FOUND)
    for width, n in sorted(main.items()):
        found = found.unionByName(join_width(classes.where(F.col("width") == width), width, n, threshold))
    if sum(main.values()) < total:
        found = found.unionByName(join_blocks(classes.where(~F.col("width").isin(list(main))), threshold))
    found = written(found, "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    labels = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    reps = classes.withColumnRenamed("vec_id", "rep").join(counts, "rep", "left").join(labels, "rep", "left")
    reps = reps.select(F.xxhash64("width", "vec").alias("name"), F.col("width").alias("_width"), F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    own = spread_join(rows.where(valid), reps, "name").where((F.col("width") == F.col("_width")) & (F.col("vec") == F.col("_vec")))
    rest = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(rest)
    return out.withColumn("component_id", F.coalesce("component_id", "vec_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
