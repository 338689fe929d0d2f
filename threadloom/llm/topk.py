"""Operator 9, exact top-k search by inner product over a pivot-distance index.

A further coordinate sqrt(M - |x|^2) gives all vectors one length, so that the largest inner product
is the least distance. Rows are keyed by their nearest pivot and sorted by the distance from it. A
query first searches the cell of its own nearest pivot, which gives a floor for its k-th score. In
every other cell the triangle inequality bounds the score of a row by the two distances from the
pivot: only the annulus about the query's own distance that can reach the floor is computed, and
cells with an empty annulus aren't visited. Scores are exact integers: doubles hold them as long as square
lengths stay below 2 ** 52. Longer vectors, and vectors of rare widths, are outside of the index: queries meet
them in blocks, with rounded scores, their error bounds, and Python's integers for what the bounds leave open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from threadloom.llm.common import written
from threadloom.llm.vectors import matrix, packed, sample

PIVOTS, SAMPLE, CELL_ROWS = 64, 4096, 65_536
#: Queries that one task takes; rows that one task of the plain search takes.
QUERY_ROWS, BLOCK_ROWS = 2048, 8192
#: Widths that this share of all rows have get an index of their own: at most 16 widths.
WIDE_SHARE = 1 / 16
#: Square lengths below which all sums are whole numbers that doubles hold exactly.
EXACT = 2.0**52
LONG = 2**63 - 1
HIT = "query_id long, vec_id long, score long"


def pivots_of(drawn: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Means of a few rounds of k-means over the sample."""
    centres = drawn[np.linspace(0, len(drawn) - 1, min(count, len(drawn))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squares(drawn, centres).argmin(1)
        for k in range(len(centres)):
            if (nearest == k).any():
                centres[k] = drawn[nearest == k].mean(0)
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T)


def _ends(rows: np.ndarray, level: float) -> np.ndarray:
    """Rows with the further coordinate that gives them the square length ``level``."""
    x = rows.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, level - (x * x).sum(1)))[:, None]])


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` rows of
    other ids with the highest inner products of floor(scale * x); ties go to the smaller id.

    Vectors that are null or hold null or non-finite components take no part; rows of different widths
    aren't compared. Components may be as large as doubles are; a product beyond the range of a long counts
    as the largest or smallest long. Repeated candidates are separate rows; a repeated query row is asked once. With
    fewer candidates all are returned; an empty table gives no rows; other columns are ignored.
    """

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            level = []
            for v in b.column(2).to_pylist():
                with np.errstate(over="ignore"):
                    e = np.floor(np.frombuffer(v, "<f8") * scale)
                    level.append(float(e @ e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(level, pa.float64())], ["vec_id", "width", "vec", "level"])

    rows = packed(embeddings).where("vec is not null and vec_id is not null").select("vec_id", "width", "vec")
    rows = written(rows.mapInArrow(measure, "vec_id long, width int, vec binary, level double"), "vectors")
    small = F.col("level") < EXACT
    total = rows.count()
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(~small).alias("large"), F.max(F.when(small, F.col("level"))).alias("level"))
    main = {r["width"]: r for r in widths.where(F.col("n") >= max(1.0, total * WIDE_SHARE)).collect()}  # at most 16
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "width", "vec", "level").distinct()
    indexed = F.col("width").isin(list(main)) & small
    out = None
    for width, r in sorted(main.items()):
        if r["level"] is not None:
            own = (F.col("width") == width) & small
            found = _search(rows.where(own), asked.where(own), width, k, scale, r["level"])
            out = found if out is None else out.unionByName(found)
    if total > sum(r["n"] - r["large"] for r in main.values()):
        plain = _by_blocks(rows.where(~indexed), asked, k, scale).unionByName(_by_blocks(rows.where(indexed), asked.where(~indexed), k, scale))
        out = plain if out is None else out.unionByName(plain)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.withColumn("rank", F.row_number().over(_ranked())).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _ranked() -> WindowSpec:
    return W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def _whole(column: pa.ChunkedArray | pa.Array, width: int, scale: int) -> np.ndarray:
    return np.floor(matrix(column, width) * scale)


def _search(rows: DataFrame, queries: DataFrame, width: int, k: int, scale: int, level: float) -> DataFrame:
    """The best rows for each query (some more than ``k``) by the index. All square lengths are at most
    ``level`` and less than ``EXACT``."""
    drawn = _ends(np.floor(matrix(sample(rows, SAMPLE), width) * scale), level)
    pivots = pivots_of(drawn, PIVOTS)
    near_by = 2.0**-24 * np.sqrt((width + 1) * max(level, 1.0))  # rounding of distances
    slack = 2 + level * 2.0**-48  # and of bounds

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            apart = _squares(_ends(_whole(b.column(1), width, scale), level), pivots)
            nearest = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest.astype(np.int32)), pa.array(np.sqrt(apart[np.arange(len(apart)), nearest]))], ["vec_id", "vec", "pivot", "distance"])

    index = written(rows.select("vec_id", "vec").mapInArrow(keyed, "vec_id long, vec binary, pivot int, distance double"), "index")
    cells = {r["pivot"]: r for r in index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}
    total = sum(c["n"] for c in cells.values())
    most = min(CELL_ROWS, max(256, 2 * total // PIVOTS))
    parts = {p: -(-c["n"] // most) for p, c in cells.items()}  # a crowded cell is cut into equal parts
    cut = F.element_at(F.create_map(*[F.lit(x) for item in (parts or {0: 1}).items() for x in item]), F.col("pivot"))
    index = index.withColumn("cell", F.col("pivot").cast("long") * 1_000_000 + F.pmod(F.xxhash64("vec_id"), cut))

    def asked(first: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A query goes to the cells of its nearest pivot that has rows, or to all others whose bound reaches its floor."""
            for b in it:
                q = _whole(b.column(1), width, scale)
                apart = np.sqrt(_squares(np.hstack([q, np.zeros((len(q), 1))]), pivots))
                there = np.array(sorted(cells))
                home = there[apart[:, there].argmin(1)] if len(there) else np.zeros(len(q), int)
                floor = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                row, cell, far = [], [], []
                for p in there.tolist():
                    if first:
                        go = home == p
                    else:
                        gap = np.maximum(0, np.maximum(apart[:, p] - cells[p]["high"], cells[p]["low"] - apart[:, p]) - 2 * near_by)
                        go = (home != p) & (((q * q).sum(1) + level - gap * gap) / 2 + slack >= floor)
                    at = np.flatnonzero(go)
                    for part in range(parts[p]):
                        row.append(at)
                        cell.append(np.full(len(at), p * 1_000_000 + part))
                        far.append(apart[at, p])
                at = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in (0, 1, 2)), pa.array(np.concatenate(cell).astype(np.int64) if row else [], pa.int64()), pa.array(np.concatenate(far) if row else [], pa.float64())], ["query_id", "vec", "floor", "cell", "far"])

        return run

    def annuli(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        distance, ids = left.column("distance").to_numpy(), left.column("vec_id").to_numpy()
        order = np.lexsort((ids, distance))
        distance, ids, x = distance[order], ids[order], _whole(left.column("vec"), width, scale)[order]
        q, out = _whole(right.column("vec"), width, scale), []
        for name, y, far, floor in zip(right.column("query_id").to_pylist(), q, right.column("far").to_pylist(), right.column("floor").to_pylist(), strict=True):
            size = float(y @ y)
            best, done_low, done_high, reach = floor, 0, 0, None
            scores, where = np.empty(0, np.int64), np.empty(0, np.int64)
            at = int(np.searchsorted(distance, far))
            done_low = done_high = at
            ring = max(256, len(ids) // 16)
            while True:  # expand the annulus until the bound ends it
                room = size + level - 2 * (best - slack)
                if room < 0:
                    break
                reach = np.sqrt(room) + 2 * near_by
                low = max(int(np.searchsorted(distance, far - reach)), done_low - ring)
                high = min(int(np.searchsorted(distance, far + reach, side="right")), done_high + ring)
                if low >= done_low and high <= done_high:
                    break
                at = np.concatenate([np.arange(low, done_low), np.arange(done_high, high)])
                at = at[ids[at] != name]
                scores, where = np.concatenate([scores, (x[at] @ y).astype(np.int64)]), np.concatenate([where, ids[at]])
                done_low, done_high = min(low, done_low), max(high, done_high)
                if len(scores) > k:
                    keep = np.lexsort((where, -scores))[:k]
                    scores, where = scores[keep], where[keep]
                if len(scores) >= k:
                    best = max(best, float(scores.min()))
            keep = np.lexsort((where, -scores))[:k]
            out += [(name, v, s) for v, s in zip(where[keep].tolist(), scores[keep].tolist(), strict=True)]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

    def run(first: bool, asking: DataFrame) -> DataFrame:
        """Each cell with its queries, these in blocks; a cell's rows go to as many tasks as it has blocks."""
        sent = written(asking.mapInArrow(asked(first), "query_id long, vec binary, floor long, cell long, far double"), "sent")
        blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
        left = index.select("cell", "vec_id", "vec", "distance").join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = sent.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
        return left.drop("blocks").groupBy("cell", "block").cogroup(right.drop("blocks").groupBy("cell", "block")).applyInArrow(annuli, HIT)

    lowest = F.lit(-(2**62)).cast("long")
    near = written(run(True, queries.select("vec_id", "vec", lowest.alias("floor"))), "near")
    floors = near.withColumn("rank", F.row_number().over(_ranked())).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    asking = queries.join(floors, "vec_id", "left").select("vec_id", "vec", F.coalesce("score", lowest).alias("floor"))
    return near.unionByName(run(False, asking))


def integers(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of doubles of any size."""
    return [math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in row.tolist()]


def block_scores(x: np.ndarray, ids: np.ndarray, y: np.ndarray, name: int, k: int, scale: int) -> list[tuple[int, int]]:
    """The ``k`` best (vec_id, score) for one query among rows of any magnitude."""
    power, whole = [], []
    for v in (x, y):
        p = np.maximum(np.frexp(np.abs(v).max(initial=0.0, axis=-1))[1], 0)
        narrow = np.abs(v) < 2.0**53
        down = -p[..., None]
        whole.append(np.where(narrow, np.ldexp(np.floor(np.where(narrow, v, 0.0) * scale), down), np.ldexp(v, down) * scale))
        power.append(p)
    rough = whole[0] @ whole[1]
    error = (x.shape[1] + 4) * 2.0**-50 * np.sqrt((whole[0] ** 2).sum(1) * (whole[1] ** 2).sum()) + 2.0**-900
    up = np.minimum(power[0] + power[1], 1000)
    low, high = (np.clip(np.ldexp(v, up), -(2.0**63), 2.0**63) for v in (rough - error, rough + error))
    at = np.flatnonzero(ids != name)
    if len(at) > k:
        at = at[high[at] >= np.partition(low[at], len(at) - k)[len(at) - k]]
    q = integers(y, scale)
    exact = [(max(-LONG - 1, min(LONG, sum(map(mul, integers(x[j], scale), q)))), int(ids[j])) for j in at.tolist()]
    return [(i, s) for s, i in sorted(exact, key=lambda r: (-r[0], r[1]))[:k]]


def _by_blocks(rows: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """Queries against rows of their width, in blocks of both: exact for components of any size."""
    sizes = rows.groupBy("width").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("row_blocks"))
    sizes = sizes.join(queries.groupBy("width").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("query_blocks")), "width")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(sizes, "width").withColumn("a", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks"))).withColumn("b", every("query_blocks"))
    right = queries.join(sizes, "width").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks"))).withColumn("a", every("row_blocks"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            x, ids = matrix(left.column("vec"), width), left.column("vec_id").to_numpy()
            for name, y in zip(right.column("query_id").to_pylist(), matrix(right.column("query"), width), strict=True):
                out += [(name, i, s) for i, s in block_scores(x, ids, y, name, k, scale)]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

    left = left.select("width", "a", "b", "vec_id", "vec")
    right = right.select(*[F.col(c).alias(n) for c, n in (("width", "w"), ("a", "ra"), ("b", "rb"), ("vec_id", "query_id"), ("vec", "query"))])
    return left.groupBy("width", "a", "b").cogroup(right.groupBy("w", "ra", "rb")).applyInArrow(tile, HIT)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
       c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
QUALIFY rank <= 10
"""
