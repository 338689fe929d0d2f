"""Dense, sparse and hybrid retrieval (KNN1-3, FTS1-3, RRF1-2, HYB1): one lazy plan, top-k by top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the ranking functions.
RRF_K, BM25_K1, BM25_B, LEAST_IDF, TERM_CHARS = 60, 1.2, 0.75, 1e-6, 3
CANDIDATES_PER_RESULT, LEAST_CANDIDATES, SCOPED_PER_RESULT, LEAST_SCOPED = 4, 20, 50, 2000


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine in double precision; the query is a literal of the plan."""
    norm = math.sqrt(sum(x * x for x in query))
    literal = F.array(*[F.lit(float(x)) for x in query])
    add = lambda x, y: x + y
    dot = F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), add)
    length = F.sqrt(F.aggregate(F.transform(vector, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add))
    return 1 - dot / (length * F.lit(norm))


def dense(vectors: DataFrame, chunks: DataFrame, query: Sequence[float], limit: int, project: str | None = None, exact_scope: bool = False, width: int | None = None) -> DataFrame:
    """(chunk_id, distance): nearest chunks. With a project, the nearest of all are cut to a wide limit,
    then filtered (so that a project may come short); ``exact_scope`` filters first."""
    if width is not None and len(query) != width:
        raise ValueError(f"query has {len(query)} dimensions, not {width}")
    scored = vectors.select("chunk_id", cosine_distance(F.col("embedding"), query).alias("distance"))
    nearest = lambda df, k: df.orderBy("distance", "chunk_id").limit(k)
    known = chunks.select("chunk_id", "project_path")
    if project is None:
        return nearest(scored, limit).join(known, "chunk_id").select("chunk_id", "distance")
    own = known.where(F.col("project_path") == project)
    if exact_scope:
        return nearest(scored.join(own, "chunk_id").select("chunk_id", "distance"), limit)
    wide = max(limit, min(own.count(), max(SCOPED_PER_RESULT * limit, LEAST_SCOPED)))
    return nearest(nearest(scored, wide).join(own, "chunk_id").select("chunk_id", "distance"), limit)


#: Vectors and queries that one task of a batch takes.
BATCH_VECTORS, BATCH_QUERIES = 32_768, 2048


def dense_batch(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, distance): for each query (vec_id, e) the nearest other vectors (vec_id, e), by exact
    cosine. Vectors and queries meet in blocks; in each a matrix product leaves few pairs, whose distances
    are then summed up in order, so that equal vectors tie."""
    blocks = [max(1, -(-df.count() // most)) for df, most in ((vectors, BATCH_VECTORS), (queries, BATCH_QUERIES))]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = vectors.select("vec_id", "e", own(blocks[0]).alias("a"), every(blocks[1]).alias("b"))
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), own(blocks[1]).alias("qb"), every(blocks[0]).alias("qa"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, y = (np.array(t.column(c).to_pylist(), float) for t, c in ((left, "e"), (right, "q")))
            ids, names = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            summed = lambda a, b: np.cumsum(a * b, axis=1)[:, -1]
            xx, yy = summed(x, x), summed(y, y)
            for k in range(0, len(y), 256):
                rough = 1 - (y[k : k + 256] @ x.T) / np.sqrt(yy[k : k + 256, None] * xx)
                rough[names[k : k + 256, None] == ids] = np.inf
                for j, row in enumerate(rough, k):
                    bound = np.partition(row, min(limit, len(row)) - 1)[min(limit, len(row)) - 1] if len(row) > limit else np.inf
                    at = np.flatnonzero((row <= bound + 1e-9) & (row < np.inf))
                    apart = 1 - summed(x[at], y[j : j + 1]) / np.sqrt(xx[at] * yy[j])
                    best = np.lexsort((ids[at], apart))[:limit]
                    out += [(int(names[j]), int(i), float(d)) for i, d in zip(ids[at[best]], apart[best], strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "distance"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    pairs = left.groupBy("a", "b").cogroup(right.groupBy("qa", "qb")).applyInArrow(tile, "query_id long, vec_id long, distance double")
    place = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= limit).drop("_rank")


def query_terms(query: str) -> list[str]:
    """FTS2: terms shorter than a trigram find nothing and are left out."""
    return [t for t in query.lower().split() if len(t) >= TERM_CHARS]


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, overlaps counted."""
    return F.regexp_count(text, F.lit("(?=" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term) + ")"))


class CorpusStats(NamedTuple):
    """Rows and mean trigrams a row; kept with a snapshot, as they don't depend on the query."""

    rows: int
    mean: float


def corpus_stats(texts: DataFrame) -> CorpusStats:
    r = texts.agg(F.count("*").alias("n"), F.sum(F.greatest(F.length("text") - 2, F.lit(0))).alias("d")).first()
    return CorpusStats(r["n"], (r["d"] or 0) / r["n"] if r["n"] else 0.0)


def sparse(texts: DataFrame, query: str, limit: int, project: str | None = None) -> DataFrame:
    """(chunk_id, bm25): rows of (chunk_id, project_path, text) that hold all terms as substrings, lowest
    score first. Statistics are those of all rows, whatever the project."""
    terms = query_terms(query)
    if not terms or limit <= 0:
        return texts.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    lowered = texts.select("chunk_id", "project_path", F.lower("text").alias("t"), F.greatest(F.length("text") - 2, F.lit(0)).alias("size"))
    held = [F.contains(F.col("t"), F.lit(term)) for term in terms]
    stats = lowered.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(h).alias(f"n{k}") for k, h in enumerate(held)])
    hits = lowered.where(_all(held))
    if project is not None:
        hits = hits.where(F.col("project_path") == project)
    score = F.lit(0.0)
    for k, term in enumerate(terms):
        own = F.col(f"n{k}")
        raw = F.ln((F.col("n") - own + 0.5) / (own + 0.5))
        idf = F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)
        f = occurrences(F.col("t"), term)
        score = score + idf * (f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / F.col("mean"))))
    return hits.crossJoin(F.broadcast(stats)).select("chunk_id", (-score).alias("bm25")).orderBy("bm25", "chunk_id").limit(limit)  # one row of statistics


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def ranked(candidates: DataFrame, order: str, name: str) -> DataFrame:
    """WIN1: 1-based ranks of a bounded list of candidates."""
    return candidates.withColumn(name, F.row_number().over(W.orderBy(order, "chunk_id")))


def fuse(dense_ranks: DataFrame, sparse_ranks: DataFrame, limit: int) -> DataFrame:
    """RRF1, JON3: full outer join of two ranked lists; ties go to the better rank, then the smaller id."""
    both = dense_ranks.join(sparse_ranks, "chunk_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("dense_rank") + part("sparse_rank")).withColumn("best_rank", F.least("dense_rank", "sparse_rank"))
    return scored.orderBy(F.desc("score"), "best_rank", "chunk_id").limit(limit)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], limit: int, project: str | None = None, exact_scope: bool = False) -> DataFrame:
    """HYB1 over chunks (chunk_id, project_path, text, ...) and vectors (chunk_id, embedding): the chunks'
    columns with score, best_rank, ranks, distance and bm25."""
    wide = max(CANDIDATES_PER_RESULT * limit, LEAST_CANDIDATES)
    near = ranked(dense(vectors, chunks, vector, wide, project, exact_scope), "distance", "dense_rank")
    said = ranked(sparse(chunks, query, wide, project), "bm25", "sparse_rank")
    return chunks.join(F.broadcast(fuse(near, said, limit)), "chunk_id")  # `limit` rows
