"""Operator 5, quality by ordinal cumulative-link regression on graded ratings.

P(grade > k | text) = logistic(w . x - t_k) with one weight vector over hashed text features for all
grades and thresholds t_0 < t_1 < ... in order. From these follow the expected grade and the tail
probability of a grade good enough, by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WordCache, batches, crc_fold, worker_state

DIMS = 1 << 11
#: The labelled sample that is fitted at most.
SAMPLE = 4000
#: The longest word in bytes that is kept with its features.
CACHED_BYTES = 64
_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))

_RUNS = re.compile(rb"(.)\1{2,}", re.S)


class Features(WordCache):
    """Hashed features of texts: the shape of each word (case, digits, marks; a run of letters counts as
    two at most), its first letters, pairs of equal neighbours, and the share of distinct words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _RUNS.sub(rb"\1\1", word.translate(_CLASS))
        found = zlib.crc32(b"s" + shape) % (DIMS - 64), zlib.crc32(b"w" + word[:3].lower()) % (DIMS - 64)
        return self.keep(word, found) if len(word) <= CACHED_BYTES else found

    def of(self, text: bytes | None) -> np.ndarray:
        """Square roots of relative frequencies, then 64 places for lengths and repetition."""
        words = text.split() if text else []
        out = np.zeros(DIMS, np.float32)
        if words:
            index = np.fromiter((k for pair in map(self.__getitem__, words) for k in pair), np.int64, 2 * len(words))
            out[: DIMS - 64] = np.sqrt(np.bincount(index, minlength=DIMS - 64) / len(words))
            distinct = len(set(words)) / len(words)
            same = sum(map(bytes.__eq__, words, words[1:])) / len(words)
            expected = min(1.0, 0.9 * len(words) ** -0.08)
            out[DIMS - 1], out[DIMS - 2], out[DIMS - 3] = distinct, same, max(0.0, expected - distinct)
            out[DIMS - 20 + min(9, int(distinct * 10))] = 1
            out[DIMS - 40 + min(9, int(same * 20))] = 1
            out[DIMS - 60 + min(15, len(words).bit_length())] = 1
        else:
            out[DIMS - 60] = 1
        return out


class Model(NamedTuple):
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


def train(x: np.ndarray, grades: list[int], strength: float = 1e-4, rounds: int = 200) -> Model:
    """Maximum likelihood with a small ridge by Adam steps. Thresholds keep their order, as a first value
    and positive gaps. One grade alone gives a constant model; no rating at all gives grade 0."""
    levels = sorted(set(grades)) or [0]
    if len(levels) == 1:
        return Model(levels, np.zeros(x.shape[1] if x.ndim == 2 else DIMS, np.float32), np.empty(0))
    k = np.searchsorted(levels, grades)
    share = np.array([(k > j).mean() for j in range(len(levels) - 1)])
    start = -np.log(share / (1 - share))
    w = np.zeros(x.shape[1])
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    for step in range(1, rounds + 1):
        gaps = np.exp(free[1:])
        t = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        z = (x @ w.astype(x.dtype)).astype(np.float64)
        # likelihood of the interval between two thresholds
        upper = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))
        tail = np.hstack([np.ones((len(z), 1)), upper, np.zeros((len(z), 1))])
        rows = np.arange(len(z))
        p = np.maximum(tail[rows, k] - tail[rows, k + 1], 1e-9)
        slope = np.hstack([np.zeros((len(z), 1)), upper * (1 - upper), np.zeros((len(z), 1))])
        dz = -(slope[rows, k] - slope[rows, k + 1]) / p / len(z)
        dt = np.zeros(len(t))
        for j in range(len(t)):
            dt[j] = ((slope[:, j + 1] * (k == j + 1)) / p - (slope[:, j + 1] * (k == j)) / p).sum() / len(z)
        dfree = np.concatenate([[dt.sum()], [dt[j:].sum() * gaps[j - 1] for j in range(1, len(t))]])
        grad = np.concatenate([(dz.astype(x.dtype) @ x) + strength * w, dfree])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[: len(w)], free - move[len(w) :]
    return Model(levels, w.astype(np.float32), free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def grade(x: np.ndarray, model: Model, good: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of a grade of ``good`` at least."""
    z = x @ model.weights
    tails = 1 / (1 + np.exp(-np.clip(z[:, None] - model.thresholds, -30, 30)))
    expected = model.grades[0] + tails @ np.diff(model.grades) if len(model.thresholds) else np.full(len(x), float(model.grades[0]))
    at = int(np.searchsorted(model.grades, good))
    tail = np.ones(len(x)) if at == 0 else np.zeros(len(x)) if at >= len(model.grades) else tails[:, at - 1]
    return expected, tail


def fit(docs: DataFrame, ratings: DataFrame, rating: str = "quality") -> Model:
    """Fits on rated documents whose id isn't held out, at most ``SAMPLE``: the least hashes of their ids."""
    known = ratings.where(F.col(rating).isNotNull() & (crc_fold(F.col("doc_id")) != 0)).select("doc_id", F.col(rating).cast("int").alias("rating")).dropDuplicates(["doc_id"])
    chosen = [(r["doc_id"], r["rating"]) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, rating int")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    features = Features()
    return train(np.stack([features.of(r["text"]) for r in rows]) if rows else np.zeros((0, DIMS), np.float32), [r["rating"] for r in rows])


def select(docs: DataFrame, model: Model, good: int = 1, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept) per row, from whole texts.

    ``kept``: the probability of a grade of ``good`` or better is ``least`` at least. Null and empty texts
    are judged as texts without words; repeated rows give equal rows; an empty table gives none; other
    columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state("quality", DIMS, Features)
        for b in batches(it, 200):
            expected, tail = grade(np.stack([words.of(x.as_py()) for x in b.column(1)]), model, good)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(expected.astype(float)), pa.array(tail.astype(float)), pa.array(tail >= least)], ["doc_id", "held_out", "expected_grade", "tail_probability", "kept"])

    held = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail_probability double, kept boolean")
