"""Vectors as packed bytes, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame) -> DataFrame:
    """(vec_id, width, norm, vec): components as little-endian doubles.

    ``vec`` is null where the vector is null or holds null or non-finite components; ``norm`` tells whether
    it has a length, however small or large.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[bytes | None] = []
            norms = []
            lists = b.column(1)
            for k in range(b.num_rows):
                own = lists[k].values if lists[k].is_valid else None
                vec = None
                if own is not None and not own.null_count:
                    x = own.to_numpy(zero_copy_only=False).astype("<f8")
                    if np.isfinite(x).all():
                        vec = x.tobytes()
                out.append(vec)
                norms.append(vec is not None and bool(x.any()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0 if v is None else len(v) // 8 for v in out], pa.int32()), pa.array(norms, pa.bool_()), pa.array(out, pa.binary())], ["vec_id", "width", "norm", "vec"])

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, width int, norm boolean, vec binary")


def matrix(column: pa.ChunkedArray | pa.Array | list[bytes], width: int, dtype: str = "<f8") -> np.ndarray:
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), width)


def sample(vectors: DataFrame, size: int) -> list[bytes]:
    """The same rows in every run: those with the least hashes of their ids. Used to place cells and
    pivots only; every row is indexed."""
    return [r["vec"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(size).select("vec").collect()]
