"""What several operators share: reading tables, the shared folder, salted ranks, batches of Arrow."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only in local mode, where driver and
    executors are one process, a session that names none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_WRITTEN: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    """At the end of the driver, written tables go; lazily read results need them until then."""
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: the cluster's own cleaning takes the folder
            return


atexit.register(_remove_all)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` into the shared folder and reads it again, so that a lost
    executor costs a read and nothing is computed twice. The write's own shuffle files go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    schema, before = df.schema, spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path and (df.sparkSession, path) in _WRITTEN:
            _WRITTEN.remove((df.sparkSession, path))
            _remove(df.sparkSession, path)


class WordCache(dict):
    """A dictionary of at most ``most`` bytes, keys and values counted with what the dictionary itself
    takes. When it is full it starts anew: what is frequent comes back at once."""

    most = 32 << 20

    def __init__(self) -> None:
        super().__init__()
        self.bytes = 0

    def keep(self, key: Any, value: Any) -> Any:
        self.bytes += sys.getsizeof(key) + _deep(value) + 104  # entry and index of a table that is half full
        if self.bytes > self.most:
            self.clear()
            self.bytes = 0
        else:
            self[key] = value
        return value


def _deep(value: Any) -> int:
    return sys.getsizeof(value) + (sum(map(sys.getsizeof, value)) if isinstance(value, tuple) else 0)


_STATE: dict[str, Any] = {}


def worker_state(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: of one operator at a time. When a task of another
    operator comes to the worker, the former one's memory goes back to the system first."""
    if _STATE.get("name") != name or _STATE.get("key") != key:
        fresh_worker()
        _STATE.update(name=name, key=key, value=make())
    return _STATE["value"]


def fresh_worker() -> None:
    """Drops what the worker keeps, and hands free memory back."""
    _STATE.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


#: A key that this share of a table's rows has is hot; there are at most as many of them as its inverse.
HOT_SHARE, HOT_SALTS = 1 / 1000, 64


def spread_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with ``other`` on a column of longs by which ``other`` has few rows a key. Keys that more than
    ``HOT_SHARE`` of ``rows`` have (at most 1000 keys) are dealt to ``HOT_SALTS`` tasks; ``other`` is repeated
    for these keys only. Null keys match nothing. ``rows`` is read twice."""
    many = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    count = rows.count()
    hot = [r["_hot"] for r in many.where(F.col("_n") > max(16, count * HOT_SHARE)).select("_hot").collect()]
    if not hot:
        return rows.join(other, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS))).otherwise(F.lit(0).cast("long")))
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(HOT_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = other.withColumn("_salt", F.explode(salts))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def batches(it: Iterator[pa.RecordBatch], rows: int, sized: int | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches: bounds what one step of a Python operator holds. With ``sized``, the number of a column
    of binaries, a batch also ends before it has over ``most`` bytes there, but for a single longer row."""
    for b in it:
        if sized is None:
            for k in range(0, b.num_rows, rows):
                yield b.slice(k, rows)
            continue
        first, held = 0, 0
        for k, n in enumerate(pc.binary_length(b.column(sized)).to_pylist()):
            if k > first and (k - first >= rows or held + (n or 0) > most):
                yield b.slice(first, k - first)
                first, held = k, 0
            held += n or 0
        if first < b.num_rows:
            yield b.slice(first)


def crc_fold(column: Column) -> Column:
    """The remainder by 5 of the CRC-32 of an id as text, which decides the held-out fold."""
    return F.crc32(column.cast("string").cast("binary")) % 5


#: Bits of the map by which rows are left out before they are shuffled: 4 MB, a fixed size.
MARKS = 1 << 25


def mark(key: Column) -> Column:
    """The bit of a key in a bitmap."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(MARKS)), F.lit(0)).cast("int")


def marked(df: DataFrame, key: str) -> np.ndarray:
    """A bitmap of ``MARKS`` bits, however many the rows, with the bits of their keys. It may cover too
    much, never too little: the join that follows stays exact."""
    bits = df.select(mark(F.col(key)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word"))
    out = np.zeros(MARKS // 64, np.uint64)
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def rows_marked(bits: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Numbers of the rows whose bit is set."""
    bit = bits.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.flatnonzero(marks[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
