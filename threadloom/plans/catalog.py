"""Tables in snapshots (SNK1-SNK15): immutable Parquet folders by bucket of the session, and a numbered
manifest for each snapshot; the highest one is current. A change writes the buckets it touches and then
moves its manifest to the next number, which fails if another change has taken it: nothing is lost, and a
failure before the move is a rollback. Readers of an older snapshot are not disturbed until it is older
than the last few; then it goes. Folders are reached through Spark's file systems only."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.schemas import TABLES

BUCKETS = 64
#: Snapshots that stay readable.
KEPT = 5


class ConflictError(RuntimeError):
    """Another change was published since this one read its snapshot; it may be tried again."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only in local mode is one made where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="threadloom-")


class Catalog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._staging = f"staging-{uuid.uuid4().hex[:10]}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        if not self._fs.exists(self._path("")):
            self._fs.mkdirs(self._path(""), self._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _text(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.setPermission(self._path(name), self._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))

    def _numbers(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(""))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self) -> dict:
        """Paths of each table's buckets, and the next ids."""
        numbers = self._numbers()
        if numbers:
            return json.loads(self._text(f"v{numbers[-1]}.json"))
        return {"tables": {t: {} for t in TABLES}, "next": {"turns": 1, "chunks": 1}, "version": 0}

    def read(self, table: str, manifest: dict | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of a snapshot, all of it or some buckets; columns that older files lack are null."""
        paths = (manifest or self.manifest())["tables"][table]
        wanted = [f"{self.root}/{p}" for k, p in paths.items() if buckets is None or int(k) in set(buckets)]
        return self.spark.read.schema(TABLES[table]).parquet(*wanted) if wanted else self.spark.createDataFrame([], TABLES[table])

    def bucket(self):  # noqa: ANN201
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int")

    def touched(self, sessions: DataFrame) -> list[int]:
        return sorted(r["b"] for r in sessions.select(self.bucket().alias("b")).distinct().collect())  # at most `buckets` rows

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """A result of a step, written so that it is computed once."""
        at = f"{self.root}/{self._staging}/{name}-{uuid.uuid4().hex[:10]}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def numbered(self, df: DataFrame, name: str, column: str, start: int, *order) -> tuple[DataFrame, int]:  # noqa: ANN002
        """Consecutive ids in a total order, without bringing rows together: a range sort, the counts of
        its partitions, and each row's place in its own."""
        placed = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
        staged = self.stage(placed, name)
        counts = staged.groupBy("_part").count().orderBy("_part").collect()  # one row for each partition
        offsets, total = [], start
        for r in counts:
            offsets += [F.lit(r["_part"]), F.lit(total)]
            total += r["count"]
        base = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(start)
        return staged.withColumn(column, (base + F.col("_place")).cast("bigint")).drop("_part", "_place"), total

    def commit(self, tables: dict[str, DataFrame], touched: Iterable[int], following: dict[str, int] | None = None, base: dict | None = None) -> None:
        """Publishes a snapshot in which the touched buckets of the given tables are replaced. ``base`` is the
        manifest that the tables were made from."""
        manifest = json.loads(json.dumps(base or self.manifest()))
        version = manifest["version"] + 1
        name = f"snapshot-{version}-{uuid.uuid4().hex[:8]}"
        for table, df in tables.items():
            at = f"{name}/{table}"
            shaped = df.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in TABLES[table].split(", ")])
            shaped.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{at}")
            there = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(self._path(at)) if s.isDirectory()}
            for b in map(str, touched):
                manifest["tables"][table].pop(b, None)
                if b in there:
                    manifest["tables"][table][b] = f"{at}/bucket={b}"
        manifest |= {"version": version, "next": manifest["next"] | (following or {})}
        self._put(f"{name}.json", json.dumps(manifest))
        self._publish(f"{name}.json", version)
        self._forget()

    def _publish(self, name: str, version: int) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        only_new = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        only_new[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(name), self._path(f"v{version}.json"), only_new)
        except (Py4JJavaError, PySparkException) as e:
            if version not in self._numbers():
                raise
            self._fs.delete(self._path(name), False)
            self._fs.delete(self._path(name.removesuffix(".json")), True)
            raise ConflictError(f"snapshot {version} was published by another change") from e

    def _forget(self) -> None:
        """Removes manifests before the last few, folders of as old snapshots that no kept manifest reads, and
        this catalog's staged results."""
        numbers = self._numbers()
        kept = numbers[-KEPT:]
        used = {p.split("/")[0] for n in kept for paths in json.loads(self._text(f"v{n}.json"))["tables"].values() for p in paths.values()}
        for x in self._fs.listStatus(self._path("")):
            name = x.getPath().getName()
            if name.startswith("snapshot-") and name not in used and int(name.split("-")[1]) < kept[0]:
                self._fs.delete(x.getPath(), True)
        for n in numbers[:-KEPT]:
            self._fs.delete(self._path(f"v{n}.json"), False)
        self._fs.delete(self._path(self._staging), True)

    def size(self) -> int:
        return int(self._fs.getContentSummary(self._path("")).getLength())
