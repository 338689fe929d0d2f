"""The engine's interface (API1-API15, DRV1-DRV2): index transcripts, search, and recall."""

from __future__ import annotations

import datetime
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.functions import text as T
from threadloom.functions.redact import redact, redact_all
from threadloom.operators import retrieval
from threadloom.operators.chunks import chunks_of
from threadloom.operators.embedding import embed, provider_of
from threadloom.operators.turns import failed_sessions, turns_of, window_around
from threadloom.plans import incremental
from threadloom.plans.catalog import Catalog
from threadloom.sources.transcripts import parse_lines, scan, transcript_lines

#: FLT12: (default, most) of numeric arguments.
SEARCH, CONTEXT, LIST = (10, 100), (3, 10), (20, 100)


class NotFoundError(LookupError):
    """No such session."""


class ArgumentError(ValueError):
    """An argument that can't be meant (API17): blank queries and negative numbers."""


def clamped(name: str, value: int, most: int) -> int:
    """FLT12: a number of at most ``most``."""
    if value < 0:
        raise ArgumentError(f"{name} must not be negative: {value}")
    return min(value, most)


class IndexStats(NamedTuple):
    indexed: int
    skipped: int
    failed: int
    failures: list[tuple[str, str]]


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, home: str | None = None, strict_reembed: bool = False) -> None:
        self.spark, self.config, self.home, self.strict_reembed = spark, config or Config(), home, strict_reembed
        self.catalog = Catalog(spark, self.config.db.path)
        self._provider = None

    def scan(self) -> DataFrame:
        return scan(self.spark, self.config.scanner.root).drop("content").orderBy(F.desc("mtime"), F.desc("transcript_path"))

    def index(self, force: bool = False, paths: list[str] | None = None) -> IndexStats:
        """One plan over all sessions; a failed one changes nothing that is stored of it."""
        catalog, manifest = self.catalog, self.catalog.manifest()
        files = scan(self.spark, self.config.scanner.root).withColumn("index_sig", F.lit(self.config.signature()))
        if paths is not None:
            files = files.where(F.col("transcript_path").isin(paths))
        sessions = catalog.read("sessions", manifest)
        due = catalog.stage(files if force else incremental.out_of_date(files, sessions), "due")
        total, wanted = files.count(), due.count()
        if not wanted:
            return IndexStats(0, total, 0, [])
        events = catalog.stage(parse_lines(transcript_lines(due)), "events")
        wrong = failed_sessions(events).select("session_id", F.concat(F.lit("invalid JSON at line "), "line").alias("reason"))
        double = incremental.conflicting(due, sessions).withColumn("reason", F.lit("another session has these bytes and this time"))
        failures = [(r["session_id"], r["reason"]) for r in wrong.unionByName(double).dropDuplicates(["session_id"]).orderBy("session_id").collect()]
        failed = self.spark.createDataFrame([(x,) for x, _ in failures], "session_id string")
        good = due.join(failed, "session_id", "left_anti")
        if len(failures) == wanted:
            return IndexStats(0, total - wanted, len(failures), failures)

        turns = turns_of(events.join(good.select("session_id"), "session_id", "left_semi"))
        order = good.select("session_id", F.col("mtime").alias("_mtime"), F.col("transcript_path").alias("_path"))
        made = catalog.stage(chunks_of(turns, good, self.config.embedding.model, self.config.chunking.max_chars, self.home), "chunks")
        touched = catalog.touched(good)
        old = catalog.read("chunks", manifest, touched)
        mine = old.join(good.select("session_id"), "session_id", "left_semi")
        reusable = mine.limit(0) if force else mine
        if self.strict_reembed:
            reusable = reusable.where((F.col("embedding_model") == self.config.embedding.model) & (F.size("embedding") == self.config.embedding.dimension))
        fresh = incremental.fresh(made, reusable).withColumn("embedding", embed(F.col("text_for_embedding"), self.config.embedding)).join(order, "session_id")
        by_scan = (F.desc("_mtime"), F.desc("_path"), "turn_index")
        fresh, next_chunk = catalog.numbered(fresh, "fresh", "chunk_id", manifest["next"]["chunks"], *by_scan, "part_index")
        stored = self._redacted_turns(turns).join(order, "session_id")
        stored, next_turn = catalog.numbered(stored, "turns", "turn_id", manifest["next"]["turns"], *by_scan)
        now = datetime.datetime.now(datetime.UTC).isoformat()
        columns = old.columns
        chunks = incremental.without(old, good).unionByName(incremental.kept(reusable, made)).unionByName(fresh.select(*columns))
        catalog.commit(
            {
                "sessions": incremental.without(catalog.read("sessions", manifest, touched), good).unionByName(good.withColumn("indexed_at", F.lit(now)).select(*sessions.columns)),
                "turns": incremental.without(catalog.read("turns", manifest, touched), good).unionByName(stored.drop("_mtime", "_path")),
                "chunks": chunks,
            },
            touched,
            {"chunks": next_chunk, "turns": next_turn},
            manifest,
        )
        return IndexStats(wanted - len(failures), total - wanted, len(failures), failures)

    def _redacted_turns(self, turns: DataFrame) -> DataFrame:
        return turns.withColumns({"user": redact(F.col("user"), self.home), "assistant": redact(F.col("assistant"), self.home), "tool_summary": redact_all(F.col("tool_summary"), self.home)})

    def parse(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Turns and chunks of one file, without storing anything."""
        files = scan(self.spark, path)
        events = parse_lines(transcript_lines(files))
        if bad := failed_sessions(events).first():
            raise ValueError(f"invalid JSON at line {bad['line']}")
        turns = turns_of(events)
        return turns, chunks_of(turns, files, self.config.embedding.model, self.config.chunking.max_chars, self.home)

    def embed_query(self, query: str) -> list[float]:
        self._provider = self._provider or provider_of(self.config.embedding)
        return [float(x) for x in self._provider.embed_texts([query])[0]]

    def search(self, query: str, limit: int = SEARCH[0], project: str | None = None, exact_scope: bool = False) -> DataFrame:
        if not query.strip():
            raise ArgumentError("query must not be blank")
        chunks = self.catalog.read("chunks")
        told = chunks.select("chunk_id", "project_path", F.col("text_for_embedding").alias("text"))
        found = retrieval.hybrid(told, chunks.select("chunk_id", "embedding"), query, self.embed_query(query), clamped("limit", limit, SEARCH[1]), project, exact_scope)
        hits = chunks.drop("embedding", "text_for_embedding").join(F.broadcast(found.drop("text", "project_path")), "chunk_id")
        return hits.orderBy(F.desc("score"), "best_rank", "chunk_id")

    def read_session(self, session_id: str) -> DataFrame:
        """All turns, redacted again. Without stored turns the file is read; without either it fails."""
        session = self.catalog.read("sessions").where(F.col("session_id") == session_id).first()
        if session is None:
            raise NotFoundError(session_id)
        turns = self.catalog.read("turns").where(F.col("session_id") == session_id).drop("turn_id")
        if turns.isEmpty():
            turns = self.parse(session["transcript_path"])[0]
        return self._redacted_turns(turns).orderBy("turn_index")

    def expand(self, session_id: str, line_start: int, context: int = CONTEXT[0]) -> DataFrame:
        return window_around(self.read_session(session_id), line_start, clamped("context", context, CONTEXT[1])).orderBy("turn_index")

    def list_sessions(self, project: str | None = None, limit: int = LIST[0]) -> DataFrame:
        sessions = self.catalog.read("sessions")
        own = sessions if project is None else sessions.where(F.col("project_path") == project)
        return own.orderBy(F.desc("indexed_at"), "session_id").limit(clamped("limit", limit, LIST[1]))

    def stats(self) -> dict[str, int]:
        return {"sessions": self.catalog.read("sessions").count(), "chunks": self.catalog.read("chunks").count(), "bytes": self.catalog.size()}

    def migrate_project(self, old: str, new: str) -> dict[str, int]:
        """Renames a project in sessions and chunks, and says how many rows had it."""
        manifest = self.catalog.manifest()
        tables = {t: self.catalog.read(t, manifest) for t in ("sessions", "chunks")}
        own = {t: df.where(F.col("project_path") == old) for t, df in tables.items()}
        counts = {t: df.count() for t, df in own.items()}
        if any(counts.values()):
            touched = self.catalog.touched(own["sessions"].select("session_id").union(own["chunks"].select("session_id")))
            self.catalog.commit({t: incremental.renamed(self.catalog.read(t, manifest, touched), old, new) for t in tables}, touched, base=manifest)
        return counts

    def reredact(self) -> tuple[int, int]:
        """Applies the present rules to what is stored; vectors stay. Gives changed turns and chunks."""
        manifest = self.catalog.manifest()
        turns, chunks = self.catalog.read("turns", manifest), self.catalog.read("chunks", manifest)
        new_turns = self._redacted_turns(turns)
        text = redact(F.col("text"), self.home)
        new_chunks = chunks.withColumns({"text": text, "title": redact(F.col("title"), self.home), "text_for_embedding": redact(F.col("text_for_embedding"), self.home)})
        differ = lambda a, b, key, names: a.alias("a").join(b.alias("b"), key).where(" or ".join(f"not (a.{n} <=> b.{n})" for n in names)).select("a.session_id")
        changed = [differ(turns, new_turns, "turn_id", ("user", "assistant", "tool_summary")), differ(chunks, new_chunks, "chunk_id", ("text", "title", "text_for_embedding"))]
        counts = tuple(x.count() for x in changed)
        if any(counts):
            touched = self.catalog.touched(changed[0].union(changed[1]))
            self.catalog.commit({"turns": self._redacted_turns(self.catalog.read("turns", manifest, touched)), "chunks": new_chunks.where(self.catalog.bucket().isin(touched))}, touched, base=manifest)
        return counts

    @staticmethod
    def as_json(df: DataFrame) -> str:
        """SNK13, for bounded results."""
        return json.dumps([json.loads(x) for x in df.toJSON().collect()], indent=2, ensure_ascii=False)
