"""What an indexing run changes (JON6-JON9, SET1-SET2, FLT7, SNK2-SNK9), as joins of old and new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRESHNESS = ["session_id", "sha256", "mtime", "index_sig"]


def out_of_date(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files of which no session has all four marks; a session without a signature never has."""
    return files.join(sessions.select(*FRESHNESS), FRESHNESS, "left_anti")


def conflicting(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id) of files whose bytes and time another session has: stored, or earlier in this run."""
    from pyspark.sql import Window as W

    order = W.partitionBy("sha256", "mtime").orderBy(F.desc("transcript_path"))
    later = files.withColumn("_nth", F.row_number().over(order)).where("_nth > 1").select("session_id")
    old = sessions.select("sha256", "mtime", F.col("session_id").alias("_other"))
    stored = files.join(old, ["sha256", "mtime"]).where("session_id <> _other").select("session_id")
    return later.unionByName(stored).distinct()


def fresh(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks whose uid isn't stored, one of each."""
    return new.dropDuplicates(["chunk_uid"]).join(old.select("chunk_uid"), "chunk_uid", "left_anti")


def kept(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("chunk_uid"), "chunk_uid", "left_semi")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("chunk_uid"), "chunk_uid", "left_anti")


def without(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """SNK8, JON9: rows of other sessions."""
    return df.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """SNK10."""
    return df.withColumn("project_path", F.when(F.col("project_path") == old, F.lit(new)).otherwise(F.col("project_path")))
