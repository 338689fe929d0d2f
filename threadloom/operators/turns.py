"""Events to turns by running counts (PAR1, PAR2, WIN2, WIN4, AGG4, AGG5), and windows of turns (API2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import trim_ws


def turns_of(events: DataFrame) -> DataFrame:
    """(session_id, turn_index, user, assistant, tool_summary, line_start, line_end, ts) of valid events.

    A user text opens a turn. Tool results belong to the turn that was open before their event, answers
    to the one that is open; what comes before any turn is dropped.
    """
    by_line = W.partitionBy("session_id").orderBy("line")
    opens = ((F.col("kind") == "user") & (F.col("user_text") != "")).cast("bigint")
    numbered = events.where("valid and not skip").withColumn("_now", F.sum(opens).over(by_line)).withColumn("_before", F.coalesce(F.sum(opens).over(by_line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    none = F.lit(None).cast("string")
    part = lambda turn, user, said, tools, ts: F.struct(turn.alias("turn"), user.alias("user"), said.alias("said"), tools.alias("tools"), ts.alias("ts"))
    no_tools = F.array().cast("array<string>")
    started = F.when(opens == 1, part(F.col("_now"), F.col("user_text"), none, no_tools, F.col("ts")))
    results = F.when((F.col("kind") == "user") & (F.size("tools") > 0), part(F.col("_before"), none, none, F.col("tools"), none))
    answer = F.when(F.col("kind") == "assistant", part(F.col("_now"), none, F.nullif(F.col("assistant_text"), F.lit("")), F.col("tools"), none))
    parts = numbered.select("session_id", "line", F.explode(F.array_compact(F.array(started, results, answer))).alias("p")).select("session_id", "line", "p.*").where("turn > 0")
    in_order = F.array_sort(F.collect_list(F.struct("line", "said", "tools")))
    grouped = parts.groupBy("session_id", "turn").agg(
        F.max("user").alias("user"),
        in_order.alias("_parts"),
        F.min(F.when(F.col("user").isNotNull(), F.col("line"))).alias("line_start"),
        F.max("line").alias("line_end"),
        F.max("ts").alias("ts"),
    )
    said = F.filter(F.transform("_parts", lambda x: x["said"]), lambda x: x.isNotNull())
    return grouped.select(
        "session_id",
        (F.col("turn") - 1).alias("turn_index"),
        "user",
        trim_ws(F.array_join(said, "\n\n")).alias("assistant"),
        F.flatten(F.transform("_parts", lambda x: x["tools"])).alias("tool_summary"),
        "line_start",
        "line_end",
        "ts",
    )


def failed_sessions(events: DataFrame) -> DataFrame:
    """PAR9: sessions with a line that isn't JSON, and the first such line."""
    return events.where("not valid").groupBy("session_id").agg(F.min("line").alias("line"))


def window_around(turns: DataFrame, line_start: int, context: int) -> DataFrame:
    """API2, WIN3: of each session the first turn at or after a line (else the last), and its neighbours."""
    session = W.partitionBy("session_id")
    target = F.coalesce(F.min(F.when(F.col("line_start") >= line_start, F.col("turn_index"))).over(session), F.max("turn_index").over(session))
    return turns.withColumn("_target", target).where(F.abs(F.col("turn_index") - F.col("_target")) <= context).drop("_target")
