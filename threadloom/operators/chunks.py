"""Turns to content-addressed chunks (CHK1-CHK5, TXT13-TXT17)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.redact import redact, redacted_title
from threadloom.sources.transcripts import _SPACES

_PARAGRAPH_GAP = re.compile(rf"\n(?:[{_SPACES}]*\n)+")


def _cut(text: str, limit: int) -> Iterator[str]:
    """CHK4, CHK5: pieces that end at a line end, else a blank, in the second half of the limit, else at it."""
    text = text.strip(_SPACES)
    while len(text) > limit:
        half = limit // 2
        at = next((k for mark in "\n " if (k := text.rfind(mark, 0, limit)) >= half and k >= 0), limit)
        yield text[:at]
        text = text[at:].strip(_SPACES)
    yield text


def split_text(text: str, limit: int) -> list[str]:
    """CHK2, CHK3: whole paragraphs as long as they fit together; a paragraph that doesn't is cut."""
    if len(text) <= limit:
        return [text]
    body = "\n".join(x.removesuffix("\r") for x in text.split("\n"))
    packed: list[str] = []
    for paragraph in _PARAGRAPH_GAP.split(body):
        if not paragraph.strip(_SPACES):
            continue
        paragraph = paragraph.strip("\n")
        if packed and len(packed[-1]) + 2 + len(paragraph) <= limit:
            packed[-1] += "\n\n" + paragraph
        else:
            packed.append(paragraph)
    return [piece for whole in packed for part in _cut(whole, limit) if (piece := part.strip(_SPACES))]


def split_column(c: Column, limit: int) -> Column:
    if limit <= 0:
        raise ValueError("max_chars must be positive")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit), na_action="ignore")

    return F.when(F.length(c) <= limit, F.array(c)).otherwise(split(F.when(F.length(c) > limit, c)))


def chunks_of(turns: DataFrame, sessions: DataFrame, model: str, limit: int, home: str | None = None) -> DataFrame:
    """Chunks of turns: redacted before they are split, cleaned after. Columns as in the catalog, but for
    ids and vectors. ``sessions`` gives (session_id, project_path)."""
    if limit <= 0:
        raise ValueError("max_chars must be positive")
    whole = redact(T.render_turn(F.col("user"), F.col("assistant"), F.col("tool_summary")), home)
    parts = turns.withColumn("_parts", split_column(whole, limit)).select("*", F.posexplode("_parts").alias("_part", "text"))
    made = parts.withColumn("text_for_embedding", T.clean_for_embedding(F.col("text"))).withColumn("content_hash", T.content_hash(F.col("text_for_embedding")))
    uid = F.concat_ws(":", "session_id", "line_start", F.col("turn_index") + 1, F.col("_part") + 1, "content_hash")
    return made.join(sessions.select("session_id", "project_path"), "session_id").select(
        uid.alias("chunk_uid"),
        "session_id",
        "project_path",
        redacted_title(F.col("user"), home).alias("title"),
        "text",
        "text_for_embedding",
        F.nullif("line_start", F.lit(0)).alias("line_start"),
        F.nullif("line_end", F.lit(0)).alias("line_end"),
        T.token_count(F.col("text_for_embedding")).alias("token_count"),
        T.normalize_timestamp(F.col("ts")).alias("created_at"),
        F.lit(model).alias("embedding_model"),
        "content_hash",
        "turn_index",
        F.col("_part").alias("part_index"),
    )
