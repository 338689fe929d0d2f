"""Hook events as a stream (STR1-STR3): each names a transcript that has grown; a batch indexes them.

File sources never read a grown file again, so the stream is of events and not of transcripts. State is
in the catalog's snapshots. Batches of one query run one after another, and a batch takes a transcript
once, however many events name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.plans.engine import Engine

PAYLOAD = "transcript_path string"


def hook_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON files; what isn't JSON or names no file is left out."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.from_json("value", PAYLOAD).alias("e")).select("e.*").where("length(transcript_path) > 0")


def index_events(engine: Engine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Indexes the transcripts that events name. A failure of one transcript leaves the others alone."""

    def batch(events: DataFrame, _: int) -> None:
        paths = [r["transcript_path"] for r in events.distinct().collect()]  # one for each session in a batch
        if paths:
            engine.index(paths=paths)

    writer = hook_events(engine.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
