"""Autosave as a stream: what is saved after each pause in a key's edits. An extension; the batch form is in operators.state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import quiet_sessions


def autosaves(edits: DataFrame, key: str, time: str, gap: str, late: str, value: str, tie: str) -> DataFrame:
    """The same rows as quiet_sessions, each once its session is closed by the watermark."""
    return quiet_sessions(edits.withWatermark(time, late), key, time, gap, value, tie)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
