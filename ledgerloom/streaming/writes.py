"""Saved state as a stream of edits: the last write of a key wins, however late or often its edits arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import first_per_key


def last_writes(edits: DataFrame, keys: list[str], time: str, tie: str, gone: Column) -> DataFrame:
    """keys, time, tie, gone and the other columns of each key's last edit, as streaming state of one row a key.

    The last edit is that of the greatest time, then tie; gone marks a deletion, which stays as state, so that an older
    edit that comes late does not bring the key back. An edit that comes again changes nothing.
    """
    rest = [c for c in edits.columns if c not in (*keys, time, tie)]
    last = F.max(F.struct(time, tie, gone.alias("gone"), *rest)).alias("last")
    return edits.groupBy(*keys).agg(last).select(*keys, "last.*")


def save(last: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the keys that each batch changed to a folder of that batch, which a repeated batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    made = last.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (made.trigger(availableNow=True) if once else made).start()


def current(spark: SparkSession, path: str, schema: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The rows that are there after all batches so far; schema: a table with the stream's columns, for a stream without batches."""
    try:
        log = spark.read.option("basePath", path).parquet(f"{path}/batch=*").select(*schema.columns)
    except AnalysisException:
        log = spark.createDataFrame([], schema.schema)
    return first_per_key(log, keys, [F.desc(time), F.desc(tie)]).where("not gone").drop("gone")
