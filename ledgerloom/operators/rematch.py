"""Candidate orders of invoices as a stored table, of which only the invoices that a command touches are made anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import cut

#: Folders of a candidate table; a command writes those that hold an invoice it touches.
BUCKETS = 64


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("invoice"), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str) -> None:
    df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of all invoices (invoice and what compute made)."""
    return spark.read.parquet(path).drop("bucket")


def start(invoices: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS) -> int:
    """Stores the candidates of all invoices; the number of invoices computed. compute: invoices -> their rows."""
    asked = cut(invoices.select("invoice").distinct())
    _write(_bucketed(compute(asked), buckets), path)
    return asked.count()


def rematch(touched: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS) -> int:
    """Replaces the candidates of the touched invoices alone; the number of invoices computed.

    The other rows of their folders are copied, folders without a touched invoice are not opened, and what is written
    depends on nothing that is replaced, so a command that failed can be given again.
    """
    asked = cut(_bucketed(touched.select("invoice").distinct(), buckets))
    n = asked.count()
    if not n:
        return 0
    numbers = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # `buckets` at most
    old = touched.sparkSession.read.parquet(path).where(F.col("bucket").isin(numbers))
    kept = old.join(asked.select("invoice"), "invoice", "left_anti")
    new = cut(_bucketed(compute(asked.select("invoice")), buckets))
    _write(cut(kept.select(*new.columns).unionByName(new)), path)
    # a folder whose every invoice lost its candidates gets no rows and so is not replaced: it becomes an empty one
    left = touched.sparkSession.read.parquet(path).join(asked.select("invoice"), "invoice", "left_semi").join(new.select("invoice"), "invoice", "left_anti")
    for r in left.select("bucket").distinct().collect():
        new.drop("bucket").where("false").write.mode("overwrite").parquet(f"{path}/bucket={r['bucket']}")
    return n
