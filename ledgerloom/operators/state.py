"""Saved state: the last write of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import first_per_key


def latest(log: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return first_per_key(log, keys, [F.desc(time), F.desc(tie)])


def upsert(state: DataFrame, edits: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return latest(state.unionByName(edits), keys, time, tie)


def delete(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return state.join(keys.select(*on).distinct(), on, "left_anti")


def insert_absent(state: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    return state.unionByName(rows.join(state.select(*on).distinct(), on, "left_anti").select(*state.columns))


def quiet_sessions(edits: DataFrame, key: str, time: str, gap: str, value: str, tie: str) -> DataFrame:
    """key, saved_at, edits and value: what is saved after each pause of `gap` in a key's edits, the last state."""
    s = edits.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("edits"), F.max(F.struct(time, tie, value)).alias("last"))
    return s.select(key, F.col("w.end").alias("saved_at"), "edits", F.col(f"last.{value}").alias(value))
