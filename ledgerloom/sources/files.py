"""Tables, scans with a list of conditions, and the CSV sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in spark.checkpoint.dir, which goes when the session ends.

    Only a local session without such a setting gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written to a table in scratch and read again, so that plans of many rounds do not grow; survives lost executors."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 10_000) -> Callable[[DataFrame], DataFrame]:
    """What a join does with a table made from df: it is broadcast if df has `rows` rows at most, else left as it is.

    A shuffle by few keys would gather all rows of a key in one task, and Spark does not know the size of every table.
    """
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda x: x


def condition(field: str, operator: str, value: object) -> Column:
    """One of =, !=, in, not in, >, <, like (contained, case aside); a null field satisfies != and not in."""
    c = F.col(field)
    made = {
        "=": lambda: c.eqNullSafe(F.lit(value)),
        "!=": lambda: ~c.eqNullSafe(F.lit(value)),
        "in": lambda: F.coalesce(c.isin(list(value)), F.lit(False)),
        "not in": lambda: ~F.coalesce(c.isin(list(value)), F.lit(False)),
        ">": lambda: c > F.lit(value),
        "<": lambda: c < F.lit(value),
        "like": lambda: F.lower(c).contains(str(value).lower()),
    }
    return made[operator]()


def scan(df: DataFrame, domain: Sequence[tuple[str, str, object]], fields: Sequence[str], order: Sequence[str | Column] = (), limit: int | None = None) -> DataFrame:
    """The fields of the rows that satisfy all conditions; filters and pruning reach the files.

    With a limit the first rows in order, which must leave no ties.
    """
    where = reduce(and_, [condition(*d) for d in domain], F.lit(True))
    found = df.where(where)
    if order:
        found = found.orderBy(*order)
    return (found if limit is None else found.limit(limit)).select(*fields)


def point(df: DataFrame, keys: dict[str, object], order: Sequence[str | Column]) -> DataFrame:
    """The one row with the given values of some columns, the first in order; no row without one. A value of None is no condition."""
    given = [(k, "=", v) for k, v in keys.items() if v is not None]
    return scan(df, given, df.columns, order, 1)


def named_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, case aside."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def slot_columns(slots: DataFrame, key: Sequence[str], used: Sequence[int], naming: Callable[[int, bool], str]) -> DataFrame:
    """key and two columns, label and amount, for each used slot (slots: key, slot, label, amount), by number."""
    columns = []
    for n in sorted(used):
        for what, amount in (("label", False), ("amount", True)):
            columns.append(F.first(F.when(F.col("slot") == n, F.col(what)), ignorenulls=True).alias(naming(n, amount)))
    return slots.groupBy(*key).agg(*columns)


def write_csv(df: DataFrame, path: str, names: dict[str, str] | None = None, mark: bool = False) -> None:
    """CSV files with a header, quotes doubled, blanks kept, columns renamed; with mark each file begins with a byte order mark."""
    named = df.withColumnsRenamed(names or {})
    if mark and named.columns:
        named = named.withColumnRenamed(named.columns[0], "\ufeff" + named.columns[0])
    named.write.option("header", True).option("escape", '"').option("lineSep", "\r\n").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote, by the columns' places; texts may hold line breaks, and empty ones are not null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\u0000").csv(path)
