"""Operators for which the order of rows is data. Every order is a list of columns that leaves no ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.files import cut

#: Rows of a range of a chained fill, of which a task holds a few.
RANGE = 100_000


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos", start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: first wins. For last wins, turn the order round."""
    return numbered(df, keys, order, "__n").where("__n = 0").drop("__n")


def filled(c: str) -> Column:
    """The column, null where it has nothing but white space."""
    return F.when(normalize(F.col(c)) != "", F.col(c))


def fill_from_previous(df: DataFrame, columns: list[str], group: str, number: str, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Blanks take the value of the row before, as it is when that one has been filled, if both belong together.

    They do if they have the same group, or if this row has no document number and the one before has one by then;
    as numbers are handed down (number should be one of the columns), that is so once any row before has one. Each
    group of keys is one window; fill_chained has no such bound.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    named = F.coalesce(F.max(filled(number).isNotNull()).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    joined = F.coalesce(F.lag(group).over(by) == F.col(group), F.lit(False)) | (filled(number).isNull() & named)
    runs = df.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(by))
    inside = Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumns({c: F.coalesce(F.last(filled(c), ignorenulls=True).over(inside), F.lit("")) for c in columns}).drop("__new", "__run")


def fill_chained(df: DataFrame, columns: list[str], group: str, number: str, keys: list[str], order: list[Column | str], ranges: int | None = None) -> DataFrame:
    """fill_from_previous for processes of any length: a parallel scan over ranges of rows.

    Rows are dealt to ranges by keys and order, so that a long process lies in many. A range is summed up by its last
    group and whether it has a number; with what lies before, each row knows whether it begins a run. The ranges are summed
    up again, by whether a run begins in them and what is filled at their end; put together in order, these give what
    every range starts with. Order columns must be columns of df. Without a number given, ranges have RANGE rows or fewer.
    """
    n = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))
    at = [*keys, "__range"]
    rows = cut(df.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))
    by = Window.partitionBy(*at).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*_names(order))
    ends = rows.groupBy(*at).agg(F.max_by(F.col(group), place).alias("__last"), F.max(filled(number).isNotNull()).alias("__any"))
    ends = cut(ends.select(*at, F.lag("__last").over(before).alias("__group"), F.coalesce(F.max("__any").over(earlier), F.lit(False)).alias("__named")))
    told = rows.repartition(n, *at).join(ends, at)  # as many parts as ranges, which Spark does not join to larger ones
    first = F.row_number().over(by) == 1
    previous = F.when(first, F.col("__group")).otherwise(F.lag(group).over(by))
    named = F.col("__named") | F.coalesce(F.max(filled(number).isNotNull()).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    joined = F.coalesce(previous == F.col(group), F.lit(False)) | (filled(number).isNull() & named)
    told = told.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(by)).drop("__group", "__named", "__new")
    inside = Window.partitionBy(*at, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = cut(told.withColumns({f"__{i}": F.last(filled(c), ignorenulls=True).over(inside) for i, c in enumerate(columns)}))
    state = F.max_by(F.struct((F.col("__run") > 0).alias("__begins"), *[f"__{i}" for i in range(len(columns))]), place)
    closing = told.groupBy(*at).agg(state.alias("__state")).select(*at, "__state.*")
    closing = closing.withColumn("__part", F.sum(F.col("__begins").cast("int")).over(before))
    chain = Window.partitionBy(*keys, "__part").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    state = closing.select(*at, *[F.last(f"__{i}", ignorenulls=True).over(chain).alias(f"__s{i}") for i in range(len(columns))])
    carry = cut(state.select(*at, *[F.lag(f"__s{i}").over(before).alias(f"__c{i}") for i in range(len(columns))]))
    out = told.join(carry, at, "left")
    values = {c: F.coalesce(F.col(f"__{i}"), F.when(F.col("__run") == 0, F.col(f"__c{i}")), F.lit("")) for i, c in enumerate(columns)}
    return out.withColumns(values).select(*df.columns)


def _names(order: list[Column | str]) -> list[str]:
    if not all(isinstance(c, str) for c in order):
        raise TypeError("the order of a chained fill is a list of column names")
    return list(order)


def fill_from_first(df: DataFrame, columns: list[str], keys: list[str], order: list[Column | str]) -> DataFrame:
    """Blanks take the value of the group's first row."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(filled(c), F.first(c).over(by), F.lit("")) for c in columns})


def spread_first_filled(df: DataFrame, columns: list[str], keys: list[str], order: list[Column | str]) -> DataFrame:
    """All rows take the group's first value that is not blank."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.first(filled(c), ignorenulls=True).over(by), F.lit("")) for c in columns})


def islands(df: DataFrame, value: str, keys: list[str], order: list[Column | str], name: str = "island") -> DataFrame:
    """Numbers the runs of rows with the same value, from 1."""
    by = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    return df.withColumn("__new", changed).withColumn(name, F.sum("__new").over(by)).drop("__new")


def runs_by_number(df: DataFrame, number: str, keys: list[str], order: list[Column | str], name: str = "run") -> DataFrame:
    """Numbers the runs of rows that begin where a document number is filled, from 1; rows before the first are run 1."""
    by = Window.partitionBy(*keys).orderBy(*order)
    begins = F.when((F.row_number().over(by) == 1) | filled(number).isNotNull(), 1).otherwise(0)
    return df.withColumn("__new", begins).withColumn(name, F.sum("__new").over(by)).drop("__new")


def invoice_key(index: Column, number: Column, pos: Column) -> Column:
    """What groups a row: its invoice's index, else its document number, else its own place."""
    n = F.when(normalize(number) != "", normalize(number))
    return F.coalesce(F.concat(F.lit("idx:"), index.cast("string")), F.concat(F.lit("doc:"), n), F.concat(F.lit("row:"), pos.cast("string")))


def one_to_one(df: DataFrame, target: str, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The second and later rows of a group that take the same target lose it."""
    by = Window.partitionBy(*keys, target).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).withColumn(target, F.when(F.col("__n") == 1, F.col(target))).drop("__n")
