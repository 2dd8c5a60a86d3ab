"""Invoices, suppliers and purchase orders derived from the test tables, which have none.

An order is an invoice, a lineitem row a line; rates follow l_tax, and header amounts are the lines' sums with a
deviation by order key. The SQL texts say the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..sources.files import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def lines(spark: SparkSession, d: str) -> DataFrame:
    """invoice, pos, qty, price, pct, vat, net and the line's part, supplier and flag."""
    t = numbered(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER)
    tax = F.col("l_tax").cast("decimal(4,2)")
    pct = F.when(tax == 0, "0").when(tax < F.lit("0.03").cast("decimal(4,2)"), "10.5").when(tax < F.lit("0.06").cast("decimal(4,2)"), "21").otherwise("27").cast("decimal(6,2)")
    qty, price = F.col("l_quantity").cast("decimal(12,2)"), (F.col("l_extendedprice").cast("decimal(12,2)"))
    vat = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit("99.50").cast("decimal(12,2)"))
    return t.select(F.col("l_orderkey").alias("invoice"), "pos", qty.alias("qty"), price.alias("price"), pct.alias("pct"), vat.alias("vat"), "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")


LINES_SQL = f"""lines as (
  select l_orderkey as invoice, row_number() over (partition by l_orderkey order by {", ".join(LINE_ORDER)}) - 1 as pos,
    cast(l_quantity as decimal(12,2)) as qty, cast(l_extendedprice as decimal(12,2)) as price,
    cast(case when cast(l_tax as decimal(4,2)) = 0 then 0 when cast(l_tax as decimal(4,2)) < 0.03 then 10.5
      when cast(l_tax as decimal(4,2)) < 0.06 then 21 else 27 end as decimal(6,2)) as pct,
    case when l_returnflag = 'R' and l_linenumber = 1 then cast(99.5 as decimal(12,2)) end as vat,
    l_partkey, l_suppkey, l_returnflag, l_shipdate
  from lineitem
), amounts as (
  select *, cast(qty * price as decimal(24,4)) as base, cast(round(cast(qty * price as decimal(20,4)) * pct / 100.0, 12) as double) as s0 from lines
)"""


def headers(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """invoice, vat (exact, 0.05 % off, 5 % off or null) and subtotal (missing for every fifth order); more columns of the order."""
    base = F.col("qty") * F.col("price")
    sums = lines(spark, d).groupBy("invoice").agg(F.sum((base * F.col("pct")).cast("decimal(26,6)")).alias("v"), F.sum(base.cast("decimal(24,4)")).alias("b"))
    k = F.col("o_orderkey") % 4
    off = F.when(k == 0, "1").when(k == 1, "1.0005").when(k == 2, "1.05").cast("decimal(6,4)")
    j = table(spark, d, "orders").select("o_orderkey", *more).join(sums, F.col("o_orderkey") == F.col("invoice"), "left")
    vat = F.round(F.col("v") * off / 100, 2).cast("decimal(18,2)")
    return j.select(F.col("o_orderkey").alias("invoice"), vat.alias("vat"), F.when(F.col("o_orderkey") % 5 != 0, F.round("b", 2).cast("decimal(18,2)")).alias("subtotal"), *more)
