"""What is wrong with rows before they are sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

#: Numbers as the screen takes them: thousands by dots and decimals after a comma, or decimals after a dot.
NUMBER = r"^[+-]?(?:(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?|\d+\.\d+)$"


def _wrong(holds: Column, rule: str, field: str) -> Column:
    return F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.coalesce(F.trim(F.col(field)), F.lit("")).alias("value")))


def violations(rows: DataFrame, keys: list[str], numeric: list[str], days: list[str]) -> DataFrame:
    """keys, pos, step, rule, field, value: all violations of each row (rows: keys, pos, rate, number, account, name and the fields named).

    Rules in order: a rate is there; a document number has five and eight digits, shorter ones filled up; numbers are numbers; a
    row with a name or a number has an account; dates are dates. Blank fields break none but the first and the fourth.
    """

    def there(c: str) -> Column:
        return text.normalize(F.col(c)) != ""

    content = there("name")
    for c in numeric:
        content = content | there(c)
    rules = [
        _wrong(~there("rate"), "no rate", "rate"),
        _wrong(there("number") & ~text.document_number(F.col("number")).rlike(r"^\d{5}-\d{8}$"), "document number", "number"),
        *[_wrong(there(c) & ~F.trim(F.col(c)).rlike(NUMBER), "no number", c) for c in numeric],
        _wrong(content & ~there("account"), "no account", "account"),
        *[_wrong(there(c) & dates.iso(F.col(c)).isNull(), "no date", c) for c in days],
    ]
    found = rows.select(*keys, "pos", F.posexplode(F.array(*rules)).alias("step", "x")).where("x is not null")
    return found.select(*keys, "pos", "step", "x.rule", "x.field", "x.value")


def import_errors(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """invoice, error, line: the first thing that keeps an invoice from being imported; line (1 on) for a missing account.

    headers: invoice, partner, journal, number, date; lines: the content lines, invoice, pos, account. In order: partner,
    journal, document number, date, any line, an account on every line.
    """
    place = F.row_number().over(Window.partitionBy("invoice").orderBy("pos"))
    bad = lines.withColumn("__n", place).groupBy("invoice").agg(F.min(F.when(F.col("account").isNull(), F.col("__n"))).alias("__bad"), F.lit(True).alias("__any"))
    j = headers.join(bad, "invoice", "left")
    error = (
        F.when(F.col("partner").isNull(), "no partner")
        .when(F.col("journal").isNull(), "no journal")
        .when(text.normalize(F.col("number")) == "", "no number")
        .when(dates.for_import(F.col("date")).isNull(), "no date")
        .when(F.col("__any").isNull(), "no lines")
        .when(F.col("__bad").isNotNull(), "no account")
    )
    return j.withColumn("error", error).where("error is not null").select("invoice", "error", F.when(F.col("error") == "no account", F.col("__bad")).alias("line"))


def first_violation(rows: DataFrame, keys: list[str], numeric: list[str], days: list[str]) -> DataFrame:
    """keys, pos, rule, field, value: of each group the one that users are told, by rule before row."""
    v = violations(rows, keys, numeric, days)
    first = v.groupBy(*keys).agg(F.min(F.struct("step", "pos", "rule", "field", "value")).alias("v"))
    return first.select(*keys, "v.pos", "v.rule", "v.field", "v.value")
