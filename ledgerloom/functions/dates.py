"""Dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parsed(c: Column) -> Column:
    t = F.trim(c)
    slashed = F.when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"), F.try_to_timestamp(F.replace(t, F.lit("-"), F.lit("/")), F.lit("d/M/yyyy")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(slashed, iso)


def for_screen(c: Column) -> Column:
    """dd/mm/yyyy; what is no date stays as it is."""
    return F.coalesce(F.date_format(_parsed(c), "dd/MM/yyyy"), F.trim(c), F.lit(""))


def iso(c: Column) -> Column:
    """yyyy-mm-dd; null for what is no date."""
    return F.date_format(_parsed(c), "yyyy-MM-dd")


def for_import(c: Column) -> Column:
    """yyyy-mm-dd of a date in any of the forms; text that begins like an ISO date passes as it is, its first ten letters."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)).otherwise(iso(c))


def due(c: Column, invoice_date: Column) -> Column:
    """The due date for an import, the invoice's date where there is none."""
    return F.coalesce(for_import(c), for_import(invoice_date))
