"""Numbers in locale text. Money is decimal throughout and rounded once, half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"


def _bare(c: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _number(t: Column) -> Column:
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?$"), t).try_cast(MONEY)


def amount(c: Column) -> Column:
    """A comma is the decimal point; null if the rest is no number."""
    return _number(F.replace(_bare(c), F.lit(","), F.lit(".")))


def loose_amount(c: Column) -> Column:
    """Amounts in either locale.

    With a comma, dots are thousands. Without one they are if every later group has three digits, and a single dot
    only after three leading digits at most. One or two digits between a dot and a comma are the mistake of a reader
    that put both: they fall away, so '350.0,00' is 350 and '12.5,75' is 12.75. Inner blanks and signs of money make
    it no number.
    """
    t = _bare(c)
    mixed = t.rlike(r"^[+-]?\d+\.\d{1,2},\d+$")
    comma = t.contains(",")
    plain = F.regexp_replace(t, r"\.", "")
    thousands = t.rlike(r"^[+-]?\d{1,3}\.\d{3}$") | t.rlike(r"^[+-]?\d+(\.\d{3}){2,}$")
    text = F.when(mixed, F.replace(F.regexp_replace(t, r"\.\d{1,2},", ","), F.lit(","), F.lit("."))).when(comma, F.replace(plain, F.lit(","), F.lit("."))).when(thousands, plain).otherwise(t)
    return _number(text)


def _strip(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def for_screen(d: Column) -> Column:
    """Up to six decimals after a comma, no zeros at the end."""
    return F.replace(_strip(F.round(d, 6).cast(MONEY).cast("string")), F.lit("."), F.lit(","))


def for_csv(d: Column, money: bool) -> Column:
    """Two decimals for money, up to six for quantities."""
    return F.round(d, 2).cast("decimal(20,2)").cast("string") if money else _strip(F.round(d, 6).cast(MONEY).cast("string"))


def rate(c: Column) -> Column:
    """The leading number of a tax text, as a share: '10,5 %' is 0.105; 0 without one."""
    t = F.replace(F.regexp_extract(F.trim(c), r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    return F.coalesce((F.when(t != "", t).try_cast("decimal(8,4)") / 100).cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))


def quantity_and_price(qty: Column, price: Column, net: Column) -> tuple[Column, Column]:
    """A price that is there stays; else net over quantity, to the cent (to six decimals below half a cent); else one piece at the net price."""
    has, some = F.coalesce(price, F.lit(0)) != 0, F.coalesce(qty, F.lit(0)) != 0
    paid = F.coalesce(net, F.lit(0)) != 0
    each = net / F.when(some, qty)
    new_price = F.when(has, price).when(some & paid, F.when(F.abs(each) < F.lit("0.000000000001").cast("decimal(20,12)"), F.round(each, 6)).otherwise(F.round(each, 2))).when(paid, F.round(net, 2)).otherwise(price)
    new_qty = F.when(has, qty).when(some & paid, qty).when(paid, F.lit(1)).otherwise(qty)
    return new_qty.cast(MONEY), new_price.cast(MONEY)


def number_or_zero(c: Column) -> Column:
    """As a form reads a number: dots before a comma, or several dots, are thousands; anything that is no number is 0."""
    t = _bare(c)
    several = (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))) > 1
    plain = F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(several | t.rlike(r"^[+-]?\d{1,3}\.\d{3}$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.coalesce(_number(plain), F.lit(0).cast(MONEY))


def money_or_blank(d: Column) -> Column:
    """Two decimals; blank for null and for what is next to nothing."""
    return F.when(d.isNull() | (F.abs(d) < F.lit("0.000000000001").cast("decimal(20,12)")), "").otherwise(F.round(d, 2).cast("decimal(20,2)").cast("string"))


def display(d: Column, currency: bool = False) -> Column:
    """1.234,50: dots for thousands and two decimals after a comma; with a sign of money, '$ 1.234,50'; blank for null."""
    t = F.translate(F.format_number(d, 2), ",.", ".,")
    return F.coalesce(F.concat(F.lit("$ "), t) if currency else t, F.lit(""))


def percent(c: Column) -> Column:
    """The number of a tax text in percent, wherever it stands: 'IVA 10,5%' is 10.5; null without one."""
    t = F.replace(F.regexp_extract(c, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    return F.when(t != "", t).try_cast("decimal(8,4)")


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)
