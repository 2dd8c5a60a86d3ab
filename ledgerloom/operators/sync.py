"""Bringing bills to a wanted state: a plan composed from the parts of an import, and its proof by replay.

A bill's present state is four tables: bills (invoice and header fields), lines (invoice, id, sequence and line fields),
taxes (invoice, id, tax_id, amount) and orders (po_line, price). A plan lists what to write where, in order. It is right
if the state after it is the wanted one, which a second plan that finds nothing to do shows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources.files import cut
from . import bills
from .order import fill_from_first, first_per_key

#: Header and line fields that are written, and the type they have.
HEADER = {"partner": "long", "journal": "long", "number": "string", "date": "string", "due": "string", "origin": "string"}
LINE = {"name": "string", "qty": "decimal(20,6)", "price": "decimal(20,6)", "product": "long", "account": "long"}


@dataclass(frozen=True)
class State:
    """What is there: bills, lines, taxes and orders."""

    bills: DataFrame
    lines: DataFrame
    taxes: DataFrame
    orders: DataFrame


CHANGES = "array<struct<step: int, target: string, field: string, value: string>>"


def _none() -> Column:
    return F.array().cast(CHANGES)


def _change(step: str, target: Column, field: str, value: Column) -> Column:
    return F.struct(F.lit(bills.STEPS.index(step)).alias("step"), target.cast("string").alias("target"), F.lit(field).alias("field"), value.cast("string").alias("value"))


def _changes(step: str, target: Column, fields: dict[str, tuple[Column, Column, str, bool]]) -> Column:
    """A list of changes: fields (wanted, present, type, clears) whose wanted value is another one; a null is one only if clears."""
    each = []
    for name, (want, have, kind, clears) in fields.items():
        new, old = want.cast(kind), have.cast(kind)
        each.append(_change(step, target, name, F.when(~new.eqNullSafe(old) & (F.lit(clears) | new.isNotNull()), F.coalesce(new.cast("string"), F.lit("")))))
    return F.filter(F.array(*each), lambda x: x["value"].isNotNull())


def _rows(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows with an invoice, headers handed down; of the header fields themselves none but the first row's are taken."""
    rows, more = rows.where("invoice is not null"), [c for c in header if c not in HEADER]
    return fill_from_first(rows, more, ["invoice"], ["pos"]) if more else rows


def links(rows: DataFrame, state: State, header: list[str]) -> DataFrame:
    """invoice, links: a bill's links to order lines that are there (pos, po_line), of several to one the first, as bills.prepared leaves them.

    paid is the price that an order's line is to have (see bills.order_prices), on its link from the greatest invoice only;
    low and high are the prices it has. Nothing but links is shuffled, to the orders and back.
    """
    rows, orders = _rows(rows, header), state.orders
    asked = rows.withColumn("__asked", F.max(F.coalesce("overwrite", F.lit(False))).over(Window.partitionBy("invoice"))).where("po_line is not null")
    pay = F.when(F.col("__asked") & F.col("is_content"), F.coalesce("price", F.lit(0)))
    first = first_per_key(asked.select("invoice", "pos", "po_line", pay.alias("pay")), ["invoice", "po_line"], ["pos"])
    price = F.coalesce("price", F.lit(0))
    known = first.join(orders.groupBy("po_line").agg(F.min(price).alias("low"), F.max(price).alias("high")), "po_line")
    by = Window.partitionBy("po_line")
    paid = F.max_by("pay", F.when(F.col("pay").isNotNull(), F.struct("invoice", "pos"))).over(by)
    known = known.withColumn("paid", F.when(F.col("invoice") == F.max("invoice").over(by), paid))
    known = known.select("invoice", F.struct("pos", "po_line", "paid", *[F.when(F.col("paid").isNotNull(), F.col(c)).alias(c) for c in ("low", "high")]).alias("links"))
    return known.repartition("invoice").groupBy("invoice").agg(F.sort_array(F.collect_list("links")).alias("links"))


def readied(rows: DataFrame, state: State, header: list[str]) -> DataFrame:
    """links, written once."""
    return cut(links(rows, state, header))


def _bills(rows: DataFrame, expected: DataFrame, state: State, header: list[str], ready: DataFrame) -> DataFrame:
    """A bill in a row: what is wanted and what is there.

    head (wanted header fields), wanted (its lines in order, with the links they keep), there (the present lines in order), have
    (present header fields), prices (po_line, paid, low, high) and taxes (id, amount, due: the tax lines that are expected).
    """
    rows = _rows(rows, header)
    line = {"name": "new_name", "qty": "new_qty", "price": "new_price", "product": "product_id", "account": "account_id"}
    first = F.min_by(F.struct(*[c for c in HEADER if c != "origin"]), "pos")
    lines = F.sort_array(F.collect_list(F.struct("pos", *[F.col(c).alias(n) for n, c in line.items()])))
    bill = bills.line_values(rows).groupBy("invoice").agg(first.alias("first"), bills.origin().alias("origin"), lines.alias("lines"))
    bill = bill.join(ready, "invoice", "left")
    # Lines and links are sorted together by their place: a link stands before its line.
    kinds = dict(bill.dtypes)
    nothing = lambda c: F.lit(None).cast(kinds[c].removeprefix("array<").removesuffix(">"))
    entry = lambda x, y, pos: F.struct(pos.alias("pos"), x.isNotNull().alias("is_line"), y.alias("link"), x.alias("line"))
    both = F.concat(F.transform("lines", lambda x: entry(x, nothing("links"), x["pos"])), F.transform(F.coalesce("links", F.array().cast(kinds["links"])), lambda y: entry(nothing("lines"), y, y["pos"])))
    bill = bill.withColumn("__both", F.sort_array(both))
    before = lambda x, i: F.get("__both", i - 1)
    link = lambda x, i: F.when(x["is_line"] & (before(x, i)["pos"] == x["pos"]), before(x, i)["link"]["po_line"])
    linked = F.transform("__both", lambda x, i: F.struct(*[x["line"][c].alias(c) for c in LINE], link(x, i).alias("po_line"), x["is_line"].alias("is_line")))
    bill = bill.withColumn("wanted", F.filter(linked, lambda x: x["is_line"])).withColumn("prices", F.transform(F.filter("links", lambda x: x["paid"].isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in ("po_line", "paid", "low", "high")])))
    f = F.col("first")
    head = {"partner": f["partner"], "journal": f["journal"], "number": F.nullif(text.normalize(f["number"]), F.lit("")), "date": dates.for_import(f["date"]), "due": dates.due(f["due"], f["date"]), "origin": F.nullif(F.col("origin"), F.lit(""))}
    bill = bill.select("invoice", F.struct(*[head[c].cast(kind).alias(c) for c, kind in HEADER.items()]).alias("head"), "wanted", "prices")
    there = state.lines.groupBy("invoice").agg(F.sort_array(F.collect_list(F.struct("sequence", "id", *LINE, "po_line"))).alias("there"))
    have = state.bills.groupBy("invoice").agg(F.collect_list(F.struct(*HEADER)).alias("have"))
    bill = bill.join(there, "invoice", "left").join(have, "invoice", "left")
    due = expected.where("invoice is not null").groupBy("invoice").agg(F.collect_list(F.struct("tax_id", "amount")).alias("due"))
    taxes = due.join(state.taxes.groupBy("invoice").agg(F.collect_list(F.struct("id", "tax_id", "amount")).alias("present")), "invoice", "left")
    paired = F.transform("due", lambda d: F.transform(F.filter("present", lambda p: p["tax_id"] == d["tax_id"]), lambda p: F.struct(p["id"].alias("id"), p["amount"].alias("amount"), d["amount"].alias("due"))))
    return bill.join(taxes.select("invoice", F.flatten(paired).alias("taxes")), "invoice", "full")  # the last join, as no distribution is left after it


def _planned(bill: DataFrame, name: str) -> DataFrame:
    """Adds the changes that a bill needs, in the order of a plan; of several values for one field of a target within a step the least."""
    no, far = _none(), lambda a, b, most: F.abs(a - b) > F.lit(most).cast("decimal(12,6)")
    on_bill = F.flatten(F.transform("have", lambda h: _changes("header", F.lit("bill"), {c: (F.col("head")[c], h[c], kind, c == "origin") for c, kind in HEADER.items()})))
    link = lambda w, t: _changes("link", t["id"], {"po_line": (w["po_line"], t["po_line"], "long", True)})
    content = lambda w, t: _changes("content", t["id"], {c: (w[c], t[c], kind, False) for c, kind in LINE.items()})
    on_line = F.flatten(F.transform(F.arrays_zip("wanted", "there"), lambda x: F.when(x["wanted"].isNotNull() & x["there"].isNotNull(), F.concat(content(x["wanted"], x["there"]), link(x["wanted"], x["there"]))).otherwise(no)))
    priced = F.filter("prices", lambda x: far(x["paid"], x["low"], "0.001") | far(x["paid"], x["high"], "0.001"))
    taxed = F.filter("taxes", lambda x: x["id"].isNotNull() & far(x["amount"], x["due"], "0.02"))
    on_price = F.transform(priced, lambda x: _change("order price", x["po_line"], "price", x["paid"].cast("decimal(20,6)")))
    on_tax = F.transform(taxed, lambda x: _change("tax amount", x["id"], "amount", x["due"]))
    made = bill.withColumn("__made", F.sort_array(F.concat(*[F.coalesce(c, no) for c in (F.when(F.col("wanted").isNotNull(), on_bill), on_line, on_price, on_tax)])))
    of = lambda x: F.struct(x["step"], x["target"], x["field"])
    return made.withColumn(name, F.filter("__made", lambda x, i: (i == 0) | ~of(x).eqNullSafe(of(F.get("__made", i - 1))))).drop("__made")


def _written(bill: DataFrame, items: str, changes: str, steps: Sequence[str], key: Callable[[Column], Column], fields: dict[str, Sequence[str]]) -> DataFrame:
    """The list items as the bill's changes of some steps leave it, the later step winning; '' is null. fields: the item's fields that a field sets.

    Items and changes are sorted together by target, an item before its changes, of which there are few, so that none is sought.
    """
    kind = dict(bill.dtypes)[items]
    kinds = {f.name: f.dataType.simpleString() for f in bill.schema[items].dataType.elementType.fields}
    mine = F.filter(changes, lambda c: c["step"].isin([bills.STEPS.index(s) for s in steps]) & c["field"].isin(list(fields)) & c["target"].isNotNull())
    entry = lambda target, step, field, value, nth: F.struct(target.alias("target"), step.alias("step"), field.alias("field"), value.alias("value"), nth.alias("nth"))
    own = F.transform(items, lambda x, i: entry(key(x).cast("string"), F.lit(-1), F.lit(""), F.lit(""), i))
    all_ = F.sort_array(F.concat(own, F.transform(mine, lambda c: entry(c["target"], c["step"], c["field"], c["value"], F.lit(-1)))))
    twice = F.size(items) - F.size(F.array_distinct(F.transform(items, lambda x: key(x).cast("string"))))
    met = bill.withColumns({"__all": all_, "__twice": twice})
    most = F.lit(len(steps) * len(fields)) + F.when(F.col("__twice") > 0, F.col("__twice")).otherwise(0)  # named twice, lest it be put into the function below
    after = lambda x, i: F.filter(F.transform(F.sequence(F.lit(1), most), lambda n: F.get("__all", i + n)), lambda c: (c["target"] == x["target"]) & (c["step"] >= 0))
    hits = F.transform("__all", lambda x, i: F.when(x["step"] < 0, F.struct(x["nth"].alias("nth"), after(x, i).alias("c"))))
    met = met.withColumn("__hits", F.sort_array(F.filter(hits, lambda x: x.isNotNull()))).withColumnRenamed(items, "__items")
    source = {n: f for f, names in fields.items() for n in names}

    def value(x: Column, name: str) -> Column:
        if name not in source:
            return x["__items"][name]
        last = F.try_element_at(F.filter(x["__hits"]["c"], lambda c: c["field"] == source[name]), F.lit(-1))
        return F.when(last.isNotNull(), F.nullif(last["value"], F.lit("")).cast(kinds[name])).otherwise(x["__items"][name])

    made = F.transform(F.arrays_zip("__items", "__hits"), lambda x: F.struct(*[value(x, n).alias(n) for n in kinds]))
    return met.withColumn(items, made.cast(kind)).drop("__items", "__hits", "__all", "__twice")


def proved(rows: DataFrame, expected: DataFrame, state: State, header: list[str]) -> DataFrame:
    """invoice, planned, left: a bill's changes (step, target, field, value; see composed), and those that it would need after them.

    A bill is one row from the first plan to the second, so that nothing is written or shuffled between them; an order's
    price stands on the one bill whose plan writes it.
    """
    bill = _planned(_bills(rows, expected, state, header, links(rows, state, header)), "planned")
    bill = _written(bill, "have", "planned", ["header"], lambda x: F.lit("bill"), {c: [c] for c in HEADER})
    bill = _written(bill, "there", "planned", ["content", "link", "reapply"], lambda x: x["id"], {c: [c] for c in (*LINE, "po_line")})
    bill = _written(bill, "taxes", "planned", ["tax amount"], lambda x: x["id"], {"amount": ["amount"]})
    bill = _written(bill, "prices", "planned", ["order price"], lambda x: x["po_line"], {"price": ["low", "high"]})
    return _planned(bill, "left").select("invoice", "planned", "left")


def _plan(bill: DataFrame, changes: str) -> DataFrame:
    # Not posexplode, for which Spark would make all changes once more, to leave out bills without one before they are made.
    return bill.select("invoice", F.posexplode_outer(changes).alias("nth", "c")).where("nth is not null").select("invoice", "c.*", "nth")


def composed(rows: DataFrame, expected: DataFrame, state: State, header: list[str], ready: DataFrame | None = None) -> DataFrame:
    """The plan (see bills.change_plan) that brings the state to what the rows of an import say.

    rows: invoice, pos, the header fields, name, qty, price, product, unit, account, po_line, order_name, chosen, overwrite,
    is_content. expected: invoice, tax_id, amount. Rows are taken as bills.prepared leaves them (headers handed down, dead and
    doubled links to order lines cleared) and meet the bill's product lines place by place. A wanted null leaves a header or
    line as it is, but clears the origin and a link to an order line. Values are texts, '' for null. Of taxes only lines that
    are there are written; bills.missing_taxes tells what to do about others. All changes of a bill leave one row.
    With ready (readied, or links, which Spark makes from the rows' shuffle if a plan is used but once) links are not found again.
    """
    ready = readied(rows, state, header) if ready is None else ready
    return _plan(_planned(_bills(rows, expected, state, header, ready), "planned"), "planned")


def _applied(table: DataFrame, plan: DataFrame, steps: Sequence[str], key: Column, fields: Sequence[str], by_invoice: bool = True) -> DataFrame:
    """table with the values that the plan's steps write, the later step winning; '' is null."""
    numbers = [bills.STEPS.index(s) for s in steps]
    mine = plan.where(F.col("step").isin(numbers) & F.col("field").isin(fields))
    last = [F.max_by(F.when(F.col("field") == c, F.struct("value")), F.when(F.col("field") == c, F.col("step"))).alias(f"__{c}") for c in fields]
    on = ["invoice", "__target"] if by_invoice else ["__target"]
    written = mine.withColumnRenamed("target", "__target").groupBy(*on).agg(*last)
    j = table.withColumn("__target", key.cast("string")).join(written, on, "left")
    kinds = dict(table.dtypes)
    return j.select(*[F.when(F.col(f"__{c}").isNotNull(), F.nullif(F.col(f"__{c}.value"), F.lit("")).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def replayed(state: State, plan: DataFrame) -> State:
    """The state after all writes of a plan, in its order; targets that are not there are left out."""
    return State(
        _applied(state.bills, plan, ["header"], F.lit("bill"), list(HEADER)),
        _applied(state.lines, plan, ["content", "link", "reapply"], F.col("id"), [*LINE, "po_line"]),
        _applied(state.taxes, plan, ["tax amount"], F.col("id"), ["amount"]),
        _applied(state.orders, plan, ["order price"], F.col("po_line"), ["price"], False),
    )


def pending(rows: DataFrame, expected: DataFrame, state: State, header: list[str]) -> tuple[DataFrame, DataFrame]:
    """A plan, and the plan that would be left after it, which a right one leaves empty."""
    both = cut(proved(rows, expected, state, header))
    return _plan(both, "planned"), _plan(both, "left")
