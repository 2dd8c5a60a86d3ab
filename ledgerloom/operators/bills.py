"""Draft bills: header and line values, their taxes, and one ordered plan of what to write.

Rows are the lines of invoices: invoice, pos, and what a function names. Nothing is written anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from . import changes
from .order import fill_from_first, first_per_key, one_to_one

#: Taxes without a rate that a line still carries, and all labels that mean no tax.
CARRIED = ("IVA No Gravado", "IVA Exento")
ZERO_LABELS = ("IVA No Corresponde", "IVA No Gravado", "IVA Exento")
#: Fixed value: the name of a line without one.
NO_NAME = "Línea importada"
#: The steps of a plan, in the order in which they must be written: later ones would be undone by earlier ones.
STEPS = ("header", "maturity", "content", "link", "reapply", "order price", "tax amount")


def explicit_zero(label: Column) -> Column:
    """Whether a tax label says that there is none; a rate of 0 does not."""
    t = text.normalize(label)
    return t.isin(*ZERO_LABELS) | t.rlike("(?i)no corresponde")


def carries_tax(label: Column) -> Column:
    """Whether a line with this label has a tax of its own: a rate above 0, exempt or not taxed."""
    return text.normalize(label).isin(*CARRIED) | (numbers.rate(label) > 0)


def content(name: Column, price: Column, qty: Column) -> Column:
    """Whether a line says anything: a name, a price or a quantity."""
    return (text.normalize(name) != "") | price.isNotNull() | qty.isNotNull()


def content_for_orders(header_only: Column, name: Column, qty: Column) -> Column:
    """Whether a line is matched against orders: a name or a quantity, and not a header alone."""
    return ~F.coalesce(header_only, F.lit(False)) & ((text.normalize(name) != "") | qty.isNotNull())


def content_on_screen(name: Column, price: Column, qty: Column) -> Column:
    """Whether a screen counts a line: a name, or a price or quantity other than 0."""
    return (text.normalize(name) != "") | (F.coalesce(price, F.lit(0)) != 0) | (F.coalesce(qty, F.lit(0)) != 0)


def line_values(rows: DataFrame) -> DataFrame:
    """Adds the values to write: name, quantity, price, product_id, unit_id (only with a product) and account_id.

    rows: name, qty, price, product, unit, account. No quantity, or one not above 0, is 1; no price is 0.
    """
    id_of = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.withColumns(
        {
            "new_name": F.when(text.normalize(F.col("name")) == "", NO_NAME).otherwise(text.normalize(F.col("name"))),
            "new_qty": F.when(F.col("qty") > 0, F.col("qty")).otherwise(F.lit(1)).cast(numbers.MONEY),
            "new_price": F.coalesce("price", F.lit(0)).cast(numbers.MONEY),
            "product_id": id_of("product"),
            "unit_id": F.when(id_of("product").isNotNull(), id_of("unit")),
            "account_id": id_of("account"),
        }
    )


def origin() -> Column:
    """Of a group's rows: the chosen order's name (chosen), else the distinct names (order_name) of content rows, in order (of pos)."""
    named = F.when(F.col("is_content") & (text.normalize(F.col("order_name")) != ""), F.struct("pos", text.normalize(F.col("order_name")).alias("n")))
    chosen = F.min(F.when(text.normalize(F.col("chosen")) != "", F.struct("pos", text.normalize(F.col("chosen")).alias("n"))))["n"]
    return F.coalesce(chosen, F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["n"])), ", "))


def origins(rows: DataFrame) -> DataFrame:
    """invoice, origin (see origin)."""
    return rows.groupBy("invoice").agg(origin().alias("origin"))


def header_values(rows: DataFrame) -> DataFrame:
    """invoice, partner, journal, number, date and due of each first row; without a due date the invoice's."""
    first = first_per_key(rows, ["invoice"], ["pos"])
    return first.select("invoice", "partner", "journal", F.nullif(text.normalize(F.col("number")), F.lit("")).alias("number"), dates.for_import(F.col("date")).alias("date"), dates.due(F.col("due"), F.col("date")).alias("due"))


def line_tax_ids(rows: DataFrame, modes: DataFrame, vat_ids: Column) -> DataFrame:
    """Adds tax_ids: the taxes each line is to carry.

    rows: invoice, pos, label, ids, is_content; modes: invoice, mode. VAT goes where the label carries none, and with mode
    header where it has a rate. With mode header or mixed the first content row also gets all other taxes of the invoice.
    """
    by = Window.partitionBy("invoice").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.filter(F.col("ids"), lambda x: ~F.array_contains(vat_ids, x))
    keep_vat = carries_tax(F.col("label")) & ~((F.col("mode") == "header") & (numbers.rate(F.col("label")) > 0))
    j = rows.join(modes.select("invoice", "mode"), "invoice").withColumn("__other", other)
    j = j.withColumn("__all", F.flatten(F.collect_list("__other").over(by))).withColumn("__first", F.first(F.when(F.col("is_content"), F.col("pos")), ignorenulls=True).over(by))
    own = F.when(keep_vat, F.col("ids")).otherwise(F.col("__other"))
    gathered = F.col("mode").isin("header", "mixed") & (F.col("pos") == F.col("__first"))
    return j.withColumn("tax_ids", F.array_distinct(F.when(gathered, F.concat(own, "__all")).otherwise(own))).drop("__other", "__all", "__first")


def reference_rows(rows: DataFrame) -> DataFrame:
    """invoice, pos: the row whose tax stands for its invoice: the first content row that carries one, else the first with a stated amount (stated), else the first."""
    rank = F.when(F.col("is_content") & carries_tax(F.col("label")), 0).when(F.col("stated").isNotNull(), 1).otherwise(2)
    return rows.groupBy("invoice").agg(F.min(F.struct(rank.alias("rank"), "pos")).alias("m")).select("invoice", "m.pos")


def first_amount(*amounts: Column) -> Column:
    """The first amount that is not null or 0, without its sign; 0 without one."""
    return F.coalesce(*[F.when(a != 0, F.abs(a)) for a in amounts], F.lit(0))


def amount_sides(amount: Column, balance: Column, debit: Column, credit: Column) -> Column:
    """debit, credit and balance of a new amount, on the side on which the line stands."""
    a = F.round(amount, 2)
    on_credit = F.coalesce(balance < 0, F.lit(False)) | (F.coalesce(credit, F.lit(0)) > F.coalesce(debit, F.lit(0)))
    zero = F.lit(0).cast("decimal(18,2)")
    parts = ((zero, a, -a), (a, zero, a))
    pick = [F.when(on_credit, x).otherwise(y).cast("decimal(18,2)") for x, y in zip(*parts, strict=True)]
    return F.struct(*[c.alias(n) for c, n in zip(pick, ("debit", "credit", "balance"), strict=True)])


def move_lines(lines: DataFrame, taxes: bool) -> DataFrame:
    """The tax lines of bills, or their product lines (of no kind or another one), with their place by sequence and id."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    part = lines.where(kind == "tax") if taxes else lines.where(~kind.isin("tax", "line_section", "line_note", "payment_term"))
    return part.withColumn("nth", F.row_number().over(Window.partitionBy("invoice").orderBy("sequence", "id")) - 1)


def tax_amounts(tax_lines: DataFrame, expected: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """invoice, line_id, tax_id, present, amount, note: tax lines to overwrite, and expected taxes that have no line (note 'no line')."""
    have = tax_lines.select("invoice", F.col("id").alias("line_id"), "tax_id", F.col("amount").alias("present"))
    j = expected.select("invoice", "tax_id", "amount").join(have, ["invoice", "tax_id"], "left")
    note = F.when(F.col("line_id").isNull(), "no line").otherwise("")
    differs = F.col("line_id").isNull() | (F.abs(F.col("present") - F.col("amount")) > F.lit(tolerance).cast("decimal(12,6)"))
    return j.where(differs).select("invoice", "line_id", "tax_id", "present", "amount", note.alias("note"))


def missing_taxes(first_lines: DataFrame, expected: DataFrame, tax_lines: DataFrame) -> DataFrame:
    """invoice, line_id, action, ids: what to do with the first product line where an expected tax has no tax line.

    first_lines: invoice, id, ids (its taxes), wanted (those it should have). add the missing ones it lacks; recompute if
    it has all that it should; else replace its taxes by the wanted and the missing ones.
    """
    absent = changes.missing(expected.select("invoice", "tax_id"), tax_lines, ["invoice", "tax_id"])
    absent = absent.groupBy("invoice").agg(F.array_sort(F.collect_list("tax_id")).alias("absent"))
    j = first_lines.join(absent, "invoice")
    to_add, desired = F.array_except("absent", "ids"), F.array_distinct(F.concat("wanted", "absent"))
    same = (F.size(F.array_except(desired, "ids")) == 0) & (F.size(F.array_except("ids", desired)) == 0)
    action = F.when(F.size(to_add) > 0, "add").when(same, "recompute").otherwise("replace")
    ids = F.when(F.size(to_add) > 0, to_add).when(same, F.array().cast("array<int>")).otherwise(desired)
    return j.select("invoice", F.col("id").alias("line_id"), action.alias("action"), ids.alias("ids"))


def order_prices(rows: DataFrame, order_lines: DataFrame, tolerance: str = "0.001") -> DataFrame:
    """po_line, present, price, note: prices to write into orders where an invoice asks for it (overwrite on any of its rows).

    The last row of an order's line wins; lines that are gone get the note 'gone'.
    """
    asked = rows.where(F.coalesce("overwrite", F.lit(False))).select("invoice").distinct()
    linked = rows.join(asked, "invoice", "left_semi").where(F.col("is_content") & F.col("po_line").isNotNull())
    wanted = first_per_key(linked, ["po_line"], [F.desc("invoice"), F.desc("pos")]).select("po_line", F.coalesce("price", F.lit(0)).alias("price"))
    j = wanted.join(order_lines.select("po_line", F.coalesce("price", F.lit(0)).alias("present")), "po_line", "left")
    note = F.when(F.col("present").isNull(), "gone").otherwise("")
    return j.where(F.col("present").isNull() | (F.abs(F.col("price") - F.col("present")) > F.lit(tolerance).cast("decimal(12,6)"))).select("po_line", "present", "price", note.alias("note"))


def prepared(rows: DataFrame, order_lines: DataFrame, header: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows ready for a plan, and the notes (invoice, pos, note) on what was changed.

    Headers are filled from each invoice's first row, links to order lines that are gone are cleared, and of several rows
    on one order line the first keeps it.
    """
    filled = fill_from_first(rows, header, ["invoice"], ["pos"])
    known = changes.clear_unknown(filled, "po_line", order_lines, "po_line")
    linked = one_to_one(known.withColumn("__was", F.col("po_line")), "po_line", ["invoice"], ["pos"])
    note = F.when(F.col("cleared"), "order line gone").when(F.col("__was").isNotNull() & F.col("po_line").isNull(), "order line used before")
    notes = linked.select("invoice", "pos", note.alias("note")).where("note is not null")
    return linked.drop("cleared", "__was"), notes


def change_plan(parts: dict[str, DataFrame]) -> DataFrame:
    """invoice, step, nth, target, field, value: all changes in the order in which they must be written.

    parts: a table (invoice, target, field, value) for any of STEPS; one that has a column step may hold several. Of several
    values for one field of a target within a step one row remains, the least value.
    """
    made = None
    for n, step in enumerate(STEPS):
        if step in parts:
            number = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step")).cast("int") - 1 if "step" in parts[step].columns else F.lit(n)
            one = parts[step].select("invoice", number.alias("step"), F.col("target").cast("string").alias("target"), "field", F.col("value").cast("string").alias("value"))
            made = one if made is None else made.unionByName(one)
    # One shuffle and one sort: changes are all but distinct, and the sort that finds the least value has the plan's order.
    one = Window.partitionBy("invoice", "step", "target", "field").orderBy(F.asc_nulls_last("value"))
    once = made.repartition("invoice").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    nth = F.row_number().over(Window.partitionBy("invoice").orderBy("step", "target", "field")) - 1
    return once.withColumn("nth", nth)


def plan_summary(plan: DataFrame) -> DataFrame:
    """invoice and, for each step, how many targets it changes."""
    targets = plan.select("invoice", "step", "target").distinct()  # once each, so that a row need not be copied for every step
    return targets.groupBy("invoice").agg(*[F.count(F.when(F.col("step") == n, F.col("target"))).alias(step.replace(" ", "_")) for n, step in enumerate(STEPS)])
