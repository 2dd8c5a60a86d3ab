"""How an invoice states its tax, and its totals.

Lines: invoice, pos, qty, price, pct (rate in percent), vat (explicit amount or null); if there, zero (the line says
exempt or not taxed) and manual (its vat was edited). Headers: invoice, vat, subtotal (either may be null); if there,
manual. Stated maps: invoice, pct, amount, a row per rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import few

D = "decimal(18,2)"


def tolerance(x: Column) -> Column:
    return F.greatest(F.lit("0.02").cast("decimal(18,6)"), (x * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,6)"))


def line_amounts(lines: DataFrame) -> DataFrame:
    """Adds base, suggested (base times rate) and effective (explicit if positive, else suggested)."""
    base = (F.col("qty") * F.col("price")).cast("decimal(24,4)")
    hundredth = F.lit("0.01").cast("decimal(3,2)")  # as exact as a division, and cheaper
    made = lines.withColumn("base", base).withColumn("suggested", (F.col("base") * F.col("pct") * hundredth).cast("decimal(24,6)"))
    return made.withColumn("effective", F.when(F.col("vat") > 0, F.col("vat")).otherwise(F.col("suggested")).cast("decimal(24,6)"))


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _facts(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """A row per header: its amounts, sums over its lines, by_line (a list of pct, suggested, effective), zero, by_hand, mode.

    What needs no list uses rates and split (the suggested amounts' sum), so that the list is not built.
    Lines are summed by invoice and rate first; both groupings and the join share the lines' distribution by invoice.
    """
    content = (F.col("qty") > 0) | (F.col("price") > 0)
    off = (F.col("vat") > 0) & (F.col("suggested") > 0) & (F.abs(F.col("vat") - F.col("suggested")) > tolerance(F.col("suggested")))
    rated = content & (F.col("pct") > 0)
    made = line_amounts(lines.withColumns({"__z": _flag(lines, "zero"), "__m": _flag(lines, "manual")}))
    rates = made.groupBy("invoice", F.when(rated, F.col("pct").cast("decimal(6,2)")).alias("pct")).agg(
        F.sum("base").alias("base"),
        F.sum("suggested").cast("decimal(28,6)").alias("suggested"),
        F.sum("effective").cast("decimal(28,6)").alias("effective"),
        F.count(F.when(content, 1)).alias("filled"),
        F.count(F.when(rated & (F.col("__m") | off), 1)).alias("edited"),
        F.bool_and(F.when(content, F.col("__z"))).alias("zero"),
        F.bool_or(F.when(content, F.col("__m"))).alias("by_hand"),
    )
    one = F.when(F.col("pct").isNotNull(), F.struct("pct", "suggested", "effective"))
    sums = rates.groupBy("invoice").agg(
        F.sum("base").alias("bases"),
        F.sum("effective").alias("effective"),
        F.sum("filled").alias("filled"),
        F.sum(F.when(F.col("pct").isNotNull(), F.col("filled"))).alias("rated"),
        F.sum("edited").alias("edited"),
        F.bool_and("zero").alias("zero"),
        F.bool_or("by_hand").alias("by_hand"),
        F.count("pct").alias("rates"),
        F.sum(F.when(F.col("pct").isNotNull(), F.round("suggested", 2))).alias("split"),
        F.array_sort(F.collect_list(one)).alias("by_line"),
    )
    h = headers.select("invoice", F.col("vat").alias("header_vat"), "subtotal", _flag(headers, "manual").alias("fixed"))
    j = h.join(sums, "invoice", "left").na.fill(0, ["filled", "rated", "edited"]).na.fill(False, ["zero", "by_hand"])
    j = j.withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(30,6)") for c in ("bases", "effective")})
    h = F.coalesce(F.col("header_vat"), F.lit(0))
    close = F.abs(F.col("effective") - h) <= tolerance(h)
    mode = (
        F.when((h <= 0) & (F.col("rated") == 0), "header")
        .when(h <= 0, "line")
        .when(F.col("rated") == 0, "header")
        .when(close, "line")
        .when((F.col("filled") == 1) & (F.col("edited") == 0), "header")
        .when(F.col("filled") == 1, "line")
        .otherwise("mixed")
    )
    return j.withColumn("mode", mode)


def modes(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """A row per header: invoice, mode (line, header or mixed), header_vat, subtotal, bases, effective."""
    return _facts(lines, headers).select("invoice", "mode", "header_vat", "subtotal", "bases", "effective")


def _split() -> Column:
    """A list of pct and amount: suggested amounts, but the header's where it has one rate and does not follow its lines."""
    alone = (F.col("header_vat") > 0) & (F.size("by_line") == 1)
    amount = lambda x: F.when(F.col("mode") == "line", x["effective"]).when(alone, F.col("header_vat")).otherwise(x["suggested"])
    return F.transform("by_line", lambda x: F.struct(x["pct"].alias("pct"), F.round(amount(x), 2).cast(D).alias("amount")))


def breakdown(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """invoice, pct, amount: tax by rate; suggested amounts, but the header's where it has one rate and does not follow its lines."""
    return _facts(lines, headers).select("invoice", F.explode(_split()).alias("x")).select("invoice", "x.pct", "x.amount")


def stated_breakdown(lines: DataFrame, headers: DataFrame, stated: DataFrame) -> DataFrame:
    """invoice, rate, amount, suggested, nth: tax by rate, the highest first, of the stated and the lines' rates.

    With mode line, unless the header was edited, the lines' tax holds; else a stated amount, else the header's where there
    is one rate in all, else the lines'. An invoice without rates has one row, _total, with the header's tax if it has any.
    """
    f = _with_stated(lines, headers, stated)
    h = F.coalesce("header_vat", F.lit(0))
    mine = F.transform("by_line", lambda x: F.struct(x["pct"].alias("pct"), F.when(F.col("mode") == "line", x["effective"]).otherwise(x["suggested"]).cast("decimal(28,6)").alias("suggested"), F.lit(None).cast(D).alias("amount")))
    theirs = F.transform("stated", lambda x: F.struct(x["pct"].alias("pct"), F.lit(None).cast("decimal(28,6)").alias("suggested"), x["amount"].cast(D).alias("amount")))
    none = F.array().cast("array<struct<pct: decimal(6,2), suggested: decimal(28,6), amount: decimal(18,2)>>")
    both = f.select("invoice", "mode", "fixed", h.alias("h"), F.explode_outer(F.concat(F.coalesce(mine, none), F.coalesce(theirs, none))).alias("x"))
    each = both.groupBy("invoice", "mode", "fixed", "h", F.col("x.pct").alias("pct")).agg(F.coalesce(F.sum("x.suggested"), F.lit(0)).cast("decimal(28,6)").alias("suggested"), F.coalesce(F.sum("x.amount"), F.lit(0)).cast(D).alias("stated"))
    own = Window.partitionBy("invoice")
    j = each.where("pct is not null or h > 0").withColumn("rates", F.count("pct").over(own)).withColumn("nth", F.row_number().over(own.orderBy(F.desc("pct"))) - 1)
    amount = F.when(F.col("pct").isNull(), F.col("h")).when((F.col("mode") == "line") & ~F.col("fixed"), F.col("suggested")).when(F.col("stated") > 0, F.col("stated")).when((F.col("h") > 0) & (F.col("rates") == 1), F.col("h")).otherwise(F.col("suggested"))
    rate = F.when(F.col("pct").isNull(), "_total").otherwise(F.regexp_replace(F.regexp_replace(F.col("pct").cast("string"), r"0+$", ""), r"\.$", ""))
    suggested = F.when(F.col("pct").isNull(), F.col("h")).otherwise(F.col("suggested"))
    return j.select("invoice", rate.alias("rate"), F.round(amount, 2).cast(D).alias("amount"), F.round(suggested, 2).cast(D).alias("suggested"), "nth")


def others(slots: DataFrame) -> DataFrame:
    """invoice, others: the sum of the amounts of other taxes over an invoice's rows (slots: invoice, amount)."""
    return slots.groupBy("invoice").agg(F.coalesce(F.sum(F.col("amount").cast(D)), F.lit(0)).cast(D).alias("others"))


def grand_totals(found: DataFrame, slots: DataFrame) -> DataFrame:
    """The totals of invoices with others, the sum of their other taxes, counted into total and total_stated."""
    j = found.join(others(slots), "invoice", "left").na.fill(0, ["others"])
    return j.withColumns({c: (F.col(c) + F.col("others")).cast(D) for c in ("total", "total_stated")})


def slot_ids(slots: DataFrame, label_ids: DataFrame, other_ids: DataFrame) -> DataFrame:
    """invoice, pos, slot, tax_id, amount: the tax of each used slot.

    By its label where that is known (label_ids: label, tax_id); slots whose label is blank or unknown take the row's other
    taxes (other_ids: invoice, pos, ids) one after the other, and fall away when there are no more.
    """
    j = slots.where("amount > 0").join(few(label_ids)(label_ids.withColumnRenamed("tax_id", "__t")), "label", "left")
    nth = F.count(F.when(F.col("__t").isNull(), 1)).over(Window.partitionBy("invoice", "pos").orderBy("slot"))
    j = j.withColumn("__n", nth).join(other_ids.select("invoice", "pos", "ids"), ["invoice", "pos"], "left")
    found = F.coalesce("__t", F.get("ids", (F.col("__n") - 1).cast("int")))
    return j.withColumn("tax_id", found).where("tax_id is not null").select("invoice", "pos", "slot", "tax_id", "amount")


def line_flags(lines: DataFrame) -> DataFrame:
    """invoice, all_rated, all_zero: whether all content lines have a rate, or all say that there is no tax (zero); false without content."""
    content = (F.col("qty") > 0) | (F.col("price") > 0)
    both = {"all_rated": F.bool_and(F.when(content, F.col("pct") > 0)), "all_zero": F.bool_and(F.when(content, _flag(lines, "zero")))}
    return lines.groupBy("invoice").agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in both.items()])


def collapsed(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """invoice, qty, price, lines: an invoice of several lines as one piece, at the stated subtotal or else the sum of its lines."""
    sums = lines.groupBy("invoice").agg(F.sum((F.coalesce("qty", F.lit(0)) * F.coalesce("price", F.lit(0))).cast("decimal(24,6)")).alias("bases"), F.count("*").alias("lines")).where("lines > 1")
    j = sums.join(headers.select("invoice", "subtotal"), "invoice", "left")
    return j.select("invoice", F.lit(1).alias("qty"), F.coalesce(F.col("subtotal").cast("decimal(24,6)"), F.round("bases", 6)).cast("decimal(24,6)").alias("price"), "lines")


def cleared_footers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """The headers; tax and edits of those whose content lines all say that there is none are taken away (zero of lines)."""
    j = headers.join(line_flags(lines), "invoice", "left").withColumn("__z", F.coalesce("all_zero", F.lit(False)))
    made = j.withColumn("vat", F.when(~F.col("__z"), F.col("vat")))
    if "manual" in headers.columns:
        made = made.withColumn("manual", F.col("manual") & ~F.col("__z"))
    return made.select(*headers.columns, F.col("__z").alias("cleared"))


def cleared_lines(lines: DataFrame) -> DataFrame:
    """The lines; where all content lines of an invoice say that there is no tax, those that say so lose their own tax and edit mark."""
    flags = line_flags(lines).select("invoice", F.col("all_zero").alias("__z"))
    gone = F.col("__z") & _flag(lines, "zero")
    made = lines.join(flags, "invoice").withColumn("vat", F.when(~gone, F.col("vat")))
    if "manual" in lines.columns:
        made = made.withColumn("manual", F.col("manual") & ~gone)
    return made.select(*lines.columns)


def totals(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """invoice, mode, base, vat, total, total_stated and the warnings base_differs and vat_differs of each header."""
    j = _facts(lines, headers)
    h = F.coalesce(F.col("header_vat"), F.lit(0))
    sub = F.coalesce(F.col("subtotal"), F.lit(0))
    split = F.when((h > 0) & (F.col("rates") == 1), h).otherwise(F.col("split"))
    base = F.when((F.col("mode") == "header") & (sub > 0), sub).otherwise(F.col("bases")).cast("decimal(24,4)")
    vat = F.when(F.col("mode") == "line", F.round("effective", 2)).otherwise(F.coalesce(split, h)).cast(D)
    j = j.withColumn("base", F.round(base, 2).cast(D)).withColumn("tax", vat)
    stated = (F.when(sub > 0, sub).otherwise(F.col("bases")) + h).cast("decimal(24,4)")
    differs = (F.col("mode") != "header") & (sub > 0) & (F.abs(sub - F.col("bases")) > tolerance(sub))
    return j.select("invoice", "mode", "base", F.col("tax").alias("vat"), (F.col("base") + F.col("tax")).cast(D).alias("total"), F.round(stated, 2).cast(D).alias("total_stated"), differs.alias("base_differs"), ((F.col("mode") == "mixed") & (F.abs(F.col("effective") - h) > tolerance(h))).alias("vat_differs"))


def repair_inflated(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines whose amount exceeds the stated subtotal: one piece, or a price that fits, or blank."""
    j = lines.join(headers.select("invoice", "subtotal"), "invoice", "left")
    cap = (F.col("subtotal") * F.lit("1.001").cast("decimal(4,3)") + F.lit("0.02").cast("decimal(4,2)")).cast("decimal(24,6)")
    over = (F.col("subtotal") > 0) & (F.col("qty") > 0) & (F.col("price") > 0) & (F.col("qty") * F.col("price") > cap)
    qty = F.when(over & (F.col("price") <= cap), F.lit(1)).when(over & (F.col("qty") > cap), None).otherwise(F.col("qty"))
    price = F.when(over & (F.col("price") > cap) & (F.col("qty") <= cap), F.round(F.col("subtotal") / F.col("qty"), 2)).when(over & (F.col("price") > cap), None).otherwise(F.col("price"))
    return j.withColumn("new_qty", qty.cast("decimal(20,2)")).withColumn("new_price", price.cast("decimal(20,2)"))


def _with_stated(lines: DataFrame, headers: DataFrame, stated: DataFrame) -> DataFrame:
    """The facts of each header and stated, a list of pct and amount of the positive stated amounts."""
    positive = stated.where("amount > 0").groupBy("invoice", F.col("pct").cast("decimal(6,2)").alias("pct")).agg(F.sum(F.col("amount").cast(D)).cast(D).alias("amount"))
    known = positive.groupBy("invoice").agg(F.array_sort(F.collect_list(F.struct("pct", "amount"))).alias("stated"))
    return _facts(lines, headers).join(known, "invoice", "left")


RATES = "array<struct<pct: decimal(6,2), amount: decimal(18,2)>>"


def _holding() -> Column:
    """The list of pct and amount that effective_map tells, from the facts of _with_stated."""
    h, s, by_line = F.coalesce("header_vat", F.lit(0)), F.col("stated"), F.col("by_line")
    total = F.aggregate(s, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["amount"]).cast("decimal(28,2)"))
    differs = (h > 0) & (F.abs(total - h) > tolerance(total)) & F.col("mode").isin("header", "mixed") & (F.size(s) == 1)
    one = lambda pct: F.array(F.struct(pct.cast("decimal(6,2)").alias("pct"), F.round(h, 2).cast(D).alias("amount")))
    usual = F.coalesce(F.when(F.size(by_line) == 1, F.get(by_line, F.lit(0))["pct"]), F.lit(21).cast("decimal(6,2)"))
    suggested = F.transform(by_line, lambda x: F.struct(x["pct"].alias("pct"), F.round(x["suggested"], 2).cast(D).alias("amount")))
    rates = (
        F.when(F.col("zero"), F.array().cast(RATES))
        .when(F.size(s) > 0, F.when(differs, one(F.get(s, F.lit(0))["pct"])).otherwise(s))
        .when((F.col("mode") == "header") & (h > 0), one(usual))
        .when(F.size(by_line) > 0, suggested)
        .when(h > 0, one(usual))
    )
    return rates.cast(RATES)


def effective_map(lines: DataFrame, headers: DataFrame, stated: DataFrame) -> DataFrame:
    """invoice, pct, amount: the tax by rate that holds for an invoice.

    The stated map, but one stated rate gives way to a header that differs; else the header under the lines' one rate or
    21; else the lines' suggested tax. Invoices whose lines are all exempt or not taxed have none.
    """
    f = _with_stated(lines, headers, stated)
    return f.select("invoice", F.explode(_holding()).alias("r")).select("invoice", "r.pct", "r.amount")


def reconciled(lines: DataFrame, headers: DataFrame, stated: DataFrame) -> DataFrame:
    """invoice, action, vat, rates: what a header and its map become before an import.

    clear where every line is exempt or not taxed; keep where the header was edited, or is not of mode line; lines where the
    lines' tax replaces both, as it does whenever a line's was edited.
    """
    f = _with_stated(lines, headers, stated)
    mine = F.filter(F.transform("by_line", lambda x: F.struct(x["pct"].alias("pct"), F.round(x["effective"], 2).cast(D).alias("amount"))), lambda x: x["amount"] > 0)
    total = F.aggregate("by_line", F.lit(0).cast("decimal(30,6)"), lambda a, x: (a + x["effective"]).cast("decimal(30,6)"))
    from_lines = (F.col("by_hand") | (F.col("mode") == "line")) & (F.size(mine) > 0)
    action = F.when(F.col("zero"), "clear").when(F.col("fixed"), "keep").when(from_lines, "lines").otherwise("keep")
    j = f.withColumn("action", action)
    vat = F.when(F.col("action") == "lines", F.round(total, 2)).when(F.col("action") == "keep", F.col("header_vat")).cast(D)
    rates = F.when(F.col("action") == "lines", mine).when(F.col("action") == "keep", F.col("stated")).cast(RATES)
    return j.select("invoice", "action", vat.alias("vat"), F.coalesce(rates, F.array().cast(RATES)).alias("rates"))


def slot_rows(rows: DataFrame, key: list[str], slots: str) -> DataFrame:
    """key, slot (from 1), label and amount of the used slots of an array of (label, amount)."""
    e = rows.select(*key, F.posexplode(slots).alias("p", "x"))
    return e.select(*key, (F.col("p") + 1).alias("slot"), F.col("x.label").alias("label"), F.col("x.amount").alias("amount")).where("amount > 0")


def used_slots(slots: DataFrame) -> DataFrame:
    """The numbers of slots that any row uses, in order."""
    return slots.select("slot").distinct().orderBy("slot")


def id_list(*ids: Column) -> Column:
    """Ids in order, each once, nulls left out, joined by commas."""
    return F.array_join(F.array_distinct(F.array_compact(F.concat(*ids))), ",")


def expected_by_id(lines: DataFrame, headers: DataFrame, slots: DataFrame, rate_ids: DataFrame, label_ids: DataFrame) -> DataFrame:
    """invoice, tax_id, amount: tax by rate and the slots' amounts under their tax ids, summed, positive ones.

    rate_ids: pct, tax_id; label_ids: label, tax_id; slots: invoice, label, amount. Unknown labels fall away.
    """
    by_rate = breakdown(lines, headers).join(few(rate_ids)(rate_ids), "pct").select("invoice", "tax_id", "amount")
    by_slot = slots.join(few(label_ids)(label_ids), "label").select("invoice", "tax_id", F.col("amount").cast(D).alias("amount"))
    both = by_rate.unionByName(by_slot).groupBy("invoice", "tax_id").agg(F.sum("amount").alias("amount"))
    return both.where("amount > 0")


def expected_taxes(lines: DataFrame, headers: DataFrame, stated: DataFrame, slots: DataFrame, rate_ids: DataFrame, label_ids: DataFrame, other_ids: DataFrame) -> DataFrame:
    """invoice, tax_id, amount: the tax that an invoice is to have under each tax id, to the cent, positive ones.

    With mode line, unless the header was edited, the lines' effective tax by rate; else the map that holds (effective_map).
    To this come the slots: by label, and where that is blank or unknown by the row's other taxes in turn (slot_ids).
    rate_ids: pct, tax_id; a rate without an id falls away. Invoices without a content line have none.
    """
    by_slot = slot_ids(slots, label_ids, other_ids).groupBy("invoice").agg(F.collect_list(F.struct(F.lit(None).cast("decimal(6,2)").alias("pct"), F.col("amount").cast("decimal(28,6)").alias("amount"), F.col("tax_id").cast("long").alias("tax_id"))).alias("slots"))
    f = _with_stated(lines, headers, stated).where("filled > 0").join(by_slot, "invoice", "left")
    wide = "array<struct<pct: decimal(6,2), amount: decimal(28,6)>>"
    by_line = F.transform("by_line", lambda x: F.struct(x["pct"].alias("pct"), x["effective"].alias("amount"))).cast(wide)
    rates = F.when((F.col("mode") == "line") & ~F.col("fixed"), by_line).otherwise(_holding().cast(wide))
    rates = F.transform(rates, lambda x: F.struct(x["pct"].alias("pct"), x["amount"].alias("amount"), F.lit(None).cast("long").alias("tax_id")))
    # Both kinds come from the one row of an invoice, so that its facts are found once and nothing is shuffled after them.
    none = F.array().cast("array<struct<pct: decimal(6,2), amount: decimal(28,6), tax_id: bigint>>")
    both = f.select("invoice", F.explode(F.concat(F.coalesce(rates, none), F.coalesce("slots", none))).alias("r")).select("invoice", "r.pct", "r.amount", F.col("r.tax_id").alias("__t")).where("amount > 0")
    known = rate_ids.select(F.col("pct").cast("decimal(6,2)").alias("pct"), "tax_id")
    both = both.join(few(rate_ids)(known), "pct", "left").withColumn("tax_id", F.coalesce(F.col("__t").cast(dict(known.dtypes)["tax_id"]), "tax_id")).where("tax_id is not null")
    return both.groupBy("invoice", "tax_id").agg(F.round(F.sum("amount"), 2).cast(D).alias("amount")).where("amount > 0")


def process_total(totals: DataFrame, process: DataFrame) -> DataFrame:
    """process, invoices, total: the sum of the invoices' totals (totals: invoice, total; process: invoice, process)."""
    return process.join(totals.select("invoice", "total"), "invoice").groupBy("process").agg(F.count("*").alias("invoices"), F.sum("total").alias("total"))
