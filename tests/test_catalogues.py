"""Small cases of kinds of invoices, tax ids, units, hierarchies and maps of tax."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import doctypes, lookup, purchase, tax, taxids


@pytest.mark.parametrize(("shown", "want"), [("Invoices  A", "FACTURAS A"), ("debit memos B", "NOTAS DE DÉBITO B"), ("Ticket", "TIQUE"), ("Electronic Debit Note SME's (FCE) B", "NOTA DE DÉBITO ELECTRÓNICA MiPyMEs (FCE) B"), ("oc-x", "OC-X"), ("Recibo", "Recibo"), ("Odd A", "Odd A"), (None, ""), ("", "")])
def test_spanish(spark, shown, want):
    assert spark.createDataFrame([(shown,)], "v string").select(doctypes.spanish(F.col("v"))).first()[0] == want


def test_kinds(spark):
    rows = [("t", 1, "FACTURA DE CREDITO ELECTRONICA MiPyMEs (FCE) A", "201"), ("t", 2, "FACTURAS A", "1"), ("t", 3, "Facturas A", "1"), ("t", 4, "X", "6"), ("t", 5, None, None), ("t", 6, "INVOICE C", None), ("u", 7, "OC-X", None), ("u", 8, "Order", "99"), ("v", 9, "RECIBO", "")]
    kinds = spark.createDataFrame(rows, "tenant string, id long, name string, code string")
    got = {(r["tenant"], r["label"]): r["id"] for r in doctypes.by_label(kinds, ["tenant"], ["id"]).collect()}
    assert got == {("t", "FACTURAS A"): 2, ("t", "FACTURAS B"): 4, ("t", "FACTURAS C"): 6, ("t", "OC-X"): 6, ("u", "OC-X"): 8}
    assert doctypes.by_label(kinds.where("id > 99"), ["tenant"], ["id"]).count() == 0


def test_tax_ids(spark):
    taxes = spark.createDataFrame([("a", 1, "IVA 21%", "21", 1), ("a", 2, "IVA Exen", "0", 2), ("b", 5, "IVA 21", "0", 1), ("b", 6, "iva 21% x", "21", 2), ("b", 7, None, None, 3), ("default", 9, "IVA 5%", "5", 1)], "profile string, id long, name string, amount string, pos int").withColumn("amount", F.col("amount").cast("decimal(12,4)"))
    rows = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "b", 99), ("a", "b", None), ("default", "default", 9), ("default", "b", 9)], "source string, target string, tax_id long")
    got = {(r["source"], r["target"], r["tax_id"]): r["w"] for r in taxids.remapped(rows, taxes, "source", "target", "w").collect()}
    assert got == {("a", "b", 1): 6, ("a", "b", 2): 57, ("a", "b", 99): None, ("a", "b", None): None, ("default", "default", 9): 9, ("default", "b", 9): None}
    labels = spark.createDataFrame([("Percepción IVA sufrida",), ("PERC  IVA",), ("none",), (None,)], "label string")
    named = spark.createDataFrame([(3, "Perc IVA"), (4, "PERC IVA"), (5, None)], "id long, name string")
    assert {r["label"]: r["tax_id"] for r in taxids.by_name(labels, "label", named).collect()} == {"Percepción IVA sufrida": 3, "PERC  IVA": 3, "none": None, None: None}


def test_heads(spark):
    rows = [(i, i - 1) for i in range(1, 40)] + [(0, None), (50, 51), (51, 50), (60, 999), (70, 70)]
    nodes = spark.createDataFrame(rows, "id long, up long")
    got = {r["id"]: r["head"] for r in lookup.heads(nodes, "id", "up").collect()}
    assert got == {**dict.fromkeys(range(40), 0), 50: None, 51: None, 60: 60, 70: None}
    chain = spark.range(1001).selectExpr("id", "if(id > 0, id - 1, null) as up")
    assert lookup.heads(chain, "id", "up").where("head = 0").count() == 1001
    assert {r["id"] for r in lookup.below(nodes, "id", "up", spark.createDataFrame([(37,), (50,)], "r long"), "r").collect()} == {37, 38, 39, 50, 51}


def test_quantities_and_units(spark):
    rows = [("500", "3", "500", "3"), ("1", "3", "20", "3"), ("1", "3", "2", "1"), (None, "3", None, "3"), (None, None, "4", "4"), (None, None, None, None), ("7", None, "7", "7")]
    df = spark.createDataFrame(rows, "a string, b string, c string, want string").select(*[F.col(x).cast("decimal(12,2)") for x in ("a", "b", "c", "want")])
    for r in df.withColumn("got", purchase.billed_quantity(F.col("a"), F.col("b"), F.col("c"))).collect():
        assert r["got"] == r["want"]
    units = spark.createDataFrame([("kg", "1", "w"), ("g", "1000", "w"), ("bad", "0", "w")], "unit string, factor string, category string").withColumn("factor", F.col("factor").cast("decimal(12,4)"))
    lines = spark.createDataFrame([("100", "kg", "kg"), ("50", None, "kg"), (None, "g", "kg"), ("120000", "GRS", "KG"), ("5", "bad", "kg"), ("5", "", "")], "qty string, unit string, order_unit string").withColumn("qty", F.col("qty").cast("decimal(12,2)"))
    got = {(r["unit"], r["order_unit"]): (r["scaled"], r["note"]) for r in purchase.scaled(lines, units).collect()}
    assert got[("kg", "kg")] == (Decimal(100), "") and got[(None, "kg")] == (Decimal(50), "Sin UM en factura") and got[("g", "kg")] == (None, "")
    assert got[("GRS", "KG")] == (Decimal(120), "Re-escalado") and got[("", "")] == (Decimal(5), "")
    assert spark.range(1).select(text.unit(F.lit("unidad(es)")).alias("a"), text.unit(F.lit("null")).alias("b"), text.unit(F.lit(None).cast("string")).alias("c")).first()[:] == ("Units", "", "")


def test_maps_of_tax(spark):
    li = spark.createDataFrame([(1, "1", "100", "21", None, False, False), (2, "1", "100", "0", None, True, False), (3, "1", "100", "21", None, False, False), (3, "1", "100", "10.5", None, False, False), (4, "1", "100", "21", "30", False, True), (5, None, None, None, None, False, False)], "invoice long, qty string, price string, pct string, vat string, zero boolean, manual boolean")
    li = li.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("qty", "price", "vat")}).withColumn("pct", F.col("pct").cast("decimal(6,2)"))
    h = spark.createDataFrame([(1, "25"), (2, "21"), (3, None), (4, "21"), (5, "9"), (6, None)], "invoice long, vat string").select("invoice", F.col("vat").cast("decimal(18,2)"), F.lit(None).cast("decimal(18,2)").alias("subtotal"))
    stated = spark.createDataFrame([(1, "21", "21"), (2, "21", "21"), (4, "21", "0")], "invoice long, pct string, amount string").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("pct", "amount")})
    got = sorted((r["invoice"], float(r["pct"]), float(r["amount"])) for r in tax.effective_map(li, h, stated).collect())
    assert got == [(1, 21.0, 25.0), (3, 10.5, 10.5), (3, 21.0, 21.0), (4, 21.0, 21.0), (5, 21.0, 9.0)]
    made = {r["invoice"]: (r["action"], r["vat"], len(r["rates"])) for r in tax.reconciled(li, h, stated).collect()}
    assert made == {1: ("keep", Decimal(25), 1), 2: ("clear", None, 0), 3: ("lines", Decimal("31.50"), 2), 4: ("lines", Decimal(30), 1), 5: ("keep", Decimal(9), 0), 6: ("keep", None, 0)}
    empty = li.limit(0)
    assert tax.effective_map(empty, h.limit(0), stated.limit(0)).count() == 0


def test_violations(spark):
    from ledgerloom.operators import validation

    rows = [(1, 0, "21", "1-2", "a", "x", "1.234,5", "1/2/2020"), (1, 1, "21", None, None, None, None, None), (2, 0, None, None, None, None, None, None), (2, 1, "21", "9x", None, "n", "1,2,3", "31/02/2020"), (3, 0, "0", "", "a", "", "1.23", "")]
    df = spark.createDataFrame(rows, "g long, pos int, rate string, number string, account string, name string, qty string, day string")
    got = sorted((r["g"], r["pos"], r["rule"]) for r in validation.violations(df, ["g"], ["qty"], ["day"]).collect())
    assert got == [(2, 0, "no rate"), (2, 1, "document number"), (2, 1, "no account"), (2, 1, "no date"), (2, 1, "no number")]
    assert [tuple(r) for r in validation.first_violation(df, ["g"], ["qty"], ["day"]).collect()] == [(2, 0, "no rate", "rate", "")]
    assert validation.violations(df.limit(0), ["g"], ["qty"], ["day"]).count() == 0
