"""Literal cases of the column functions and small cases of the operators."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers, text
from ledgerloom.operators import changes, documents, lookup, order, purchase, state, tax
from ledgerloom.sources.files import named_column, read_csv, scan, write_csv
from ledgerloom.streaming.autosave import autosaves, to_table


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("shown", "value"), [("350.0,00", 350), ("1457.256", "1457.256"), ("45.000", 45000), ("1.657.755", 1657755), ("1.234", 1234), ("15,175", "15.175"), ("1.000,50", "1000.50"), ("82.000,52", "82000.52"), ("-0,19", "-0.19"), ("", None), ("x", None), (None, None)])
def test_loose_amount(spark, shown, value):
    got = one(spark, numbers.loose_amount, shown)
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("value", "shown"), [("15.175", "15,175"), ("-0.19", "-0,19"), ("100", "100"), ("100.50", "100,5")])
def test_for_screen(spark, value, shown):
    assert one(spark, lambda c: numbers.for_screen(c.cast("decimal(20,6)")), value) == shown


@pytest.mark.parametrize(("shown", "screen", "iso"), [("1/2/2020", "01/02/2020", "2020-02-01"), ("2020-02-01", "01/02/2020", "2020-02-01"), ("31/02/2020", "31/02/2020", None), (None, "", None), ("", "", None)])
def test_dates(spark, shown, screen, iso):
    assert (one(spark, dates.for_screen, shown), one(spark, dates.iso, shown)) == (screen, iso)


def test_texts(spark):
    assert one(spark, text.normalize, " a  b\t") == "a b"
    assert one(spark, text.normalize, None) == ""
    assert one(spark, text.accent_fold, "Ñandú") == "NANDU"
    assert one(spark, text.document_number, "0001200000034") == "00012-00000034"
    assert one(spark, text.document_number, "123456-1") == "123456-00000001"
    assert one(spark, text.repair_scan, "C0LA 1234 4GUA") == "COLA 1234 4GUA"
    assert one(spark, lambda c: text.first_filled(F.lit("nan"), F.lit(None).cast("string"), c), "x") == "x"
    assert one(spark, lambda c: text.first_filled(F.lit(""), c), "x") == ""


INVOICE = [(1, 0, "1", "272644.68", "21", "57255.38"), (2, 0, "1", "964.37", "0", None), (2, 1, "2", "12786.04", "0", None), (3, 0, "1", "17768.60", "10.5", None), (4, 0, "1", "964.37", "21", None), (4, 1, "2840", "12628.72", "0", None), (5, 0, "1", "1000", "21", None), (6, 0, "1", "1000", "21", None), (7, 0, "2", "500", "21", None), (8, 0, "1", "5000", "0", None)]
HEADER = [(1, "57255.38", None), (2, "20521.22", "97719.14"), (3, "7736.40", "17768.60"), (4, "20521.22", None), (5, "210.01", None), (6, "210.30", None), (7, None, None), (8, "0", None), (9, None, None)]
MODES = {1: "line", 2: "header", 3: "header", 4: "mixed", 5: "line", 6: "header", 7: "line", 8: "header", 9: "header"}


def test_invoice_modes_and_totals(spark):
    li = spark.createDataFrame(INVOICE, "invoice int, pos int, qty string, price string, pct string, vat string")
    li = li.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("qty", "price", "vat")}).withColumn("pct", F.col("pct").cast("decimal(6,2)"))
    h = spark.createDataFrame(HEADER, "invoice int, vat string, subtotal string").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("vat", "subtotal")})
    got = {r["invoice"]: r for r in tax.totals(li, h).collect()}
    assert {k: r["mode"] for k, r in got.items()} == MODES
    assert (got[1]["total"], got[2]["total"], got[3]["total"], got[7]["vat"]) == (Decimal("329900.06"), Decimal("118240.36"), Decimal("25505.00"), Decimal("210.00"))


def test_order(spark):
    df = spark.createDataFrame([("a", 1, "n", "x"), ("a", 2, "", ""), ("b", 3, "", ""), ("c", 4, "m", "")], "g string, pos int, number string, v string").withColumn("all", F.lit(1))
    prev = {r["pos"]: r["v"] for r in order.fill_from_previous(df, ["v"], "g", "number", ["all"], ["pos"]).collect()}
    assert prev == {1: "x", 2: "x", 3: "x", 4: ""}
    assert {r["pos"]: r["v"] for r in order.fill_from_first(df, ["v"], ["g"], ["pos"]).collect()} == {1: "x", 2: "x", 3: "", 4: ""}
    assert {r["pos"]: r["v"] for r in order.spread_first_filled(df, ["v"], ["all"], ["pos"]).collect()} == dict.fromkeys((1, 2, 3, 4), "x")


def test_lookups_and_changes(spark):
    accounts = spark.createDataFrame([(183, "1.1", "Stock"), (184, "1.2", "Cash")], "id long, code string, name string")
    probe = spark.createDataFrame([("1.1 Cash",), ("1.1 Other",), ("Stock",), (None,)], "label string")
    assert [r["account_id"] for r in lookup.account(probe, "label", accounts).orderBy(F.col("label").asc_nulls_last()).collect()] == [184, 183, 183, None]
    taxes = spark.createDataFrame([(1, "Ret IIBB CABA"), (2, "P. IIBB CABA"), (3, "P. IIBB BA")], "id long, name string")
    labels = spark.createDataFrame([("Percepción IIBB CABA Sufrida",), ("IIBB ARBA",), ("IVA",), ("IIBB Luna",)], "label string")
    assert {r["label"]: r["tax_id"] for r in lookup.jurisdiction_tax(labels, "label", taxes).collect()} == {"Percepción IIBB CABA Sufrida": 2, "IIBB ARBA": 3, "IVA": None, "IIBB Luna": None}
    want = spark.createDataFrame([(1, 0, 7), (1, 1, None), (1, 2, 7)], "g int, at int, k int")
    have = spark.createDataFrame([(1, 10, 9), (1, 11, 7)], "g int, id long, k int")
    got = changes.by_key_else_position(want.withColumn("id", F.col("at").cast("long")), have, "g", "k", ["id"])
    assert {r["at"]: r["target"] for r in got.collect()} == {0: 11, 1: None, 2: None}
    s = spark.createDataFrame([(100.0,)], "q double").select(purchase.converted(F.col("q").cast("decimal(12,2)"), F.lit(1), F.lit(1), F.lit("a"), F.lit("a")).alias("x"))
    assert s.first()["x"] == Decimal("100.000000")


def test_documents(spark):
    rows = [(1, '{"facturas":[{"json":{}},{"json":{"factura":{"numero_factura":"7"}}}]}'), (2, None), (3, ""), (4, "{bad"), (5, '"{\\"facturas\\":[]}"')]
    df = spark.createDataFrame(rows, "process long, json_data string")
    assert [(r["process"], r["invoice"], r["line"], r["number"]) for r in documents.lines(df).collect()] == [(1, 0, 0, "7")]
    assert {r["process"] for r in documents.rejects(df).collect()} == {2, 3, 4}


def test_files_and_state(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 'q"'), (2, None, "y")], "id int, Company string, t string")
    assert named_column(df, ["empresa", "company"]) == "Company"
    assert [r["id"] for r in scan(df, [("Company", "!=", "a,b")], ["id"]).collect()] == [2]
    write_csv(df, str(tmp_path / "c"), {"t": "text"})
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).where("id = 1").first()["text"] == 'q"'
    empty = df.where("id > 5")
    assert state.upsert(df, empty, ["id"], "id", "t").count() == 2
    assert state.delete(df, empty, ["id"]).count() == 2


def test_autosave_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "a"), (1, "2024-01-01 00:10:00", 2, "b"), (1, "2024-01-03 00:00:00", 3, "c"), (2, "2024-01-09 00:00:00", 4, "d")], "k int, ts string, n int, v string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    to_table(autosaves(stream, "k", "ts", "1 hour", "1 hour", "v", "n"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {(r["k"], r["edits"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["k"], r["edits"], r["v"]) for r in state.quiet_sessions(rows, "k", "ts", "1 hour", "v", "n").where("k = 1").collect()}


def test_csv_is_read_as_written(spark, tmp_path):
    rows = [(1, "", None), (2, None, 'a"b'), (3, "x, y\nz", "\\"), (None, '""', " s ")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    write_csv(df, str(tmp_path / "c"), {"t": "text"}, mark=True)
    got = read_csv(spark, str(tmp_path / "c"), "id int, t string, u string")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_basket_rank_means(spark):
    mine = spark.createDataFrame([(1, 7, 0, "PAPER"), (1, 7, 1, "PEN"), (1, 7, 2, None)], "invoice int, partner int, line int, name string")
    theirs = spark.createDataFrame([(10, 7, 1, "PAPER"), (10, 7, 2, "PEN"), (20, 7, 1, "PENS"), (30, 8, 1, "PEN")], "order int, partner int, po_line int, name string")
    got = {tuple(r) for r in purchase.basket_rank(mine, theirs).select("invoice", "order", "matched", "score", "mean", "nth").collect()}
    assert got == {(1, 10, 2, 200.0, 66.7, 1), (1, 20, 1, 75.0, 25.0, 2)}


def test_numbers_with_white_space_and_exponents(spark):
    rows = [("\t12,5", 12.5, 12.5), (" 7\r\n", 7.0, 7.0), ("1e3", 1000.0, 1000.0), ("2,5E-1", 0.25, 0.25), ("1 2", None, None), ("", None, None), ("e3", None, None), (" 1.657.755 ", None, 1657755.0), ("1e999", None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = df.select(numbers.amount(F.col("t")).cast("double").alias("a"), numbers.loose_amount(F.col("t")).cast("double").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(a, b) for _, a, b in rows]
