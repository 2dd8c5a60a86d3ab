"""Small cases of documents, draft bills, saved rows and order matching."""

from __future__ import annotations

import json
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, similar
from ledgerloom.operators import bills, documents, lookup, purchase, saved, tax
from ledgerloom.sources.files import write_csv


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("shown", "value"), [("12.5,75", "12.75"), ("350.25,00", "350"), ("350.0,00", "350"), ("$ 5", None), ("1 000", None), ("1457,256", "1457.256"), ("-1.234", "-1234"), ("1.2.3", None)])
def test_loose_amounts(spark, shown, value):
    assert one(spark, numbers.loose_amount, shown) == (None if value is None else Decimal(value))


def test_number_forms(spark):
    assert one(spark, numbers.number_or_zero, "x") == 0 and one(spark, numbers.number_or_zero, "1.2.3") == 123
    assert one(spark, lambda c: numbers.display(c.cast("decimal(18,2)"), True), "1234567.5") == "$ 1.234.567,50"
    assert one(spark, lambda c: numbers.money_or_blank(c.cast("decimal(18,6)")), "0") == ""


FACTURA = {
    "numero_factura": "1-23",
    "iva_21": "57255,38",
    "percepcion_iibb": "3344.38",
    "otros_tributos": "0",
    "proveedor": {"razon_social": "", "nombre": "Uno"},
    "items": [{"cantidad": 2, "subtotal_sin_iva": 20660.31}, {"subtotal": "81630,95", "alicuota_iva": "10.5"}, {"cantidad": 15.175, "precio_unitario": 1457.256}],
}


def test_document(spark):
    payload = json.dumps({"facturas": [{"json": "x"}, {"json": {"factura": FACTURA}}]})
    processes = spark.createDataFrame([(1, payload), (2, '{"facturas": ['), (3, json.dumps(payload)), (4, "{}"), (5, None)], "process int, json_data string")
    h = documents.headers(processes).where("process = 1").first()
    assert (h["invoice"], h["number"], h["vat"], dict(h["rates"]), h["supplier"]) == (0, "00001-00000023", "57255.38", {"21": "57255.38"}, "Uno")
    assert [tuple(s) for s in h["slots"]] == [("percepcion_iibb", Decimal("3344.38"))]
    got = [(r["quantity"], r["price"], r["label"]) for r in documents.screen_lines(processes).where("process = 3").orderBy("line").collect()]
    assert got == [("2", "10330,16", ""), ("1", "81630,95", "10,5"), ("15,175", "1457,256", "")]
    assert {(r["process"], r["reason"]) for r in documents.rejects(processes).collect()} == {(2, "not an object"), (4, "no invoices"), (5, "null")}


def test_weighted_ratio():
    assert similar.weighted_ratio("", "a") == 0 and similar.weighted_ratio("abc", "abc") == 100
    assert similar.weighted_ratio("b a", "a b") == pytest.approx(95)
    assert similar.weighted_ratio("la madrid", "la madrid srl y otros") == pytest.approx(90)
    assert similar.weighted_ratio("ab", "ab" + "x" * 40) == pytest.approx(60)


@pytest.mark.parametrize("few", [2000, 0])
def test_cascade_and_fallback(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW_NAMES", few)
    probe = spark.createDataFrame([(1, "30-1", "x"), (2, "", "perro grand"), (3, None, "gato"), (4, "9", None)], "key int, cuit string, name string")
    a = spark.createDataFrame([(10, "7", "perro grande"), (11, "", "casa")], "id int, cuit string, name string")
    b = spark.createDataFrame([(20, "301", "perro grand"), (21, "", "gatos")], "id int, cuit string, name string")
    assert {tuple(r) for r in lookup.cascade(probe, "key", [a, b], 72.0).collect()} == {(1, 1, 20, 100.0), (2, 0, 10, 91.6667), (3, 1, 21, 80.0)}
    named = lookup.by_name(probe, "key", "name", a.select("id", "name"), 72.0, "casa")
    assert {tuple(r) for r in named.collect()} == {(1, 11), (2, 10), (3, 11), (4, 11)}


def catalogue(spark):
    partners = spark.createDataFrame([(22, "LA MADRID SRL", "30710552602"), (10, "Alicia Vazquez", None)], "id int, name string, cuit string")
    known = spark.createDataFrame([("LA MADRID SRL", "30710552602", "FP CUP NEA", "Rubro test", "5.1.1.01.030 Purchase of merchandise")], "name string, cuit string, journal string, category string, account string")
    lists = {"journal": [(5, "FP CUP NEA")], "category": [(3, "Rubro test")], "account": [(100, "5.1.1.01.030 Purchase of merchandise")]}
    return partners, known, {k: spark.createDataFrame(v, "id int, name string") for k, v in lists.items()}


def test_saved_rows_of_another_tenant(spark):
    partners, known, lists = catalogue(spark)
    headers = spark.createDataFrame([(1, "LA MADRID", "30-71055260-2", 1419, 999, 888, 777), (2, "LA MADRID SRL", "30710552602", 22, 5, 3, 100), (3, "", "", 1419, 1, 1, 1), (4, "alicia vasquez", "", 8, 1, 1, 1), (5, "nobody at all", "", 8, 1, 1, 1)], "invoice int, name string, cuit string, partner int, journal int, category int, account int")
    made = saved.remapped(headers, partners, known, lists)
    got = {r["invoice"]: (r["partner"], r["changed"], r["journal"], r["category"], r["account"]) for r in made.collect()}
    assert got == {1: (22, True, 5, 3, 100), 2: (22, False, 5, 3, 100), 3: (1419, False, 1, 1, 1), 4: (10, True, 1, 1, 1), 5: (8, False, 1, 1, 1)}
    rows = spark.createDataFrame([(1, 0, 1419, 999, 7), (1, 1, None, None, 8), (2, 0, 22, 5, 9), (9, 0, 4, 6, 1)], "invoice int, pos int, partner int, journal int, po_line int")
    out = {(r["invoice"], r["pos"]): (r["partner"], r["journal"], r["po_line"]) for r in saved.with_headers(rows, made, ["journal"], ["po_line"]).collect()}
    assert out == {(1, 0): (22, 5, None), (1, 1): (22, None, None), (2, 0): (22, 5, 9), (9, 0): (4, 6, 1)}


def test_products_of_another_tenant(spark):
    products = spark.createDataFrame([(50, "PX01", "Producto X"), (51, "", "Otra cosa")], "id int, code string, name string")
    rows = spark.createDataFrame([(1, 9999, "PX01", "x"), (2, 9999, "", "otra  cosas"), (3, 50, "", ""), (4, None, "PX01", ""), (5, 9999, "", "nada")], "row int, product int, code string, name string")
    assert {r["row"]: r["product"] for r in saved.remapped_products(rows, products).collect()} == {1: 50, 2: 51, 3: 50, 4: None, 5: 9999}


def test_chosen_orders(spark):
    ranked = spark.createDataFrame([(1, 20, 1), (1, 10, 2), (2, 20, 1), (3, 20, 1)], "invoice int, `order` int, nth int")
    picked = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "invoice int, `order` int")
    assert {tuple(r) for r in purchase.selected_order(ranked, picked).collect()} == {(1, 10, True), (2, 20, False), (3, 20, False)}
    state = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c"), (4, 5, "d")], "invoice int, `order` int, note string")
    commands = spark.createDataFrame([(1, 1, "clear", None), (1, 2, "select", 7), (2, 1, "clear", None), (3, 1, "rematch", None)], "invoice int, seq int, action string, `order` int")
    got = {r["invoice"]: (r["order"], r["note"], r["rematch"]) for r in purchase.commanded(state, commands, ["note"]).collect()}
    assert got == {1: (7, None, False), 2: (None, None, False), 3: (None, None, True), 4: (5, "d", False)}


def fit(code: str, said: str, name: str, same: bool) -> float:
    """An order line's fit by the rules, in plain Python."""

    def scan(t: str) -> str:
        out = []
        for w in t.upper().split():
            letters = sum(c.isalpha() for c in w)
            out.append(w.translate(str.maketrans("015", "OIS")) if len(w) >= 3 and letters >= max(2, len(w) - 1) else w)
        return " ".join(out)

    def words(t: str) -> list[str]:
        return [w for w in t.upper().replace("/", " ").replace("-", " ").split() if len(w) >= 3]

    k, n = code.upper(), name.upper()
    if not n:
        return 0.0
    if k not in ("", "1", "NO DISPONIBLE", "NONE", "NULL"):
        if k == n:
            return 100.0
        if k in n or n in k:
            return 92.0
    best = 0.0
    for t in (said.upper(), scan(said)) if said else ():
        s = round(similar.token_set_ratio(t, n), 4)
        if s >= 80:
            return s
        best = max(best, s)
        if any(a in b or b in a for a in words(t) for b in words(n)):
            best = max(best, 75.0)
        best = max(best, round(similar.partial_ratio(t, n), 4))
    return best if best > 0 else 55.0 if same else 0.0


def test_order_lines_by_brute_force(spark):
    names = ["CON-CHOCLO", "ALM PAN FRANCES", "MOT PERA", "TOMATE", "", "ACEITE OLIVA"]
    said = ["CHOCL0 MC", "6 KG PAN", "X", "TOMATES SECOS", "ACE1TE OLIVA", "OLIVA ACEITE"]
    codes = ["", "MOT PERA", "1", "PERA"]
    i = [(n, 1, 1, c, s, float(n % 3)) for n, (s, c) in enumerate(product(said, codes))]
    p = [(10 + n % 2, 1, n, t, float(n % 3)) for n, t in enumerate(names)]
    invoices = spark.createDataFrame(i, "invoice int, partner int, line int, code string, name string, qty double")
    orders = spark.createDataFrame(p, "`order` int, partner int, po_line int, name string, qty double")
    got = {r["invoice"]: (r["order"], r["po_line"], round(r["score"], 4)) for r in purchase.best_order_line(invoices, orders).collect()}
    want = {}
    for n, _, _, code, s, q in i:
        best = min((-fit(code, s, t, r != 0 and abs(q - r) <= 0.01), o, k) for o, _, k, t, r in p)
        if -best[0] >= (75 if code else 70):
            want[n] = (best[1], best[2], round(-best[0], 4))
    assert got == want and len(want) > 8
    chosen = spark.createDataFrame([(n, 10) for n in range(0, 24, 2)], "invoice int, `order` int")
    inside = {r["invoice"]: r["order"] for r in purchase.best_order_line(invoices, orders, selected=chosen).collect()}
    assert set(inside.values()) == {10} and all(n % 2 == 0 for n in inside) and all(n in inside for n, (o, _, _) in want.items() if o == 10 and n % 2 == 0)


def test_taxes_of_lines(spark):
    rows = spark.createDataFrame([(1, 0, "0", [63], True), (1, 1, "0", [63], True), (2, 0, "21", [63, 27], True), (2, 1, "0", [], True), (3, 0, "", [70], False), (3, 1, "IVA Exento", [57], True)], "invoice int, pos int, label string, ids array<int>, is_content boolean")
    modes = spark.createDataFrame([(1, "header"), (2, "mixed"), (3, "mixed")], "invoice int, mode string")
    made = bills.line_tax_ids(rows, modes, F.array(F.lit(63), F.lit(57)))
    assert {(r["invoice"], r["pos"]): r["tax_ids"] for r in made.collect()} == {(1, 0): [], (1, 1): [], (2, 0): [63, 27], (2, 1): [], (3, 0): [70], (3, 1): [57, 70]}


def test_breakdown_of_a_header_without_rates(spark):
    li = spark.createDataFrame([(1, 0, "1", "100", "0", None), (2, 0, "1", "100", "21", None), (2, 1, "1", "100", "10.5", None)], "invoice int, pos int, qty string, price string, pct string, vat string")
    li = li.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("qty", "price", "vat")}).withColumn("pct", F.col("pct").cast("decimal(6,2)"))
    h = spark.createDataFrame([(1, "9.50", None), (2, "40", None), (3, None, None)], "invoice int, vat string, subtotal string").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("vat", "subtotal")})
    stated = spark.createDataFrame([(2, "21", "22.00")], "invoice int, pct string, amount string").withColumns({"pct": F.col("pct").cast("decimal(6,2)"), "amount": F.col("amount").cast("decimal(18,2)")})
    got = [(r["invoice"], r["rate"], float(r["amount"]), r["nth"]) for r in tax.stated_breakdown(li, h, stated).orderBy("invoice", "nth").collect()]
    assert got == [(1, "_total", 9.5, 0), (2, "21", 22.0, 0), (2, "10.5", 10.5, 1)]


def test_csv_with_mark(spark, tmp_path):
    write_csv(spark.createDataFrame([("a", 1)], "x string, y int").coalesce(1), str(tmp_path / "out"), {"y": "z"}, mark=True)
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw == b"\xef\xbb\xbfx,z\r\na,1\r\n"
