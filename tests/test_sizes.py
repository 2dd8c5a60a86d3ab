"""Queries on odd rows against their SQL, and plans whose work must grow with the tables and no faster."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import plans
from ledgerloom.functions import similar
from ledgerloom.operators import bills, documents, order, purchase, sync
from ledgerloom.plans import catalogue, scopes
from ledgerloom.sources import paged

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_money_texts_of_nothing(spark, tmp_path):
    """An account at zero is written out, one that is not there stays null."""
    rows = [(1, "a", 1, 0.0, "x"), (2, "b", 1, -0.0, "x"), (3, "c", 1, 0.0, "x"), (4, "d", 1, -1234567.8, "x"), (5, "e", 1, None, "x"), (6, "f", 1, None, "x"), (-1, "g", 1, 5.0, "x")]
    df = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    df.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()["money_texts"]).fetchall()
    got = [tuple(r) for r in plans.queries()["money_texts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_summary_counts_without_copies(spark):
    """A plan's rows meet in one shuffle, and are not copied for each step that is counted; null targets do not count."""
    some = spark.createDataFrame([(1, "a", "x", "2"), (1, "a", "x", "1"), (1, "a", "y", None), (1, None, "y", "3"), (2, "b", "x", None)], "invoice int, target string, field string, value string")
    plan = bills.change_plan({"header": some, "link": some.where("invoice = 1")})
    assert sorted(map(tuple, plan.where("invoice = 1 and step = 0").select("nth", "target", "field", "value").collect())) == [(0, None, "y", "3"), (1, "a", "x", "1"), (2, "a", "y", None)]
    planned = plan_of(made := bills.plan_summary(plan))
    assert "Expand" not in planned and planned.count("Exchange hashpartitioning") <= 1
    assert sorted((r.invoice, r.header, r.link, r.content) for r in made.collect()) == [(1, 1, 1, 0), (2, 1, 0, 0)]


def test_few_units_are_not_shuffled_by(spark):
    """Lines do not gather by the handful of spellings and units there are."""
    assert "hashpartitioning(product_unit" not in (p := plan_of(plans.queries()["product_units"](spark, SMALL))) and "hashpartitioning(__u" not in p


@pytest.mark.parametrize("name", ["expected_taxes", "expected_tax_by_id"])
def test_taxes_are_not_shuffled_by_rate(spark, name):
    """Tax ids of three rates are broadcast."""
    p = plan_of(plans.queries()[name](spark, SMALL))
    assert "hashpartitioning(pct" not in p and "hashpartitioning(label" not in p


def test_orders_fit_by_names_not_by_quantities(spark):
    """Where an equal quantity is not enough, lines of all quantities share the pairs of their names: the pairs are fewer than lines."""
    i = spark.createDataFrame([(1, 7, k, "", "NUT", k) for k in range(30)] + [(2, 7, 0, "BOLT", "x", 5), (3, 7, 0, None, None, None)], "invoice int, partner int, line int, code string, name string, qty int")
    p = spark.createDataFrame([(o, 7, k, "NUT" if k % 2 else "BOLT", k) for o in (4, 5) for k in range(40)] + [(6, 7, 0, None, 1)], "order int, partner int, po_line int, name string, qty int")
    got = purchase.best_order_line(i, p)
    assert sorted(map(tuple, got.collect())) == [(1, k, 4, 1, 100.0) for k in range(30)] + [(2, 0, 4, 0, 100.0)]
    chosen = spark.createDataFrame([(1, 5), (3, 6)], "invoice int, order int")
    assert sorted(map(tuple, purchase.best_order_line(i, p, selected=chosen).collect())) == [(1, k, 5, 1, 100.0) for k in range(30)]
    by_quantity = purchase.best_order_line(i.where("invoice = 1").withColumn("name", F.lit("zzzz")), p, 50.0, 50.0)
    assert sorted(map(tuple, by_quantity.collect())) == [(1, k, 4, k, 55.0) for k in range(1, 30)]
    ranked = purchase.fitted_rank(i, p)
    assert sorted((r.invoice, r["order"], r.matched, r.score) for r in ranked.collect()) == sorted([(1, 4, 30, 3000.0), (1, 5, 30, 3000.0), (1, 6, 0, 0.0), (2, 4, 1, 100.0), (2, 5, 1, 100.0), (2, 6, 0, 0.0), (3, 4, 0, 0.0), (3, 5, 0, 0.0), (3, 6, 0, 0.0)])
    for made in (got, ranked):
        assert "hashpartitioning(code" not in (s := plan_of(made)) and "hashpartitioning(q" not in s


def test_a_sync_plan_reads_its_rows_once(spark):
    """Lines are read by a plan for what is there only; the import's rows come from their written table (13 scans and 28 shuffles before)."""
    p = plan_of(plans.queries()["sync_plan"](spark, SMALL))
    assert p.count("lineitem.parquet") <= 2 and p.count("Exchange hashpartitioning") <= 10


def test_pages_need_few_tasks(spark, tmp_path):
    """A task writes many pages."""
    assert paged.write_pages(spark.range(1000).repartition(3), path := f"{tmp_path}/pages", "id", 10) == 100
    assert len({f.name.split("-")[1] for f in (tmp_path / "pages").glob("part-*")}) == 1
    assert [r.id for r in paged.read_pages(spark, path, 95, 205).orderBy("id").collect()] == list(range(95, 205))


def test_orders_are_ranked_without_a_table_of_pairs(spark):
    """An invoice and an order meet as one row each: nothing but the rank is shuffled, sorted or hashed after they met (two groupings before)."""
    i = spark.createDataFrame([(1, 7, 0, "NUT"), (1, 7, 1, "NUT"), (1, 7, 2, None), (1, 7, 3, "ABCDEFGHIJ"), (2, 7, 0, "BOLT"), (3, None, 0, "NUT"), (4, 8, 0, "NUT")], "invoice int, partner int, line int, name string")
    p = spark.createDataFrame([(5, 7, 0, "NUT"), (5, 7, 1, "ABCDEFG"), (6, 7, 0, None), (6, 7, 1, "BOLT"), (6, 7, 2, "BOLT"), (9, None, 0, "NUT")], "order int, partner int, po_line int, name string")
    ranked = purchase.basket_rank(i, p)
    want = [(1, 5, 3, 270.0, 67.5, 1), (1, 6, 0, 0.0, 0.0, 2), (2, 6, 1, 100.0, 100.0, 1), (2, 5, 0, 0.0, 0.0, 2)]
    assert sorted((r.invoice, r["order"], r.matched, r.score, r["mean"], r.nth) for r in ranked.collect()) == sorted(want)
    s = plan_of(purchase.basket_rank(i, p))
    above = s[: s.index("Join")]  # the plan is printed from its end
    assert "Aggregate" not in above and above.count("Exchange") == 1


def test_screen_lines_read_a_document_once(spark):
    """Lines take their document's header with them: nothing is parsed twice or joined, and documents of one process stay apart."""
    made = '{"facturas": [{"json": {"factura": {"numero_factura": "1-2", "tipo_comprobante": "C", "proveedor": {"nombre": "Dos"}, "items": [{"descripcion": "a", "cantidad": "2", "subtotal": "5"}, {"descripcion": "b", "precio_unitario": "1,5"}]}}}]}'
    df = spark.createDataFrame([(1, made), (1, made), (2, None)], "process int, json_data string")
    p = plan_of(documents.screen_lines(df))
    assert p.count("from_json") == 1 and "Join" not in p
    first, second = (0, "00001-00000002", "Dos", "a", "2", "2,5", "IVA No Corresponde"), (1, "", "", "b", "", "1,5", "IVA No Corresponde")
    got = documents.screen_lines(df).select("line", "number", "supplier", "description", "quantity", "price", "label").collect()
    assert sorted(map(tuple, got)) == sorted([first, first, second, second])


def test_rematching_reads_lines_once(spark, monkeypatch):
    """Names and brands come from one reading of the lines (two before)."""
    read = []
    for m in (catalogue, scopes):
        monkeypatch.setattr(m, "table", lambda s, d, name, of=m.table: (read.append(name), of(s, d, name))[1])
    plans.queries()["rematched_candidates"](spark, SMALL)
    assert read.count("lineitem") == 1


def test_ranges_of_a_chained_fill_grow_in_number(spark, monkeypatch):
    """A range has a bound, however many rows there are."""
    made, kept = [], order.cut
    monkeypatch.setattr(order, "RANGE", 50)
    monkeypatch.setattr(order, "cut", lambda df: (made.append(kept(df)), made[-1])[1])
    k = F.col("id")
    df = spark.range(1000).select((k % 2).alias("process"), k.alias("pos"), F.when(k % 7 > 0, F.floor(k / 9)).alias("idx"), F.when(k % 31 == 0, F.concat(F.lit("n"), k)).otherwise(" ").alias("number"), F.when(k % 5 == 0, k.cast("string")).alias("partner"))
    got = order.fill_chained(df, ["number", "partner"], "idx", "number", ["process"], ["pos"])
    want = order.fill_from_previous(df, ["number", "partner"], "idx", "number", ["process"], ["pos"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert made[0].groupBy("process", "__range").count().agg(F.max("count")).first()[0] <= 100  # ranges are dealt by a sample


def test_suggestions_meet_a_pool_in_rows(spark, monkeypatch):
    """A name meets rows of a pool's names, not each name in a row to be sorted; the result is that of pairs."""
    i = spark.createDataFrame([(1, k, 7, n) for k, n in enumerate(["NUT", "NUTS", "BOLT", None, "NUT", "zz"])], "invoice int, line int, partner int, name string")
    pool = spark.createDataFrame([(7, 9, "NUT"), (7, 8, "NUT"), (7, 7, "BOLTS"), (7, 6, "BOLTE"), (7, 5, None), (7, None, "zz"), (7, 4, "x"), (7, 3, "y"), (8, 1, "zz")], "partner int, product int, name string")
    want = [(1, 0, 8, 100.0), (1, 1, 8, 75.0), (1, 2, 6, 80.0), (1, 4, 8, 100.0)]
    assert "collect_list" in plan_of(purchase.suggested(i, pool, 70.0))
    for size in (512, 2):
        monkeypatch.setattr(purchase, "POOL", size)
        assert sorted(map(tuple, purchase.suggested(i, pool, 70.0).collect())) == want
    by_column = purchase.suggested(i, pool.where("name is not null"), 70.0, similar.name_score).where("line = 4").collect()
    assert [tuple(r) for r in by_column] == [(1, 4, 8, 100.0)]


def test_order_lines_meet_invoices_in_rows(spark):
    """Pairs of lines are neither shuffled nor grouped; ties go to the first line."""
    i = spark.createDataFrame([(1, 7, 2, "NUT"), (1, 7, 1, "NUT"), (1, 7, 3, "BOLT"), (2, 7, 1, "NAIL"), (3, 8, 1, None), (4, 7, 1, None)], "invoice int, partner int, line int, name string")
    p = spark.createDataFrame([(5, 7, 1, "NUT"), (5, 7, 2, "BOLTS"), (6, 7, 1, None), (6, 8, 2, "x")], "order int, partner int, po_line int, name string")
    best = purchase.best_line_per_order_line(i, p)
    s = plan_of(best)
    assert "Aggregate" not in (above := s[: s.index("Join")]) and "Exchange" not in above
    assert sorted(map(tuple, best.collect())) == [(1, 5, 1, 1, 100.0), (1, 5, 2, 3, 80.0), (2, 5, 1, 1, 25.0), (2, 5, 2, 1, 0.0)]
    assert purchase.best_line_per_order_line(i, p, similar.name_score).where("po_line = 1 and invoice = 1").first()["line"] == 1


def test_lines_fit_orders_without_a_table_of_pairs(spark, monkeypatch):
    """Nothing but the rank is shuffled, sorted or hashed after an invoice and an order met as rows; quantities count where 55 is enough."""
    i = spark.createDataFrame([(1, 7, 0, "", "zzzz", 3.0), (1, 7, 1, "", "NUT", 4.0), (1, 7, 1, "", "NUT", 4.0), (1, 7, 2, None, None, None), (2, 7, 0, "B0LT", "qq", 5.0), (3, None, 0, "", "NUT", 1.0), (4, 8, 0, "", "NUT", 1.0)], "invoice int, partner int, line int, code string, name string, qty double")
    p = spark.createDataFrame([(5, 7, 0, "NUT", 3.005), (5, 7, 1, "B0LT", 9.0), (6, 7, 0, None, 3.0), (6, 7, 1, "PIN  X", 0.0), (9, None, 0, "NUT", 1.0)], "order int, partner int, po_line int, name string, qty double")
    by_name = [(1, 5, 2, 200.0, 50.0, 1), (1, 6, 0, 0.0, 0.0, 2), (2, 5, 1, 100.0, 100.0, 1), (2, 6, 0, 0.0, 0.0, 2)]
    with_quantity = [(1, 5, 3, 255.0, 63.8, 1), (1, 6, 0, 0.0, 0.0, 2), (2, 5, 1, 100.0, 100.0, 1), (2, 6, 0, 0.0, 0.0, 2)]
    for at_once in (similar._AT_ONCE, 1):
        monkeypatch.setattr(similar, "_AT_ONCE", at_once)
        for want, limits in ((by_name, (70.0, 75.0)), (with_quantity, (55.0, 75.0))):
            ranked = purchase.fitted_rank(i, p, *limits)
            assert sorted((r.invoice, r["order"], r.matched, r.score, r["mean"], r.nth) for r in ranked.collect()) == want
            above = (s := plan_of(purchase.fitted_rank(i, p, *limits)))[: s.index("Join")]  # the plan is printed from its end
            assert "Aggregate" not in above and above.count("Exchange") == 1


def test_a_plan_and_its_proof_stay_in_a_bills_row(spark):
    """Rows go to their bill once and only links to orders go further; the proof in a bill's row is that of tables, on odd rows too (a second shuffle of the rows and of all changes before)."""
    rows = spark.createDataFrame(
        [
            (1, 0, 7, "1-1", " bolt ", 2, "10.126", 5, 900, True), (1, 1, None, "", "nut", -1, None, None, 900, False), (1, 2, None, "", " ", None, "3", 6, 999, False), (1, 3, None, "", "a", 1, "1", 6, 901, False),
            (2, 0, None, None, None, 1, "1", None, 901, False), (2, 1, 8, "x", "pin", 1, "2.5", None, None, False), (None, 0, 9, "y", "lost", 1, "1", None, 900, True), (4, 0, 7, "4", "new", 1, "1", None, None, False),
        ],
        "invoice long, pos int, partner long, number string, name string, qty int, price string, product long, po_line long, overwrite boolean",
    ).withColumns({"price": F.col("price").cast("decimal(12,3)"), "journal": F.lit(3).cast("long"), "date": F.lit("2/1/2024"), "due": F.lit(""), "unit": F.lit(None).cast("long"), "account": F.lit(40).cast("long"), "order_name": F.lit("P7"), "chosen": F.lit(""), "is_content": F.lit(True)})
    line = "invoice long, id long, sequence int, name string, qty decimal(20,6), price decimal(20,2), product long, account long, po_line long"
    d = lambda x: None if x is None else Decimal(x)
    state = sync.State(
        spark.createDataFrame([(1, 7, 2, None, "2024-01-02", None, "old"), (2, None, None, "kept", None, None, None), (3, 1, 1, "1", None, None, None)], "invoice long, partner long, journal long, number string, date string, due string, origin string"),
        spark.createDataFrame([(1, 12, 1, "bolt", d("2"), d("9"), None, 40, None), (1, 12, 2, "nut", d("1"), d("0"), 77, 40, 900), (1, None, 3, "x", d("1"), d("3"), 6, None, 999), (2, 21, 1, "pin", d("1"), d("1"), None, 40, None), (3, 31, 1, "far", d("1"), d("1"), None, 1, 1)], line),
        spark.createDataFrame([(1, 31, 63, d("5")), (1, 32, 63, d("9")), (1, None, 70, d("4")), (5, 51, 63, d("1"))], "invoice long, id long, tax_id int, amount decimal(18,2)"),
        spark.createDataFrame([(900, d("3")), (901, d("1"))], "po_line long, price decimal(12,2)"),
    )
    expected = spark.createDataFrame([(1, 63, d("9")), (1, 70, d("6")), (1, 81, d("2")), (5, 63, d("2"))], "invoice long, tax_id int, amount decimal(18,2)")
    header = ["partner", "journal", "number", "date", "due"]
    told = lambda df: sorted(map(repr, (tuple(r) for r in df.select("invoice", "step", "nth", "target", "field", "value").collect())))
    plan, left = sync.pending(rows, expected, state, header)
    assert told(plan) == told(sync.composed(rows, expected, state, header, sync.links(rows, state, header)))
    assert told(left) == told(sync.composed(rows, expected, sync.replayed(state, plan), header)) and left.where("target <> 'bill'").count() > 0
    assert {(r.invoice, r.target, r.field, r.value) for r in plan.where("step >= 5").collect()} == {(1, "900", "price", "10.126000"), (1, "31", "amount", "9.00"), (5, "51", "amount", "2.00")}
    s = plan_of(sync.proved(rows.repartition("invoice"), expected, state, header))
    assert "hashpartitioning(invoice#" in s and "__target" not in s and "posexplode" not in s
