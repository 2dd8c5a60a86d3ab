"""Queries on draft bills, their taxes and purchase orders, over the invoices derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bills, order, purchase, tax
from ..sources.files import table
from .catalogue import _BASKET_SQL, _SLOTS_SQL, _STATED_SQL, HEADERS_SQL, _baskets, _slots, _stated
from .proxies import LINES_SQL, headers, lines
from .registered import doubles, query

_LABEL = "case l_linenumber % 6 when 0 then '21' when 1 then 'IVA Exento' when 2 then 'IVA  No Gravado' when 3 then 'IVA No Corresponde' when 4 then '0' else 'no corresponde (C)' end"


@query("tax_labels", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 6 in (1, 2, 3, 5) as zero, l_linenumber % 6 in (0, 1, 2) as carries from lineitem""")
def tax_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("label", F.expr(_LABEL))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bills.explicit_zero(F.col("label")).alias("zero"), bills.carries_tax(F.col("label")).alias("carries"))


@query("line_values", f"""with {LINES_SQL} select invoice, pos, case when l_returnflag = 'N' then 'Línea importada' else l_returnflag || ' x' end as new_name, cast(case when pos % 3 = 0 or pos % 3 = 1 then 1 else qty end as double) as new_qty,
  cast(case when pos % 4 = 1 then 0 else price end as double) as new_price, case when l_partkey % 2 = 0 then nullif(l_partkey, 0) end as product_id, case when l_partkey % 2 = 0 and l_partkey > 0 and l_suppkey % 2 = 0 then nullif(l_suppkey, 0) end as unit_id, nullif(l_suppkey, 0) as account_id from lines""")
def line_values(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("pos") % 3, F.col("pos") % 4
    name = F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.concat("l_returnflag", F.lit("  x")))
    rows = lines(spark, d).withColumns({"name": name, "qty": F.when(p == 0, F.lit(None)).when(p == 1, F.lit(-1)).otherwise(F.col("qty")), "price": F.when(q != 1, F.col("price")), "product": F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).otherwise(0), "unit": F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")), "account": F.col("l_suppkey")})
    return doubles(bills.line_values(rows).select("invoice", "pos", "new_name", "new_qty", "new_price", "product_id", "unit_id", "account_id"), "new_qty", "new_price")


@query("header_values", """select o_orderkey as invoice, o_custkey as partner, 3 as journal, case when o_orderkey % 2 = 0 then '1-' || o_orderkey end as number, case when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') end as date,
  case when o_orderkey % 3 = 0 then '2030-01-02' when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') end as due from orders""")
def header_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = table(spark, d, "orders").select(k.alias("invoice"), F.lit(0).alias("pos"), F.col("o_custkey").alias("partner"), F.lit(3).alias("journal"), F.when(k % 2 == 0, F.concat(F.lit(" 1-"), k.cast("string"))).otherwise(" ").alias("number"), F.when(k % 5 == 4, "31/02/2020").otherwise(F.date_format("o_orderdate", "d/M/yyyy")).alias("date"), F.when(k % 3 == 0, "2030-01-02").otherwise("").alias("due"))
    later = first.select("invoice", F.lit(1).alias("pos"), F.lit(None).cast("long").alias("partner"), "journal", F.lit("9-9").alias("number"), "date", "due")
    return bills.header_values(first.unionByName(later))


#: Taxes of a line: VAT 63 or 57 by its label, and one other tax on some lines; modes by invoice.
_TAX_ROWS = f"""tr as (select invoice, pos, case when pos % 4 = 0 then '21' when pos % 4 = 1 then 'IVA Exento' when pos % 4 = 2 then 'IVA No Corresponde' else '' end as label, case when pos % 4 = 1 then 57 else 63 end as vat,
  case when l_partkey % 3 = 0 then 70 when l_partkey % 3 = 1 then 71 end as other, qty > 5 as is_content, case invoice % 3 when 0 then 'header' when 1 then 'line' else 'mixed' end as mode from lines)"""


def _tax_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, k = F.col("pos") % 4, F.col("l_partkey") % 3
    label = F.when(p == 0, "21").when(p == 1, "IVA Exento").when(p == 2, "IVA No Corresponde").otherwise("")
    ids = F.array_compact(F.array(F.when(p == 1, 57).otherwise(63), F.when(k == 0, 70).when(k == 1, 71)))
    rows = lines(spark, d).select("invoice", "pos", label.alias("label"), ids.alias("ids"), (F.col("qty") > 5).alias("is_content"), F.when(F.col("invoice") % 4 == 0, F.lit(1)).alias("stated"))
    m = F.col("invoice") % 3
    return rows, rows.select("invoice").distinct().withColumn("mode", F.when(m == 0, "header").when(m == 1, "line").otherwise("mixed"))


@query("line_tax_ids", f"""with {LINES_SQL}, {_TAX_ROWS}, f as (select invoice, min(pos) filter (is_content) as first from tr group by 1), o as (select invoice, list(distinct other) filter (other is not null) as others from tr group by 1)
select tr.invoice, pos, array_to_string(list_sort(list_distinct(list_concat(list_concat(case when (pos % 4 = 0 and mode <> 'header') or pos % 4 = 1 then [vat] else [] end, case when other is null then [] else [other] end),
  case when mode <> 'line' and pos = f.first then coalesce(others, []) else [] end))), ',') as ids from tr join f on f.invoice = tr.invoice join o on o.invoice = tr.invoice""")
def line_tax_ids(spark: SparkSession, d: str) -> DataFrame:
    rows, modes = _tax_rows(spark, d)
    made = bills.line_tax_ids(rows, modes, F.array(F.lit(63), F.lit(57)))
    return made.select("invoice", "pos", F.array_join(F.array_sort("tax_ids"), ",").alias("ids"))


@query("reference_rows", f"""with {LINES_SQL}, {_TAX_ROWS} select invoice, pos from tr qualify row_number() over (partition by invoice order by case when is_content and pos % 4 in (0, 1) then 0 when invoice % 4 = 0 then 1 else 2 end, pos) = 1""")
def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    return bills.reference_rows(_tax_rows(spark, d)[0])


@query("tax_line_sides", """with a as (select *, round(coalesce(nullif(abs(c_acctbal), 0), 7), 2) as amt from customer)
select c_custkey, case when c_acctbal < 0 or (c_custkey % 3 = 0) then 0 else amt end as debit, case when c_acctbal < 0 or (c_custkey % 3 = 0) then amt else 0 end as credit, case when c_acctbal < 0 or (c_custkey % 3 = 0) then -amt else amt end as balance from a""")
def tax_line_sides(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal").cast("decimal(18,2)")
    amount = bills.first_amount(F.lit(None).cast("decimal(18,2)"), b, F.lit(7).cast("decimal(18,2)"))
    sides = bills.amount_sides(amount, b, F.lit(1), F.when(F.col("c_custkey") % 3 == 0, 2))
    return doubles(table(spark, d, "customer").select("c_custkey", sides.alias("s")).select("c_custkey", "s.*"), "debit", "credit", "balance")


_KIND = "case l_linenumber % 5 when 0 then 'tax' when 1 then 'line_note' when 2 then 'product' when 3 then 'payment_term' end"


def _move_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice")), "invoice").select("invoice", (F.col("invoice") * 100 + F.col("pos")).alias("id"), (10 - F.col("pos")).alias("sequence"), F.expr("case pos % 5 when 0 then 'tax' when 1 then 'line_note' when 2 then 'product' when 3 then 'payment_term' end").alias("kind"))


@query("move_lines_split", f"""with {LINES_SQL}, k as (select invoice, invoice * 100 + pos as id, pos, pos % 5 = 0 as tax from lines where pos % 5 in (0, 2, 4)) select invoice, id, tax, row_number() over (partition by invoice, tax order by pos desc) - 1 as nth from k""")
def move_lines_split(spark: SparkSession, d: str) -> DataFrame:
    li = _move_lines(spark, d)
    both = [bills.move_lines(li, t).select("invoice", "id", F.lit(t).alias("tax"), "nth") for t in (True, False)]
    return both[0].unionByName(both[1])


#: Expected taxes by invoice and rate; tax lines are there for most of them, some a little off.
_EXPECTED = """e as (select invoice, cast(pct as integer) as tax_id, cast(round(sum(base), 2) as decimal(18,2)) as amount from amounts group by all), p as (select *, invoice * 100 + tax_id as id from e where (invoice + tax_id) % 4 <> 0)"""


def _expected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = tax.line_amounts(lines(spark, d)).groupBy("invoice", F.floor("pct").cast("int").alias("tax_id")).agg(F.round(F.sum("base"), 2).cast("decimal(18,2)").alias("amount"))
    off = F.when(F.col("tax_id") == 21, F.col("amount") - 1).when(F.col("tax_id") == 27, F.col("amount") + F.lit("0.02").cast("decimal(4,2)")).otherwise(F.col("amount")).cast("decimal(18,2)")
    have = e.where((F.col("invoice") + F.col("tax_id")) % 4 != 0).select("invoice", "tax_id", (F.col("invoice") * 100 + F.col("tax_id")).alias("id"), off.alias("amount"))
    return e, have


@query("tax_amount_overwrites", f"""with {LINES_SQL}, {_EXPECTED.replace("cast(pct as integer)", "cast(floor(pct) as integer)")} select e.invoice, p.id as line_id, e.tax_id, cast(p.amount - 1 as double) as present, cast(e.amount as double) as amount, case when p.id is null then 'no line' else '' end as note
from e left join p on p.invoice = e.invoice and p.tax_id = e.tax_id where p.id is null or e.tax_id = 21""")
def tax_amount_overwrites(spark: SparkSession, d: str) -> DataFrame:
    e, have = _expected(spark, d)
    return doubles(bills.tax_amounts(have, e), "present", "amount")


@query("missing_tax_actions", f"""with {LINES_SQL}, {_EXPECTED.replace("cast(pct as integer)", "cast(floor(pct) as integer)")}, m as (select invoice, list_sort(list(tax_id)) as absent from e where (invoice + tax_id) % 4 = 0 group by 1),
f as (select *, case invoice % 3 when 0 then absent when 1 then [99] else list_concat(absent, [98]) end as ids, list_concat(absent, case when invoice % 6 = 2 then [98] else []::integer[] end) as wanted from m)
select invoice, invoice * 100 as line_id, case when len(list_filter(absent, lambda x: not list_contains(ids, x))) > 0 then 'add' when list_sort(list_distinct(wanted)) = list_sort(list_distinct(ids)) then 'recompute' else 'replace' end as action,
  array_to_string(case when len(list_filter(absent, lambda x: not list_contains(ids, x))) > 0 then absent when list_sort(list_distinct(wanted)) = list_sort(list_distinct(ids)) then []::integer[] else absent end, ',') as new_ids from f""")
def missing_tax_actions(spark: SparkSession, d: str) -> DataFrame:
    e, have = _expected(spark, d)
    gone = e.where((F.col("invoice") + F.col("tax_id")) % 4 == 0).groupBy("invoice").agg(F.array_sort(F.collect_list("tax_id")).alias("a"))
    k = F.col("invoice") % 3
    ids = F.when(k == 0, F.col("a")).when(k == 1, F.array(F.lit(99))).otherwise(F.concat("a", F.array(F.lit(98))))
    wanted = F.when(F.col("invoice") % 6 == 2, F.concat("a", F.array(F.lit(98)))).otherwise(F.col("a"))
    first = gone.select("invoice", (F.col("invoice") * 100).alias("id"), ids.alias("ids"), wanted.alias("wanted"))
    return bills.missing_taxes(first, e, have).select("invoice", "line_id", "action", F.array_join("ids", ",").alias("new_ids"))


#: A line belongs to the order line of its part; every third invoice asks for its prices, and some order lines are gone.
@query("order_price_overwrites", f"""with {LINES_SQL}, w as (select l_partkey as po_line, price from lines where qty > 2 and invoice in (select invoice from lines where pos = 0 and invoice % 3 = 0) qualify row_number() over (partition by l_partkey order by invoice desc, pos desc) = 1)
select po_line, case when p_size % 5 > 0 then cast(p_retailprice as double) end as present, cast(price as double) as price, case when p_size % 5 > 0 then '' else 'gone' end as note from w left join part on p_partkey = po_line where p_size % 5 = 0 or p_partkey is null or abs(cast(p_retailprice as decimal(12,2)) - price) > 0.001""")
def order_price_overwrites(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("invoice", "pos", "price", F.col("l_partkey").alias("po_line"), (F.col("qty") > 2).alias("is_content"), ((F.col("pos") == 0) & (F.col("invoice") % 3 == 0)).alias("overwrite"))
    have = table(spark, d, "part").where("p_size % 5 > 0").select(F.col("p_partkey").alias("po_line"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return doubles(bills.order_prices(rows, have), "present", "price")


def _prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = lines(spark, d).select("invoice", "pos", F.when(F.col("pos") == 0, F.concat(F.lit("n"), F.col("invoice").cast("string"))).otherwise("").alias("number"), (F.col("l_suppkey") % 4).alias("po_line"))
    known = spark.createDataFrame([(0,), (1,), (2,)], "po_line long")
    return bills.prepared(rows, known, ["number"])


_PREPARED_SQL = f"with {LINES_SQL}, r as (select invoice, pos, l_suppkey % 4 as was, row_number() over (partition by invoice, l_suppkey % 4 order by pos) as n from lines)"


@query("import_prepared", _PREPARED_SQL + " select invoice, pos, 'n' || invoice as number, case when was < 3 and n = 1 then was end as po_line from r")
def import_prepared(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d)[0].select("invoice", "pos", "number", "po_line")


@query("import_notes", _PREPARED_SQL + " select invoice, pos, case when was = 3 then 'order line gone' else 'order line used before' end as note from r where was = 3 or n > 1")
def import_notes(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d)[1]


_PLAN_SQL = f"""with {LINES_SQL}, c as (select o_orderkey as invoice, 0 as step, 'bill' as target, 'origin' as field, 'P' || o_custkey as value from orders where o_orderkey % 2 = 0
  union all select invoice, 2, cast(pos as varchar), 'name', l_returnflag from lines where pos < 2 union all select invoice, 2, cast(pos as varchar), 'qty', cast(qty as varchar) from lines where pos = 1
  union all select invoice, 3, cast(pos as varchar), 'po_line', cast(l_partkey as varchar) from lines where pos = 0 union all select invoice, 6, cast(cast(pct as integer) as varchar), 'amount', cast(cast(sum(base) as decimal(18,2)) as varchar) from amounts where pct in (21, 27) group by invoice, pct)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("invoice"), F.lit("bill").alias("target"), F.lit("origin").alias("field"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("value"))
    one = lambda rows, field, value: rows.select("invoice", F.col("pos").alias("target"), F.lit(field).alias("field"), value.cast("string").alias("value"))
    content = one(li.where("pos < 2"), "name", F.col("l_returnflag")).unionByName(one(li.where("pos = 1"), "qty", F.col("qty")))
    amounts = tax.line_amounts(li.where("pct in (21, 27)")).groupBy("invoice", F.col("pct").cast("int").alias("target")).agg(F.sum("base").cast("decimal(18,2)").cast("string").alias("value")).withColumn("field", F.lit("amount"))
    return bills.change_plan({"header": o, "content": content, "link": one(li.where("pos = 0"), "po_line", F.col("l_partkey")), "tax amount": amounts})


@query("import_plan", _PLAN_SQL + " select *, row_number() over (partition by invoice order by step, target, field) - 1 as nth from c")
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query("import_summary", _PLAN_SQL + """ select invoice, count(distinct case when step = 0 then target end) as header, 0 as maturity, count(distinct case when step = 2 then target end) as content, count(distinct case when step = 3 then target end) as link, 0 as reapply, 0 as order_price, count(distinct case when step = 6 then target end) as tax_amount from c group by invoice""")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    return bills.plan_summary(_plan(spark, d))


# Breakdown with stated amounts, other taxes


@query("stated_breakdown", HEADERS_SQL + _STATED_SQL + """, k as (select invoice, pct from own where pct is not null union select invoice, pct from st), n as (select invoice, count(*) as keys from k group by 1),
x as (select k.invoice, k.pct, n.keys, f.mode, f.hv, f.fixed, coalesce(case when f.mode = 'line' then own.e else own.s end, 0) as sug, coalesce(st.amount, 0) as stv from k join n on n.invoice = k.invoice join f on f.invoice = k.invoice
  left join own on own.invoice = k.invoice and own.pct = k.pct left join st on st.invoice = k.invoice and st.pct = k.pct)
select invoice, case pct when 10.5 then '10.5' else cast(cast(pct as integer) as varchar) end as rate, cast(round(case when mode = 'line' and not fixed then sug when stv > 0 then stv when hv > 0 and keys = 1 then hv else sug end, 2) as double) as amount, cast(round(sug, 2) as double) as suggested,
  row_number() over (partition by invoice order by pct desc) - 1 as nth from x
union all select f.invoice, '_total', cast(f.hv as double), cast(f.hv as double), 0 from f where f.hv > 0 and f.invoice not in (select invoice from k)""")
def stated_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return doubles(tax.stated_breakdown(*_stated(spark, d)), "amount", "suggested")


@query("totals_with_others", HEADERS_SQL + f""", {_SLOTS_SQL}, o as (select invoice, sum(amount) as x from slots group by 1)
select m.invoice, cast(coalesce(o.x, 0) as double) as others, cast(tb + tv + coalesce(o.x, 0) as double) as total, cast(round(coalesce(case when sub > 0 then cast(sub as decimal(24,4)) end, bases) + coalesce(hv, 0) + coalesce(o.x, 0), 2) as double) as total_stated
from (select m.*, cast(round(case when mode = 'header' and coalesce(sub, 0) > 0 then sub else bases end, 2) as decimal(18,2)) as tb, cast(case when mode = 'line' then round(e, 2) else coalesce(a, hv, 0) end as decimal(18,2)) as tv
  from m left join (select invoice, sum(amount) as a from split group by 1) x on m.invoice = x.invoice) m left join o on o.invoice = m.invoice""")
def totals_with_others(spark: SparkSession, d: str) -> DataFrame:
    found = tax.grand_totals(tax.totals(lines(spark, d), headers(spark, d)), _slots(spark, d))
    return doubles(found.select("invoice", "others", "total", "total_stated"), "others", "total", "total_stated")


@query("slot_tax_ids", f"""with {_SLOTS_SQL}, s as (select *, case when label <> 'P. IIBB CABA' then row_number() over (partition by invoice order by label = 'P. IIBB CABA', slot) end as n from slots)
select invoice, slot, case when label = 'P. IIBB CABA' then 70 when n = 1 then 81 else 82 end as tax_id, cast(amount as double) as amount from s where label = 'P. IIBB CABA' or n <= case when invoice % 2 = 0 then 2 else 1 end""")
def slot_tax_ids(spark: SparkSession, d: str) -> DataFrame:
    s = _slots(spark, d).withColumn("pos", F.lit(0))
    own = s.select("invoice", "pos").distinct().withColumn("ids", F.when(F.col("invoice") % 2 == 0, F.array(F.lit(81), F.lit(82))).otherwise(F.array(F.lit(81))))
    labels = spark.createDataFrame([("P. IIBB CABA", 70)], "label string, tax_id int")
    return doubles(tax.slot_ids(s, labels, own).select("invoice", "slot", "tax_id", "amount"), "amount")


@query("line_flags", f"with {LINES_SQL} select invoice, coalesce(bool_and(pct > 0), false) as all_rated, coalesce(bool_and(pct = 0), false) as all_zero from lines group by invoice")
def line_flags(spark: SparkSession, d: str) -> DataFrame:
    return tax.line_flags(lines(spark, d).withColumn("zero", F.col("pct") == 0))


@query("cleared_footers", HEADERS_SQL + ", z as (select invoice from lines group by 1 having bool_and(pct = 0)) select h.invoice, cast(case when z.invoice is null then hv end as double) as vat, cast(sub as double) as subtotal, z.invoice is not null as cleared from h left join z on z.invoice = h.invoice")
def cleared_footers(spark: SparkSession, d: str) -> DataFrame:
    return doubles(tax.cleared_footers(lines(spark, d).withColumn("zero", F.col("pct") == 0), headers(spark, d)), "vat", "subtotal")


# Groups of rows


@query("invoice_keys", f"with {LINES_SQL} select invoice, pos, case when pos % 3 = 0 then 'idx:' || invoice when pos % 3 = 1 then 'doc:' || l_suppkey else 'row:' || pos end as key from lines")
def invoice_keys(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pos") % 3
    number = F.when(p == 1, F.concat(F.col("l_suppkey").cast("string"), F.lit(" "))).otherwise("  ")
    return lines(spark, d).select("invoice", "pos", order.invoice_key(F.when(p == 0, F.col("invoice")), number, F.col("pos")).alias("key"))


@query("runs_by_number", f"with {LINES_SQL} select invoice, pos, sum(case when pos = 0 or l_returnflag = 'R' then 1 else 0 end) over (partition by invoice order by pos rows unbounded preceding) as run from lines")
def runs_by_number(spark: SparkSession, d: str) -> DataFrame:
    return order.runs_by_number(lines(spark, d).withColumn("number", F.when(F.col("l_returnflag") == "R", "x").otherwise(" ")), "number", ["invoice"], ["pos"]).select("invoice", "pos", "run")


@query("first_line_account", f"with {LINES_SQL} select invoice, arg_min(l_suppkey, pos) as account from lines where l_returnflag <> 'N' group by invoice")
def first_line_account(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("account", F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")))
    return order.first_per_key(rows.where("account is not null"), ["invoice"], ["pos"]).select("invoice", "account")


# Purchase orders


_RANK_SQL = _BASKET_SQL.rstrip() + """, r as (select invoice, po, row_number() over (partition by invoice order by matched desc, score desc, po) as nth from e)"""


@query("selected_order", _RANK_SQL + """ select invoice, po as "order", nth <> 1 as kept from (select *, max(nth) over (partition by invoice) as last from r) where nth = case when invoice % 2 = 0 and last >= 2 then 2 else 1 end""")
def selected_order(spark: SparkSession, d: str) -> DataFrame:
    """Every second invoice has a saved choice: the second candidate where there is one, else an order that is gone."""
    invoices, orders = _baskets(spark, d)
    ranked = purchase.basket_rank(invoices.drop("qty"), orders.drop("qty"))
    saved = ranked.where("invoice % 2 = 0").groupBy("invoice").agg(F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("order"))), F.lit(-1)).alias("order"))
    return purchase.selected_order(ranked, saved)


@query("order_commands", """with c as (select user_id, event_type as a, event_id, row_number() over (partition by user_id order by event_id desc) as n from events)
select c_custkey as invoice, case when a is null then c_nationkey when a = 'click' then event_id end as "order", case when a is null then c_name end as note, coalesce(a = 'purchase', false) as rematch from customer left join c on user_id = c_custkey and n = 1""")
def order_commands(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "customer").select(F.col("c_custkey").alias("invoice"), F.col("c_nationkey").cast("long").alias("order"), F.col("c_name").alias("note"))
    action = F.when(F.col("event_type") == "click", "select").when(F.col("event_type") == "purchase", "rematch").otherwise("clear")
    given = table(spark, d, "events").select(F.col("user_id").alias("invoice"), F.col("event_id").alias("seq"), action.alias("action"), F.col("event_id").alias("order"))
    return purchase.commanded(state, given, ["note"])


_PAIRS_SQL = """with i as (select l_orderkey as invoice, o_custkey as partner, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) as line, upper(p_name) as name, l_partkey as product, o_orderstatus as st from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey),
s as (select a.invoice, a.line, b.invoice as po, b.line as po_line, b.product, round(100.0 * (1 - levenshtein(a.name, b.name) / cast(greatest(length(a.name), length(b.name)) as double)), 4) as score from i a join i b on a.partner = b.partner where a.st = 'F' and b.st = 'P')"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("partner"), "o_orderstatus")
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("name")), F.col("p_partkey") == F.col("l_partkey"))
    li = order.numbered(li, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "line", 1).select(F.col("l_orderkey").alias("order"), "line", "name", F.col("l_partkey").alias("product"))
    both = o.join(li, "order")
    return both.where("o_orderstatus = 'F'").withColumnRenamed("order", "invoice"), both.where("o_orderstatus = 'P'").withColumnRenamed("line", "po_line")


@query("product_suggestions", _PAIRS_SQL + " select invoice, line, product, score from s where score >= 70 qualify row_number() over (partition by invoice, line order by score desc, product) = 1")
def product_suggestions(spark: SparkSession, d: str) -> DataFrame:
    invoices, orders = _pairs(spark, d)
    return purchase.suggested(invoices, orders.select("partner", "product", "name"), 70.0)


@query("best_line_per_order_line", _PAIRS_SQL + """ select invoice, po as "order", po_line, line, score from s qualify row_number() over (partition by invoice, po, po_line order by score desc, line) = 1""")
def best_line_per_order_line(spark: SparkSession, d: str) -> DataFrame:
    return purchase.best_line_per_order_line(*_pairs(spark, d))


@query("matching_summary", f"with {LINES_SQL} select count(distinct l_suppkey) as partners, count(*) as rows_total, count(case when l_partkey % 3 > 0 then 1 end) as rows_matched from lines where qty > 3")
def matching_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select(F.col("l_suppkey").alias("partner"), (F.col("qty") > 3).alias("is_content"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("po_line"))
    return purchase.matching_summary(rows)
