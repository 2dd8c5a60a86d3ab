"""All registered queries of the library, each beside the SQL it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, similar, text
from ..operators import bills, changes, doctypes, documents, lookup, order, purchase, registry, state, tax, taxids, validation
from ..sources.files import cut, read_csv, scan, scratch, table, write_csv
from ..streaming.autosave import autosaves, to_table
from .proxies import LINE_ORDER, LINES_SQL, headers, lines
from .registered import doubles, query

#: Header sums and modes for the oracle; whole numbers of ten-thousandths keep sums exact.
HEADERS_SQL = f"""with {LINES_SQL}, sums as (
  select invoice, sum(cast(qty * price as decimal(20,4)) * cast(pct as decimal(6,2))) as v, sum(base) as b, count(*) as filled,
    sum(case when pct > 0 then 1 else 0 end) as rated,
    sum(case when vat > 0 then cast(vat as decimal(24,6)) else cast(cast(qty * price as decimal(20,4)) * pct as decimal(26,6)) * cast(0.01 as decimal(3,2)) end) as e,
    sum(case when pct > 0 and vat > 0 and base > 0 and abs(vat - base * pct / 100) > greatest(0.02, base * pct / 100000) then 1 else 0 end) as edited
  from amounts group by invoice
), h as (
  select o_orderkey as invoice, coalesce(edited, 0) as edited, b, coalesce(filled, 0) as filled, coalesce(rated, 0) as rated, coalesce(e, 0) as e, coalesce(b, 0) as bases,
    cast(round(cast(v as decimal(30,6)) * case o_orderkey % 4 when 0 then cast(1 as decimal(6,4)) when 1 then cast(1.0005 as decimal(6,4)) when 2 then cast(1.05 as decimal(6,4)) end * cast(0.01 as decimal(3,2)), 2) as decimal(18,2)) as hv,
    case when o_orderkey % 5 <> 0 then cast(round(b, 2) as decimal(18,2)) end as sub
  from orders left join sums on o_orderkey = invoice
), m as (
  select *, case when coalesce(hv, 0) <= 0 and rated = 0 then 'header' when coalesce(hv, 0) <= 0 then 'line' when rated = 0 then 'header'
    when abs(e - hv) <= greatest(0.02, hv * 0.001) then 'line' when filled = 1 and edited = 0 then 'header' when filled = 1 then 'line' else 'mixed' end as mode from h
), rates as (
  select invoice, pct, sum(cast(cast(qty * price as decimal(20,4)) * pct as decimal(26,6)) * cast(0.01 as decimal(3,2))) as s,
    sum(case when vat > 0 then cast(vat as decimal(24,6)) else cast(cast(qty * price as decimal(20,4)) * pct as decimal(26,6)) * cast(0.01 as decimal(3,2)) end) as e
  from amounts where pct > 0 group by all
), split as (
  select r.invoice, r.pct, cast(round(case when m.mode = 'line' then r.e when m.hv > 0 and count(*) over (partition by r.invoice) = 1 then m.hv else r.s end, 2) as decimal(18,2)) as amount
  from rates r join m on r.invoice = m.invoice
)"""


# Taxes and totals


@query("invoice_totals", HEADERS_SQL + """ select m.invoice, m.mode, cast(tb as double) as base, cast(tv as double) as vat, cast(tb + tv as double) as total,
  cast(round(coalesce(case when sub > 0 then cast(sub as decimal(24,4)) end, bases) + coalesce(hv, 0), 2) as double) as total_stated,
  m.mode <> 'header' and coalesce(sub, 0) > 0 and abs(sub - bases) > greatest(0.02, sub * 0.001) as base_differs, mode = 'mixed' as vat_differs
from (select m.*, cast(round(case when mode = 'header' and coalesce(sub, 0) > 0 then sub else bases end, 2) as decimal(18,2)) as tb,
  cast(case when mode = 'line' then round(e, 2) else coalesce(a, hv, 0) end as decimal(18,2)) as tv
  from m left join (select invoice, sum(amount) as a from split group by 1) x on m.invoice = x.invoice) m""")
def invoice_totals(spark: SparkSession, d: str) -> DataFrame:
    return doubles(tax.totals(lines(spark, d), headers(spark, d)), "base", "vat", "total", "total_stated")


@query("tax_mode_counts", HEADERS_SQL + " select mode, count(*) as invoices from m group by mode")
def tax_mode_counts(spark: SparkSession, d: str) -> DataFrame:
    return tax.modes(lines(spark, d), headers(spark, d)).groupBy("mode").agg(F.count("*").alias("invoices"))


@query("vat_breakdown_by_rate", HEADERS_SQL + " select invoice, cast(pct as double) as pct, cast(amount as double) as amount from split")
def vat_breakdown_by_rate(spark: SparkSession, d: str) -> DataFrame:
    return doubles(tax.breakdown(lines(spark, d), headers(spark, d)), "pct", "amount")


@query("inflated_amount_repair", f"""with {LINES_SQL}, h as (select invoice, cast(round(max(price), 2) as decimal(18,2)) as sub from lines group by 1)
select l.invoice, l.pos, cast(case when qty * price > cap and price <= cap then 1 when qty * price > cap and qty > cap then null else qty end as double) as new_qty,
  cast(case when qty * price > cap and price > cap and qty <= cap then round(sub / qty, 2) when qty * price > cap and price > cap then null else price end as double) as new_price
from (select l.*, sub, cast(sub * 1.001 + 0.02 as decimal(24,6)) as cap from lines l join h on l.invoice = h.invoice) l""")
def inflated_amount_repair(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    made = tax.repair_inflated(li, li.groupBy("invoice").agg(F.max("price").cast("decimal(18,2)").alias("subtotal")))
    return doubles(made.select("invoice", "pos", "new_qty", "new_price"), "new_qty", "new_price")


@query("invoice_collapse", f"""with {LINES_SQL}, s as (select invoice, sum(base) as b, count(*) as n from amounts group by invoice having count(*) > 1)
select invoice, 1 as qty, cast(case when invoice % 5 <> 0 then round(b, 2) else b end as double) as price, n as lines from s""")
def invoice_collapse(spark: SparkSession, d: str) -> DataFrame:
    return doubles(tax.collapsed(lines(spark, d), headers(spark, d)), "price")


@query("qty_price_derivation", """with c as (select *, cast(round(l_extendedprice * 100) as bigint) as cents, cast(l_quantity as bigint) as q from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when l_linenumber % 3 = 2 then 1 else l_quantity end as double) as qty,
  case when l_linenumber % 3 <> 1 then l_extendedprice else (2 * cents + q) // (2 * q) / 100.0 end as price from c""")
def qty_price_derivation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 3
    net = F.col("l_extendedprice").cast("decimal(20,2)")
    qty, price = numbers.quantity_and_price(F.when(k != 2, F.col("l_quantity").cast("decimal(20,2)")), F.when(k == 0, net), net)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", qty.cast("double").alias("qty"), price.cast("double").alias("price"))


# Numbers, dates and texts

_STYLES = """case l_orderkey % 5 when 0 then {v} when 1 then replace({v}, '.', ',') when 3 then concat(cast(floor(l_extendedprice) as bigint), '.7,', substring({v}, length({v}) - 1, 2))
  when 4 then concat('$ ', {v}) else concat(cast(floor(l_extendedprice / 1000) as bigint), '.', lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as string), 3, '0'), ',', substring({v}, length({v}) - 1, 2)) end"""


@query("amount_parse_loose", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_orderkey % 5 <> 4 then l_extendedprice end as amount from lineitem")
def amount_parse_loose(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    shown = F.expr(_STYLES.format(v="cast(cast(l_extendedprice as decimal(12,2)) as string)"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.loose_amount(shown).cast("double").alias("amount"))


@query("amount_parse", "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as amount from orders")
def amount_parse(spark: SparkSession, d: str) -> DataFrame:
    shown = F.replace(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), F.lit("."), F.lit(","))
    return table(spark, d, "orders").select("o_orderkey", numbers.amount(F.when(F.col("o_orderkey") % 7 == 0, F.concat(shown, F.lit("x"))).otherwise(shown)).cast("double").alias("amount"))


@query("amount_format", """select o_orderkey, replace(regexp_replace(regexp_replace(cast(cast(o_totalprice as decimal(14,2)) as varchar), '0+$', ''), '\\.$', ''), '.', ',') as screen,
  cast(cast(o_totalprice as decimal(14,2)) as varchar) as csv from orders""")
def amount_format(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice").cast("decimal(14,2)")
    return table(spark, d, "orders").select("o_orderkey", numbers.for_screen(v).alias("screen"), numbers.for_csv(v, True).alias("csv"))


@query("vat_rate", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_tax, 4) as double) + 0.0 as rate from lineitem")
def vat_rate(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.replace((F.col("l_tax") * 100).cast("decimal(6,1)").cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(numbers.rate(shown).cast("double"), 4).alias("rate"))


@query("date_normalise", "select o_orderkey, case when o_orderkey % 5 = 4 then '31/02/2020' else strftime(o_orderdate, '%d/%m/%Y') end as screen, case when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') end as iso from orders")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    shown = F.when(k == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 4, "31/02/2020").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", dates.for_screen(shown).alias("screen"), dates.iso(shown).alias("iso"))


@query("docnum_normalise", "select o_orderkey, lpad(cast(o_orderkey % 90000 as varchar), 5, '0') || '-' || lpad(cast(o_orderkey as varchar), 8, '0') as number from orders")
def docnum_normalise(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("o_orderkey") % 90000).cast("string"), F.col("o_orderkey").cast("string")
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(a, F.lit(" - "), b)).otherwise(F.concat(F.lpad(a, 5, "0"), F.lpad(b, 8, "0")))
    return table(spark, d, "orders").select("o_orderkey", text.document_number(shown).alias("number"))


@query("doctype_label", "select o_orderkey, case o_orderkey % 4 when 0 then 'FACTURAS A' when 1 then 'FACTURAS B' when 2 then 'FACTURAS C' else 'OC-X' end as label from orders")
def doctype_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", text.document_type(F.when(k == 0, " factura  a").when(k == 1, "Facturas B").when(k == 2, "c").otherwise("remito")).alias("label"))


@query("text_normalise", """select doc_id, coalesce(trim(regexp_replace(text, '[\\s\\v\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), '') as clean from documents""")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("clean"))


@query("digits_only", "select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits, upper(c_mktsegment) as folded from customer")
def digits_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.digits(F.col("c_name")).alias("digits"), text.accent_fold(F.translate("c_mktsegment", "AEIOU", "ÁÉÍÓÚ")).alias("folded"))


@query("qty_um_from_text", "select p_partkey, cast(p_size as varchar) || '.5' as qty, case p_partkey % 3 when 0 then 'kg' when 1 then 'L' else 'Units' end as unit from part")
def qty_um_from_text(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("Caja x "), F.col("p_size").cast("string"), F.lit(",5 "), F.when(F.col("p_partkey") % 3 == 0, "Kilos").when(F.col("p_partkey") % 3 == 1, "litros").otherwise("unidades"), F.lit(" de "), F.col("p_name"))
    qty, unit = text.quantity_and_unit(shown)
    return table(spark, d, "part").select("p_partkey", qty.alias("qty"), unit.alias("unit"))


#: A name with a slash before its third word and an accented one behind; one letter of each word may be read as a number.
@query("ocr_repair", """select p_partkey, upper(split_part(p_name, ' ', 1)) || ' ' || upper(split_part(p_name, ' ', 2)) || '/' || upper(split_part(p_name, ' ', 3)) || '-CAFÉO' as name from part""")
def ocr_repair(spark: SparkSession, d: str) -> DataFrame:
    words = [F.upper(F.coalesce(F.get(F.split("p_name", " "), F.lit(k)), F.lit(""))) for k in range(3)]
    spoilt = [F.when((F.length(w) >= 4) & w.rlike("^[A-Z]+$"), F.regexp_replace(w, "^([^O]*)O([^O]*)$", "$10$2")).otherwise(w) for w in words]
    shown = F.concat(spoilt[0], F.lit(" "), spoilt[1], F.lit("/"), spoilt[2], F.lit("-café0"))
    return table(spark, d, "part").select("p_partkey", text.repair_scan(shown).alias("name"))


@query("desc_tokens", "select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(upper(p_name || '/' || p_type), '[\\s/\\-]+'), lambda w: length(w) >= 3))), ' ') as tokens from part")
def desc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.tokens(F.concat_ws("/", "p_name", "p_type"))), " ").alias("tokens"))


# Order


@query("line_running_number", f"with {LINES_SQL} select invoice, pos, l_partkey, l_suppkey from lines")
def line_running_number(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("invoice", "pos", "l_partkey", "l_suppkey")


@query("first_content_line", f"with {LINES_SQL} select invoice, min(pos) as first_pos from lines where l_returnflag <> 'N' group by invoice")
def first_content_line(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where("l_returnflag <> 'N'").groupBy("invoice").agg(F.min("pos").alias("first_pos"))


_MASKED = f"with {LINES_SQL}, masked as (select invoice, pos, case when pos % 3 = 1 then cast(l_suppkey as varchar) else '' end as partner, case when pos = 0 then cast(invoice as varchar) else '' end as number from lines)"


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("invoice", "pos", F.when(F.col("pos") % 3 == 1, F.col("l_suppkey").cast("string")).otherwise("").alias("partner"), F.when(F.col("pos") == 0, F.col("invoice").cast("string")).otherwise("").alias("number"))


@query("fill_prev", _MASKED + " select invoice, pos, coalesce(last_value(nullif(partner, '') ignore nulls) over (partition by invoice order by pos rows unbounded preceding), '') as partner from masked")
def fill_prev(spark: SparkSession, d: str) -> DataFrame:
    m = _masked(spark, d).withColumn("part", F.col("invoice"))
    return order.fill_from_previous(m, ["partner"], "invoice", "number", ["part"], ["pos"]).select("invoice", "pos", "partner")


@query("fill_first", _MASKED + " select invoice, pos, coalesce(nullif(number, ''), first_value(number) over (partition by invoice order by pos), '') as number from masked")
def fill_first(spark: SparkSession, d: str) -> DataFrame:
    return order.fill_from_first(_masked(spark, d), ["number"], ["invoice"], ["pos"]).select("invoice", "pos", "number")


@query("fill_any", _MASKED + ", one as (select invoice, arg_min(partner, pos) as p from masked where partner <> '' group by invoice) select m.invoice, m.pos, coalesce(p, '') as partner from masked m left join one on m.invoice = one.invoice")
def fill_any(spark: SparkSession, d: str) -> DataFrame:
    return order.spread_first_filled(_masked(spark, d), ["partner"], ["invoice"], ["pos"]).select("invoice", "pos", "partner")


@query("islands", """with f as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id))
select event_id, user_id, event_type, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from f""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    return order.islands(table(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "island")


@query("greedy_one_to_one", f"with {LINES_SQL} select invoice, pos, case when row_number() over (partition by invoice, l_suppkey % 3 order by pos) = 1 then l_suppkey % 3 end as target from lines")
def greedy_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("invoice", "pos", (F.col("l_suppkey") % 3).alias("target"))
    return order.one_to_one(li, "target", ["invoice"], ["pos"])


@query("registry_latest_per_partner", "select o_custkey, o_orderkey, o_orderdate, n_name from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where r = 1")
def registry_latest_per_partner(spark: SparkSession, d: str) -> DataFrame:
    one = order.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return one.join(named, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "o_orderdate", "n_name")


# Lookups


@query("lookup_first_wins", "select s_suppkey, (select min(c_custkey) from customer where c_nationkey = s_nationkey) as found from supplier")
def lookup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("k"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("k"))
    return lookup.exact(s, c, "k", {"c_custkey": "found"}, ["c_custkey"]).select("s_suppkey", "found")


@query("lookup_last_wins", "select s_suppkey, (select max(c_custkey) from customer where c_nationkey = s_nationkey) as found from supplier")
def lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("k"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("k"))
    return lookup.exact(s, c, "k", {"c_custkey": "found"}, [F.desc("c_custkey")]).select("s_suppkey", "found")


@query("account_resolution", """with a as (select distinct 1000 + cast(regexp_extract(p_brand, '[0-9]+') as integer) as id, regexp_extract(p_brand, '[0-9]+') as code, upper(p_brand) as name from part)
select p_partkey, coalesce((select max(id) from a where name = upper(p_brand)), (select max(id) from a where code = cast(p_size as varchar))) as account_id from part""")
def account_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    code = F.regexp_extract("p_brand", "[0-9]+", 0)
    accounts = p.select((code.cast("int") + 1000).alias("id"), code.alias("code"), F.col("p_brand").alias("name")).distinct()
    probe = p.select("p_partkey", F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand").alias("label"))
    return lookup.account(probe, "label", accounts).select("p_partkey", "account_id")


@query("fuzzy_top1", """with t as (select n_nationkey as id, upper(n_name) as r from nation), q as (select n_nationkey as key, upper(n_name) || 'X' as q from nation),
s as (select key, id, round(100.0 * (1 - levenshtein(q, r) / cast(greatest(length(q), length(r)) as double)), 4) as score from q, t)
select key, id, score from s where score >= 65 qualify row_number() over (partition by key order by score desc, id) = 1""")
def fuzzy_top1(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    probe = n.select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit("x")).alias("name"))
    return lookup.best_match(probe, "key", "name", n, "n_nationkey", "n_name", 65.0)


@query("partner_hierarchy", "select c_custkey, r_name as head from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def partner_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("head"))
    up = table(spark, d, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, d, "customer").join(up, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "head")


# Process documents

_USED = "o_orderkey % 10 <> 3"


def _processes(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("l_returnflag").alias("descripcion"), F.col("qty").cast("string").alias("cantidad"), F.col("price").cast("string").alias("precio_unitario"))
    items = lines(spark, d).groupBy("invoice").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]).alias("items"))
    j = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("invoice"), "left")
    f = F.struct(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("numero_factura"), F.struct(F.col("o_custkey").cast("string").alias("cuit")).alias("proveedor"), F.coalesce("items", F.array().cast("array<struct<descripcion:string,cantidad:string,precio_unitario:string>>")).alias("items")).alias("factura")).alias("json"))
    doc = F.to_json(F.struct(F.array(f).alias("facturas")))
    k = F.col("o_orderkey") % 10
    twice = F.regexp_extract(F.to_json(F.struct(doc.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return j.select(F.col("o_orderkey").alias("process"), F.when(k == 1, twice).when((k == 3) & (F.col("o_orderkey") % 20 == 3), " ").when(k == 3, '["x"').otherwise(doc).alias("json_data"))


@query("process_json_lines", f"""with {LINES_SQL} select o_orderkey as process, 0 as invoice, cast(coalesce(pos, 0) as integer) as line, cast(o_orderkey as varchar) as number, cast(o_custkey as varchar) as cuit, l_returnflag as description,
  cast(qty as varchar) as quantity, cast(price as varchar) as price from orders left join lines on lines.invoice = o_orderkey where {_USED}""")
def process_json_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.lines(_processes(spark, d)).select("process", "invoice", "line", "number", "cuit", "description", "quantity", "price")


@query("json_rejects", "select o_orderkey as process, case when o_orderkey % 20 = 3 then 'blank' else 'not an object' end as reason from orders where o_orderkey % 10 = 3")
def json_rejects(spark: SparkSession, d: str) -> DataFrame:
    return documents.rejects(_processes(spark, d))


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


# Purchase orders


@query("po_recent_lines", "with o as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) select o_custkey as partner, o_orderkey as \"order\", l_linenumber, l_partkey, l_suppkey, l_quantity from o join lineitem on l_orderkey = o_orderkey where r <= 12")
def po_recent_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("partner"), F.col("o_orderdate").alias("date"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return purchase.recent_lines(o, li).select("partner", "order", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


#: A finished order is an invoice, any other one a purchase order; each partner's latest twelve take part.
_BASKET_SQL = """with n as (select l_orderkey as o, o_custkey as partner, o_orderstatus as st, o_orderdate as dt, upper(p_name) as name, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) as line
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey),
last as (select o_orderkey from orders where o_orderstatus <> 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 12),
met as (select i.o as invoice, p.o as po, i.line, max(round(100.0 * (1 - levenshtein(i.name, p.name) / cast(greatest(length(i.name), length(p.name)) as double)), 4)) as s
  from n i join n p on i.partner = p.partner where i.st = 'F' and p.o in (select o_orderkey from last) group by 1, 2, 3),
e as (select invoice, po, sum(case when s >= 70 then 1 else 0 end) as matched, cast(round(coalesce(sum(case when s >= 70 then cast(s as decimal(12,4)) end), 0), 1) as double) as score,
  round(cast(coalesce(sum(case when s >= 70 then cast(s as decimal(12,4)) end), 0) as double) / count(*), 1) as mean from met group by 1, 2)
"""


def _baskets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("partner"), F.col("o_orderdate").alias("date"), "o_orderstatus")
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("name"), F.upper("p_brand").alias("brand")), F.col("p_partkey") == F.col("l_partkey"))
    li = order.numbered(li, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "line", 1)
    li = li.select(F.col("l_orderkey").alias("order"), "line", "name", "brand", F.col("l_quantity").alias("qty"))
    invoices = o.where("o_orderstatus = 'F'").select("order", "partner").join(li, "order").withColumnRenamed("order", "invoice")
    return invoices, purchase.recent_lines(o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), li.withColumnRenamed("line", "po_line")).drop("date")


@query("po_basket_rank", _BASKET_SQL + """select invoice, po as "order", cast(matched as bigint) as matched, score, mean, row_number() over (partition by invoice order by matched desc, score desc, po) as nth from e""")
def po_basket_rank(spark: SparkSession, d: str) -> DataFrame:
    invoices, orders = _baskets(spark, d)
    return purchase.basket_rank(invoices.drop("qty"), orders.drop("qty"))


@query("uom_convert", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 3 when 0 then l_quantity * 1000 when 1 then l_quantity / 1000 end as converted from lineitem")
def uom_convert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    f, t = F.when(k == 1, 1000).otherwise(1).cast("decimal(8,2)"), F.when(k == 0, 1000).otherwise(1).cast("decimal(8,2)")
    made = purchase.converted(F.col("l_quantity").cast("decimal(12,2)"), f, t, F.lit("weight"), F.when(k == 2, "volume").otherwise("weight"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made.cast("double").alias("converted"))


# Plans of changes


@query("positional_join", f"with {LINES_SQL}, o as (select *, row_number() over (partition by invoice order by l_suppkey, pos) - 1 as r from lines where l_returnflag <> 'N') select l.invoice, l.pos, l.l_partkey as have, o.l_partkey as want from lines l join o on o.invoice = l.invoice and o.r = l.pos")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("invoice", "pos", "l_partkey", "l_suppkey", "l_returnflag").withColumnRenamed("pos", "at")
    want = li.where("l_returnflag <> 'N'").select("invoice", "at", "l_suppkey", F.col("l_partkey").alias("want"))
    return changes.by_position(li.select("invoice", "at", F.col("l_partkey").alias("have")), want, ["invoice"], [F.col("at")], ["l_suppkey", "at"]).select("invoice", "pos", "have", "want")


@query("tax_line_diff", f"with {LINES_SQL}, w as (select invoice, pct, sum(base) as v from amounts group by all), p as (select invoice, pct, sum(case when pos = 0 then base - 1 else base end) as v from amounts group by all) select w.invoice, cast(w.pct as double) as pct, cast(w.v as double) as amount, cast(p.v as double) as present from w join p on w.invoice = p.invoice and w.pct = p.pct where abs(w.v - p.v) > 0.02")
def tax_line_diff(spark: SparkSession, d: str) -> DataFrame:
    li = tax.line_amounts(lines(spark, d))
    want = li.groupBy("invoice", "pct").agg(F.sum("base").alias("amount"))
    have = li.groupBy("invoice", "pct").agg(F.sum(F.when(F.col("pos") == 0, F.col("base") - 1).otherwise(F.col("base"))).alias("amount"))
    return doubles(changes.differing(want, have, ["invoice", "pct"], "amount", "0.02"), "pct", "amount", "present")


@query("missing_tax_lines", f"with {LINES_SQL} select distinct invoice, cast(pct as double) as pct from lines where (invoice, pct) not in (select (invoice, pct) from lines where pos < 2)")
def missing_tax_lines(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    return doubles(changes.missing(li.select("invoice", "pct").distinct(), li.where("pos < 2"), ["invoice", "pct"]), "pct")


@query("anti_repair", "select o_orderkey, case when c_custkey is not null then o_custkey end as partner, c_custkey is null as cleared from orders left join (select c_custkey from customer where c_acctbal > 0) on c_custkey = o_custkey")
def anti_repair(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("partner"))
    return changes.clear_unknown(o, "partner", scan(table(spark, d, "customer"), [("c_acctbal", ">", 0)], ["c_custkey"]), "c_custkey").select("o_orderkey", "partner", "cleared")


@query("source_diff", "select coalesce(c, u) as key, case when c is null then 'right' when u is null then 'left' else 'both' end as side from (select distinct c_custkey as c from customer) full join (select distinct user_id as u from events) on c = u")
def source_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return changes.key_sets(a, table(spark, d, "events").select(F.col("user_id").alias("key")), "key")


@query("header_diff_plan", "select o_orderkey, case when o_orderkey % 3 = 0 then 'F' || o_orderstatus end as status, case when o_orderkey % 4 = 0 then o_custkey + 1 end as partner from orders where o_orderkey % 3 = 0 or o_orderkey % 4 = 0")
def header_diff_plan(spark: SparkSession, d: str) -> DataFrame:
    k, s, c = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey")
    pairs = {"status": (F.when(k % 3 == 0, F.concat(F.lit("F"), s)).otherwise(s), s), "partner": (F.when(k % 4 == 0, c + 1).otherwise(c), c)}
    return changes.changed_fields(table(spark, d, "orders"), pairs).select("o_orderkey", "status", "partner")


@query("merge_changes", "select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, coalesce(a.o_totalprice, b.o_totalprice + 1) as price, coalesce(a.o_custkey, b.o_custkey) as partner from (select * from orders where o_orderstatus <> 'F') a full join (select * from orders where o_orderstatus <> 'O') b on a.o_orderkey = b.o_orderkey")
def merge_changes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("partner"))
    b = o.where("o_orderstatus <> 'O'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"), F.col("o_custkey").alias("partner"))
    return changes.merged(a, b, "o_orderkey", ["price", "partner"])


@query("origin_concat", f"with {LINES_SQL}, d as (select invoice, l_returnflag as f, min(pos) as p from lines where qty > 2 group by 1, 2), c as (select distinct invoice from lines where invoice % 9 = 4) select l.invoice, coalesce(max(case when c.invoice is not null then 'P' || c.invoice end), string_agg(f, ', ' order by p), '') as origin from (select distinct invoice from lines) l left join d on d.invoice = l.invoice left join c on c.invoice = l.invoice group by l.invoice")
def origin_concat(spark: SparkSession, d: str) -> DataFrame:
    named = F.when((F.col("invoice") % 9 == 4) & (F.col("pos") == 0), F.concat(F.lit("P"), F.col("invoice").cast("string"))).otherwise("")
    return bills.origins(lines(spark, d).select("invoice", "pos", named.alias("chosen"), F.col("l_returnflag").alias("order_name"), (F.col("qty") > 2).alias("is_content")))


@query("row_violations", """select o_orderkey as invoice, case when o_orderkey % 7 = 0 then 'no partner' when o_orderkey % 11 = 0 then 'no journal' when o_orderkey % 13 = 0 then 'no number' when o_orderkey % 5 = 4 then 'no date' when n is null then 'no lines' when bad is not null then 'no account' end as error, case when o_orderkey % 7 > 0 and o_orderkey % 11 > 0 and o_orderkey % 13 > 0 and o_orderkey % 5 <> 4 and n is not null then bad end as line
from orders left join (select l_orderkey, count(*) as n, min(case when l_returnflag = 'A' then r end) as bad from (select *, row_number() over (partition by l_orderkey order by """ + ", ".join(LINE_ORDER) + """) as r from lineitem) group by 1) on l_orderkey = o_orderkey
where o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0 or o_orderkey % 5 = 4 or n is null or bad is not null""")
def row_violations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice"))
    li = lines(spark, d).select("invoice", "pos", F.when(F.col("l_returnflag") != "A", 1).alias("account"))
    k = F.col("invoice")
    h = o.withColumns({"partner": F.when(k % 7 > 0, 1), "journal": F.when(k % 11 > 0, 1), "number": F.when(k % 13 > 0, "1-1").otherwise(" "), "date": F.when(k % 5 == 4, "31/02/2020").otherwise("1/2/2020")})
    return validation.import_errors(h, li)


# State

_LATEST = "select user_id, event_type, event_id, value from events {where} qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")


@query("latest_conversion", _LATEST.format(where=""))
def latest_conversion(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(_events(spark, d), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("upsert_state", _LATEST.format(where=""))
def upsert_state(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return state.upsert(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("delete_state", "select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'error' and value > 250)")
def delete_state(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return state.delete(e, e.where("event_type = 'error' and value > 250"), ["user_id"]).select("event_id", "user_id")


@query("insert_if_absent", "select c_custkey as id from customer union select s_suppkey from supplier")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    return state.insert_absent(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), ["id"])


_SESSIONS_SQL = """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from g)
select user_id, max(ts) + interval 1 hour as saved_at, count(*) as edits, arg_max(value, (ts, event_id)) as value from s group by user_id, n"""


@query("autosave_sessions", _SESSIONS_SQL)
def autosave_sessions(spark: SparkSession, d: str) -> DataFrame:
    return state.quiet_sessions(_events(spark, d), "user_id", "ts", "1 hour", "value", "event_id")


@query("autosave_stream", f"select * from ({_SESSIONS_SQL}) where saved_at <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)")
def autosave_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that the watermark, an hour behind the last event, has closed once the stream has read all there is."""
    kept = scratch(spark, "stream")
    known = table(spark, d, "events").schema
    stream = spark.readStream.schema(known).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    saved = autosaves(stream, "user_id", "ts", "1 hour", "1 hour", "value", "event_id")
    to_table(saved, f"{kept}/rows", f"{kept}/log").awaitTermination()
    return spark.read.schema(saved.schema).parquet(f"{kept}/rows").withColumn("saved_at", F.col("saved_at").cast(known["ts"].dataType))


# Catalogues


@query("catalog_clean", "select min(p_partkey) as id, p_name as name, p_brand as brand, upper(p_name) as sort_key from part where trim(p_name) <> '' group by p_name, p_brand")
def catalog_clean(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return registry.cleaned(p, ["name", "brand"], "name", ["id"])


@query("option_search", "select p_partkey, p_name from part where lower(p_name) like '%a%' order by p_partkey limit 50")
def option_search(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "part"), [("p_name", "like", "a")], ["p_partkey", "p_name"]).orderBy("p_partkey").limit(50)


@query("count_distinct_registry", "select count(*) as n, count(distinct trim(p_name)) as names, count(distinct p_brand) as brands from part")
def count_distinct_registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count("*").alias("n"), F.countDistinct(F.trim("p_name")).alias("names"), F.countDistinct("p_brand").alias("brands"))


_CSV_ROWS = f"with {LINES_SQL} select case when pos = 0 then cast(invoice as varchar) else '' end as numero, cast(qty as varchar) as cantidad, cast(price as varchar) as precio, '\"' || l_returnflag || ', ' || chr(10) || pos as detalle, invoice from lines"


@query("csv_written", _CSV_ROWS)
def csv_written(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as CSV files with renamed columns, a byte order mark, quotes and line breaks, and read again."""
    kept = scratch(spark, "csv")
    detail = F.concat(F.lit('"'), "l_returnflag", F.lit(", \n"), F.col("pos").cast("string"))
    number = F.when(F.col("pos") == 0, F.col("invoice").cast("string")).otherwise("")
    rows = lines(spark, d).select(number.alias("number"), numbers.for_csv(F.col("qty"), True).alias("quantity"), numbers.for_csv(F.col("price"), True).alias("price"), detail.alias("detail"), "invoice")
    names = {"number": "numero", "quantity": "cantidad", "price": "precio", "detail": "detalle"}
    write_csv(rows, kept, names, mark=True)
    return read_csv(spark, kept, "numero string, cantidad string, precio string, detalle string, invoice long")


@query("csv_projection", f"with {LINES_SQL} select case when pos = 0 then cast(invoice as varchar) else '' end as number, cast(qty as varchar) as quantity, cast(price as varchar) as price, invoice, pos from lines")
def csv_projection(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(F.when(F.col("pos") == 0, F.col("invoice").cast("string")).otherwise("").alias("number"), F.col("qty").cast("string").alias("quantity"), numbers.for_csv(F.col("price"), True).alias("price"), "invoice", "pos")


# Tax ids and slots


def _slots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice"))
    one = lambda label, n: F.struct(F.lit(label).alias("label"), (F.col("invoice") % n).cast("decimal(12,2)").alias("amount"))
    return tax.slot_rows(o.withColumn("slots", F.array(one("P. IIBB CABA", 3), one("P. IVA", 5), one("unknown", 2))), ["invoice"], "slots")


_SLOTS_SQL = """slots as (select o_orderkey as invoice, 1 as slot, 'P. IIBB CABA' as label, o_orderkey % 3 as amount from orders where o_orderkey % 3 > 0
  union all select o_orderkey, 2, 'P. IVA', o_orderkey % 5 from orders where o_orderkey % 5 > 0
  union all select o_orderkey, 3, 'unknown', o_orderkey % 2 from orders where o_orderkey % 2 > 0)"""


@query("other_tax_slots", f"with {_SLOTS_SQL} select invoice, slot, label, cast(amount as double) as amount from slots")
def other_tax_slots(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_slots(spark, d), "amount")


@query("used_slots", f"with {_SLOTS_SQL} select slot, count(*) as invoices, cast(sum(amount) as double) as amount from slots group by slot")
def used_slots(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).groupBy("slot").agg(F.count("*").alias("invoices"), F.sum("amount").cast("double").alias("amount"))


@query("expected_tax_by_id", HEADERS_SQL + f""", {_SLOTS_SQL}, u as (select invoice, case pct when 10.5 then 62 when 21 then 63 else 65 end as tax_id, amount from split
  union all select invoice, case label when 'P. IVA' then 63 else 70 end, cast(amount as decimal(18,2)) from slots where label <> 'unknown')
select invoice, tax_id, cast(sum(amount) as double) as amount from u group by 1, 2 having sum(amount) > 0""")
def expected_tax_by_id(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("10.5", 62), ("21", 63), ("27", 65)], "pct string, tax_id int").withColumn("pct", F.col("pct").cast("decimal(6,2)"))
    labels = spark.createDataFrame([("P. IIBB CABA", 70), ("P. IVA", 63)], "label string, tax_id int")
    return doubles(tax.expected_by_id(lines(spark, d), headers(spark, d), _slots(spark, d), rates, labels), "amount")


@query("tax_id_list", "select o_orderkey, case when o_orderkey % 3 = 0 then '63,70' when o_orderkey % 3 = 1 then '62,63,70' else '63,62,70' end as ids from orders")
def tax_id_list(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    primary = F.array(F.when(k == 0, F.lit(None).cast("int")).when(k == 1, 62).otherwise(63))
    ids = tax.id_list(primary, F.when(k == 0, F.array(F.lit(63))).otherwise(F.array(F.lit(63), F.lit(62))), F.array(F.lit(70), F.lit(63)))
    return table(spark, d, "orders").select("o_orderkey", ids.alias("ids"))


# More plans


@query("existing_bill_lookup", """with w as (select o_orderkey as bill, o_custkey as partner, o_orderkey % 50 as n from orders where o_orderkey % 2 = 0),
p as (select o_orderkey as id, o_custkey as partner, o_orderkey % 50 as n, o_orderkey % 4 = 1 as exact from orders where o_orderkey % 2 = 1),
m as (select bill, id as found, case when exact then 0 else 1 end as rank from w join p on w.partner = p.partner and w.n = p.n - 1)
select bill, found, rank from m qualify row_number() over (partition by bill order by rank, found desc) = 1""")
def existing_bill_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("partner"))
    n = F.col("id") % 50
    bills = o.where("id % 2 = 0").select(F.col("id").alias("bill"), "partner", F.concat(F.lit("00001-"), F.lpad(n.cast("string"), 8, "0")).alias("number"))
    m = (n - 1).cast("string")
    present = o.where("id % 2 = 1").select("id", "partner", F.concat(F.lit("1-"), m).alias("number"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("00001-"), F.lpad(m, 8, "0"))).alias("ref"))
    return changes.same_bill(bills, present)


@query("maturity_plan", "select o_orderkey as id, o_orderdate as due from orders where o_orderkey % 3 = 0 and o_custkey % 4 < 2")
def maturity_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    moves = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("account"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("due"))
    accounts = spark.createDataFrame([(0, "payable"), (1, "receivable"), (2, "expense"), (3, None)], "account long, kind string")
    return changes.missing_maturity(moves, accounts).select("id", "due")


@query("semi_valid", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_valid(spark: SparkSession, d: str) -> DataFrame:
    known = scan(table(spark, d, "customer"), [("c_mktsegment", "=", "BUILDING")], ["c_custkey"])
    return changes.valid_only(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", known, "c_custkey").select("o_orderkey", "o_custkey")


@query("option_union", "select coalesce(c_custkey, s_suppkey) as id, coalesce(c_name, s_name) as name from customer full join supplier on c_custkey = s_suppkey")
def option_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return changes.ordered_union(c, s, "id", ["name"])


# Maps of tax by rate

_STATED_SQL = """, st as (select h.invoice, cast(21 as decimal(6,2)) as pct, cast(case o_orderstatus when 'F' then hv + h.invoice % 2 else hv end as decimal(18,2)) as amount from h join orders on o_orderkey = h.invoice where o_orderstatus <> 'O' and hv > 0
  union all select h.invoice, 10.5, 1 from h join orders on o_orderkey = h.invoice where o_orderstatus = 'P' and hv > 0),
sg as (select invoice, sum(amount) as total, max(pct) as pct, count(*) as n from st group by 1),
own as (select invoice, nullif(pct, 0) as pct, sum(cast(cast(qty * price as decimal(20,4)) * pct as decimal(26,6)) * cast(0.01 as decimal(3,2))) as s,
  sum(case when vat > 0 then cast(vat as decimal(24,6)) else cast(cast(qty * price as decimal(20,4)) * pct as decimal(26,6)) * cast(0.01 as decimal(3,2)) end) as e from amounts group by all),
og as (select invoice, count(pct) as n, max(pct) as pct, sum(case when pct > 0 then e else 0 end) as e from own group by 1),
hand as (select distinct invoice from lines where l_returnflag = 'A' and pos = 0),
f as (select m.*, sg.n as sn, sg.total, sg.pct as spct, coalesce(og.n, 0) as n, og.pct as opct, og.e as oe, coalesce(og.n = 0, false) as zero, hand.invoice is not null as by_hand,
  o_orderpriority = '1-URGENT' as fixed from m join orders on o_orderkey = m.invoice left join sg on sg.invoice = m.invoice left join og on og.invoice = m.invoice left join hand on hand.invoice = m.invoice)"""


def _stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = lines(spark, d)
    li = li.withColumn("zero", F.col("pct") == 0)
    # Written once: stated maps come from the headers, which come from the lines, and neither is to be made twice in one task.
    h = cut(headers(spark, d, "o_orderstatus", "o_orderpriority")).withColumn("manual", F.col("o_orderpriority") == "1-URGENT")
    main = F.when(F.col("o_orderstatus") == "F", F.col("vat") + F.col("invoice") % 2).otherwise(F.col("vat"))
    entry = lambda pct, amount: F.struct(F.lit(pct).cast("decimal(6,2)").alias("pct"), amount.cast("decimal(18,2)").alias("amount"))
    entries = F.array(entry("21", main), entry("10.5", F.when(F.col("o_orderstatus") == "P", F.lit(1))))
    stated = h.where("o_orderstatus <> 'O' and vat > 0").select("invoice", F.explode(entries).alias("x")).select("invoice", "x.pct", "x.amount")
    return li, h.select("invoice", "vat", "subtotal", "manual"), stated


@query("effective_tax_map", HEADERS_SQL + _STATED_SQL + """, pick as (select *, case when zero then 'none' when sn > 0 then case when hv > 0 and abs(total - hv) > greatest(0.02, total * 0.001) and mode <> 'line' and sn = 1 then 'one' else 'stated' end
  when mode = 'header' and hv > 0 then 'header' when n > 0 then 'own' when hv > 0 then 'header' else 'none' end as how from f)
select invoice, cast(pct as double) as pct, cast(amount as double) as amount from (
  select invoice, spct as pct, hv as amount from pick where how = 'one' union all select pick.invoice, st.pct, st.amount from pick join st on st.invoice = pick.invoice where how = 'stated'
  union all select invoice, case when n = 1 then opct else 21 end, hv from pick where how = 'header'
  union all select pick.invoice, own.pct, round(own.s, 2) from pick join own on own.invoice = pick.invoice where how = 'own' and own.pct is not null)""")
def effective_tax_map(spark: SparkSession, d: str) -> DataFrame:
    return doubles(tax.effective_map(*_stated(spark, d)), "pct", "amount")


@query("footer_reconciled", HEADERS_SQL + _STATED_SQL + """, did as (select *, case when zero then 'clear' when fixed then 'keep' when (by_hand or mode = 'line') and n > 0 then 'lines' else 'keep' end as action from f)
select invoice, action, cast(case action when 'lines' then round(oe, 2) when 'keep' then hv end as double) as vat, cast(case action when 'lines' then n when 'keep' then coalesce(sn, 0) else 0 end as integer) as rates from did""")
def footer_reconciled(spark: SparkSession, d: str) -> DataFrame:
    li, h, stated = _stated(spark, d)
    li = li.withColumn("manual", (F.col("l_returnflag") == "A") & (F.col("pos") == 0))
    made = tax.reconciled(li, h, stated)
    return doubles(made.select("invoice", "action", "vat", F.size("rates").alias("rates")), "vat")


# Kinds of invoices and tax ids of tenants

_KINDS = "case p_partkey % 10 when 0 then 'FACTURAS A' when 1 then 'Factura  B' when 2 then 'Invoices C' when 3 then 'FACTURAS A EXPORT' when 4 then 'FACTURA DE CREDITO ELECTRONICA MiPyMEs (FCE) A' when 5 then 'OC-X' when 6 then 'FACTURA DE SERVICIOS C' when 7 then 'RECIBO' when 8 then 'Credit Notes A' else 'Ticket Invoice M' end"
_CODES = "case when p_partkey % 10 = 7 and p_partkey % 4 = 3 then '6' when p_partkey % 30 = 9 then '99' else '' end"


@query("document_kind_ids", f"""with k as (select p_brand as tenant, p_partkey as id, trim(regexp_replace(upper({_KINDS}), ' +', ' ', 'g')) as n, {_CODES} as c from part),
s as (select tenant, id, x.l, case when regexp_matches(n, 'CREDIT|TICKET|FCE') then 0 when n in ('FACTURAS ' || x.l, 'INVOICES ' || x.l) then 100 when n in ('FACTURA ' || x.l, 'INVOICE ' || x.l) then 95
  when c = x.code then 90 when contains(n, 'FACTURAS ' || x.l) then 80 when contains(n, 'FACTURA ' || x.l) then 75 when ends_with(n, ' ' || x.l) and contains(n, 'FACTURA') then 40 else 0 end as fit
  from k, (values ('A', '1'), ('B', '6'), ('C', '11')) x(l, code)),
b as (select tenant, 'FACTURAS ' || l as label, id from s where fit > 0 qualify row_number() over (partition by tenant, l order by fit desc, id) = 1),
o as (select tenant, max(id) as id from k where c in ('OC-X', '99') or n = 'OC-X' group by 1)
select * from b union all select coalesce(o.tenant, b.tenant), 'OC-X', coalesce(o.id, b.id) from o full join (select * from b where label = 'FACTURAS C') b on b.tenant = o.tenant""")
def document_kind_ids(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").select(F.col("p_brand").alias("tenant"), F.col("p_partkey").alias("id"), F.expr(_KINDS).alias("name"), F.expr(_CODES).alias("code"))
    return doctypes.by_label(kinds, ["tenant"], ["id"])


@query("document_kind_names", """select p_partkey, case p_partkey % 10 when 0 then 'FACTURAS A' when 1 then 'Factura B' when 2 then 'FACTURAS C' when 3 then 'FACTURAS A EXPORT' when 4 then 'FACTURA DE CREDITO ELECTRONICA MiPyMEs (FCE) A'
  when 5 then 'OC-X' when 6 then 'FACTURA DE SERVICIOS C' when 7 then 'RECIBO' when 8 then 'NOTAS DE CRÉDITO A' else 'TIQUE FACTURA M' end as name from part""")
def document_kind_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", doctypes.spanish(F.expr(_KINDS)).alias("name"))


#: Two tenants' catalogues of purchase taxes; ids are not the same, and the second names one rate only in the name.
TAXES = [("default", 63, "IVA 21%", 21.0, 1), ("default", 61, "IVA 10,5%", 10.5, 2), ("default", 57, "IVA Exento", 0.0, 3), ("default", 53, "IVA No Corresponde", 0.0, 4), ("default", 70, "P. IIBB CABA", 0.0, 5), ("north", 7, "IVA 21% bis", 21.0, 2), ("north", 5, "IVA 21%", 21.0, 1), ("north", 6, "IVA 10.5", 0.0, 3), ("north", 8, "IVA Exen", 0.0, 4), ("north", 9, "Perc Gananc", 0.0, 5)]


def _taxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXES, "profile string, id long, name string, amount double, pos int").withColumn("amount", F.col("amount").cast("decimal(12,4)"))


_TAX_SLOT = "(array(63, 61, 57, 53, 70))[cast(l_linenumber % 5 as int)]"


@query("tax_remap", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, t.tax_id, case when l_returnflag = 'N' then t.same else t.other end as wanted from lineitem
join (values (0, 63, 63, 5), (1, 61, 61, 6), (2, 57, 57, 8), (3, 53, 53, 53), (4, 70, null, null)) t(n, tax_id, same, other) on t.n = l_linenumber % 5""")
def tax_remap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_TAX_SLOT).cast("long").alias("tax_id"), F.lit("default").alias("source"), F.when(F.col("l_returnflag") == "N", "default").otherwise("north").alias("target"))
    return taxids.remapped(rows, _taxes(spark), "source", "target", "wanted").drop("source", "target")


@query("tax_by_label", """select o_orderkey, case o_orderkey % 4 when 0 then 70 when 1 then 9 when 2 then 63 end as tax_id from orders""")
def tax_by_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, "Percepción IIBB CABA Sufrida").when(k == 1, "Percepción Ganancias Aplicada").when(k == 2, " iva  21%").otherwise("Percepción IIBB Luna Sufrida")
    return taxids.by_name(table(spark, d, "orders").select("o_orderkey", shown.alias("label")), "label", _taxes(spark).where("id not in (5, 7)")).select("o_orderkey", "tax_id")


@query("tax_id_split", """select o_orderkey, case when o_orderkey % 3 = 0 then '61,63' else '61,57' end as vat, '70' as other, case when o_orderkey % 3 = 0 then 63 else 61 end as main from orders""")
def tax_id_split(spark: SparkSession, d: str) -> DataFrame:
    ids = F.when(F.col("o_orderkey") % 3 == 0, F.array(*map(F.lit, (61, 70, 63)))).otherwise(F.array(*map(F.lit, (61, 57, 70))))
    vat, other = taxids.split_ids(ids, F.array(*map(F.lit, (63, 61, 57, 53))))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(vat, ",").alias("vat"), F.array_join(other, ",").alias("other"), taxids.primary_id(vat, F.lit(63)).alias("main"))


# Quantities and units of invoices

_UNIT = "case l_linenumber % 5 when 0 then 'Kilos' when 1 then 'grs' when 2 then 'Lts' when 3 then '' else 'cajas' end"


@query("unit_notes", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 5 when 1 then 'Re-escalado' when 2 then 'Categoría UM distinta' when 3 then 'Sin UM en factura' when 4 then 'UM sin mapeo' else '' end as note,
  case l_linenumber % 5 when 1 then l_quantity / 1000 else l_quantity end as scaled, cast(case l_linenumber % 5 when 0 then 1.0 when 1 then 0.001 end as double) as factor from lineitem""")
def unit_notes(spark: SparkSession, d: str) -> DataFrame:
    units = spark.createDataFrame([("kg", 1, "weight"), ("g", 1000, "weight"), ("L", 1, "volume"), ("Units", 1, "unit")], "unit string, factor long, category string").withColumn("factor", F.col("factor").cast("decimal(12,4)"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(12,2)").alias("qty"), F.expr(_UNIT).alias("unit"), F.lit("kg").alias("order_unit"))
    return doubles(purchase.scaled(li, units).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "note", "scaled", "factor"), "scaled", "factor")


@query("billed_quantity", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 4 when 0 then l_quantity when 1 then l_quantity + 1 when 2 then l_quantity when 3 then 500.0 end as qty from lineitem""")
def billed_quantity(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("decimal(12,2)")
    size = F.lit(500).cast("decimal(12,2)")
    made = purchase.billed_quantity(F.when(k == 0, q).when(k == 1, size), F.when(k == 1, q + 1).when(k == 2, q), size)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made.cast("double").alias("qty"))


# Hierarchies and names


@query("deep_hierarchy", """with recursive t as (select p_partkey as key, case when p_partkey % 7 = 0 then null else p_partkey // 2 end as up from part),
r(key, head) as (select key, key from t where up is null union all select t.key, r.head from t join r on t.up = r.key)
select t.key as p_partkey, r.head from t left join r on r.key = t.key""")
def deep_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.floor(F.col("p_partkey") / 2)).alias("up"))
    return lookup.heads(p, "p_partkey", "up")


@query("po_line_match")
def po_line_match(spark: SparkSession, d: str) -> DataFrame:
    invoices, orders = _baskets(spark, d)
    seen = F.concat_ws(" ", F.lit("ALM"), F.translate("name", "OI", "01"))
    return purchase.best_order_line(invoices.withColumn("name", seen).withColumn("code", F.lit("")), orders)


#: Each pair's longest common subsequences by the same bit operations, over whole numbers of 128 bits.
_WORDS_SQL = """with typed as (select c_custkey as key, upper(case when c_custkey % 3 = 0 then n_name else replace(n_name, 'A', case when c_custkey % 3 = 1 then 'E' else '' end) end || ' ' || c_mktsegment) as q from customer join nation on n_nationkey = c_nationkey), names as (select distinct q from typed),
regs as (select upper(n_name) as r, min(n_nationkey) as id from nation group by 1),
words as (select q, r, list_sort(list_distinct(string_split(q, ' '))) as a, list_sort(list_distinct(string_split(r, ' '))) as b from names cross join regs),
sets as (select *, list_filter(a, lambda x: list_contains(b, x)) as common, list_filter(a, lambda x: not list_contains(b, x)) as only_a, list_filter(b, lambda x: not list_contains(a, x)) as only_b from words),
texts as (select *, array_to_string(common, ' ') as c, array_to_string(list_concat(common, only_a), ' ') as ca, array_to_string(list_concat(common, only_b), ' ') as cb from sets),
ways as (select q, r, q as x, r as y from words where length(q) <= length(r) union all select q, r, r, q from words where length(r) <= length(q)),
runs as (select q, r, x, y, unnest(range(1 - length(x), length(y))) as i from ways),
asked as (select q, r, 'words' as kind, ca as x, cb as y from texts
  union all select q, r, 'words', c, ca from texts where c <> ''
  union all select q, r, 'words', c, cb from texts where c <> ''
  union all select q, r, 'run', x, substr(y, greatest(i, 0) + 1, i + length(x) - greatest(i, 0)) from runs),
bits as (select x, y, (1::hugeint << length(x)) - 1 as full_x, list_transform(string_split(y, ''), lambda l: list_sum(list_transform(range(length(x)), lambda k: case when substr(x, k + 1, 1) = l then 1::hugeint << k::int else 0::hugeint end))::hugeint) as masks from (select distinct x, y from asked)),
longest as (select x, y, length(x) - bit_count(list_reduce(list_prepend(full_x, masks), lambda rest, m: ((rest + (rest & m)) | (rest - (rest & m))) & full_x)) as n from bits),
ratios as (select q, r, kind, max(200.0::double * n / (length(asked.x) + length(asked.y))) as s from asked join longest on longest.x = asked.x and longest.y = asked.y group by all),
parts as (select q, r, round(max(case when kind = 'words' then s end), 4) as t, case when contains(q, r) or contains(r, q) then 100.0::double else round(max(case when kind = 'run' then s end), 4) end as p from ratios group by q, r),
best as (select q, id, round(greatest(t, 0.55::double * t + 0.45::double * p), 4) as score from parts join regs using (r)),
top as (select * from best where score >= 72 qualify row_number() over (partition by q order by score desc, id) = 1)
select key, id, score from typed join top using (q)"""


@query("fuzzy_words_top1", _WORDS_SQL)
def fuzzy_words_top1(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations and segments as typed, with a letter wrong or left out in two of three, against a registry of nations."""
    n = table(spark, d, "nation")
    k = F.col("c_custkey") % 3
    wrong = F.when(k == 0, F.col("n_name")).when(k == 1, F.replace("n_name", F.lit("A"), F.lit("E"))).otherwise(F.replace("n_name", F.lit("A"), F.lit("")))
    typed = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("key"), F.concat_ws(" ", wrong, "c_mktsegment").alias("name"))
    return lookup.best_match(typed, "key", "name", n, "n_nationkey", "n_name", 72.0, score=similar.name_score)


# Checks before sending

_SCREEN = {
    "rate": "case when l_linenumber = 7 then '' else '21' end",
    "number": "case when l_orderkey % 11 = 0 then '12x' else '1-23' end",
    "account": "case when l_returnflag = 'A' then '' else '1.1' end",
    "quantity": "case when l_quantity = 50 then 'many' else cast(cast(l_quantity as integer) as string) end",
    "day": "case when l_discount = 0.1 then '31/02/2020' when l_discount = 0 then '' else '1/2/2020' end",
}
_FIRST_SQL = ", ".join(f"{sql} as {name}" for name, sql in _SCREEN.items())


@query("first_violation", f"""with {LINES_SQL}, s as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as pos, {_FIRST_SQL} from lineitem),
v as (select l_orderkey, pos, 0 as step, 'no rate' as rule, 'rate' as field, rate as value from s where rate = '' union all select l_orderkey, pos, 1, 'document number', 'number', number from s where number = '12x'
  union all select l_orderkey, pos, 2, 'no number', 'quantity', quantity from s where quantity = 'many' union all select l_orderkey, pos, 3, 'no account', 'account', account from s where account = ''
  union all select l_orderkey, pos, 4, 'no date', 'day', day from s where day = '31/02/2020')
select l_orderkey, pos, rule, field, value from v qualify row_number() over (partition by l_orderkey order by step, pos) = 1""")
def first_violation(spark: SparkSession, d: str) -> DataFrame:
    t = order.numbered(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER)
    rows = t.select("l_orderkey", "pos", F.lit("x").alias("name"), *[F.expr(sql).alias(name) for name, sql in _SCREEN.items()])
    return validation.first_violation(rows, ["l_orderkey"], ["quantity"], ["day"])


@query("tax_options", "select * from (values (70, 'Percepción IIBB CABA Sufrida', 1), (9, 'Percepción Ganancias Sufrida', 3), (63, 'IVA 21%', null), (61, 'IVA 10,5%', null), (57, 'IVA Exento', null), (53, 'IVA No Corresponde', null), (6, 'IVA 10.5', null), (8, 'IVA Exen', null)) t(id, label, pos)")
def tax_options(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([(1, "Percepción IIBB CABA Sufrida"), (2, "Percepción Ganancias Aplicada"), (3, "Percepción Ganancias Sufrida"), (4, "Percepción IIBB Salta Sufrida")], "pos int, label string")
    return taxids.options(labels, _taxes(spark).where("id not in (5, 7)").select("id", "name"))


@query("pairing_key_else_place", f"""with {LINES_SQL}, p as (select invoice, 100 - pos as id, l_partkey as k, row_number() over (partition by invoice order by 100 - pos) - 1 as n from lines),
e as (select invoice, k, min(id) as id from p group by 1, 2),
t as (select l.invoice, l.pos, coalesce(e.id, p.id) as target from lines l left join e on e.invoice = l.invoice and l.l_returnflag = 'A' and e.k = l.l_partkey left join p on p.invoice = l.invoice and p.n = l.pos)
select invoice, pos, case when row_number() over (partition by invoice, target order by pos) = 1 then target end as target from t""")
def pairing_key_else_place(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    want = li.select("invoice", F.col("pos").alias("id"), F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("k"))
    have = li.select("invoice", (100 - F.col("pos")).alias("id"), F.col("l_partkey").alias("k"))
    return changes.by_key_else_position(want, have, "invoice", "k", ["id"]).select("invoice", "pos", "target")
