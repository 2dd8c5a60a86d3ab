"""Queries over larger registries, chained fills, scopes, streams of edits, stored candidates and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similar, text
from ..operators import changes, conditions, lookup, order, purchase, registry, rematch, saved, sync, tax, taxids
from ..sources.files import cut, scratch, table
from ..sources.paged import read_pages, write_pages
from ..streaming import writes
from .catalogue import _SLOTS_SQL, _STATED_SQL, HEADERS_SQL, _baskets, _slots, _stated
from .proxies import LINES_SQL, headers, lines
from .registered import doubles, query

#: A registry of offers: part, brand and the supplier's nation, each with its smallest line; and what was typed for parts.
_OFFERS_SQL = """with offers as (select upper(p_name || ' ' || p_brand || ' ' || n_name) as r, min(l_orderkey * 10 + l_linenumber) as id from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1),
typed as (select p_partkey as key, upper(case p_partkey % 3 when 0 then replace(p_name, 'a', 'e') when 1 then replace(p_name, 'e', '') else p_name || 'x' end || ' ' || replace(p_brand, '#', '') || ' ' || n_name) as q from part join nation on n_nationkey = p_partkey % 25)"""


def _offers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    s = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    li = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    offers = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat_ws(" ", "p_name", "p_brand", "n_name").alias("name"))
    k = F.col("p_partkey") % 3
    wrong = F.when(k == 0, F.replace("p_name", F.lit("a"), F.lit("e"))).when(k == 1, F.replace("p_name", F.lit("e"), F.lit(""))).otherwise(F.concat("p_name", F.lit("x")))
    typed = p.join(n, F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("p_partkey").alias("key"), F.concat_ws(" ", wrong, F.replace("p_brand", F.lit("#"), F.lit("")), "n_name").alias("name"))
    return typed, offers


@query("fuzzy_parts", _OFFERS_SQL + """, s as (select q, id, round(100.0::double * (1 - levenshtein(q, r) / greatest(length(q), length(r))::double), 4) as score from (select distinct q from typed) cross join offers where abs(length(q) - length(r)) <= 0.2 * greatest(length(q), length(r))),
top as (select * from s where score >= 80 qualify row_number() over (partition by q order by score desc, id) = 1) select key, id, score from typed join top using (q)""")
def fuzzy_parts(spark: SparkSession, d: str) -> DataFrame:
    """Mistyped parts against thousands of offers, by edit distance."""
    typed, offers = _offers(spark, d)
    return lookup.best_match(typed, "key", "name", offers, "id", "name", 80.0)


@query("fuzzy_parts_words")
def fuzzy_parts_words(spark: SparkSession, d: str) -> DataFrame:
    """The same by common words and runs of letters."""
    typed, offers = _offers(spark, d)
    return lookup.best_match(typed, "key", "name", offers, "id", "name", 72.0, score=similar.name_score)


@query("fuzzy_parts_weighted")
def fuzzy_parts_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same by the weighted ratio."""
    typed, offers = _offers(spark, d)
    return lookup.best_match(typed, "key", "name", offers, "id", "name", 75.0, score=similar.weighted)


#: Lines as rows of a process (the supplier's nation number of the order) with two blank rows and more in a row, indexes that
#: are missing on some, and numbers on few; a row's place is its order and line.
_PROCESS = "pos % 4 = 0 and invoice % 3 > 0"


@query("fill_chained", f"""with {LINES_SQL}, p as (select invoice % 7 as process, invoice * 100 + pos as place, case when invoice % 5 > 0 then invoice end as idx, case when {_PROCESS} then 'n' || invoice else case when pos % 2 = 0 then '' else chr(9) end end as number, case when pos % 3 = 1 then cast(l_suppkey as varchar) else ' ' end as partner from lines),
s as (select *, sum(case when number like 'n%' then 1 else 0 end) over (partition by process order by place) as have, lag(idx) over (partition by process order by place) as before from p),
t as (select *, coalesce(idx = before, false) or (number not like 'n%' and have > 0) as joined from s),
r as (select *, sum(case when joined then 0 else 1 end) over (partition by process order by place) as run from t)
select process, place, coalesce(last_value(case when number like 'n%' then number end ignore nulls) over (partition by process, run order by place), '') as number, coalesce(last_value(nullif(trim(partner), '') ignore nulls) over (partition by process, run order by place), '') as partner from r""")
def fill_chained(spark: SparkSession, d: str) -> DataFrame:
    """Seven processes, each of a seventh of all lines and dealt to several ranges."""
    li = lines(spark, d)
    named = (F.col("pos") % 4 == 0) & (F.col("invoice") % 3 > 0)
    number = F.when(named, F.concat(F.lit("n"), F.col("invoice").cast("string"))).when(F.col("pos") % 2 == 0, "").otherwise("\t")
    rows = li.select((F.col("invoice") % 7).alias("process"), (F.col("invoice") * 100 + F.col("pos")).alias("place"), F.when(F.col("invoice") % 5 > 0, F.col("invoice")).alias("idx"), number.alias("number"), F.when(F.col("pos") % 3 == 1, F.col("l_suppkey").cast("string")).otherwise(" ").alias("partner"))
    return order.fill_chained(rows, ["number", "partner"], "idx", "number", ["process"], ["place"]).select("process", "place", "number", "partner")


#: Every second order is a bill to send, the others are there, known by ref, number or name, with and without zeros.
_BILLS_SQL = """with b as (select o_orderkey as bill, o_custkey as partner, o_orderkey % 60 as n from orders where o_orderkey % 2 = 0),
p as (select o_orderkey as id, o_custkey as partner, o_orderkey % 60 - 1 as n, o_orderkey // 2 % 4 as k from orders where o_orderkey % 2 = 1),
c as (select *, '1-' || n as bare, '0001-' || lpad(cast(n as varchar), 8, '0') as number from b),
q as (select id, partner, case when k = 0 then '00001-' || n end as num, case when k = 1 then '0001-' || lpad(cast(n as varchar), 8, '0') end as ref, case k when 2 then 'FA-A 00001-1-' || n when 3 then 'FC 0001-' || n end as bare_name from p),
m as (select bill, id as found, case when ref = number then 0 else 1 end as rank from c join q using (partner) where ref = number or num = '00001-' || c.n or regexp_replace(coalesce(bare_name, ''), '(^|-)0+([^-])', '\\1\\2', 'g') like '%' || c.bare or contains(regexp_replace(coalesce(bare_name, ''), '(^|-)0+([^-])', '\\1\\2', 'g'), '-' || c.bare))
select bill, found, rank from m qualify row_number() over (partition by bill order by rank, found desc) = 1"""


@query("existing_bill_by_name", _BILLS_SQL)
def existing_bill_by_name(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("partner"))
    n = F.col("id") % 60
    filled = lambda x: F.concat(F.lit("0001-"), F.lpad(x.cast("string"), 8, "0"))
    want = o.where("id % 2 = 0").select(F.col("id").alias("bill"), "partner", filled(n).alias("number"))
    k, m = F.floor(F.col("id") / 2) % 4, (n - 1).cast("string")
    name = F.when(k == 2, F.concat(F.lit("FA-A 00001-01-"), F.lpad(m, 4, "0"))).when(k == 3, F.concat(F.lit("FC 0001-"), F.lpad(m, 8, "0")))
    have = o.where("id % 2 = 1").select("id", "partner", F.when(k == 0, F.concat(F.lit("00001-"), m)).alias("number"), F.when(k == 1, filled(n - 1)).alias("ref"), name.alias("name"))
    return changes.same_bill(want, have)


@query("order_scope", """with recursive t as (select c_custkey as k from customer where c_custkey in (3, 700) union all select c.c_custkey from customer c join t on c.c_custkey - 1 = t.k and c.c_custkey % 500 <> 0)
select o_orderkey, o_custkey from orders where o_orderstatus in ('P', 'O') and (o_custkey in (select k from t) or o_totalprice > 300000) and not (o_orderpriority = '1-URGENT' and o_orderdate < timestamp '1996-01-01')""")
def order_scope(spark: SparkSession, d: str) -> DataFrame:
    """Orders of partners below two others, in chains of hundreds, or of high price; urgent old ones are left out."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 500 != 0, F.col("c_custkey") - 1).alias("up"))
    terms = [("o_orderstatus", "in", ["P", "O"]), "|", ("o_custkey", "child_of", [3, 700]), ("o_totalprice", ">", 300000), "!", "&", ("o_orderpriority", "=", "1-URGENT"), ("o_orderdate", "<", F.lit("1996-01-01").cast("timestamp"))]
    return conditions.matching(table(spark, d, "orders"), terms, {"o_custkey": (c, "c_custkey", "up")}).select("o_orderkey", "o_custkey")


@query("last_write_stream", """select user_id, ts, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and event_type <> 'error'""")
def last_write_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of their user's state, errors as deletions; they come in shuffled batches, a third of them twice."""
    kept = scratch(spark, "writes")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    e.unionByName(e.where("event_id % 3 = 0")).repartition(12, F.xxhash64("event_id", F.rand(1))).write.parquet(f"{kept}/edits")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{kept}/edits")
    last = writes.last_writes(stream, ["user_id"], "ts", "event_id", F.col("event_type") == "error")
    writes.save(last, f"{kept}/rows", f"{kept}/log").awaitTermination()
    shape = e.withColumn("gone", F.lit(False)).select(*last.columns).where("false")
    return writes.current(spark, f"{kept}/rows", shape, ["user_id"], "ts", "event_id").select(*e.columns)


@query("rematched_candidates", """with n as (select l_orderkey as o, o_custkey as partner, o_orderstatus as st, upper(p_name) as plain, upper(p_brand) as brand, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) as line
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey),
last as (select o_orderkey from orders where o_orderstatus <> 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 12),
i as (select *, case o % 7 when 1 then plain || ' X' when 3 then brand else plain end as name from n where st = 'F' and o % 11 > 0),
met as (select i.o as invoice, p.o as po, i.line, max(round(100.0 * (1 - levenshtein(i.name, p.plain) / cast(greatest(length(i.name), length(p.plain)) as double)), 4)) as s
  from i join n p on i.partner = p.partner where p.o in (select o_orderkey from last) group by 1, 2, 3),
e as (select invoice, po, sum(case when s >= 70 then 1 else 0 end) as matched, cast(round(coalesce(sum(case when s >= 70 then cast(s as decimal(12,4)) end), 0), 1) as double) as score from met group by 1, 2)
select invoice, po as "order", cast(matched as bigint) as matched, score, row_number() over (partition by invoice order by matched desc, score desc, po) as nth from e""")
def rematched_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are stored once; then three commands change lines of some invoices, and only those are ranked again."""
    invoices, orders = _baskets(spark, d)
    invoices, orders = cut(invoices), cut(orders.select("partner", "order", "name"))
    k = F.col("invoice") % 7
    path = f"{scratch(spark, 'candidates')}/table"

    def ranked(rows: DataFrame):
        def compute(asked: DataFrame) -> DataFrame:
            some = rows.join(asked, "invoice", "left_semi").select("invoice", "partner", "line", "name")
            return purchase.basket_rank(some, orders).drop("mean")

        return compute

    rematch.start(invoices, ranked(invoices), path)
    longer = invoices.withColumn("name", F.when(k == 1, F.concat("name", F.lit(" X"))).otherwise(F.col("name")))
    branded = longer.withColumn("name", F.when(k == 3, F.col("brand")).otherwise(F.col("name")))
    gone = branded.where("invoice % 11 > 0")
    for rows, touched in ((longer, k == 1), (branded, k == 3), (gone, F.col("invoice") % 11 == 0)):
        rematch.rematch(invoices.where(touched), ranked(rows), path)
    return rematch.stored(spark, path)


@query("po_fitted_rank")
def po_fitted_rank(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each invoice's partner by the score of their lines; names as a scanner reads them, codes on some lines."""
    invoices, orders = _baskets(spark, d)
    code = F.when(F.col("line") % 5 == 0, F.col("name")).otherwise("")
    return purchase.fitted_rank(invoices.withColumn("code", code).withColumn("name", F.translate("name", "OI", "01")), orders)


@query("paged_orders", "(select o_orderkey, o_custkey, o_totalprice, 'range' as part from orders where o_orderkey >= 700 and o_orderkey < 2500) union all (select o_orderkey, o_custkey, o_totalprice, 'last' from orders order by o_orderkey desc limit 150)")
def paged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as pages by key, of which a range and the last ones are read."""
    path = scratch(spark, "pages")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_pages(o, path, "o_orderkey", 500)
    some = read_pages(spark, path, 700, 2500).withColumn("part", F.lit("range"))
    return some.unionByName(read_pages(spark, path, descending=True, limit=150).withColumn("part", F.lit("last")))


# Taxes and plans of whole imports


#: A stated map for some invoices, header amounts edited on some, and a slot with an unknown label that takes tax 81.
_EXPECTED_SQL = HEADERS_SQL + _STATED_SQL + f""", {_SLOTS_SQL}, pick as (select *, case when zero then 'none' when sn > 0 then case when hv > 0 and abs(total - hv) > greatest(0.02, total * 0.001) and mode <> 'line' and sn = 1 then 'one' else 'stated' end
  when mode = 'header' and hv > 0 then 'header' when n > 0 then 'own' when hv > 0 then 'header' else 'none' end as how from f where filled > 0),
held as (select invoice, spct as pct, hv as amount from pick where how = 'one' union all select pick.invoice, st.pct, st.amount from pick join st on st.invoice = pick.invoice where how = 'stated'
  union all select invoice, case when n = 1 then opct else 21 end, hv from pick where how = 'header' union all select pick.invoice, own.pct, round(own.s, 2) from pick join own on own.invoice = pick.invoice where how = 'own' and own.pct is not null),
due as (select p.invoice, own.pct, own.e as amount from pick p join own on own.invoice = p.invoice where p.mode = 'line' and not p.fixed and own.pct is not null
  union all select h.invoice, h.pct, h.amount from held h join pick p on p.invoice = h.invoice where p.mode <> 'line' or p.fixed),
ids as (select invoice, case pct when 10.5 then 62 when 21 then 63 when 27 then 65 end as tax_id, cast(amount as decimal(28,6)) as amount from due where amount > 0
  union all select s.invoice, case label when 'P. IIBB CABA' then 70 when 'P. IVA' then 63 else 81 end, cast(s.amount as decimal(28,6)) from slots s join pick on pick.invoice = s.invoice),
expected as (select invoice, tax_id, cast(round(sum(amount), 2) as decimal(18,2)) as amount from ids group by all having sum(amount) > 0)"""


def _expected(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("10.5", 62), ("21", 63), ("27", 65)], "pct string, tax_id int")
    labels = spark.createDataFrame([("P. IIBB CABA", 70), ("P. IVA", 63)], "label string, tax_id int")
    s = _slots(spark, d).withColumn("pos", F.lit(0))
    own = s.select("invoice", "pos").distinct().withColumn("ids", F.array(F.lit(81)))
    return tax.expected_taxes(*_stated(spark, d), s, rates, labels, own)


@query("expected_taxes", _EXPECTED_SQL + " select invoice, tax_id, cast(amount as double) as amount from expected where amount > 0")
def expected_taxes(spark: SparkSession, d: str) -> DataFrame:
    return doubles(_expected(spark, d), "amount")


@query("cleared_lines", f"""with {LINES_SQL}, z as (select invoice from lines group by 1 having bool_and(pct = 0)) select l.invoice, l.pos, cast(case when z.invoice is null then vat end as double) as vat, z.invoice is null and l.pos = 0 as manual from lines l left join z on z.invoice = l.invoice""")
def cleared_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumns({"zero": F.col("pct") == 0, "manual": F.col("pos") == 0})
    return doubles(tax.cleared_lines(rows).select("invoice", "pos", "vat", "manual"), "vat")


@query("flags_and_places", """select c_custkey, c_custkey % 8 < 6 as yes, case c_custkey % 4 when 0 then c_name when 1 then c_mktsegment else '' end as place from customer""")
def flags_and_places(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("1", " TRUE", "yes\t", "Si", "SÍ", "on", "no", None)]), (F.col("c_custkey") % 8 + 1).cast("int"))
    pair = lambda c: F.to_json(F.array(F.lit("7"), c))
    k = F.col("c_custkey") % 4
    place = text.deliver_to(F.when(k == 0, pair(F.col("c_name"))).otherwise("false"), F.when(k < 2, pair(F.col("c_mktsegment"))).when(k == 2, "9"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(text.truthy(said), F.lit(False)).alias("yes"), place.alias("place"))


@query("process_totals", HEADERS_SQL + """, t as (select m.invoice, cast(round(case when mode = 'header' and coalesce(sub, 0) > 0 then sub else bases end, 2) as decimal(18,2)) + cast(case when mode = 'line' then round(e, 2) else coalesce(a, hv, 0) end as decimal(18,2)) as total from m left join (select invoice, sum(amount) as a from split group by 1) x on m.invoice = x.invoice)
select o_custkey as process, count(*) as invoices, cast(sum(total) as double) as total from t join orders on o_orderkey = invoice group by 1""")
def process_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each partner's invoices as a process."""
    of = table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice"), F.col("o_custkey").alias("process"))
    return doubles(tax.process_total(tax.totals(lines(spark, d), headers(spark, d)), of), "total")


@query("tax_options_of_nations", """with l as (select s_suppkey as pos, n_nationkey as id, 'Tax ' || n_name || case when s_suppkey % 3 = 0 then ' Sufrida' else ' SUFRIDA' end as label from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 5 > 0 and n_nationkey % 4 > 0),
k as (select id, label, pos from l qualify row_number() over (partition by id order by case when label like '%Sufrida' then 0 else 1 end, case when label like '%Sufrida' then -pos else pos end) = 1)
select id, label, pos from k union all select n_nationkey, 'Tax ' || n_name || ' sufrida', null from nation where n_nationkey not in (select id from k)""")
def tax_options_of_nations(spark: SparkSession, d: str) -> DataFrame:
    """A tax for each nation, and labels that the suppliers of most nations give theirs."""
    n = table(spark, d, "nation")
    kind = F.when(F.col("s_suppkey") % 3 == 0, " Sufrida").otherwise(" SUFRIDA")
    given = table(spark, d, "supplier").where("s_suppkey % 5 > 0").join(n.where("n_nationkey % 4 > 0"), F.col("n_nationkey") == F.col("s_nationkey"))
    labels = given.select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("Tax "), "n_name", kind).alias("label"))
    return taxids.options(labels, n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Tax "), "n_name", F.lit(" sufrida")).alias("name")))


def _import(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, sync.State]:
    """Rows of an import, the taxes they are to have, and bills that differ from them in places."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice"), "o_custkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    li = lines(spark, d).join(o, "invoice")
    first = lambda c: F.when(F.col("pos") == 0, c).otherwise(F.lit("") if not isinstance(c, str) else c)
    rows = li.select(
        "invoice", "pos", F.col("o_custkey").alias("partner"), F.lit(3).cast("long").alias("journal"), first(F.concat(F.lit("1-"), F.col("invoice").cast("string"))).alias("number"), first(F.col("day")).alias("date"), F.lit("").alias("due"),
        F.col("l_returnflag").alias("name"), "qty", "price", F.col("l_partkey").alias("product"), F.lit(None).cast("long").alias("unit"), F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("po_line"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("order_name"), F.lit("").alias("chosen"), ((F.col("pos") == 0) & (F.col("invoice") % 3 == 0)).alias("overwrite"), F.lit(True).alias("is_content"),
    )
    k = F.col("invoice") % 4
    have = o.select("invoice", F.col("o_custkey").alias("partner"), F.when(k == 0, 2).otherwise(3).cast("long").alias("journal"), F.when(k != 1, F.concat(F.lit("1-"), F.col("invoice").cast("string"))).alias("number"), F.col("iso").alias("date"), F.when(k == 2, "2030-01-01").otherwise(F.col("iso")).alias("due"), F.lit(None).cast("string").alias("origin"))
    kept = li.select(
        "invoice", (F.col("invoice") * 100 + F.col("pos")).alias("id"), (10 + F.col("pos")).alias("sequence"), F.when(F.col("pos") % 2 == 0, F.col("l_returnflag")).otherwise("old").alias("name"),
        (F.col("qty") + F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).cast("decimal(20,6)").alias("qty"), F.col("price").cast("decimal(20,6)").alias("price"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey")).alias("product"), F.col("l_suppkey").alias("account"), F.when(F.col("pos") % 2 == 1, F.col("l_partkey")).alias("po_line"),
    )
    expected = cut(_expected(spark, d))
    off = F.when(F.col("tax_id") == 63, F.col("amount") - 1).otherwise(F.col("amount")).cast("decimal(18,2)")
    taxes = expected.where("(invoice + tax_id) % 4 <> 0").select("invoice", (F.col("invoice") * 100 + F.col("tax_id")).alias("id"), "tax_id", off.alias("amount"))
    orders = table(spark, d, "part").where("p_size % 5 > 0").select(F.col("p_partkey").alias("po_line"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return rows, expected, sync.State(have, kept, taxes, orders)


#: A line's link is its part, if orders have it and no earlier line of the invoice took it.
_IMPORT_SQL = _EXPECTED_SQL + """, r as (select l.*, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as iso, p_partkey is not null as known, row_number() over (partition by invoice, l_partkey order by pos) as nth from lines l join orders on o_orderkey = invoice left join part on p_partkey = l_partkey and p_size % 5 > 0),
org as (select invoice, max(case when l_partkey % 2 = 0 then 'P' || o_custkey end) as origin from r group by 1),
w as (select *, case when known and nth = 1 then l_partkey end as link from r),
paid as (select link, arg_max(price, invoice * 100 + pos) as price, arg_max(invoice, invoice * 100 + pos) as inv from w where link is not null and invoice % 3 = 0 group by 1),
last as (select link, max(invoice) as inv from w where link is not null group by 1),
c as (select distinct h.invoice, 0 as step, 'bill' as target, field, value from (select distinct invoice, o_custkey, iso from r) h join org using (invoice), lateral (values ('journal', case when h.invoice % 4 = 0 then '3' end), ('number', case when h.invoice % 4 = 1 then '1-' || h.invoice end), ('due', case when h.invoice % 4 = 2 then iso end), ('origin', nullif(coalesce(origin, ''), ''))) f(field, value) where value is not null
  union all select invoice, 2, cast(invoice * 100 + pos as varchar), 'name', l_returnflag from r where pos % 2 = 1
  union all select invoice, 2, cast(invoice * 100 + pos as varchar), 'qty', cast(cast(qty as decimal(20,6)) as varchar) from r where pos % 3 = 0
  union all select invoice, 2, cast(invoice * 100 + pos as varchar), 'product', cast(l_partkey as varchar) from r where l_partkey % 5 = 0 and l_partkey > 0
  union all select invoice, 3, cast(invoice * 100 + pos as varchar), 'po_line', coalesce(cast(link as varchar), '') from w where link is distinct from case when pos % 2 = 1 then l_partkey end
  union all select last.inv, 5, cast(paid.link as varchar), 'price', cast(cast(paid.price as decimal(20,6)) as varchar) from paid join last using (link) join part on p_partkey = paid.link where abs(cast(p_retailprice as decimal(12,2)) - paid.price) > 0.001
  union all select invoice, 6, cast(invoice * 100 + tax_id as varchar), 'amount', cast(amount as varchar) from expected where amount > 0 and tax_id = 63 and (invoice + 63) % 4 <> 0)"""

_HEADER = ["partner", "journal", "number", "date", "due"]


@query("sync_plan", _IMPORT_SQL + " select invoice, step, target, field, value, row_number() over (partition by invoice order by step, target, field) - 1 as nth from c")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    """All that must be written to bring the bills to the import, composed from its rows."""
    rows, expected, state = _import(spark, d)
    return sync.composed(rows, expected, state, _HEADER)


@query("sync_replayed", _IMPORT_SQL + " select invoice, invoice * 100 + pos as id, l_returnflag as name, cast(qty as double) as qty, cast(price as double) as price, nullif(l_partkey, 0) as product, l_suppkey as account, link as po_line from w")
def sync_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The bills' lines after the plan: those of the import."""
    rows, expected, state = _import(spark, d)
    after = sync.replayed(state, sync.composed(rows, expected, state, _HEADER, sync.links(rows, state, _HEADER)))
    return doubles(after.lines.drop("sequence"), "qty", "price")


@query("sync_left", _IMPORT_SQL + " select count(*) as planned, 0 as left_over from c")
def sync_left(spark: SparkSession, d: str) -> DataFrame:
    """How many writes the plan has, and how many a second plan finds after it: none."""
    rows, expected, state = _import(spark, d)
    both = sync.proved(rows, expected, state, _HEADER)
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    return both.agg(count("planned").alias("planned"), count("left").cast("int").alias("left_over"))


# Saved rows in another tenant's catalogue


@query("remapped_accounts", """select c_custkey as invoice, case when c_custkey % 4 < 3 then n_nationkey + 100 else 7 end as account from customer join nation on n_nationkey = c_nationkey""")
def remapped_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts named after nations; labels in full, with another code, mistyped, and none."""
    n = table(spark, d, "nation")
    accounts = n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.concat(F.lit("5.1."), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))
    k = F.col("c_custkey") % 4
    label = F.when(k == 0, F.concat(F.lit("5.1."), F.col("n_nationkey").cast("string"), F.lit(" "), F.lower("n_name"))).when(k == 1, F.concat(F.lit("5.1.99 "), "n_name")).when(k == 2, F.concat("n_name", F.lit("x"))).otherwise(" ")
    headers = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("invoice"), F.lit(7).cast("long").alias("account"), label.alias("label"))
    return saved.remapped_accounts(headers, accounts, 65.0, lookup.similarity)


@query("remapped_kinds", """select c_custkey as invoice, case when c_custkey % 9 = 8 then null when c_custkey % 9 >= 5 and c_custkey % 3 <> 1 then 1 else c_custkey % 9 end as kind from customer""")
def remapped_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by region, of which one is FACTURAS C; saved kinds of which some are not there."""
    r = F.col("r_regionkey")
    kinds = table(spark, d, "region").select(r.cast("long").alias("id"), F.when(r == 0, "FACTURAS A").when(r == 1, "Facturas c").otherwise(F.col("r_name")).alias("name"), F.lit("").alias("code"), r.alias("pos"))
    k = F.col("c_custkey")
    rate = F.when(k % 3 == 0, "IVA no corresponde ").when(k % 3 == 1, "21").otherwise("0%")
    return saved.remapped_kinds(table(spark, d, "customer").select(k.alias("invoice"), F.when(k % 9 < 8, k % 9).alias("kind"), rate.alias("rate")), kinds, ["pos"])


# Lists of a catalogue


@query("catalogue_lists", """select 'partners' as kind, cast(s_suppkey as varchar) as id, s_name as name, upper(s_name) as sort_key from supplier
union all select 'journals', cast(r_regionkey as varchar), r_name, upper(r_name) from region union all select 'categories', cast(n_nationkey as varchar), n_name, upper(n_name) from nation
union all select 'accounts', cast(min(p_partkey) as varchar), p_brand, upper(p_brand) from part group by p_brand
union all select 'kinds', cast(min(o_orderkey) as varchar), o_orderpriority, upper(o_orderpriority) from orders group by o_orderpriority
union all select 'products', cast(min(p_partkey) as varchar), p_name, upper(p_name) from part where p_partkey % 10 > 0 group by p_name, p_type""")
def catalogue_lists(spark: SparkSession, d: str) -> DataFrame:
    """Six lists, of which some have a name more than once and products of blank name."""
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    one = lambda name, key, label: table(spark, d, name).select(F.col(key).alias("id"), F.col(label).alias("name"))
    products = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), "p_type")
    return registry.catalogue(
        {
            "partners": (one("supplier", "s_suppkey", "s_name"), ["id"], ["name"]),
            "journals": (one("region", "r_regionkey", "r_name"), ["id"], ["name"]),
            "categories": (one("nation", "n_nationkey", "n_name"), ["id"], ["name"]),
            "accounts": (part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), ["name"], ["id"]),
            "kinds": (orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")), ["name"], ["id"]),
            "products": (products, ["name", "p_type"], ["id"]),
        }
    )


@query("names_or_registry", "select distinct 'empty' as asked, p_brand as name from part union all select distinct 'filled', n_name from nation where n_regionkey = 1")
def names_or_registry(spark: SparkSession, d: str) -> DataFrame:
    """With two sources that have no names, and with one that has some."""
    n, brands = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), table(spark, d, "part").select(F.col("p_brand").alias("name"))
    blank = n.withColumn("name", F.lit("  "))
    empty = registry.names_or_registry("name", brands, n.where("n_regionkey > 90"), blank).withColumn("asked", F.lit("empty"))
    return empty.unionByName(registry.names_or_registry("name", brands, blank, n.where("n_regionkey = 1"), n).withColumn("asked", F.lit("filled")))


@query("filtered_arms", "select 'some' as asked, s_suppkey from supplier where s_nationkey = 3 or not exists (select 1 from supplier where s_nationkey = 3) union all select 'none', s_suppkey from supplier")
def filtered_arms(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation, if it has any, and of a nation that is not there, which leaves all."""
    s = table(spark, d, "supplier")
    arms = [registry.filtered_or_all(s, F.col("s_nationkey") == k).select(F.lit(name).alias("asked"), "s_suppkey") for name, k in (("some", 3), ("none", 99))]
    return arms[0].unionByName(arms[1])
