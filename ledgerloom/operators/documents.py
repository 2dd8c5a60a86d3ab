"""Process documents: JSON of invoices with items, flattened to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from .bills import ZERO_LABELS

#: The keys of a document, in the order in which they are asked.
SUBTOTALS = ("subtotal", "subtotal_sin_iva", "subtotal_sin_ivas", "base_imponible", "importe_neto", "total_sin_iva", "total_neto", "neto", "importe_total_neto", "monto_neto")
VAT_TOTALS = ("iva_monto", "iva_total", "importe_iva", "total_iva", "monto_iva", "impuesto_iva")
VAT_RATES = {"iva_21": "21", "iva_10_5": "10.5", "iva_27": "27", "iva_2_5": "2.5", "iva_5": "5"}
PERCEPTIONS = ("percepcion_iibb", "percepcion_iva", "otros_tributos")

_ITEM_KEYS = ("descripcion", "cantidad", "precio_unitario", "subtotal_sin_iva", "subtotal", "codigo", "unidad_medida", "alicuota_iva", "otros_impuestos", "otros_tributos")
_HEADER_KEYS = ("numero_factura", "fecha", "fecha_de_vencimiento", "fecha_vencimiento", "tipo_comprobante", *SUBTOTALS, *VAT_TOTALS, *VAT_RATES, *PERCEPTIONS)
ITEM = f"STRUCT<{', '.join(f'{k}: STRING' for k in _ITEM_KEYS)}>"
INVOICE = f"STRUCT<{', '.join(f'{k}: STRING' for k in _HEADER_KEYS)}, proveedor: STRUCT<razon_social: STRING, nombre: STRING, cuit: STRING>, items: ARRAY<{ITEM}>>"
PROCESS = f"STRUCT<facturas: ARRAY<STRUCT<json: STRUCT<factura: {INVOICE}>>>>"
PROBE = "STRUCT<facturas: ARRAY<STRING>, _corrupt_record: STRING>"


def decoded(c: Column, kind: str = PROCESS) -> Column:
    """A JSON document, or a JSON string that holds one; null if it is neither, and without invoices if it is broken."""
    inner = F.when(F.trim(c).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)
    return F.from_json(F.when(F.trim(inner).startswith("{"), inner), kind)


def rejects(processes: DataFrame) -> DataFrame:
    """process and reason of the rows whose document cannot be used."""
    d = processes.withColumn("__d", decoded(F.col("json_data"), PROBE))
    reason = F.when(F.col("json_data").isNull(), "null").when(F.trim("json_data") == "", "blank").when(F.col("__d").isNull() | F.col("__d._corrupt_record").isNotNull(), "not an object").when(F.col("__d.facturas").isNull(), "no invoices")
    return d.withColumn("reason", reason).where("reason is not null").select("process", "reason")


def invoices(processes: DataFrame) -> DataFrame:
    """process, invoice (0 on over usable invoices) and f, the document, of each invoice."""
    usable = F.filter(decoded(F.col("json_data"))["facturas"], lambda x: x["json"]["factura"].isNotNull())
    return processes.select("process", F.posexplode(usable).alias("invoice", "w")).select("process", "invoice", F.col("w.json.factura").alias("f"))


def lines(processes: DataFrame) -> DataFrame:
    """process, invoice, line (0 on), number, cuit, description, quantity, price and all other fields of each item.

    An invoice without items gives one blank line; wrappers without an invoice are skipped and not counted.
    """
    e = invoices(processes).select("process", "invoice", F.col("f.numero_factura").alias("number"), F.col("f.proveedor.cuit").alias("cuit"), F.posexplode(_items()).alias("line", "item"))
    return e.select("process", "invoice", "line", "number", "cuit", *_fields())


def _items() -> Column:
    """The items of f, one that is null if there is none."""
    return F.when(F.size("f.items") > 0, F.col("f.items")).otherwise(F.array(F.lit(None).cast(ITEM)))


def _fields() -> list[Column]:
    """The fields of an item by their names in a line."""
    named = {"descripcion": "description", "cantidad": "quantity", "precio_unitario": "price", "codigo": "code", "unidad_medida": "unit", "alicuota_iva": "rate"}
    return [F.col(f"item.{k}").alias(named.get(k, k)) for k in _ITEM_KEYS]


def _number_kind_supplier() -> list[Column]:
    supplier = F.coalesce(F.nullif(text.normalize(F.col("f.proveedor.razon_social")), F.lit("")), text.normalize(F.col("f.proveedor.nombre")))
    return [text.document_number(F.col("f.numero_factura")).alias("number"), text.document_type(F.col("f.tipo_comprobante")).alias("kind"), supplier.alias("supplier")]


def tax_label(rate: Column, other: Column, kind: Column) -> tuple[Column, Column]:
    """The tax label of a line and its other tax: a rate, 2.5 written as 2,5; else another tax that means no VAT; else, on invoices of class C, that there is none."""
    t, o = text.normalize(rate), text.normalize(other)
    dotted = F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("."), F.lit(","))
    shown = F.when(dotted.isin("2,5", "10,5"), dotted).otherwise(t)
    moved = (t == "") & o.isin(*ZERO_LABELS)
    label = F.when(t != "", shown).when(moved, o).when(kind == "FACTURAS C", "IVA No Corresponde").otherwise("")
    return label, F.when(moved, "").otherwise(o)


def headers(processes: DataFrame) -> DataFrame:
    """process, invoice, number, kind, date, due, supplier, cuit, subtotal, vat (text), rates (rate to amount) and slots.

    vat is the sum of the rates' positive amounts, else the first of the totals that is there. slots lists the positive
    amounts of other taxes, in their order, as label and amount.
    """
    f = lambda k: F.col(f"f.{k}")
    by_rate = F.filter(F.array(*[F.struct(F.lit(r).alias("key"), numbers.amount(f(k)).alias("value")) for k, r in VAT_RATES.items()]), lambda x: x["value"] > 0)
    total = F.aggregate(by_rate, F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x["value"]).cast("decimal(28,6)"))
    slots = F.filter(F.array(*[F.struct(F.lit(k).alias("label"), F.round(numbers.amount(f(k)), 2).cast("decimal(18,2)").alias("amount")) for k in PERCEPTIONS]), lambda x: x["amount"] > 0)
    vat = F.when(F.size(by_rate) > 0, numbers.money_or_blank(total)).otherwise(text.first_filled(*[f(k) for k in VAT_TOTALS]))
    number, kind, supplier = _number_kind_supplier()
    return invoices(processes).select(
        "process",
        "invoice",
        number,
        kind,
        dates.for_screen(f("fecha")).alias("date"),
        dates.for_screen(F.coalesce(F.nullif(f("fecha_de_vencimiento"), F.lit("")), f("fecha_vencimiento"))).alias("due"),
        supplier,
        text.normalize(f("proveedor.cuit")).alias("cuit"),
        text.first_filled(*[f(k) for k in SUBTOTALS]).alias("subtotal"),
        vat.alias("vat"),
        F.map_from_entries(F.transform(by_rate, lambda x: F.struct(x["key"], numbers.money_or_blank(x["value"])))).alias("rates"),
        slots.alias("slots"),
    )


def screen_lines(processes: DataFrame) -> DataFrame:
    """process, invoice, line, number, supplier, description, quantity, price, label and other of each line, as a screen shows them.

    Header fields are on the first line only; quantity and price are derived where the document has none. A document
    is read once, and its lines take its header with them. Lines are made inside their document's row: as columns of
    exploded rows they are one method too long for the JVM to compile.
    """
    shown = lambda d: F.coalesce(numbers.for_screen(d), F.lit(""))

    def read(x: Column) -> Column:
        net = F.coalesce(numbers.amount(x["subtotal_sin_iva"]), numbers.amount(x["subtotal"]))
        other = F.coalesce(F.nullif(x["otros_impuestos"], F.lit("")), x["otros_tributos"])
        return F.struct(x["descripcion"].alias("description"), numbers.amount(x["cantidad"]).alias("q"), numbers.amount(x["precio_unitario"]).alias("p"), net.alias("n"), x["alicuota_iva"].alias("rate"), other.alias("other"))

    def derived(x: Column) -> Column:
        qty, price = numbers.quantity_and_price(x["q"], x["p"], x["n"])
        return F.struct(text.normalize(x["description"]).alias("description"), qty.alias("q"), price.alias("p"), text.normalize(x["rate"]).alias("rate"), text.normalize(x["other"]).alias("other"))

    number, kind, supplier = _number_kind_supplier()

    def made(x: Column, n: Column) -> Column:
        label, other = tax_label(x["rate"], x["other"], kind)
        once = lambda c: F.when(n == 0, c).otherwise("")
        return F.struct(once(number).alias("number"), once(supplier).alias("supplier"), x["description"].alias("description"), shown(x["q"]).alias("quantity"), shown(x["p"]).alias("price"), label.alias("label"), other.alias("other"))

    items = F.transform(F.transform(F.transform(_items(), read), derived), made)
    return invoices(processes).select("process", "invoice", F.posexplode(items).alias("line", "item")).select("process", "invoice", "line", "item.*")


def description_lists(processes: DataFrame) -> DataFrame:
    """process, labels: the sorted distinct descriptions of a process's lines, blank ones left out."""
    t = text.normalize(F.col("description"))
    return lines(processes).groupBy("process").agg(F.array_sort(F.collect_set(F.when(t != "", t))).alias("labels"))


def rates_text(rates: Column) -> Column:
    """A map of amounts by rate as JSON, and null for an empty one."""
    return F.when(F.size(rates) > 0, F.to_json(rates))


def rates_read(c: Column) -> Column:
    """The positive amounts by rate of such a text; an empty map for anything else."""
    read = F.transform_values(F.from_json(F.when(F.trim(c).startswith("{"), c), "map<string,string>"), lambda _, v: numbers.loose_amount(v))
    return F.coalesce(F.map_filter(read, lambda k, v: (k != "_total") & (v > 0)), F.create_map().cast(f"map<string,{numbers.MONEY}>"))
