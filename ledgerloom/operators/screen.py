"""The columns of rows on a screen and in a CSV file: what they are, and which a tax mode or a tenant has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns in order, the label, and the list a value is chosen from.
COLUMNS = [
    ("l10n_latam_document_number", "Número de Documento", None),
    ("CUIT", "Cuit", None),
    ("partner_id", "Proveedor", "proveedores"),
    ("l10n_latam_document_type_id", "Tipo de Documento", "document_types"),
    ("invoice_date", "Fecha factura", None),
    ("invoice_date_due", "Fecha de vencimiento", None),
    ("x_studio_category", "Rubros", "rubros"),
    ("invoice_line_ids/name", "Etiqueta", None),
    ("invoice_line_ids/product_id", "Producto", "productos"),
    ("journal_id", "Diario", "journals"),
    ("invoice_line_ids/account_id", "Cuenta", "cuentas"),
    ("invoice_line_ids/quantity", "Cantidad", None),
    ("invoice_line_ids/price_unit", "Precio", None),
    ("iva_monto", "Monto IVA", None),
    ("iva_pct", "Impuesto IVA", "iva_options"),
    ("otros_impuestos_monto", "Monto Otros Impuestos", None),
    ("otros_impuestos", "Otros Impuestos", "otros_impuestos_options"),
    ("__qty_pedido", "Cant. pedida", None),
    ("__qty_recibido", "Cant. recibida", None),
    ("__um_proveedor", "UM proveedor", None),
    ("__um_empresa", "UM empresa", None),
    ("__oc_match_note", "Notas OC/UM", None),
]
#: Columns of numbers, those nobody edits, those a file does not have, and names in a file.
NUMBERS = ("invoice_line_ids/quantity", "invoice_line_ids/price_unit", "iva_monto", "otros_impuestos_monto", "__qty_pedido", "__qty_recibido")
READ_ONLY = ("CUIT", "__qty_pedido", "__qty_recibido", "__um_proveedor", "__um_empresa", "__oc_match_note")
NOT_IN_FILES = ("otros_impuestos", "__qty_pedido", "__qty_recibido", "__um_proveedor", "__um_empresa", "__oc_match_note")
FILE_NAMES = {
    "partner_id": "partner_id/.id",
    "l10n_latam_document_type_id": "l10n_latam_document_type_id/.id",
    "x_studio_category": "x_studio_category/.id",
    "journal_id": "journal_id/.id",
    "invoice_line_ids/account_id": "invoice_line_ids/account_id/.id",
    "invoice_line_ids/product_id": "invoice_line_ids/product_id/.id",
}
CATEGORY = "x_studio_category"


def columns(spark: SparkSession, with_category: bool = True) -> DataFrame:
    """nth, key, label, type, options, readonly, editable and file_name of each column; tenants without categories lack theirs."""
    rows = []
    for key, label, options in COLUMNS:
        if key == CATEGORY and not with_category:
            continue
        kind = "selection" if options else "numeric" if key in NUMBERS else "text"
        fixed = key in READ_ONLY
        rows.append((len(rows), key, label, kind, options, fixed, kind == "text" and not fixed, None if key in NOT_IN_FILES else FILE_NAMES.get(key, key)))
    return spark.createDataFrame(rows, "nth int, key string, label string, type string, options string, readonly boolean, editable boolean, file_name string")


def shown(keys: DataFrame, modes: DataFrame) -> DataFrame:
    """invoice, key: the columns each invoice shows (keys: key; modes: invoice, mode, header_only).

    The amount of VAT is shown with mode line and for a header only; subtotal and the amounts of other taxes for a header
    only; all others always.
    """
    vat = (F.col("mode") == "line") | F.col("header_only")
    of_header = (F.col("key") == "__subtotal") | F.col("key").rlike(r"^otros_impuestos(_\d+)?_monto$")
    seen = F.when(F.col("key") == "iva_monto", vat).when(of_header, F.col("header_only")).otherwise(True)
    listed = keys.agg(F.collect_list("key").alias("k"))  # one row of a few dozen names
    each = modes.join(F.broadcast(listed), F.lit(True)).select("invoice", "mode", "header_only", F.explode("k").alias("key"))
    return each.where(seen).select("invoice", "key")


def for_tenant(df: DataFrame, with_category: bool) -> DataFrame:
    """The rows as a tenant's file has them: without categories where it has none, columns under the file's names."""
    kept = df if with_category else df.drop(CATEGORY)
    return kept.withColumnsRenamed({k: v for k, v in FILE_NAMES.items() if k in kept.columns})


def tax_names(label: Column, others: Column, special: Sequence[str]) -> Column:
    """The names of a row's taxes in order, each once: its VAT ('IVA 10.5%', a special label as it is, none for 0), then its other taxes."""
    rate = F.when(label.isin(*special), label).when((label != "") & (label != "0"), F.concat(F.lit("IVA "), F.when(F.replace(label, F.lit(" "), F.lit("")).rlike(r"^\d+,\d+$"), F.replace(label, F.lit(","), F.lit("."))).otherwise(label), F.lit("%")))
    return F.array_distinct(F.filter(F.concat(F.array(rate), others), lambda x: x.isNotNull() & (x != "")))
