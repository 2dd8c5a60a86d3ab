"""Kinds of invoices: which catalogue entry a label means, and their names in Spanish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .order import first_per_key

#: Words of kinds that are no plain purchase invoice, and the usual code of each letter.
NO_INVOICE = ("NOTA DE CREDITO", "NOTA DE DEBITO", "NOTA DE CRÉDITO", "NOTA DE DÉBITO", "CREDIT NOTE", "DEBIT NOTE", "DEBIT MEMO", "TIQUE", "TICKET", "MIPYME", "SMB", "FCE", "CREDITO ELECTRONICA", "CRÉDITO ELECTRÓNICA", "ELECTRONIC CREDIT", "ELECTRONIC DEBIT")
LETTER_CODES = {"A": "1", "B": "6", "C": "11"}
OTHER_CODES = ("OC-X", "99")

#: English names of kinds and their Spanish ones, where no rule below gives them.
SPANISH = {
    "CLASS A SINGLE COMMERCIAL TAX SETTLEMENT": "LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE A",
    "CLASS B SINGLE COMMERCIAL TAX SETTLEMENT": "LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE B",
    "CLASS C SINGLE COMMERCIAL TAX SETTLEMENT": "LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE C",
    "CREDIT NOTE SINGLE COMMERCIAL TAX SETTLEMENT CLASS A": "NOTA DE CRÉDITO LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE A",
    "CREDIT NOTE SINGLE COMMERCIAL TAX SETTLEMENT CLASS B": "NOTA DE CRÉDITO LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE B",
    "CREDIT NOTE SINGLE COMMERCIAL TAX SETTLEMENT CLASS C": "NOTA DE CRÉDITO LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE C",
    "DEBIT NOTE SINGLE COMMERCIAL TAX SETTLEMENT CLASS A": "NOTA DE DÉBITO LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE A",
    "DEBIT NOTE SINGLE COMMERCIAL TAX SETTLEMENT CLASS B": "NOTA DE DÉBITO LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE B",
    "DEBIT NOTE SINGLE COMMERCIAL TAX SETTLEMENT CLASS C": "NOTA DE DÉBITO LIQUIDACIÓN ÚNICA IMPOSITIVA CLASE C",
    "CREDIT NOTE TICKET": "NOTA DE CRÉDITO TIQUE",
    "CREDIT NOTE TICKET A": "NOTA DE CRÉDITO TIQUE A",
    "CREDIT NOTE TICKET B": "NOTA DE CRÉDITO TIQUE B",
    "CREDIT NOTE TICKET C": "NOTA DE CRÉDITO TIQUE C",
    "CREDIT NOTE TICKET M": "NOTA DE CRÉDITO TIQUE M",
    "DEBIT NOTE TICKET A": "NOTA DE DÉBITO TIQUE A",
    "DEBIT NOTE TICKET B": "NOTA DE DÉBITO TIQUE B",
    "DEBIT NOTE TICKET C": "NOTA DE DÉBITO TIQUE C",
    "DEBIT NOTE TICKET M": "NOTA DE DÉBITO TIQUE M",
    "CREDIT NOTES FOR FOREIGN OPERATIONS": "NOTAS DE CRÉDITO POR OPERACIONES CON EL EXTERIOR",
    "CREDIT NOTES M": "NOTAS DE CRÉDITO M",
    "DEBIT MEMOS M": "NOTAS DE DÉBITO M",
    "DEBIT NOTES FOR FOREIGN OPERATIONS": "NOTAS DE DÉBITO POR OPERACIONES CON EL EXTERIOR",
    "ELECTRONIC CREDIT INVOICE FOR SMBS (ECF) B": "FACTURA DE CRÉDITO ELECTRÓNICA MiPyMEs (FCE) B",
    "ELECTRONIC CREDIT INVOICE FOR SMBS (FCE) C": "FACTURA DE CRÉDITO ELECTRÓNICA MiPyMEs (FCE) C",
    "ELECTRONIC CREDIT INVOICE FOR SMBS (FCE) TO": "FACTURA DE CRÉDITO ELECTRÓNICA MiPyMEs (FCE) A",
    "ELECTRONIC CREDIT NOTE SME SMES (FCE) A": "NOTA DE CRÉDITO ELECTRÓNICA MiPyMEs (FCE) A",
    "ELECTRONIC CREDIT NOTE SME'S (FCE) C": "NOTA DE CRÉDITO ELECTRÓNICA MiPyMEs (FCE) C",
    "ELECTRONIC CREDIT NOTICE FOR SMBS (FCE) B": "NOTA DE CRÉDITO ELECTRÓNICA MiPyMEs (FCE) B",
    "ELECTRONIC DEBIT NOTE SME'S (FCE) B": "NOTA DE DÉBITO ELECTRÓNICA MiPyMEs (FCE) B",
    "ELECTRONIC DEBIT NOTE SME'S (FCE) C": "NOTA DE DÉBITO ELECTRÓNICA MiPyMEs (FCE) C",
    "ELECTRONIC DEBIT NOTE SMMES (FCE) A": "NOTA DE DÉBITO ELECTRÓNICA MiPyMEs (FCE) A",
    "EXPORT INVOICES": "FACTURAS DE EXPORTACIÓN",
    "FOREIGN CREDIT NOTES AND REIMBURSEMENTS": "NOTAS DE CRÉDITO Y REINTEGROS DEL EXTERIOR",
    "IMPORT CLEARANCE": "DESPACHO DE IMPORTACIÓN",
    "INVOICES AND RECEIPTS FROM ABROAD": "FACTURAS Y RECIBOS DEL EXTERIOR",
    "INVOICES M": "FACTURAS M",
    "LIQUIDATION OF CLASS A UTILITIES": "LIQUIDACIÓN DE SERVICIOS PÚBLICOS CLASE A",
    "LIQUIDATION OF CLASS B UTILITIES": "LIQUIDACIÓN DE SERVICIOS PÚBLICOS CLASE B",
    "LIQUIDATIONS A": "LIQUIDACIONES A",
    "LIQUIDATIONS B": "LIQUIDACIONES B",
    "OTHER COMPROBANTES A QUE CUMPLEN CON LA R.G. Nº 1415": "OTROS COMPROBANTES A QUE CUMPLEN CON LA R.G. Nº 1415",
    "OTHER COMPROBANTES B QUE CUMPLAN CON LA R.G. Nº 1415": "OTROS COMPROBANTES B QUE CUMPLAN CON LA R.G. Nº 1415",
    "OTHER COMPROBANTES C QUE CUMPLAN CON LA R.G. Nº 1415": "OTROS COMPROBANTES C QUE CUMPLAN CON LA R.G. Nº 1415",
    "OTHER VOUCHERS THAT DO NOT COMPLY WITH OR ARE EXEMPT FROM G.R. NO. 1415 AND AMENDMENTS THERETO": "OTROS COMPROBANTES QUE NO CUMPLEN O ESTÁN EXCEPTUADOS DE LA R.G. Nº 1415 Y SUS MODIFICATORIAS",
    "PROOF CREDIT NOTES WITH CODE. 34, 39, 58, 59, 60, 63, 96, 97,": "COMPROBANTES NOTAS DE CRÉDITO CON CÓD. 34, 39, 58, 59, 60, 63, 96, 97,",
    "PROOFS OF PURCHASE OF NON-REGISTRABLE GOODS TO FINAL CONSUMERS": "COMPROBANTES DE COMPRA DE BIENES NO REGISTRABLES A CONSUMIDORES FINALES",
    "RECEIPTS M": "RECIBOS M",
    "SALES ACCOUNTS AND LIQUID PRODUCT A": "CUENTAS DE VENTA Y LÍQUIDO PRODUCTO A",
    "SALES ACCOUNTS AND LIQUID PRODUCT B": "CUENTAS DE VENTA Y LÍQUIDO PRODUCTO B",
    "TICKET": "TIQUE",
    "TICKET - INVOICE B": "TIQUE - FACTURA B",
    "TICKET INVOICE M": "TIQUE FACTURA M",
}
#: The English and Spanish names of kinds that a letter follows.
LETTERED = {"INVOICES": "FACTURAS", "INVOICE": "FACTURA", "CREDIT NOTES": "NOTAS DE CRÉDITO", "DEBIT NOTES": "NOTAS DE DÉBITO", "DEBIT MEMOS": "NOTAS DE DÉBITO", "RECEIPT": "RECIBO", "TICKET INVOICE": "TIQUE FACTURA"}


def _mapped(pairs: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[c]


def spanish(c: Column) -> Column:
    """The Spanish name of a kind, case aside; what is unknown or Spanish already stays."""
    t = text.label_key(c)
    head, letter = F.regexp_extract(t, r"^(.+) ([ABC])$", 1), F.regexp_extract(t, r"^(.+) ([ABC])$", 2)
    kind = _mapped(LETTERED, head)
    return F.coalesce(_mapped(SPANISH, t), F.when(kind.isNotNull(), F.concat(kind, F.lit(" "), letter)), F.when(t == "OC-X", t), text.normalize(c))


def fit(name: Column, code: Column, letter: Column) -> Column:
    """0 to 100: how well a catalogue entry stands for invoices of a letter."""
    n, k = text.label_key(name), text.label_key(code)
    many, single = F.concat(F.lit("FACTURAS "), letter), F.concat(F.lit("FACTURA "), letter)
    steps = [
        (n.rlike("|".join(NO_INVOICE)), 0),
        ((n == many) | (n == F.concat(F.lit("INVOICES "), letter)), 100),
        ((n == single) | (n == F.concat(F.lit("INVOICE "), letter)), 95),
        (k == _mapped(LETTER_CODES, letter), 90),
        (n.contains(many), 80),
        (n.contains(single), 75),
        (n.endswith(F.concat(F.lit(" "), letter)) & n.contains("FACTURA"), 40),
    ]
    return F.coalesce(*[F.when(holds, value) for holds, value in steps], F.lit(0))


def by_label(kinds: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """keys, label and id: the entry for FACTURAS A, B and C and for OC-X in each catalogue (kinds: keys, id, name, code).

    The best fit wins, of equals the first. The last entry coded or named OC-X stands for it, else that of FACTURAS C.
    """
    named = kinds.select(*keys, "id", "name", "code", F.explode(F.array(*map(F.lit, LETTER_CODES))).alias("letter"), *[c for c in order if isinstance(c, str) and c not in {*keys, "id"}])
    scored = named.withColumn("fit", fit(F.col("name"), F.col("code"), F.col("letter"))).where("fit > 0")
    best = first_per_key(scored, [*keys, "letter"], [F.desc("fit"), *order]).select(*keys, F.concat(F.lit("FACTURAS "), "letter").alias("label"), "id")
    is_other = text.label_key(F.col("code")).isin(*OTHER_CODES) | (text.label_key(F.col("name")) == "OC-X")
    stated = kinds.where(is_other).groupBy(*keys).agg(F.max_by("id", F.struct(*order)).alias("id")).withColumn("rank", F.lit(0))
    instead = best.where("label = 'FACTURAS C'").select(*keys, "id").withColumn("rank", F.lit(1))
    other = first_per_key(stated.unionByName(instead), keys, ["rank"]).select(*keys, F.lit("OC-X").alias("label"), "id")
    return best.unionByName(other)
