"""Text: normalization, keys, document numbers, descriptions. Column in, Column out; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of units and the unit they mean.
UNIT_ALIASES = {"UN": "Units", "U": "Units", "UNIDAD": "Units", "UNIDADES": "Units", "UNIDAD(ES)": "Units", "UNIT": "Units", "UNITS": "Units", "PIEZA": "Units", "PIEZAS": "Units", "KG": "kg", "KGS": "kg", "KILO": "kg", "KILOS": "kg", "GR": "g", "GRS": "g", "G": "g", "LT": "L", "L": "L", "LTS": "L", "LITRO": "L", "LITROS": "L", "ML": "ml", "M": "m", "MT": "m", "M2": "m²", "MES": "Units"}
ACCENTS = ("ÁÉÍÓÚÜÑ", "AEIOUUN")


def normalize(c: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def label_key(c: Column) -> Column:
    return F.upper(normalize(c))


def accent_fold(c: Column) -> Column:
    return F.translate(label_key(c), *ACCENTS)


def digits(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is not null and not 'nan'; an empty text ends the search."""
    return F.coalesce(*[F.when(c.isNotNull() & (F.lower(normalize(c)) != "nan"), normalize(c)) for c in candidates], F.lit(""))


def document_number(c: Column) -> Column:
    """'12-345' or 13 digits as five digits, a dash, eight digits; anything else as it is. Longer parts are not cut."""
    t = normalize(c)
    a, b = F.regexp_extract(t, r"^(\d+)\s*-\s*(\d+)$", 1), F.regexp_extract(t, r"^(\d+)\s*-\s*(\d+)$", 2)

    def fill(x: Column, n: int) -> Column:
        return F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))

    return F.when(t.rlike(r"^\d{13}$"), F.concat(F.substring(t, 1, 5), F.lit("-"), F.substring(t, 6, 8))).when(a != "", F.concat(fill(a, 5), F.lit("-"), fill(b, 8))).otherwise(t)


def document_type(c: Column) -> Column:
    """Invoices A, B and C by their letter; everything else is OC-X."""
    t = accent_fold(c)
    letter = F.regexp_extract(t, r"^(?:FACTURAS? )?([ABC])$", 1)
    return F.when(letter != "", F.concat(F.lit("FACTURAS "), letter)).otherwise(F.lit("OC-X"))


def account_parts(c: Column) -> tuple[Column, Column]:
    """The code and the name of '1.1.02 Cash'; no code if it does not begin with one."""
    t = normalize(c)
    pattern = r"^([0-9][0-9.\-]*)\s+(.+)$"
    code = F.regexp_extract(t, pattern, 1)
    return code, F.when(code != "", F.regexp_extract(t, pattern, 2)).otherwise(t)


def unit(c: Column) -> Column:
    """The unit a spelling means, or the spelling in capitals; empty for 'nan', 'none' and 'null'."""
    t = label_key(c)
    table = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.when(t.isin("NAN", "NONE", "NULL"), "").otherwise(F.coalesce(table[t], t))


#: Fixed value: a quantity and its unit in a description.
QUANTITY = r"(?i)(\d+(?:[.,]\d+)?)\s*(kgs?|kilos?|grs?|g|l|lt|litros?|un|unid(?:ades?)?)\b"


def quantity_and_unit(c: Column) -> tuple[Column, Column]:
    """The first quantity with a unit in a description: '12,5 kg' -> ('12.5', 'kg')."""
    pattern = QUANTITY
    t = normalize(c)
    return F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")), unit(F.regexp_extract(t, pattern, 2))


def repair_scan(c: Column) -> Column:
    """0, 1 and 5 read as O, I and S in words that are letters of any script but for one character at most.

    Words end at blanks, slashes and dashes, which stay.
    """
    parts = F.regexp_extract_all(label_key(c), F.lit(r"([^\s/\-]+|[\s/\-]+)"), F.lit(1))
    letters = lambda w: F.length(F.regexp_replace(w, r"\P{L}", ""))
    fixed = F.transform(parts, lambda w: F.when((F.length(w) >= 3) & (letters(w) >= F.greatest(F.lit(2), F.length(w) - 1)), F.translate(w, "015", "OIS")).otherwise(w))
    return F.array_join(fixed, "")


def ids_in(c: Column) -> Column:
    """The whole numbers in a text, in order: '[63, 70]' -> [63, 70]; an empty list without any."""
    return F.coalesce(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int")), F.array().cast("array<int>"))


def reference(c: Column) -> tuple[Column, Column]:
    """The id and the label of '[7, "Cash"]', '7', or 'false': null for what is not there."""
    t = F.trim(c)
    pair = F.from_json(F.when(t.startswith("["), t), "array<string>")
    digits_only = F.when(t.rlike(r"^\d+$"), t)
    return F.coalesce(F.get(pair, F.lit(0)), digits_only).try_cast("long"), F.nullif(normalize(F.get(pair, F.lit(1))), F.lit(""))


def match_key(tax_id: Column, name: Column) -> Column:
    """What names a supplier: 'cuit:' and its digits, else 'name:' and its name in capitals; null for neither."""
    d, n = digits(tax_id), label_key(name)
    return F.when(d != "", F.concat(F.lit("cuit:"), d)).when(n != "", F.concat(F.lit("name:"), n))


#: States of a receipt and what the screen shows.
RECEIPTS = {"pending": "No recepcionada", "partial": "Parcialmente recepcionada", "full": "Recepcionada"}


def receipt_label(c: Column) -> Column:
    """The label of a receipt's state; blank means received, an unknown state stays."""
    table = F.create_map(*[F.lit(x) for pair in RECEIPTS.items() for x in pair])
    return F.when(F.coalesce(c, F.lit("")) == "", RECEIPTS["full"]).otherwise(F.coalesce(table[c], c))


#: What users and forms write for yes.
YES = ("1", "true", "yes", "si", "sí", "on")


def truthy(c: Column) -> Column:
    """Whether a text or a boolean says yes; blank and null do not."""
    return F.lower(normalize(c.cast("string"))).isin(*YES)


def deliver_to(address: Column, picking: Column) -> Column:
    """Where an order is delivered: the label of its address, else of its picking type, as [id, label] texts; blank without one."""
    return F.coalesce(*[F.nullif(normalize(reference(c)[1]), F.lit("")) for c in (address, picking)], F.lit(""))


def slot_name(n: Column, amount: bool = False) -> Column:
    """The column of the n-th other tax or of its amount; the first has no number."""
    number = F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise("")
    return F.concat(F.lit("otros_impuestos"), number, F.lit("_monto" if amount else ""))


def tokens(c: Column) -> Column:
    """The distinct words of three letters or more, cut at blanks, slashes and dashes."""
    return F.array_distinct(F.filter(F.split(label_key(c), r"[\s/\-]+"), lambda w: F.length(w) >= 3))
