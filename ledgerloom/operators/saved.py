"""Saved rows: their envelope, older column names, another tenant's catalogue, and backfill from the document."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similar, text
from ..sources.files import cut
from . import doctypes, lookup
from .order import first_per_key, numbered

#: Fixed value: the format of an envelope.
FORMAT = "odoo_matching_ui"


def packed(rows: DataFrame, key: str, fields: list[str], profile: Column, version: int = 1) -> DataFrame:
    """key and payload: a JSON envelope (format, version, odoo_profile, rows) of each key's rows, in order of pos."""
    one = F.struct("pos", F.struct(*fields).alias("row"))
    listed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]).alias("rows"), F.first(profile).alias("odoo_profile"))
    return listed.select(key, F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(version).alias("version"), "odoo_profile", "rows")).alias("payload"))


def unpacked(payloads: DataFrame, key: str, row: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, pos and the fields of the type `row`) of envelopes, and the rejects (key, reason).

    An envelope of another format is rejected, one that names none is taken; so are payloads that are no object or have
    no list of rows.
    """
    kind = f"STRUCT<format: STRING, rows: ARRAY<{row}>>"
    is_object = F.trim("payload").startswith("{")
    read = payloads.withColumn("__e", F.from_json(F.when(is_object, F.col("payload")), kind))
    listed = F.get_json_object("payload", "$.rows").startswith("[")
    reason = (
        F.when(F.col("payload").isNull(), "null")
        .when(~is_object, "not an object")
        .when((F.coalesce("__e.format", F.lit("")) != "") & (F.col("__e.format") != FORMAT), "another format")
        .when(~F.coalesce(listed, F.lit(False)), "no rows")
    )
    read = read.withColumn("reason", reason)
    rows = read.where("reason is null").select(key, F.posexplode("__e.rows").alias("pos", "__r")).select(key, "pos", "__r.*")
    return rows, read.where("reason is not null").select(key, "reason")


def migrated(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Old column names become new ones; a new column that is there and filled stays."""
    made = rows
    for old, new in names.items():
        if old in made.columns:
            kept = F.when(F.trim(F.col(f"`{new}`")) != "", F.col(f"`{new}`")) if new in made.columns else F.lit(None)
            made = made.withColumn(new, F.coalesce(kept, F.col(f"`{old}`"))).drop(old)
    return made


def from_document(rows: DataFrame, items: DataFrame, invoice: str, fields: Mapping[str, str]) -> DataFrame:
    """Adds fields of a document's items to rows of the same invoice at the same place, where the row has none.

    rows: invoice, pos; items: invoice, line (0 on). fields: the row's column and the item's.
    """
    placed = numbered(rows, [invoice], ["pos"], "__n")
    have = items.select(F.col(invoice).alias("__i"), F.col("line").alias("__l"), *[F.col(v).alias(f"__{k}") for k, v in fields.items()])
    j = placed.join(have, (F.col(invoice) == F.col("__i")) & (F.col("__n") == F.col("__l")), "left")
    own = {k: F.coalesce(F.when(F.trim(F.col(k).cast("string")) != "", F.col(k)) if k in rows.columns else F.lit(None), F.col(f"__{k}")) for k in fields}
    return j.withColumns(own).drop("__n", "__i", "__l", *[f"__{k}" for k in fields])


def remapped_products(rows: DataFrame, products: DataFrame, threshold: float = 72.0, score: Callable[[Column, Column], Column] = similar.weighted) -> DataFrame:
    """product of each row in another catalogue: kept if it is there, else by code, else by the most similar name, else kept.

    rows: row (a key), product, code, name; products: id, code, name. Rows without a product stay so.
    """
    known = products.select(F.col("id").alias("__v")).distinct()
    by_code = first_per_key(products.where(F.trim("code") != ""), ["code"], ["id"]).select(F.trim("code").alias("__c"), F.col("id").alias("__by_code"))
    j = rows.join(known, F.col("product") == F.col("__v"), "left").join(by_code, F.trim("code") == F.col("__c"), "left")
    open_ = j.where("product is not null and __v is null and __by_code is null")
    close = lookup.best_match(open_, "row", "name", products, "id", "name", threshold, score=score).select("row", F.col("id").alias("__by_name"))
    found = F.when(F.col("product").isNotNull() & F.col("__v").isNull(), F.coalesce("__by_code", "__by_name", "product")).otherwise(F.col("product"))
    return j.join(close, "row", "left").withColumn("product", found).drop("__v", "__c", "__by_code", "__by_name")


def remapped(headers: DataFrame, partners: DataFrame, registry: DataFrame, lists: Mapping[str, DataFrame], fuzzy: float = 72.0, score: Callable[[Column, Column], Column] = similar.weighted) -> DataFrame:
    """partner, changed and the fields of lists of each saved invoice in another tenant's catalogue.

    headers: invoice, name, cuit, partner and a column per list; partners: id, name, cuit; registry: name, cuit and a name
    per list (what the supplier's bills have); lists: id, name for each field, an account's name with its code. The
    partner is found by tax id, then by the most similar name. A field is found by the registry's name for the supplier,
    equal or similar; what is not found stays, as does an invoice without name and tax id. changed says that the partner
    is another one.
    """
    p = partners.select(F.col("id").alias("__id"), text.digits(F.col("cuit")).alias("__d"), F.col("name").alias("__n"))
    by_doc = first_per_key(p.where("__d <> ''"), ["__d"], ["__id"]).select("__d", F.col("__id").alias("__by_doc"))
    h = headers.withColumn("__d", text.digits(F.col("cuit"))).join(by_doc, "__d", "left")
    close = lookup.best_match(h.where("__by_doc is null"), "invoice", "name", partners, "id", "name", fuzzy, score=score).select("invoice", F.col("id").alias("__by_name"))
    h = h.join(close, "invoice", "left").withColumn("__new", F.coalesce("__by_doc", "__by_name"))
    named = (text.normalize(F.col("name")) != "") | (F.col("__d") != "")
    h = h.withColumn("changed", named & F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("partner"))).withColumn("partner", F.when(named, F.coalesce("__new", "partner")).otherwise(F.col("partner")))
    facts = first_per_key(registry.withColumn("__rd", text.digits(F.col("cuit"))).where("__rd <> ''"), ["__rd"], ["name"])
    h = h.join(facts.select(F.col("__rd").alias("__d"), *[F.col(c).alias(f"__{c}") for c in lists]), "__d", "left")
    h = cut(h)
    for c, options in lists.items():
        to = lookup.by_name(h.select("invoice", f"__{c}").where(f"`__{c}` is not null"), "invoice", f"__{c}", options, fuzzy, score=score).select("invoice", F.col("id").alias("__to"))
        h = h.join(to, "invoice", "left").withColumn(c, F.when(named, F.coalesce("__to", c)).otherwise(F.col(c))).drop("__to", f"__{c}")
    return h.drop("__d", "__by_doc", "__by_name", "__new")


def remapped_accounts(headers: DataFrame, accounts: DataFrame, threshold: float = 65.0, score: Callable[[Column, Column], Column] = similar.weighted) -> DataFrame:
    """invoice and account of each saved invoice in another tenant's accounts.

    headers: invoice, account, label (the account's code and name that the registry has for the supplier, null or blank
    for none); accounts: id, code, name. An account is found by its label (lookup.by_similar_name: in full, by name, by
    code, by the most similar name, then code and name); what is not found stays as it is.
    """
    asked = headers.where(text.normalize(F.col("label")) != "").select("invoice", "label")
    found = lookup.by_similar_name(asked, "invoice", "label", accounts, threshold, score).select("invoice", F.col("account_id").alias("__to"))
    return headers.join(found, "invoice", "left").select("invoice", F.coalesce("__to", "account").alias("account"))


#: Tax labels, in capitals, of invoices that are of kind C.
WITHOUT_TAX = ("IVA NO CORRESPONDE", "0", "0%")


def remapped_kinds(headers: DataFrame, kinds: DataFrame, order: list[str]) -> DataFrame:
    """invoice and kind: a saved kind that the catalogue lacks becomes its FACTURAS C where the first line has no tax, else it stays.

    headers: invoice, kind, rate (the first line's tax label); kinds: id, name, code, in order. No kind stays none.
    """
    known = kinds.select(F.col("id").alias("__v")).distinct()
    c = doctypes.by_label(kinds.withColumn("__all", F.lit(0)), ["__all"], order).where("label = 'FACTURAS C'").select(F.col("id").alias("__c"))  # a row at most
    j = headers.join(known, F.col("kind") == F.col("__v"), "left").join(F.broadcast(c), F.lit(True), "left")
    stale = F.col("kind").isNotNull() & F.col("__v").isNull() & F.upper(F.trim("rate")).isin(*WITHOUT_TAX)
    return j.select("invoice", F.when(F.coalesce(stale, F.lit(False)), F.coalesce("__c", "kind")).otherwise(F.col("kind")).alias("kind"))


def with_headers(rows: DataFrame, headers: DataFrame, fields: list[str], cleared: list[str]) -> DataFrame:
    """Rows with the partner of their remapped header on each, its fields on the first row, and cleared columns emptied where the partner changed.

    rows: invoice, pos, partner, fields and cleared; headers: as remapped gives them.
    """
    new = headers.select("invoice", F.col("partner").alias("__p"), "changed", *[F.col(c).alias(f"__{c}") for c in fields])
    first = numbered(rows, ["invoice"], ["pos"], "__n").join(new, "invoice", "left")
    made = first.withColumns({c: F.when(F.col("__n") == 0, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in fields})
    made = made.withColumns({c: F.when(~F.coalesce("changed", F.lit(False)), F.col(c)) for c in cleared})
    return made.withColumn("partner", F.coalesce("__p", "partner")).drop("__n", "__p", "changed", *[f"__{c}" for c in fields])
