"""Registries of suppliers, taxes and options: scans with columns that are found by name, and sources that stand in for others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import named_column
from .order import first_per_key


def _named(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(name) != "")


def suppliers(df: DataFrame, columns: Mapping[str, Sequence[str]], limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """name and, as far as there are columns for them, doc, category, journal and account of each row with a name.

    columns: candidates for name, doc, category, journal, kind, account, account_code and account_name; an account is its
    code and name where both are there. limit keeps the first rows in the given order, which must leave no ties.
    """
    found = {k: named_column(df, v) for k, v in columns.items()}
    if not found.get("name"):
        raise ValueError("no column holds names")
    shown = [F.col(found["name"]).alias("name")]
    shown += [F.col(found[k]).alias(k) for k in ("doc", "category", "journal", "kind") if found.get(k)]
    if found.get("account_code") and found.get("account_name"):
        parts = [F.trim(F.col(found[k]).cast("string")) for k in ("account_code", "account_name")]
        shown.append(F.concat(parts[0], F.lit(" "), parts[1]).alias("account"))
    elif found.get("account"):
        shown.append(F.col(found["account"]).alias("account"))
    kept = df.where(_named(found["name"]))
    return (kept.orderBy(*order).limit(limit) if limit is not None else kept).select(*shown)


def suppliers_or_partners(df: DataFrame, columns: Mapping[str, Sequence[str]], partners: DataFrame) -> DataFrame:
    """The suppliers of df; where it has no column for names, those of partners (name, vat), the rest blank."""
    if named_column(df, columns["name"]):
        return suppliers(df, columns)
    blank = [F.lit("").alias(c) for c in ("category", "journal", "account")]
    return partners.where(_named("name")).select("name", F.col("vat").alias("doc"), *blank)


def tax_registry(df: DataFrame) -> DataFrame:
    """name, doc, tax_ids of rows with a name (df: name, doc, ids as text, main): main comes first where the list lacks it."""
    ids = text.ids_in(F.col("ids"))
    main = F.when(F.trim("main").rlike(r"^\d+$"), F.trim("main").cast("int"))
    lacks = main.isNotNull() & ~F.array_contains(ids, F.coalesce(main, F.lit(-1)))
    return df.where(_named("name")).select(text.normalize(F.col("name")).alias("name"), text.normalize(F.col("doc")).alias("doc"), F.when(lacks, F.concat(F.array(main), ids)).otherwise(ids).alias("tax_ids"))


def sample_values(df: DataFrame, column: str, limit: int, order: Sequence[str]) -> DataFrame:
    """The distinct values, not blank, among the first `limit` rows in an order without ties, sorted."""
    first = df.where(_named(column)).orderBy(*order).limit(limit)
    return first.select(text.normalize(F.col(column)).alias(column)).distinct().orderBy(column)


def cleaned(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[str | Column]) -> DataFrame:
    """Rows with a name, one for each set of keys (the first in order), with sort_key, their name in capitals."""
    once = first_per_key(df.where(_named(name)), list(keys), list(order))
    return once.withColumn("sort_key", text.label_key(F.col(name)))


def catalogue(lists: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str | Column]]]) -> DataFrame:
    """kind, id (as text), name and sort_key of several lists at once, each cleaned by its own keys and order (lists: id, name)."""
    made = None
    for kind, (df, keys, order) in lists.items():
        one = cleaned(df, keys, "name", order).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), text.normalize(F.col("name")).alias("name"), "sort_key")
        made = one if made is None else made.unionByName(one)
    return made


def names_or_registry(column: str, registry: DataFrame, *sources: DataFrame) -> DataFrame:
    """The names of the first source that has any; without one, the distinct names of the registry."""
    own = [s.where(_named(column)).select(text.normalize(F.col(column)).alias(column)).distinct() for s in (*sources, registry)]
    return first_filled_source(*own)


def first_filled_source(*sources: DataFrame) -> DataFrame:
    """The rows of the first source that has any."""
    both = sources[0].withColumn("__s", F.lit(0))
    for n, other in enumerate(sources[1:], 1):
        both = both.unionByName(other.withColumn("__s", F.lit(n)))
    least = both.agg(F.min("__s").alias("__m"))  # one row
    return both.join(F.broadcast(least), F.col("__s") == F.col("__m")).drop("__s", "__m")


def filtered_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that satisfy a condition; all rows if none does."""
    return first_filled_source(df.where(condition), df)


def saved_or_made(saved: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """For each key the saved rows, or those made anew where nothing is saved."""
    return saved.unionByName(made.join(saved.select(key).distinct(), key, "left_anti").select(*saved.columns))


def document_types(df: DataFrame, codes: Sequence[str] = ("OC-X", "99"), extra: str = "OC-X") -> DataFrame:
    """id, name, code of each kind of document with a name, and a second row named OC-X for those with its codes."""
    is_other = text.label_key(F.col("code")).isin(*codes)
    names = F.array_distinct(F.array_compact(F.array(text.normalize(F.col("name")), F.when(is_other, F.lit(extra)))))
    rows = df.where(_named("name")).select("id", F.explode(names).alias("name"), "code")
    return rows.dropDuplicates(["id", "name"])


def company_labels(df: DataFrame) -> DataFrame:
    """id, label: the trade name, else the name, of companies that are not deleted; those without either fall away."""
    label = F.coalesce(*[F.when(_named(c), F.trim(c)) for c in ("trade_name", "name")])
    return df.where("deleted_at is null").select("id", label.alias("label")).where("label is not null")


def seeds(present: DataFrame, offered: DataFrame, key: str, least: int, order: Sequence[str | Column]) -> DataFrame:
    """Offered rows to add: one per key of `least` digits or more, the first in order, that is not present yet."""
    usable = offered.withColumn("__d", text.digits(F.col(key))).where(F.length("__d") >= least)
    new = first_per_key(usable, ["__d"], list(order))
    return new.join(present.select(text.digits(F.col(key)).alias("__d")).distinct(), "__d", "left_anti").drop("__d")


def option_lists(sources: Mapping[str, DataFrame]) -> DataFrame:
    """list, id, label: all lists of options as one table (sources: id, label), labels trimmed, blank ones left out."""
    made = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("list"), F.col("id").cast("string").alias("id"), text.normalize(F.col("label")).alias("label")).where("label <> ''")
        made = one if made is None else made.unionByName(one)
    return made
