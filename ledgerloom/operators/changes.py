"""Plans of changes: what is there against what is wanted. Nothing is written anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .order import first_per_key, numbered


def by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """Rows of both sides paired by their place in a group; the longer side's rest falls away."""
    return numbered(left, keys, left_order).join(numbered(right, keys, right_order), [*keys, "pos"])


def by_key_else_position(wanted: DataFrame, present: DataFrame, group: str, key: str, order: list) -> DataFrame:
    """Adds target: the present id with the same key, else the one at the same place; a target serves once, the first wanted row first."""
    w, p = numbered(wanted, [group], order), numbered(present, [group], ["id"], "pos")
    exact = first_per_key(present.where(F.col(key).isNotNull()), [group, key], ["id"]).select(group, key, F.col("id").alias("by_key"))
    j = w.join(exact, [group, key], "left").join(p.select(group, "pos", F.col("id").alias("by_pos")), [group, "pos"], "left")
    j = j.withColumn("target", F.coalesce("by_key", "by_pos"))
    won = first_per_key(j.where("target is not null"), [group, "target"], ["pos"]).select(group, "pos", F.lit(True).alias("won"))
    return j.join(won, [group, "pos"], "left").withColumn("target", F.when(F.col("won"), F.col("target"))).drop("won", "by_key", "by_pos")


def differing(wanted: DataFrame, present: DataFrame, keys: list[str], value: str, tolerance: str) -> DataFrame:
    """keys, value (wanted) and present, where they differ by more than the tolerance."""
    p = present.select(*keys, F.col(value).alias("present"))
    return wanted.join(p, keys).where(F.abs(F.col(value) - F.col("present")) > F.lit(tolerance).cast("decimal(12,6)"))


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def clear_unknown(df: DataFrame, reference: str, known: DataFrame, known_id: str) -> DataFrame:
    """References that no longer exist become null; cleared says so."""
    k = known.select(F.col(known_id).alias("__k")).distinct()
    j = df.join(k, F.col(reference) == F.col("__k"), "left")
    gone = F.col(reference).isNotNull() & F.col("__k").isNull()
    return j.withColumn("cleared", gone).withColumn(reference, F.col("__k")).drop("__k")


def changed_fields(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows of which a field is wanted otherwise; fields that stay are null."""
    made = df.withColumns({n: F.when(~want.eqNullSafe(have) & want.isNotNull(), want) for n, (want, have) in pairs.items()})
    return made.where(F.coalesce(*[F.col(n).cast("string") for n in pairs]).isNotNull())


def merged(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two sets of changes as one; the first wins where both set a field."""
    s = second.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fields])
    j = first.join(s, F.col(key) == F.col("__k"), "full_outer")
    return j.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(c, f"__{c}").alias(c) for c in fields])


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side: both, left or right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def bare(c: Column) -> Column:
    """A document number or name without the zeros that lead its parts; a part of zeros alone is one zero."""
    return F.array_join(F.transform(F.split(text.normalize(c), "-"), lambda x: F.regexp_replace(x, "^0+(?=.)", "")), "-")


def _name_keys(name: Column, longest: Column) -> Column:
    """All ends of a name, and all stretches after a dash, of up to `longest` letters: the numbers that the name may stand for."""
    n = F.length(name)
    ends = F.transform(F.sequence(F.lit(1), F.least(n, longest)), lambda k: F.substr(name, n - k + 1, k))
    dashes = F.filter(F.sequence(F.lit(1), n), lambda p: F.substr(name, p, F.lit(1)) == "-")
    after = F.flatten(F.transform(dashes, lambda p: F.transform(F.sequence(F.lit(1), F.least(n - p, longest)), lambda k: F.substr(name, p + 1, k))))
    return F.when(n > 0, F.array_distinct(F.concat(ends, F.filter(after, lambda x: x != ""))))


def same_bill(bills: DataFrame, present: DataFrame) -> DataFrame:
    """bill, found and rank: the newest present bill of the partner with the same document number, exactly or but for zeros.

    bills: bill, partner, number; present: id, partner, number, ref and name (each may be null, name may be missing). A ref
    that is the number as it is comes first (rank 0); else (1) number or ref but for zeros, or a name that ends with the
    number or holds it after a dash, zeros aside. A present bill has a key for each number it may stand for, and of each
    key only the newest bill is kept, so a partner's bills never meet each other but by an equal key.
    """
    want = bills.where(text.normalize(F.col("number")) != "").select("bill", "partner", text.normalize(F.col("number")).alias("__n"), bare(F.col("number")).alias("__k"))
    longest = want.agg(F.coalesce(F.max(F.length("__k")), F.lit(0)).alias("__most"))  # one row
    p = present.join(F.broadcast(longest), F.lit(True))
    keys = F.array(bare(F.col("number")), bare(F.col("ref")))
    if "name" in present.columns:
        keys = F.concat(keys, F.coalesce(_name_keys(bare(F.col("name")), F.col("__most")), F.array().cast("array<string>")))
    loose = p.select("id", "partner", F.explode(F.array_distinct(keys)).alias("__k")).where("__k <> ''").groupBy("partner", "__k").agg(F.max("id").alias("__loose"))
    exact = present.select("partner", text.normalize(F.col("ref")).alias("__n"), "id").where("__n <> ''").groupBy("partner", "__n").agg(F.max("id").alias("__exact"))
    j = want.join(exact, ["partner", "__n"], "left").join(loose, ["partner", "__k"], "left")
    found = F.coalesce("__exact", "__loose")
    return j.where(found.isNotNull()).select("bill", found.alias("found"), F.when(F.col("__exact").isNotNull(), 0).otherwise(1).alias("rank"))


def missing_maturity(move_lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines on payable and receivable accounts without a due date; due is their invoice's date."""
    kinds = accounts.where(F.col("kind").isin("payable", "receivable")).select("account")
    return move_lines.where("due is null").join(kinds, "account", "left_semi").withColumn("due", F.col("date"))


def valid_only(df: DataFrame, reference: str, known: DataFrame, known_id: str) -> DataFrame:
    return df.join(known.select(F.col(known_id).alias(reference)).distinct(), reference, "left_semi")


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of both, one per key; the first table's before the second's, then by order."""
    both = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1)))
    return first_per_key(both, [key], ["__s", *order]).drop("__s")
