"""Which tax of a tenant's catalogue a rate, a label or another tenant's tax means.

Catalogues: profile, id, name, amount (rate in percent), pos (source order; the first of equals wins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .lookup import jurisdiction_tax
from .order import first_per_key

#: Taxes without a rate, and the names that mean them.
SPECIAL = {"IVA No Corresponde": ("IVA NO CORRESP", "IVA NO CORRESPONDE"), "IVA No Gravado": ("IVA NO GRAV", "IVA NO GRAVADO"), "IVA Exento": ("IVA EXEN", "IVA EXENTO")}
#: Ids of the oldest tenant, for catalogues that cannot be read.
OLDEST_IDS = {"21": 63, "10,5": 61, "27": 65, "IVA No Corresponde": 53, "IVA No Gravado": 55, "IVA Exento": 57}
#: Labels on screen and the short names that tenants give the tax.
ALIASES = {
    "PERCEPCION GANANCIAS SUFRIDA": ("PERC GANANC", "PERCEPCION GANANCIAS"),
    "PERCEPCION GANANCIAS APLICADA": ("PERC GANANC", "PERCEPCION GANANCIAS"),
    "PERCEPCION IVA SUFRIDA": ("PERC IVA", "PERCEPCION IVA"),
    "PERCEPCION IVA APLICADA": ("PERC IVA", "PERCEPCION IVA"),
    "IVA ADICIONAL 20%": ("IVA ADIC 20%", "IVA ADICIONAL 20%"),
    "IMPUESTOS INTERNOS": ("INTERNAL TAXES",),
    "OTROS IMPUESTOS": ("OTHER TAXES",),
}


def rate_label(rate: Column) -> Column:
    """21 for 21.0000, '10,5' for 10.5."""
    t = F.regexp_replace(F.regexp_replace(rate.cast("decimal(12,4)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.replace(t, F.lit("."), F.lit(","))


def special_label(name: Column) -> Column:
    n = text.accent_fold(name)
    return F.coalesce(*[F.when(n.rlike("|".join(words)), label) for label, words in SPECIAL.items()])


def label_of(name: Column, amount: Column) -> Column:
    """What a tax means: its rate if it has one, else which of the taxes without a rate it is; null for others."""
    return F.when(amount > 0, rate_label(amount)).otherwise(special_label(name))


def is_vat(name: Column) -> Column:
    return text.accent_fold(name).startswith("IVA ")


def by_meaning(catalogue: DataFrame) -> DataFrame:
    """profile, label, id: the tax for each label, by its rate before the rate in its name."""
    c = catalogue.where(is_vat(F.col("name")))
    in_name = F.replace(F.regexp_replace(text.accent_fold(F.col("name")), "[^0-9.,]", ""), F.lit(","), F.lit(".")).try_cast("decimal(12,4)")
    meant = F.array(
        F.struct(F.when(F.col("amount") > 0, rate_label(F.col("amount"))).alias("label"), F.lit(0).alias("rank")),
        F.struct(special_label(F.col("name")).alias("label"), F.lit(0).alias("rank")),
        F.struct(F.when(in_name > 0, rate_label(in_name)).alias("label"), F.lit(1).alias("rank")),
    )
    e = c.select("profile", "id", "pos", F.explode(meant).alias("m")).select("profile", "id", "pos", "m.*").where("label is not null")
    return first_per_key(e, ["profile", "label"], ["rank", "pos"]).select("profile", "label", "id")


def remapped(rows: DataFrame, catalogue: DataFrame, source: str, target: str, wanted: str, oldest: str = "default") -> DataFrame:
    """Adds wanted: the id in the target tenant that means what tax_id means in the source tenant.

    Without one, the fixed ids serve; without those too, tenants other than the oldest get null, the oldest keeps ids of VAT.
    rows: source (a column naming the tenant), target, tax_id.
    """
    means = catalogue.where(is_vat(F.col("name"))).select(F.col("profile").alias(source), F.col("id").alias("tax_id"), label_of(F.col("name"), F.col("amount")).alias("__l"))
    goal = by_meaning(catalogue).select(F.col("profile").alias(target), F.col("label").alias("__l"), F.col("id").alias("__to"))
    fixed = F.create_map(*[F.lit(x) for pair in OLDEST_IDS.items() for x in pair])
    stays = F.when((F.col(target) == oldest) & F.col("__vat"), F.col("tax_id"))
    j = rows.join(means.withColumn("__vat", F.lit(True)), [source, "tax_id"], "left").join(goal, [target, "__l"], "left")
    return j.withColumn(wanted, F.coalesce("__to", fixed[F.col("__l")].cast("long"), stays)).drop("__l", "__to", "__vat")


def by_name(probe: DataFrame, label: str, taxes: DataFrame) -> DataFrame:
    """Adds tax_id of a label on screen: by exact name, by an alias, by the jurisdiction of a gross-income tax.

    taxes: id, name. Names differ by accents and case only where an alias says so; of equal names the smaller id wins.
    """
    exact = first_per_key(taxes.select(text.label_key(F.col("name")).alias("__k"), F.col("id").alias("__exact")).where("__k <> ''"), ["__k"], ["__exact"])
    named = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    p = probe.withColumn("__k", text.label_key(F.col(label))).join(exact, "__k", "left")
    folded = first_per_key(taxes.select(text.accent_fold(F.col("name")).alias("__a"), F.col("id").alias("__i")), ["__a"], ["__i"])
    labels = probe.select(text.accent_fold(F.col(label)).alias("__f")).distinct()
    alias = labels.select("__f", F.posexplode(named[F.col("__f")]).alias("__n", "__a")).join(folded, "__a")
    alias = first_per_key(alias, ["__f"], ["__n"]).select("__f", F.col("__i").alias("__alias"))
    j = p.withColumn("__f", text.accent_fold(F.col(label))).join(alias, "__f", "left").drop("__k", "__f")
    return jurisdiction_tax(j, label, taxes).withColumn("tax_id", F.coalesce("__exact", "__alias", "tax_id")).drop("__exact", "__alias")


def split_ids(ids: Column, vat_ids: Column) -> tuple[Column, Column]:
    """The ids of VAT and the others, in order."""
    return F.filter(ids, lambda x: F.array_contains(vat_ids, x)), F.filter(ids, lambda x: ~F.array_contains(vat_ids, x))


def primary_id(vat: Column, usual: Column) -> Column:
    """The usual tax's id if it is among them, else the first."""
    return F.when(F.array_contains(vat, usual), usual).otherwise(F.get(vat, F.lit(0)))


#: Names of taxes and what the screen shows for them.
SHOWN = {"INTERNAL TAXES": "Impuestos internos", "OTHER TAXES": "Otros impuestos"}


def options(labels: DataFrame, taxes: DataFrame) -> DataFrame:
    """id, label, pos: what a list of taxes offers, a row per tax; ordered by pos (nulls last), then the label in capitals.

    labels: pos, label; taxes: id, name. A known label stands for the tax it means, the last one with 'Sufrida' before the
    first of the others; taxes that no label means show their own name, those without a name fall away.
    """
    suffered = F.col("label").contains("Sufrida")
    meant = by_name(labels, "label", taxes).where("tax_id is not null")
    known = first_per_key(meant, ["tax_id"], [suffered.desc(), F.when(suffered, -F.col("pos")).otherwise(F.col("pos"))]).select(F.col("tax_id").alias("id"), "label", "pos")
    shown = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    own = taxes.join(known.select("id"), "id", "left_anti").select("id", F.coalesce(shown[text.accent_fold(F.col("name"))], text.normalize(F.col("name"))).alias("label"), F.lit(None).cast(known.schema["pos"].dataType).alias("pos"))
    return known.unionByName(own.where("label <> ''"))
