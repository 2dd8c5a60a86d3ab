"""Lookups in registries: exact steps in order, then the best fuzzy match."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similar, text
from ..sources.files import cut
from . import nearest
from .order import first_per_key


def exact(probe: DataFrame, registry: DataFrame, on: str, take: Mapping[str, str], order: list[Column | str]) -> DataFrame:
    """Left lookup on a key; of several registry rows the first in order wins; a blank key finds nothing."""
    one = first_per_key(registry.where(F.col(on) != ""), [on], order).select(F.col(on).alias("__k"), *[F.col(c).alias(n) for c, n in take.items()])
    return probe.join(one, F.col(on) == F.col("__k"), "left").drop("__k")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: how few edits turn one text into the other."""
    return alike(apart(a, b))


def apart(a: Column, b: Column) -> Column:
    """1 to 0: the edits that turn one text into the other, over the length of the longer one. The least makes the best score (alike)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.levenshtein(a, b) / longest)


def alike(part: Column) -> Column:
    """The similarity of texts that are so far apart."""
    return F.round(100.0 * (1 - part), 4)


#: Names of a registry that are sent to every task, where all of them are compared by edit distance.
FEW_NAMES = 2_000
#: How alike two names are: by edit distance (similarity), or one of functions.similar.
Scorer = Callable[[Column, Column], Column]


def best_match(probe: DataFrame, key: str, name: str, registry: DataFrame, registry_id: str, registry_name: str, threshold: float, score: Scorer = similarity) -> DataFrame:
    """(key, id, score): for each probe the registry row with the most similar name, if the threshold is reached.

    Distinct names are compared once, and registries may be of any size: all scores are searched in blocks by their bounds
    (see nearest), but for edit distance in a registry of up to FEW_NAMES names, which is sent to all tasks. Ties go to
    the smaller id.
    """
    names = probe.select(text.label_key(F.col(name)).alias("q")).where("q <> ''").distinct()
    targets = registry.select(F.col(registry_id).alias("id"), text.label_key(F.col(registry_name)).alias("r")).where("r <> ''")
    targets = targets.groupBy("r").agg(F.min("id").alias("id"))
    if score is similarity and targets.count() > FEW_NAMES:
        score = similar.edits
    if isinstance(score, similar.Score):
        top = nearest.best_names(names, targets, score, threshold)
    else:
        near = F.least(F.length("q"), F.length("r")) * 100 >= threshold * F.greatest(F.length("q"), F.length("r"))
        met = names.join(F.broadcast(targets), near)
        by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        top = met.withColumn("score", score(F.col("q"), F.col("r"))).where(F.col("score") >= threshold).withColumn("n", F.row_number().over(by)).where("n = 1")
    return probe.select(F.col(key), text.label_key(F.col(name)).alias("q")).join(top.select("q", "id", "score"), "q").select(key, "id", "score")


def by_name(probe: DataFrame, key: str, name: str, registry: DataFrame, threshold: float, fallback: str | None = None, score: Scorer = similarity) -> DataFrame:
    """(key, id): by equal name, else by the most similar one, else the row that is named as the fallback.

    registry: id, name; the first of equal names, by id, wins. Probes without a name only have the fallback.
    """
    one = first_per_key(registry.select(text.label_key(F.col("name")).alias("__k"), F.col("id").alias("__exact")).where("__k <> ''"), ["__k"], ["__exact"])
    p = probe.select(key, name, text.label_key(F.col(name)).alias("__k")).join(one, "__k", "left")
    close = best_match(p.where("__exact is null and __k <> ''"), key, name, registry, "id", "name", threshold, score=score).select(key, F.col("id").alias("__near"))
    p = p.join(close, key, "left")
    if fallback:
        p = p.join(F.broadcast(one.where(F.col("__k") == fallback.upper()).select(F.col("__exact").alias("__last"))), F.lit(True), "left")  # a row at most
    return p.select(key, F.coalesce("__exact", "__near", *(["__last"] if fallback else [])).alias("id"))


def cascade(probe: DataFrame, key: str, sources: list[DataFrame], threshold: float, score: Scorer = similarity) -> DataFrame:
    """(key, source, id, score): by tax id over all sources, in their order; else by name in the first source that reaches the threshold.

    probe: key, cuit, name; sources: id, cuit, name. A tax id scores 100; the first row by id wins.
    """
    listed = None
    for n, df in enumerate(sources):
        one = df.select(F.lit(n).alias("source"), "id", text.digits(F.col("cuit")).alias("__d"), F.col("name").alias("__n"))
        listed = one if listed is None else listed.unionByName(one)
    exact = first_per_key(listed.where("__d <> ''"), ["__d"], ["source", "id"]).select("__d", "source", "id", F.lit(100.0).alias("score"))
    p = probe.select(key, "name", text.digits(F.col("cuit")).alias("__d"))
    found = p.join(exact, "__d").select(key, "source", "id", "score")
    rest = p.join(exact.select("__d"), "__d", "left_anti")
    for n, df in enumerate(sources):
        close = best_match(rest, key, "name", df, "id", "name", threshold, score=score)
        found = found.unionByName(close.select(key, F.lit(n).alias("source"), "id", "score"))
        rest = rest.join(close.select(key), key, "left_anti")
    return found


def account(probe: DataFrame, label: str, accounts: DataFrame) -> DataFrame:
    """Adds account_id: by full label; by code and by name, where the name wins a conflict. Last of equal ones wins.

    What is not found so is left null; by_similar_name goes on from there.
    """
    code, name = text.account_parts(F.col(label))
    p = probe.withColumn("__full", text.label_key(F.col(label))).withColumn("__code", code).withColumn("__name", F.upper(name))
    a = accounts.select("id", F.col("code").alias("c"), text.label_key(F.col("name")).alias("n")).withColumn("f", F.concat_ws(" ", "c", "n"))

    def last(col: str, out: str) -> DataFrame:
        return first_per_key(a.where(F.col(col) != ""), [col], [F.desc("id")]).select(F.col(col).alias(f"__{out}_k"), F.col("id").alias(out))

    for col, out, key in (("f", "by_full", "__full"), ("c", "by_code", "__code"), ("n", "by_name", "__name")):
        p = p.join(last(col, out), F.col(key) == F.col(f"__{out}_k"), "left").drop(f"__{out}_k")
    return p.withColumn("account_id", F.coalesce("by_full", "by_name", "by_code")).drop("__full", "__code", "__name", "by_full", "by_code", "by_name")


#: Jurisdictions of the gross-income tax and the suffix of their tax names.
JURISDICTIONS = {
    "CABA": "CABA", "ARBA": "BA", "CATAMARCA": "CTS", "CORDOBA": "CBA", "CORRIENTES": "C", "ENTRE RIOS": "ER",
    "JUJUY": "J", "MENDOZA": "MZA", "LA RIOJA": "LR", "SALTA": "S", "SAN JUAN": "SJ", "SAN LUIS": "SL",
    "SANTA FE": "SF", "SANTIAGO DEL ESTERO": "SE", "TUCUMAN": "T", "CHACO": "CHO", "CHUBUT": "CHT", "FORMOSA": "F",
    "MISIONES": "MS", "NEUQUEN": "N", "LA PAMPA": "LP", "RIO NEGRO": "RN", "SANTA CRUZ": "SC", "TIERRA DEL FUEGO": "TAIS",
}


def jurisdiction_tax(probe: DataFrame, label: str, taxes: DataFrame) -> DataFrame:
    """Adds tax_id: 'P. IIBB x' by exact name, else the first tax that ends with 'IIBB x'; x is the jurisdiction's suffix.

    A label is '[Percepción] IIBB place Sufrida' or 'Aplicada', or 'IIBB place'. Unknown places find nothing.
    """
    suffixes = F.create_map(*[F.lit(x) for pair in JURISDICTIONS.items() for x in pair])
    t = text.accent_fold(F.col(label))
    long, short = F.regexp_extract(t, "^(?:PERCEPCION )?IIBB (.+?) (?:SUFRIDA|APLICADA)$", 1), F.regexp_extract(t, "^IIBB (.+)$", 1)
    p = probe.withColumn("__s", suffixes[F.when(long != "", long).when(short != "", short)])
    n = text.accent_fold(F.col("name"))
    x = taxes.where(n.contains("IIBB ")).select(F.substring_index(n, "IIBB ", -1).alias("__k"), F.when(n.startswith("P. IIBB "), 0).otherwise(1).alias("__r"), F.col("id").alias("tax_id"))
    return p.join(first_per_key(x, ["__k"], ["__r", "tax_id"]).drop("__r"), F.col("__s") == F.col("__k"), "left").drop("__s", "__k")


def by_similar_name(probe: DataFrame, key: str, label: str, accounts: DataFrame, threshold: float = 65.0, score: Scorer = similarity) -> DataFrame:
    """(key, account_id): account, and for what it leaves open the most similar name, else the most similar code and name."""
    _, name = text.account_parts(F.col(label))
    found = account(probe, label, accounts).select(key, label, "account_id").withColumn("__name", name)
    full = accounts.select("id", F.concat_ws(" ", "code", "name").alias("name"))
    for registry, part in ((accounts.select("id", "name"), "__name"), (full, label)):
        close = best_match(found.where("account_id is null"), key, part, registry, "id", "name", threshold, score=score).select(key, F.col("id").alias("__near"))
        found = cut(found.join(close, key, "left").withColumn("account_id", F.coalesce("account_id", "__near")).drop("__near"))
    return found.select(key, "account_id")


def star(bills: DataFrame, partners: DataFrame, bill_accounts: DataFrame, order: list[Column | str], accounts: DataFrame, categories: DataFrame, no_category: str) -> DataFrame:
    """partner, name, account, category: each partner's bill with the labels of its first account that is not null and of the partner's category.

    bills: partner, bill; partners: partner, name, category; bill_accounts: bill, account; accounts: account, label;
    categories: category, label.
    """
    first = first_per_key(bill_accounts.where("account is not null"), ["bill"], order).select("bill", "account")
    j = bills.join(partners, "partner").join(first, "bill", "left").join(accounts.withColumnRenamed("label", "__a"), "account", "left").join(categories.withColumnRenamed("label", "__c"), "category", "left")
    return j.select("partner", "name", F.col("__a").alias("account"), F.coalesce("__c", F.lit(no_category)).alias("category"))


def heads(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """key and head: the topmost row above each one; null where a circle has none.

    Each round follows twice as many steps, until all chains have ended or are longer than the table, so a chain of n
    steps takes about log2(n) joins. A parent that is missing or null ends a chain.
    """
    known = nodes.select(F.col(key).alias("__k"))
    up = nodes.select(F.col(key).alias("k"), F.col(parent).alias("__p")).join(known, F.col("__p") == F.col("__k"), "left")
    up = cut(up.select("k", F.coalesce("__k", "k").alias("h"), F.col("__k").isNull().alias("top")))
    steps, most = 1, up.count()
    while steps < 2 * most and not up.where("not top").isEmpty():
        over = up.select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("top").alias("__t"))
        done = up.where("top")
        up = cut(up.where("not top").join(over, F.col("h") == F.col("__k")).select("k", F.col("__h").alias("h"), F.col("__t").alias("top")).unionByName(done))
        steps *= 2
    return up.select(F.col("k").alias(key), F.when(F.col("top"), F.col("h")).alias("head"))


def below(nodes: DataFrame, key: str, parent: str, roots: DataFrame, root: str) -> DataFrame:
    """The keys of the roots and of all rows below them, by parents; roots that are no rows are left out.

    Each row asks the row above, then the one two above, four above and so on, whether a root was met on the way, so
    a chain of n steps takes about log2(n) joins. A circle without a root ends when that is longer than the table.
    """
    marked = roots.select(F.col(root).alias("k")).distinct().withColumn("__m", F.lit(True))
    up = nodes.select(F.col(key).alias("k"), F.col(parent).alias("u")).join(marked, "k", "left")
    up = cut(up.select("k", F.when(F.col("__m").isNull(), F.col("u")).alias("u"), F.col("__m").isNotNull().alias("hit")))
    steps, most = 1, up.count()
    while steps < 2 * most and not up.where("u is not null").isEmpty():
        over = up.select(F.col("k").alias("u"), F.col("u").alias("__u"), F.col("hit").alias("__h"))
        done = up.where("u is null")
        moved = up.where("u is not null").join(over, "u", "left").withColumn("__h", F.coalesce("__h", F.lit(False)))
        up = cut(moved.select("k", F.when(~F.col("__h"), F.col("__u")).alias("u"), F.col("__h").alias("hit")).unionByName(done))
        steps *= 2
    return up.where("hit").select(F.col("k").alias(key)).distinct()
