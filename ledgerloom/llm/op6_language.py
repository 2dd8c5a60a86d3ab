"""Language identification by Bayesian evidence fusion.

Three kinds of evidence on a document are fused: the likelihood of its text under byte-trigram models, the
language that it declares (in its markup, or a column), and a prior of its host, smoothed towards the prior of the
host's address suffix, which is smoothed towards that of all documents. Models, the reliability of declarations
and the priors are counted over all documents by grouped aggregation; no labels are used. Beside the languages
stands a background, none of them, under which all trigram slots are as likely; it has its own priors and
declarations, and a text that it explains best (random letters, codes, a language without a model) is rejected.

Neighbouring trigrams are not independent: a text of n of them counts as n to the power a. The exponent a is the one
under which the texts of all documents tell the declared languages with the least logarithmic loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, mix, spread_join, text_slices, whole_rows

SLOTS = 1 << 14
#: Languages whose trigram counts a task holds in full at a time.
BLOCK_LANGUAGES = 32
#: Exponents of a text's number of trigrams that are tried.
EXPONENTS = tuple(k / 20 for k in range(6, 21))
#: Documents that a prior one level up is worth, and the least posterior that is not rejected.
SMOOTH, LEAST = 20.0, 0.5
#: Share of each language's model spread over all slots, so that an unseen trigram counts the same in every language.
SPREAD = 0.05
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the byte trigrams with a letter, in lower case, and each document's first one."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    low, letter = LOWER[data].astype(np.uint64), _LETTER[data]
    code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    good = letter[:-2] | letter[1:-1] | letter[2:]
    for k in (1, 2):
        cut = at[1:-1] - k
        good[cut[(cut >= 0) & (cut < n - 2)]] = False
    place = np.flatnonzero(good)
    return (mix(code[place]) % np.uint64(SLOTS)).astype(np.int64), np.searchsorted(place, at)


def evidence(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", extra: Sequence[str] = ()) -> DataFrame:
    """id, th, text, declared (a language code or ''), host and suffix of each row; columns that are not there declare nothing."""
    declared, host = (c if c in docs.columns else None for c in (declared, host))
    said = F.coalesce(F.regexp_extract(F.lower(F.col(declared)), "^ *([a-z]{2,3})([^a-z].*)?$", 1), F.lit("")) if declared else F.lit("")
    name = F.coalesce(F.lower(F.col(host)), F.lit("")) if host else F.lit("")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text).alias("th"),
        F.col(text).alias("text"),
        said.alias("declared"),
        name.alias("host"),
        F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit("")).alias("suffix"),
        *extra,
    )


def page_documents(pages: DataFrame) -> DataFrame:
    """doc_id, text, lang and source of web pages: text without tags, the markup's lang attribute, the address's host."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select(
        F.col("page_id").alias("doc_id"),
        body.alias("text"),
        F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1).alias("lang"),
        F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1).alias("source"),
    )


def languages(rows: DataFrame) -> list[str]:
    """All languages that are declared: 26 * 26 + 26 * 26 * 26 codes at most."""
    return sorted(r["declared"] for r in rows.where("declared <> ''").select("declared").distinct().collect())


def text_counts(rows: DataFrame) -> DataFrame:
    """declared, slot and n: how often each trigram slot occurs in the texts that declare a language."""

    def table(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        full = {s: np.flatnonzero(n) for s, n in held.items()}
        names = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for x in full.values()])))
        slot = np.concatenate([np.zeros(0, np.int64), *full.values()])
        return pa.RecordBatch.from_arrays([names, pa.array(slot), pa.array(np.concatenate([np.zeros(0, np.int64), *(held[s][x] for s, x in full.items())]))], ["declared", "slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part, data, at in text_slices(batches):
            slots, first = trigrams(data, at)
            texts: dict[str, list[np.ndarray]] = {}
            for k, said in enumerate(part.column("declared").to_pylist()):
                if said:
                    texts.setdefault(said, []).append(slots[first[k] : first[k + 1]])
            for said, own in texts.items():
                if said not in held and len(held) == BLOCK_LANGUAGES:
                    yield table(held)
                    held = {}
                n = np.bincount(np.concatenate(own), minlength=SLOTS)
                held[said] = held[said] + n if said in held else n
        yield table(held)

    counted = rows.select("declared", "text").mapInArrow(count, "declared string, slot long, n long")
    return materialize(counted.groupBy("declared", "slot").agg(F.sum("n").alias("n")))


def text_models(rows: DataFrame, names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each block of languages: places of the trigram slots that occur (language in the block * SLOTS + slot) and their counts."""
    counts, out = text_counts(rows), []
    for i in range(0, len(names), BLOCK_LANGUAGES):
        block = names[i : i + BLOCK_LANGUAGES]
        seen = counts.where(F.col("declared").isin(block)).toArrow()
        place = {s: k for k, s in enumerate(block)}
        lang = np.array([place[s] for s in seen.column("declared").to_pylist()], np.int64)
        out.append(((lang * SLOTS + seen.column("slot").to_numpy()).astype(np.int32), seen.column("n").to_numpy()))
    return out


def _gain(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """The logarithm of trigram slots' shares in a language over their share in the background."""
    return np.log((1 - SPREAD) * SLOTS * counts / np.maximum(1, total) + SPREAD)


def scored(rows: DataFrame, names: list[str], models: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """id, th, declared, host, suffix, n (letters), t (trigrams), text_score (a trigram's mean, by language, the background last) and best (place; null without trigrams).

    A text is not evidence for the language that it declares itself: its own trigrams are taken out of that model.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def dense(model: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.zeros(size * SLOTS)
        counts[model[0]] = model[1]
        counts = counts.reshape(size, SLOTS)
        total = counts.sum(1)
        return counts, total, _gain(counts, total[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {s: k for k, s in enumerate(names)}
        kept: dict[int, tuple] = {}
        for part, data, at in text_slices(batches):
            slots, first = trigrams(data, at)
            n = np.diff(first)
            full = n > 0
            said = np.array([where.get(s, -1) for s in part.column("declared").to_pylist()], np.int64)
            weight = 1 / np.maximum(1, n)
            score = np.zeros((len(n), len(names) + 1))
            begin = first[:-1][full]
            for b, model in enumerate(shared.value):
                low = b * BLOCK_LANGUAGES
                if b not in kept:
                    kept = {b: dense(model, min(BLOCK_LANGUAGES, len(names) - low))}
                counts, total, gain = kept[b]
                for k in range(len(gain)):
                    if len(begin):
                        score[full, low + k] = np.add.reduceat(gain[k][slots], begin) * weight[full]
                for i in np.flatnonzero(full & (said >= low) & (said < low + len(gain))):
                    k = said[i] - low
                    own, times = np.unique(slots[first[i] : first[i + 1]], return_counts=True)
                    score[i, said[i]] = times @ _gain(counts[k][own] - times, total[k] - n[i]) * weight[i]
            upto = np.concatenate([[0], np.cumsum(_LETTER[data])])
            letters = upto[at[1:]] - upto[at[:-1]]
            best = pa.array(score.argmax(1), mask=~full)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * score.shape[1]), pa.array(score.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "th", "declared", "host", "suffix")), pa.array(letters), pa.array(n), lists, best], ["id", "th", "declared", "host", "suffix", "n", "t", "text_score", "best"])

    return rows.mapInArrow(run, "id long, th long, declared string, host string, suffix string, n long, t long, text_score array<double>, best long")


def losses(mean: np.ndarray, n: np.ndarray, said: np.ndarray) -> np.ndarray:
    """For each of EXPONENTS the logarithmic loss of texts' evidence on the declared languages' places."""
    out = []
    for a in EXPONENTS:
        logs = mean * (n**a)[:, None]
        top = logs.max(1, keepdims=True)
        out.append(float((top[:, 0] + np.log(np.exp(logs - top).sum(1)) - logs[np.arange(len(logs)), said]).sum()))
    return np.array(out)


def best_exponent(found: DataFrame, names: list[str]) -> float:
    """The exponent of least loss over all documents that declare a language and have trigrams; the least one without such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {s: k for k, s in enumerate(names)}
        step = max(1, (1 << 20) // (len(names) + 1))
        total = np.zeros(len(EXPONENTS))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                mean = part.column("text_score").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names) + 1)
                total += losses(mean, part.column("t").to_numpy(), np.array([where[s] for s in part.column("declared").to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "loss"])

    told = found.where("declared <> '' and best is not null").select("declared", "t", "text_score").mapInArrow(run, "k long, loss double")
    summed = {r["k"]: r["loss"] for r in told.groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    return EXPONENTS[min(range(len(EXPONENTS)), key=lambda k: round(summed.get(k, 0.0), 6))]


def _tally(counts: DataFrame, *by: str) -> DataFrame:
    """by, their pairs (best, count) of the languages that occur, and size, all counts."""
    n = counts.where("best is not null").groupBy(*by, "best").agg(F.sum("c").alias("c"))
    return n.groupBy(*by).agg(F.collect_list(F.struct("best", "c")).alias(f"{by[0]}_n"), F.sum("c").alias("size"))


def priors(found: DataFrame) -> DataFrame:
    """host, suffix, declared, size (documents) and the tallies host_n, suffix_n, declared_n of each combination that occurs."""
    counts = materialize(found.groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("c")))
    each = counts.groupBy("host", "suffix", "declared").agg(F.sum("c").alias("documents"))
    each = materialize(each.join(_tally(counts, "host", "suffix").drop("size"), ["host", "suffix"], "left"))
    total = each.count()
    for name, rows in (("suffix", counts), ("declared", counts.where("declared <> ''"))):
        size = each.groupBy(name).agg(F.count("*").alias("size"))
        each = materialize(spread_join(each, _tally(rows, name).drop("size").join(size, name), [name], total))
    return each.withColumnRenamed("documents", "size")


def _spread(pairs: list[dict] | None, n: int) -> np.ndarray:
    out = np.zeros(n)
    for x in pairs or ():
        out[x["best"]] = x["c"]
    return out


def fused(found: DataFrame, names: list[str]) -> DataFrame:
    """id, th, declared, host, n, lang (the likeliest language) and confidence (its posterior, among the languages and the background).

    A host's prior is its counts smoothed towards its suffix's, those towards all; a declaration counts by how
    likely a document of each language makes it. Only the sums over all documents are held by the driver.
    """
    n = len(names) + 1
    sums, said_sums = np.zeros(n), np.zeros(n)
    for r in found.where("best is not null").groupBy("best").agg(F.count("*").alias("c"), F.count(F.when(F.col("declared") != "", 1)).alias("d")).collect():
        sums[r["best"]], said_sums[r["best"]] = r["c"], r["d"]
    base = (sums + 1) / (sums.sum() + n)
    power = best_exponent(found, names)
    joined = spread_join(found, priors(found), ["host", "suffix", "declared"], found.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // n)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                prior, likely = {}, {}
                logs = part.column("text_score").flatten().to_numpy(zero_copy_only=False).reshape(-1, n) * (part.column("t").to_numpy() ** power)[:, None]
                pairs = [part.column(c) for c in ("host_n", "suffix_n", "declared_n")]
                for k, (host, suffix, said) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "suffix", "declared")), strict=True)):
                    if (host, suffix) not in prior:
                        own, above = _spread(pairs[0][k].as_py(), n), _spread(pairs[1][k].as_py(), n)
                        upper = (above + SMOOTH * base) / (above.sum() + SMOOTH)
                        prior[host, suffix] = np.log((own + SMOOTH * upper) / (own.sum() + SMOOTH))
                    if said not in likely:
                        told = pairs[2][k].as_py()
                        likely[said] = np.log((_spread(told, n) + 0.5) / (said_sums + 0.5 * n)) if told else np.zeros(n)
                    logs[k] += prior[host, suffix] + likely[said]
                place = logs[:, :-1].argmax(1)
                top = logs.max(1)
                confidence = np.exp(logs[np.arange(len(logs)), place] - top) / np.exp(logs - top[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "th", "declared", "host", "n")), pa.array(names, pa.string()).take(pa.array(place)), pa.array(confidence)], ["id", "th", "declared", "host", "n", "lang", "confidence"])

    return joined.mapInArrow(run, "id long, th long, declared string, host string, n long, lang string, confidence double")


def _identified(rows: DataFrame) -> DataFrame:
    """id, th, declared, host, lang, confidence and kept of each row of evidence."""
    names = languages(rows)
    key = ("id", "th", "declared", "host")
    if not names:
        return rows.select(*key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    found = materialize(scored(rows, names, text_models(rows, names)))
    has = F.col("n") > 0
    return fused(found, names).select(*key, F.when(has, F.col("lang")).alias("lang"), F.when(has, F.col("confidence")).otherwise(0.0).alias("confidence"), (has & (F.col("confidence") >= LEAST)).alias("kept"))


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source") -> DataFrame:
    """doc_id, th (hash of the text), lang, confidence, declared and kept of each row of docs.

    A text without a letter, empty or null ones among them, has no language and is rejected; so is one whose
    likeliest language has a posterior below LEAST, among the languages and the background. One or two letters have
    no trigrams: the other evidence decides. A null or unusable declaration is none, as is a column that is missing;
    a null host is ''. Null and repeated ids keep a row each; other columns are not read; an empty table gives no
    rows. If nothing is declared anywhere there are no languages to tell apart and all rows are rejected.
    """
    real = F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id")
    return _identified(evidence(docs, text, declared, host)).select(real, "th", "lang", "confidence", "declared", "kept")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, unchanged but for lang (if there), which is now the language found.

    Rows alike in id, text, declaration and source have one result and all stay or go; see identify for nulls, empty
    texts and missing columns. Other columns are kept as they are, whatever their names.
    """
    key = ["id", "th", "declared", "host"]
    found = _identified(evidence(docs)).where("kept").select(*key, F.col("lang").alias("found")).dropDuplicates(key)
    names = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    rows = evidence(docs.select(*names, whole_rows(docs).alias("whole")), extra=["whole"]).drop("text")
    return rows.join(found, key).select(*[F.col("found").alias("lang") if c == "lang" else F.col(f"whole.`{c}`") for c in docs.columns])
