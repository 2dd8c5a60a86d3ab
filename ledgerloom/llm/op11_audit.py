"""Audit of how filters interact, by a product of histograms with an incidence matrix.

Each document fails some of five filters: a mask of five bits. Whatever an order of the filters keeps, removes or
counts as redundant depends on the mask alone, so one pass turns every document into (part, mask) and counts. The
histograms over the 32 masks, one row a part and kind (all documents, those of good quality, toxic ones), are multiplied
by integer matrices of 32 rows and 600 columns, a column for each of the 120 orders and 5 steps, that hold 1 where a
document of that mask is kept, removed, redundant or a unique failure.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, span_hashes, text_slices, word_spans

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
#: Bytes of filter D, and the bit of filter E, the only one that other documents decide.
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#$%&*|")] = True
REPEATED = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
#: Parts whose rows are made at once: 600 rows each.
CHUNK = 64


def matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kept, removed, redundant and unique_fails (each 32 by 600), and shapley (32 by 5, a column a filter).

    Column 5 o + s belongs to step s of order o.
    """
    mask = np.arange(MASKS)[:, None]
    step_bit = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])[None, :]
    before = np.array([sum(1 << FILTERS.index(f) for f in order[:s]) for order in ORDERS for s in range(STEPS)])[None, :]
    fails, earlier = (mask & step_bit) > 0, (mask & before) > 0
    kept, removed, redundant = ~fails & ~earlier, fails & ~earlier, fails & earlier
    of_filter = step_bit[0][:, None] == 1 << np.arange(STEPS)[None, :]
    return tuple(m.astype(np.int64) for m in (kept, removed, redundant, mask == step_bit)) + (removed.astype(np.int64) @ of_filter.astype(np.int64),)


def text_masks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of filters A to D of each text.

    Distinct words are told apart by 64-bit hashes less the bits that number the texts of a slice, so by all 64 in a
    long text.
    """
    docs = len(at) - 1
    starts, ends, first = word_spans(data, at)
    words = np.diff(first)
    bits = max(0, (docs - 1).bit_length())
    owner = np.repeat(np.arange(docs), words).astype(np.uint64)
    keys = span_hashes(data, starts, ends)
    if bits:
        keys = (keys >> np.uint64(bits)) | (owner << np.uint64(64 - bits))
    keys = np.sort(keys)
    fresh = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    distinct = np.bincount((fresh >> np.uint64(64 - bits)).astype(np.int64), minlength=docs) if bits else np.array([len(fresh)])[:docs]

    def count(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    capitals = count((data >= 65) & (data <= 90))
    points = count((data & 0xC0) != 0x80)
    failed = (words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, count(SIGNS[data]) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in text_slices(batches):
        names = [span_hashes(data, at[:-1], at[1:], lane).view(np.int64) for lane in (0, 1)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("part"), pa.array(names[0]), pa.array(names[1]), pa.array(text_masks(data, at).astype(np.int32))], ["doc_id", "part", "h1", "h2", "mask"])


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit k is set if the document fails filter k of A to E), one row for each row of docs.

    A null text is an empty one, a null lang the part ''; without a lang column all documents are in the part ''.
    A row fails E if a smaller doc_id has its text, told by two independent 64-bit hashes; rows that share the
    smallest doc_id of a text all pass, and a null doc_id neither fails E nor makes others fail it.
    """
    part = F.coalesce(F.col("`lang`").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = materialize(docs.select("doc_id", "text", part.alias("part")).mapInArrow(_texts, "doc_id long, part string, h1 long, h2 long, mask int"))
    # The first document of each text is met on doc_id as well, so that no task gets all copies of one text.
    first = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = rows.join(first, ["h1", "h2", "doc_id"], "left")
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return told.select("doc_id", "part", (F.col("mask") + F.when(repeated, REPEATED).otherwise(0)).alias("mask"))


def histograms(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: how many rows of a part have a mask, and how many of them the labels call so.

    A document is good (toxic) if any label row of its doc_id has quality (toxic) 1.
    """
    flag = lambda name: F.coalesce(F.max((F.col(f"`{name}`") == 1).cast("long")), F.lit(0)) if name in labels.columns else F.lit(0).cast("long")
    marked = only(labels, *[c for c in ("doc_id", "quality", "toxic") if c in labels.columns]).groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    told = masks.join(marked.where("doc_id is not null and (good > 0 or toxic > 0)"), "doc_id", "left")
    return told.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


_RESULT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, h: its entries mask, n, good, toxic) -> 600 rows a part."""
    kept, removed, redundant, unique, shapley = matrices()
    column = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    orders = pa.array([order for order in ORDERS for _ in range(STEPS)])
    steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
    for batch in batches:
        parts, entries = batch.column("part"), batch.column("h").to_pylist()
        for i in range(0, len(parts), CHUNK):
            some = entries[i : i + CHUNK]
            stack = np.zeros((3, len(some), MASKS), np.int64)
            for k, masks in enumerate(some):
                for e in masks:
                    stack[:, k, e["mask"]] = e["n"], e["good"], e["toxic"]
            every, good, toxic = stack
            table = [every @ kept, every @ removed, every @ redundant, every @ unique, good @ removed, toxic @ removed, (every @ shapley)[:, column]]
            times = len(orders)
            yield pa.RecordBatch.from_arrays(
                [parts.take(pa.array(np.repeat(np.arange(i, i + len(some)), times))), pa.concat_arrays([orders] * len(some)), pa.concat_arrays([steps] * len(some)), *(pa.array(t.ravel()) for t in table)],
                ["part", "filter_order", "step", *_RESULT],
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part of docs (each lang, '' for null), each of the 120 orders of ABCDE and each step 1 to 5,
    zeros included; see failure_masks and histograms for nulls, empty texts and repeated rows. An empty table has no
    parts and gives no rows; other columns are not read. What is shuffled is a few numbers a document, then 32 rows
    a part; each task multiplies the histograms of its parts.
    """
    counts = histograms(failure_masks(docs), labels)
    # 32 entries a part at most
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))
    return rows.mapInArrow(_products, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _RESULT))
