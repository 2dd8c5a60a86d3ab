"""Best-fit packing of documents into token sequences, by hierarchical packing of what is left.

Documents become pieces of at most CAPACITY tokens. Pieces are dealt to groups of bounded size; each group packs its
own by best fit, longest first. Bins without room to speak of are done. The others are items of the next round: the
groups of FAN neighbours merge, and their underfull bins are packed by best fit once more, until one group is left.

Of two bins at most half full, best fit makes one, so a group has one such bin at most, and each of them can take in
few others. So of the bins more than half full and equally full a group passes on no more than could still be needed,
and even the last round reads a bounded number of rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, only, text_slices
from .word_table import WordTable, byte_words

CAPACITY, END = 2048, 0
#: Items of a group, groups that merge in a round, and free tokens of a bin that is as good as full.
GROUP, FAN, SPARE = 16_384, 16, 16
#: Merged bins up to this number (about 50 bytes each) are sent to all tasks, beyond it they are shuffled.
BROADCAST_ROWS = 200_000

_TABLES: dict[str, WordTable] = {}


def byte_table(path: str) -> WordTable:
    """The words of a byte-level vocabulary that this worker has met, encoded by the tokenizers library."""
    if path not in _TABLES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        specials = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        _TABLES[path] = WordTable(
            lambda words: [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)],
            lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int32),
            byte_words(specials),
        )
    return _TABLES[path]


def piece_bounds(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, number, start and length of the pieces of documents of some sizes (1 or more): only the first may be short."""
    count = -(-sizes // capacity)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    short = sizes - (count - 1) * capacity
    start = np.where(number > 0, short[owner] + (number - 1) * capacity, 0)
    return owner, number, start, np.where(number > 0, capacity, short[owner])


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with the ids of all their texts, an end id after each, and each text's first place."""
    table = byte_table(vocabulary)
    for rows, data, at in text_slices(batches):
        ids, first = table.encode(data, at)
        yield rows, np.insert(ids, first[1:], end).astype("<u4"), first + np.arange(len(first))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """item (a number of its own), doc_id, piece, start, length and ids_crc32 of the pieces of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 40
        for rows, ids, first in _encoded(batches, vocabulary, end):
            owner, number, start, length = piece_bounds(np.diff(first), capacity)
            begin, raw = (first[owner] + start) * 4, memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item + np.arange(len(owner))), rows.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["item", "doc_id", "piece", "start", "length", "ids_crc32"],
            )
            item += len(owner)

    return only(docs, "doc_id", "text").mapInArrow(run, "item long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each item, and what each bin holds; longest items first, each into the fullest bin that has room.

    Bins of a free length lie on a stack of that length, and a number has a bit for each length whose stack is not empty.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, fill = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        rest = bits >> n
        if rest:
            free = n + (rest & -rest).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                bits ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - free
        fill[b] += n
        left = free - n
        if left:
            stacks[left].append(b)
            bits |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def passed_on(fill: np.ndarray, capacity: int, equal: int) -> np.ndarray:
    """Which bins the next round gets: those with room, and of equally full ones that are over half full `equal` at most."""
    keep = capacity - fill >= SPARE
    for f in np.unique(fill[keep & (2 * fill > capacity)]).tolist():
        keep[np.flatnonzero(fill == f)[equal:]] = False
    return keep


def _round(open_: DataFrame, capacity: int, equal: int) -> DataFrame:
    """One round over the bins (grp, bin, fill): bin, into (the bin it is now part of), shift, and fill and keep of each bin that is left (on the row where bin = into)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bin", "ascending")])
        group, name, held = (table.column(c).to_numpy() for c in ("grp", "bin", "fill"))
        bins, offsets, fill = best_fit(held, capacity)
        head = np.zeros(len(fill), np.int64)
        head[bins[offsets == 0]] = name[offsets == 0]
        first = offsets == 0
        keep = passed_on(fill, capacity, equal)
        return pa.table({"grp": group, "bin": name, "into": head[bins], "shift": offsets, "fill": pa.array(fill[bins], mask=~first), "keep": pa.array(keep[bins] & first)})

    return open_.groupBy("grp").applyInArrow(run, "grp long, bin long, into long, shift long, fill long, keep boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of items with sequence_id and offset: each a place of its own in a sequence of `capacity` at most, without gaps.

    items has a long column item, a number of its own for each row and below 2^62, and a long column length of 1 to
    capacity; other columns are kept (none may be called grp, sequence_id or offset). Results depend on items and
    lengths alone. An empty table gives none.
    """
    rows = materialize(items)
    part = rows.where(F.col("length") < capacity)
    wrong = rows.where("item is null or length is null or length < 1 or length > " + str(capacity)).first()
    if wrong:
        raise ValueError(f"items need a number and a length of 1 to {capacity}: {wrong}")
    full = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    groups = max(1, -(-part.count() // group))
    levels = 0
    while FAN**levels < groups:
        levels += 1
    schema = T.StructType([*part.schema.fields, T.StructField("grp", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("at", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("keep", T.BooleanType())])

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending")])
        bins, offsets, fill = best_fit(table.column("length").to_numpy(), capacity)
        keep = passed_on(fill, capacity, FAN * levels)
        first = offsets == 0
        name = (table.column("grp").to_numpy() << 32) + bins
        return table.append_column("bin", pa.array(name)).append_column("at", pa.array(offsets)).append_column("fill", pa.array(fill[bins], mask=~first)).append_column("keep", pa.array(keep[bins] & first))

    dealt = part.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)))
    placed = dealt.groupBy("grp").applyInArrow(local, schema)
    if not levels:
        return placed.select(*rows.columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset")).unionByName(full)
    placed = materialize(placed)
    open_, moved = placed.where("keep").select("grp", "bin", "fill"), None
    for level in range(1, levels + 1):
        met = materialize(_round(open_.withColumn("grp", F.floor(F.col("grp") / FAN)), capacity, FAN * (levels - level)))
        new = met.where("bin <> into").select("bin", "into", "shift")
        if moved is not None:
            then = new.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(then, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            new = moved.unionByName(new)
        moved, open_ = materialize(new), met.where("keep").select("grp", "bin", "fill")
    told = F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved
    out = placed.join(told, "bin", "left")
    return out.select(*rows.columns, F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    A document is its ids by the tokenizers library with an end id after them; one of more than `capacity` is cut into
    pieces of that many, of which the first may be shorter. A null or empty text is the end id alone; null and
    repeated ids, and repeated rows, are documents like others; other columns are not read; an empty table gives no
    rows. sequence_id may be any number; within one the pieces lie from offset 0 on without gaps.
    """
    return pack(pieces(docs, vocabulary, capacity, end), capacity).drop("item")


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id and ids (array of int, `capacity` at most) of every sequence that pack_documents makes.

    The ids travel with their pieces, four bytes each, so that a group holds GROUP times `capacity` of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 40
        for _, ids, first in _encoded(batches, vocabulary, end):
            owner, _, start, length = piece_bounds(np.diff(first), capacity)
            begin = first[owner] + start
            parts = [ids[a : a + n].astype(np.int32) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            flat = np.concatenate([np.zeros(0, np.int32), *parts])
            edges = np.concatenate([[0], np.cumsum(length)])
            yield pa.RecordBatch.from_arrays([pa.array(item + np.arange(len(owner))), pa.array(length), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))], ["item", "length", "ids"])
            item += len(owner)

    placed = pack(only(docs, "doc_id", "text").mapInArrow(run, "item long, length long, ids array<int>"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
