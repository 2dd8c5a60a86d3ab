"""Token ids in files of shuffled bit planes.

A file holds the documents of one range of doc_id. Its ids are cut into blocks of a fixed number of ids; a block
is transposed into its bit planes (or byte planes), each plane is compressed with zstandard, and a chunk index
at the end of the file names every plane's place:

    "LOOMBP01" | planes of block 0 | planes of block 1 | ... | footer | length of footer (8 bytes) | "LOOMBP01"

The footer is a zstandard frame of: kind (0 bit, 1 byte), number of blocks and of documents; for each block the
number of ids, the id width in bits, the offset and the size of each plane; for each document doc_id, whether
it is null, and the number of ids.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, only, shared_dir, text_slices
from .word_table import WordTable, lower_words

MAGIC = b"LOOMBP01"
BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """The planes of one block: plane k has bit k (or byte k) of every id."""
    if kind == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, k].tobytes() for k in range(width // 8)]
    narrow = ids.astype("<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(narrow.view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits[:, :width].T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The inverse of to_planes."""
    if kind == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4").astype(np.uint32)
    packed = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    bits = np.zeros((n, 16 if len(planes) <= 16 else 32), np.uint8)
    bits[:, : len(planes)] = np.unpackbits(packed, axis=1, count=n, bitorder="little").T
    whole = np.packbits(bits, axis=1, bitorder="little")
    return whole.reshape(-1).view("<u2" if len(planes) <= 16 else "<u4").astype(np.uint32)


class PlaneWriter:
    """Writes one file; holds at most one block of ids besides the document index."""

    def __init__(self, sink, kind: str = "bit", block_ids: int = BLOCK_IDS, level: int = 1):
        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.at = self.sink.write(MAGIC) or len(MAGIC)
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.blocks: list[tuple[int, int, int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, first: np.ndarray) -> None:
        """Append documents; document k has ids[first[k] : first[k + 1]]."""
        self.docs += zip(doc_ids, np.diff(first).tolist(), strict=True)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            whole = np.concatenate(self.rest)
            full = len(whole) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(whole[i : i + self.block_ids])
            self.rest, self.waiting = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        top = int(ids.max())
        width = (8 if top < 256 else 16 if top < 65536 else 32) if self.kind == "byte" else max(1, top.bit_length())
        packed = [self.packer.compress(p) for p in to_planes(ids, width, self.kind)]
        self.blocks.append((len(ids), width, self.at, [len(p) for p in packed]))
        self.at += sum(map(len, packed))
        self.sink.write(b"".join(packed))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        parts = [struct.pack("<BQQ", int(self.kind == "byte"), len(self.blocks), len(self.docs))]
        for n, width, at, sizes in self.blocks:
            parts.append(struct.pack(f"<IBQB{len(sizes)}I", n, width, at, len(sizes), *sizes))
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        nulls = np.array([d is None for d, _ in self.docs], np.uint8)
        parts += [ids.tobytes(), nulls.tobytes(), np.array([n for _, n in self.docs], "<i8").tobytes()]
        footer = self.packer.compress(b"".join(parts))
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


def read_file(source, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of an open file, block by block."""
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of token planes")
    (length,) = struct.unpack("<Q", tail[:8])
    source.seek(size - 16 - length)
    raw = zstandard.ZstdDecompressor().decompress(source.read(length))
    byte, n_blocks, n_docs = struct.unpack_from("<BQQ", raw)
    kind, at, blocks = ("byte" if byte else "bit"), 17, []
    for _ in range(n_blocks):
        n, _, place, planes = struct.unpack_from("<IBQB", raw, at)
        sizes = struct.unpack_from(f"<{planes}I", raw, at + 14)
        blocks.append((n, place, sizes))
        at += 14 + 4 * planes
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    nulls = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)
    unpack = zstandard.ZstdDecompressor()
    rest, todo = np.zeros(0, np.uint32), iter(blocks)
    for doc, null, count in zip(doc_ids.tolist(), nulls.tolist(), counts.tolist(), strict=True):
        have, parts = len(rest), [rest]
        while have < count:
            n, place, sizes = next(todo)
            source.seek(place)
            packed = source.read(sum(sizes))
            ends = np.cumsum(sizes)
            parts.append(from_planes([unpack.decompress(packed[e - s : e]) for s, e in zip(sizes, ends.tolist(), strict=True)], n, kind))
            have += n
        whole = np.concatenate(parts) if len(parts) > 1 else rest
        rest = whole[count:]
        yield (None if null else doc), whole[:count]


_TABLES: dict[str, WordTable] = {}


def library_table(path: str) -> WordTable:
    """A word table filled by the tokenizers library; whole texts go to it where words cannot be cut ahead."""
    if path not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _TABLES[path] = WordTable(lambda words: [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)], lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int32), lower_words([t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]))
    return _TABLES[path]


def write_planes(docs: DataFrame, vocabulary: str, end_id: int, folder: str, kind: str = "bit", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text and write the files; one manifest row per file: part, path, n_docs, n_ids.

    Documents lie in ascending (doc_id, hash of text) order over the parts, null ids first. A null or empty text
    has the end id alone; repeated ids keep all their rows; an empty table writes no file; other columns are not
    read. A task that runs again writes another file, and the manifest names only the one that was finished.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocabulary)
        part, writer, sink, path = TaskContext.get().partitionId(), None, None, ""
        for rows, data, at in text_slices(batches):
            if writer is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                path = f"{folder}/{name}"
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = PlaneWriter(sink, kind, block_ids)
            ids, first = table.encode(data, at)
            n = len(first) - 1
            grown = np.full(len(ids) + n, end_id, np.int32)
            ends = first[1:] + np.arange(n)
            keep = np.ones(len(grown), bool)
            keep[ends] = False
            grown[keep] = ids
            writer.add(rows.column("doc_id").cast(pa.int64()).to_pylist(), grown, np.concatenate([[0], ends + 1]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.docs)], "n_ids": [sum(n for _, n in writer.docs)]})

    placed = only(docs, "doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    return materialize(placed.select("doc_id", "text").mapInArrow(run, "part long, path string, n_docs long, n_ids long"))


def read_planes(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                out: list[tuple[int | None, int, int, int]] = []
                with fs.open_input_file(name) as f:
                    for doc, ids in read_file(f, f.size()):
                        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return files.repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_planes(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, kind: str = "bit") -> DataFrame:
    """Write docs as token planes into the shared folder and return what the files say of each document."""
    return read_planes(write_planes(docs, vocabulary, end_id, shared_dir(spark), kind))
