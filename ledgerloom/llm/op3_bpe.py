"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file is of the tokenizers JSON kind with NFC, white-space and lower-case normalization, a
splitting pattern, byte-level symbols and a word-end suffix. Every distinct piece a task meets is encoded
once: the symbols of all new pieces lie in one flat array, each round finds the rank of every adjacent pair
by binary search over the sorted pair keys, and each piece merges its lowest-rank pair.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import only, text_slices
from .word_table import WordTable, lower_words, ragged

# str.split() cuts at Unicode white space, as the tokenizer does, but also at these four control characters.
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
_CONTROL_WORDS = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def pieces(text: str) -> list[str]:
    """Cut a text at white space, where the tokenizer always cuts as well: pieces encode one by one."""
    return _CONTROL_WORDS.findall(text) if any(c in text for c in _CONTROL) else text.split()


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.cut, self.newer = regex.compile(steps[0]["pattern"]["Regex"]), Tokenizer.from_file(path).pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        symbols = _byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def _words(self, piece: str) -> list[str]:
        """The words of one piece; specials stay whole."""
        out = []
        for part in self.special_cut.split(piece) if self.special_cut and "<|" in piece else [piece]:
            if part in self.specials:
                out.append(part)
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            if part.isalpha():
                out.append(part)
            elif part[:-1].isalpha() and part[-1] in ".,!?;:":
                out += (part[:-1], part[-1])
            else:
                out += self._cut(part)
        return out

    def _cut(self, part: str) -> list[str]:
        """The words of a normalized part; where it has characters newer than Python's tables, the library tells which are letters."""
        if any(unicodedata.category(c) == "Cn" for c in part):
            return [part[a:b] for _, (a, b) in self.newer.pre_tokenize_str(part)]
        return self.cut.findall(part)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (no specials), by merge rounds over all words at once."""
        raw = [w.encode() for w in words]
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends[sizes > 0] - 1] = self.last[data[ends[sizes > 0] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        none = np.int64(1 << 40)
        while len(symbols):
            rank = np.full(len(symbols), none)
            key = (symbols[:-1] << 20) | symbols[1:]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[spot] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[spot[hit]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.concatenate([first, [len(symbols)]]))
            if (best == none).any():  # these words are finished
                over = best == none
                for f, n in zip(first[over].tolist(), span[over].tolist(), strict=True):
                    done[word[f]] = symbols[f : f + n]
                keep = np.repeat(~over, span)
                symbols, word, rank = symbols[keep], word[keep], rank[keep]
                best, span = best[~over], span[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, span))
            if len(at) > 1:  # of overlapping places, as in a run of one symbol, every other one merges
                run = np.concatenate([[True], np.diff(at) > 1])
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return done

    def encode(self, text: str) -> np.ndarray:
        """The ids of any text, piece by piece."""
        words = [w for p in pieces(text) for w in self._words(p)]
        distinct = list(set(words) - self.specials.keys())
        ids = dict(zip(distinct, self.merge(distinct), strict=True)) | {s: np.array([i], np.int64) for s, i in self.specials.items()}
        return np.concatenate([ids[w] for w in words]).astype(np.int32) if words else np.zeros(0, np.int32)

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by one space (the vocabulary has no decoder); unknown ids are skipped."""
        return " ".join(self.names[i] for i in ids if i in self.names)


class Digests:
    """Joins ids, as decimal text and as token strings, for many documents at once."""

    def __init__(self, names: dict[int, str]):
        self.tables = [self._table(lambda i: str(i), names), self._table(names.get, names)]

    @staticmethod
    def _table(text: Callable[[int], str], names: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [((text(i) if i in names else "") + " ").encode() for i in range(max(names) + 1)]
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes

    def texts(self, ids: np.ndarray, first: np.ndarray, table: int) -> Iterator[memoryview]:
        pool, starts, sizes = self.tables[table]
        joined, total = ragged(pool, starts, sizes, ids)
        view, place = memoryview(joined), total[first].tolist()
        for a, b in zip(place[:-1], place[1:], strict=True):
            yield view[a : max(a, b - 1)]


_LOADED: dict[str, tuple[Bpe, WordTable, Digests]] = {}


def loaded(path: str) -> tuple[Bpe, WordTable, Digests]:
    """The encoder of this worker process for a file, read once."""
    if path not in _LOADED:
        bpe = Bpe(path)
        _LOADED[path] = bpe, WordTable(bpe.merge, bpe.encode, lower_words([s.encode() for s in bpe.specials])), Digests(bpe.names)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, place: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and decoded_bytes, one row for each row of docs.

    If place names a column of whole numbers, it is kept as the last column.

    A null or empty text has no tokens and the digests of the empty string; null and repeated ids are kept as
    they are; other columns are not read. No shuffle takes place: a task holds one Arrow batch and a bounded
    table of words.
    """

    kept = [place] if place else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, digests = loaded(vocabulary)
        for rows, data, at in text_slices(batches):
            ids, first = words.encode(data, at)
            decimal = [hashlib.sha256(x).hexdigest() for x in digests.texts(ids, first, 0)]
            decoded = [(hashlib.sha256(x).hexdigest(), len(x)) for x in digests.texts(ids, first, 1)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(decimal, pa.string()), pa.array([x for x, _ in decoded], pa.string()), pa.array([n for _, n in decoded], pa.int64()), *(rows.column(c).cast(pa.int64()) for c in kept)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_bytes", *kept])

    return only(docs, "doc_id", "text", *kept).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_bytes long" + "".join(f", `{c}` long" for c in kept))


def encode_rows(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of each row, for use by other jobs; defined as in encode_documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, _ = loaded(vocabulary)
        for rows, data, at in text_slices(batches):
            ids, first = words.encode(data, at)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_rows(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text decoded from an ids column; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _, _ = loaded(vocabulary)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
