"""Vectorized word lookup for BPE vocabularies.

The texts of a slice are cut into words in numpy, each word is found by a hash and its bytes are compared with those
of the word found; only words that a worker has not met yet are encoded one by one. A text that holds special
tokens, characters of unknown class, or a word that shares its hash with another is encoded whole by the slow way, so
the result never depends on which path was taken.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .common import same_spans, span_hashes
from .cuts import cut, holding

#: Words a worker remembers, about 60 bytes each, and their bytes; beyond that it starts anew.
MAX_WORDS, MAX_BYTES = 1_500_000, 64 << 20

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Bytes that need a look: not ASCII, an apostrophe (contractions) or an angle bracket (special tokens).
_LOOK = np.zeros(256, bool)
_LOOK[128:] = True
_LOOK[[39, 60]] = True
# After lead byte 0xC3 the letters À to ÿ follow, without × and ÷.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LATIN_LOWER = np.arange(256, dtype=np.uint8)
_LATIN_LOWER[0x80:0x9F] += 0x20

#: Bytes, starts and ends of words, each text's first word, and which texts were cut.
Cut = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def plain_documents(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents the byte classes cut exactly as the lower-case tokenizer does."""
    ok = np.ones(len(at) - 1, bool)
    spots = np.flatnonzero(_LOOK[data])
    if len(spots):
        b = data[spots]
        nxt = data[np.minimum(spots + 1, len(data) - 1)]
        prev = data[np.maximum(spots - 1, 0)]
        fine = ((b == 0xC3) & _LATIN[nxt]) | ((b >= 0x80) & (b < 0xC0) & (prev == 0xC3)) | ((b == 60) & (nxt != 124))
        bad = spots[~fine]
        if len(bad):
            ok[np.unique(np.searchsorted(at, bad, side="right") - 1)] = False
    return ok


def normalized(raw: bytes) -> bytes:
    """A text in NFC and lower case (a final sigma is one like any other)."""
    text = unicodedata.normalize("NFC", raw.decode())
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower().encode()


def lower_words(specials: list[bytes]) -> Callable[[np.ndarray, np.ndarray], Cut]:
    """The cut of a vocabulary with NFC, white-space and lower-case normalization.

    Texts of ASCII and Latin-1 letters are cut by byte classes; if a slice holds others, they are normalized and all
    are cut by the classes of their characters.
    """

    def plain(data: np.ndarray, at: np.ndarray, low: np.ndarray) -> Cut:
        kind = _CLASS[data]
        fresh = np.ones(len(data) + 1, bool)
        if len(data):
            np.not_equal(kind[1:], kind[:-1], out=fresh[1:-1])
            fresh[:-1] |= kind == 2
        fresh[at] = True
        edges = np.flatnonzero(fresh)
        starts, ends = edges[:-1], edges[1:]
        word = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        return low, starts, ends, np.searchsorted(starts, at), np.ones(len(at) - 1, bool)

    def run(data: np.ndarray, at: np.ndarray) -> Cut:
        low = _LOWER[data]
        high = np.flatnonzero((data == 0xC3)) + 1
        low[high] = _LATIN_LOWER[data[high]]
        ok = plain_documents(data, at)
        if ok.all():
            return plain(data, at, low)
        marked = holding(data, at, specials)
        texts = [low[a:b].tobytes() if fine else b"" if special else normalized(data[a:b].tobytes()) for a, b, fine, special in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist(), marked.tolist(), strict=True)]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, ends, first, known = cut(data, at, False)
        return data, starts, ends, first, known & ~marked

    return run


def byte_words(specials: list[bytes]) -> Callable[[np.ndarray, np.ndarray], Cut]:
    """The cut of a byte-level vocabulary without normalization."""

    def run(data: np.ndarray, at: np.ndarray) -> Cut:
        starts, ends, first, known = cut(data, at, True)
        return data, starts, ends, first, known & ~holding(data, at, specials)

    return run


class WordTable:
    """hash of a word -> its ids, filled by encode_words as words come up."""

    def __init__(self, encode_words: Callable[[list[str]], list[np.ndarray]], encode_text: Callable[[str], np.ndarray], words: Callable[[np.ndarray, np.ndarray], Cut]):
        self.encode_words, self.encode_text, self.words = encode_words, encode_text, words
        self.reset()

    def reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.filled = 0
        self.text = np.zeros(1 << 16, np.uint8)  # the words' bytes, and where each begins; the last entry is the end
        self.word_at = np.zeros(1, np.int64)

    @staticmethod
    def _room(pool: np.ndarray, total: int) -> np.ndarray:
        while total > len(pool):
            pool = np.concatenate([pool, np.zeros_like(pool)])
        return pool

    def _add(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        """New words by rising hash: pools grow by doubling, and hashes are put in their places without another sort."""
        words = [w.decode() for w in raw]
        ids = self.encode_words(words)
        joined, used = np.frombuffer(b"".join(raw), np.uint8), int(self.word_at[-1])
        self.text = self._room(self.text, used + len(joined))
        self.text[used : used + len(joined)] = joined
        self.word_at = np.concatenate([self.word_at, used + np.cumsum([len(w) for w in raw])])
        sizes = np.array([len(i) for i in ids], np.int64)
        total = self.filled + int(sizes.sum())
        self.pool = self._room(self.pool, total)
        starts = self.filled + np.cumsum(sizes) - sizes
        if total > self.filled:
            self.pool[self.filled : total] = np.concatenate(ids)
        self.filled = total
        slots = len(self.starts) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        spot = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, spot, hashes), np.insert(self.slots, spot, slots)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in one array, and each document's first place in it."""
        raw, starts, ends, first_word, cut_ok = self.words(data, at)
        ids, first, sure = self._found(raw, starts, ends, first_word)
        sure &= cut_ok
        if sure.all():
            return ids, first
        parts = [ids[first[i] : first[i + 1]] if fine else np.asarray(self.encode_text(data[at[i] : at[i + 1]].tobytes().decode()), np.int32) for i, fine in enumerate(sure.tolist())]
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and first places, and for each document whether all its words have the bytes of the words found."""
        if len(self.hashes) > MAX_WORDS or self.word_at[-1] > MAX_BYTES:
            self.reset()
        uniq, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, uniq)
        known = np.zeros(len(uniq), bool)
        inside = spot < len(self.hashes)
        known[inside] = self.hashes[spot[inside]] == uniq[inside]
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            self._add(uniq[~known], [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.hashes, uniq)][back]
        length = ends - starts
        equal = self.word_at[slot + 1] - self.word_at[slot] == length
        equal[equal] = same_spans(data, starts[equal], self.text, self.word_at[slot[equal]], length[equal])
        sure = np.ones(len(first_word) - 1, bool)
        sure[np.searchsorted(first_word, np.flatnonzero(~equal), side="right") - 1] = False
        sizes = self.sizes[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(total[-1]) + np.repeat(self.starts[slot] - total[:-1], sizes)
        return self.pool[place], total[first_word], sure


def ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join pool[starts[i] : starts[i] + sizes[i]] over all i in ids; also the place where each begins."""
    n = sizes[ids]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    return pool[np.arange(total[-1]) + np.repeat(starts[ids] - total[:-1], n)], total
