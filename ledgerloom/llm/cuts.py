"""Cutting the texts of a slice into a tokenizer's words by the classes of their characters, all at once.

A tokenizer's pattern tells letters, digits, white space and other characters apart. Whether a word begins at a
character follows from its class and its neighbours', so places are found in numpy over the UTF-8 bytes of all texts.
Characters that Python's Unicode tables do not know leave their text to the tokenizer itself.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, DIGIT, BLANK, UNKNOWN = range(5)
#: Characters of Unicode's White_Space property: fixed values.
_WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: What follows an apostrophe in a contraction: fixed values.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else UNKNOWN if kind == "Cn" else OTHER
    out[_WHITE] = BLANK
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each character's first byte, and the character's class."""
    table = classes()
    if not len(data) or data.max() < 128:
        return np.arange(len(data)), table[:128][data]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead]
    kind = table[:128][np.minimum(b, 127)]
    wide = np.flatnonzero(b >= 128)
    at, b = lead[wide], b[wide].astype(np.int32)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    tail = [padded[at + k] & 0x3F for k in (1, 2, 3)]
    two, three = (b & 0x1F) << 6 | tail[0], (b & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    kind[wide] = table[np.where(b < 0xE0, two, np.where(b < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    return lead, kind


def cut(data: np.ndarray, at: np.ndarray, attach: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of words, each text's first word, and which texts have known characters only.

    With attach, words are those of byte-level vocabularies: a blank joins the letters, digits or signs after it, the
    white space before that blank is a word. Without, white space is dropped and each digit is a word. Either way an
    apostrophe at a word's start and one of s, t, m, d, re, ve, ll after it are a word.
    """
    place, kind = characters(data)
    m, edges = len(place), np.searchsorted(place, at)
    byte = np.append(data[place], np.zeros(3, np.uint8))
    opens = np.zeros(m + 4, bool)  # first characters of texts, and all that follows the last
    opens[edges] = True
    opens[m:] = True
    start = opens[: m + 1].copy()
    start[1:m] |= kind[1:] != kind[:-1]
    if not attach:
        start[:m] |= kind == DIGIT
    joins = np.zeros(m + 1, bool)  # characters that join the blank before them
    if attach:
        joins[1:m] = start[1:m] & ~opens[1:m] & (kind[1:] != BLANK) & (byte[: m - 1] == 32) if m else False
        begin = start.copy()
        begin[joins] = False
        last = np.zeros(m + 1, bool)  # last characters of white space before something else
        last[: m - 1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~opens[1:m]
        begin |= last
    else:
        begin = start.copy()
    quotes = np.flatnonzero(start[:m] & ~joins[:m] & (byte[:m] == 39))
    quotes = quotes[~opens[quotes + 1]]
    if len(quotes):
        a, b = byte[quotes + 1], byte[quotes + 2]
        one = np.isin(a, list(_ONE))
        two = np.zeros(len(quotes), bool)
        for x, y in _TWO:
            two |= (a == x) & (b == y) & ~opens[quotes + 2]
        begin[quotes[one | two] + 1] = False
        begin[quotes[one] + 2] = True
        begin[quotes[two] + 3] = True
    chosen = np.flatnonzero(begin[:m])
    starts = place[chosen]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    if not attach:
        word = kind[chosen] != BLANK
        starts, ends = starts[word], ends[word]
    known = np.ones(len(at) - 1, bool)
    strange = np.flatnonzero(kind == UNKNOWN)
    known[np.searchsorted(edges, strange, side="right") - 1] = False
    return starts, ends, np.searchsorted(starts, at), known


def holding(data: np.ndarray, at: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which texts hold one of the marks, each of which begins with '<|'."""
    out = np.zeros(len(at) - 1, bool)
    spots = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else np.zeros(0, np.int64)
    for k in np.unique(np.searchsorted(at, spots, side="right") - 1).tolist():
        text = data[at[k] : at[k + 1]].tobytes()
        out[k] = any(x in text for x in marks)
    return out
