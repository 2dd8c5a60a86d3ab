"""Secret scans: a keyword automaton first, anchored patterns only at its hits, then embedded checksums.

Kinds: assign, access and hex are judged by pattern alone; github and npm tokens carry a CRC-32 in base 62 in
their last six characters and are reported only where it fits. Runs of hex digits have no keyword: they are found
by byte classes over a whole batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, text_slices

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
_KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
_PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
}
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def checksum62(body: str) -> str:
    """The CRC-32 of body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


_AUTOMATON: list[ahocorasick.Automaton] = []


def keyword_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret that begins with a keyword, in code points."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered
        low = text.translate(_ASCII_LOWER)
    out: list[tuple[int, int, str]] = []
    reach = dict.fromkeys(_PATTERNS, 0)
    for start, kind in sorted((end - n + 1, kind) for end, (kind, n) in _AUTOMATON[0].iter(low)):
        if start < reach[kind]:
            continue
        m = _PATTERNS[kind].match(text, start)
        if m is None:
            continue
        reach[kind] = m.end()
        if kind == "assign":
            good = len(m[2]) >= MIN_VALUE
        elif kind == "access":
            good = m.end() - start >= MIN_ACCESS
        else:
            good = checksum62(m[1][:30]) == m[1][30:]
        if good:
            out.append((start, m.end(), kind))
    return out


def hex_runs(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the runs of hex digits in a batch, as byte offsets in the row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _HEX[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    out = []
    for s, e in zip(begin[end - begin >= MIN_HEX].tolist(), end[end - begin >= MIN_HEX].tolist(), strict=True):
        row = int(np.searchsorted(at, s, side="right")) - 1
        while s < e:  # a run may go on over the end of a text
            stop = min(e, int(at[row + 1]))
            if stop - s >= MIN_HEX:
                out.append((row, s - int(at[row]), stop - int(at[row])))
            s, row = stop, row + 1
    return out


def batch_spans(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Text and spans of each row, by start and then kind."""
    found: dict[int, list[tuple[int, int]]] = {}
    for row, s, e in hex_runs(data, at):
        found.setdefault(row, []).append((s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    for i, text in enumerate(rows.column("text").to_pylist()):
        text = text or ""
        spans = keyword_spans(text)
        runs = found.get(i, ())
        begins = np.array([s for s, _ in runs], np.int64)
        if runs and len(text) < at[i + 1] - at[i]:  # not all ASCII: count the bytes that begin a character
            begins = np.concatenate([[0], np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)])[begins]
        spans += [(b, b + e - s, "hex") for b, (s, e) in zip(begins.tolist(), runs, strict=True)]
        yield text, sorted(spans, key=lambda x: (x[0], order[x[2]], x[1]))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_checked, base_sha256 and spans, one row for each row of docs.

    A null or empty text has no spans; null and repeated ids keep all their rows; other columns are not read.
    Whole texts are scanned; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for _, spans in batch_spans(rows, data, at):
                kinds = [k for _, _, k in spans]
                for i, k in enumerate(BASE_KINDS):
                    out[i].append(kinds.count(k))
                out[3].append(len(kinds) - sum(o[-1] for o in out[:3]))
                out[4].append(hashlib.sha256(_join([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest())
                out[5].append(_join(spans))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *(pa.array(o, pa.int64()) for o in out[:4]), *(pa.array(o, pa.string()) for o in out[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every span, overlapping ones merged, replaced by its kind in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and n_chars, where there is such a column, counted anew; no row goes.

    A null text stays null and keeps its n_chars; an empty one stays empty; repeated rows and ids are masked each on
    their own, other columns are untouched, whatever their names, and an empty table gives no rows.
    """
    schema = docs.schema
    names = docs.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            texts = [mask(t, s) if s else t for t, s in batch_spans(rows, data, at)]
            gone = rows.column("text").is_null().to_pylist()
            cols = list(rows.columns)
            cols[text_at] = pa.array([None if n else t for t, n in zip(texts, gone, strict=True)], cols[text_at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([None if v is None or n else len(t) for t, n, v in zip(texts, gone, cols[k].to_pylist(), strict=True)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
