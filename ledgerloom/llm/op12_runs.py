"""Periodic runs of words by suffix arrays, longest previous factors and Main's boundary extensions.

All documents of a slice are worked on at once, as one array of word numbers that never match across documents.
Prefix doubling ranks the strings of 1, 2, 4, ... words from every place; the last ranks order the suffixes, and the
ranks of every length give the longest common extension of two places, forwards or backwards, exactly. Neighbours
in suffix order have the longest common prefixes; the nearest smaller places before and after in that order give
each place its longest previous factor (LPF), and those cut a document into blocks, each of them one new word or a
copy of something earlier.

A run that touches the start or end of a block is found by Main's extensions from that boundary: for each period
q up to a third of the lengths beside it, how far does the text repeat itself at distance q to either side. A run
strictly inside a block is the copy of an earlier one, which lies in the bucket of its start. Runs must hold their
period four times, which is what bounds q.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, same_spans, span_hashes, text_slices, word_spans

#: A run has this many words at least and holds its period so many times.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text worked on at once (a longer text alone), about 150 bytes of memory for each of its words.
SLICE = 2 << 20


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for words of the same bytes."""
    _, first, numbers = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like = first[numbers]
    size = ends - starts
    if not ((size[like] == size) & same_spans(data, starts, data, starts[like], np.minimum(size, size[like]))).all():
        raw, names = data.tobytes(), {}
        numbers = np.array([names.setdefault(raw[s:e], len(names)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return numbers


def planted(doc_ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """For each word the place of the word that stands there.

    With h the CRC-32 of the decimal doc_id and g = h // 10, a document with h divisible by ten has its words from
    a = g % n on repeat with period 1 + (n - a) // (3 + g % 8). Null ids leave their text alone.
    """
    out = np.arange(first[-1])
    for k, doc in enumerate(doc_ids):
        n = int(first[k + 1] - first[k])
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return out


class Suffixes:
    """Ranks of the strings of 2^k words from every place of several documents, and what follows from them."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray):
        n = len(numbers)
        self.n, self.owner = n, np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.low, self.end = first[:-1][self.owner], first[1:][self.owner]  # the document of each place
        key = self.owner * (int(numbers.max(initial=0)) + 1) + numbers
        order = np.argsort(key, kind="stable")
        self.ranks = [self._groups(key[order], order, np.zeros(n, np.int32))]
        sizes = np.bincount(self.ranks[0], minlength=n)
        open_ = np.flatnonzero(sizes[self.ranks[0]] > 1)  # places whose string is not the only one of its kind
        step = 1
        while len(open_):
            before = self.ranks[-1]
            then = np.where(open_ + step < self.end[open_], before[np.minimum(open_ + step, n - 1)].astype(np.int64) + 1, 0)
            key = before[open_].astype(np.int64) * (n + 1) + then
            order = np.argsort(key)
            key, places = key[order], open_[order]
            rank = before.copy()
            group = before[places]
            new_group = np.concatenate([[True], group[1:] != group[:-1]])
            at = np.flatnonzero(new_group)
            inside = np.arange(len(places)) - at[np.cumsum(new_group) - 1]
            new = new_group | np.concatenate([[True], key[1:] != key[:-1]])
            head = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            rank[places] = group + inside[head][which]
            self.ranks.append(rank)
            open_ = places[np.diff(np.concatenate([head, [len(places)]]))[which] > 1]
            step *= 2
        self.array = np.empty(n, np.int64)
        self.array[self.ranks[-1]] = np.arange(n)

    @staticmethod
    def _groups(key: np.ndarray, order: np.ndarray, out: np.ndarray) -> np.ndarray:
        if len(key):
            new = np.concatenate([[True], key[1:] != key[:-1]])
            out[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for places i < j of one document or one past its end."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, top = self.ranks[k], self.n - 1
            a, b = i + out, j + out
            inside = b < self.stop(j)
            out += (inside & (rank[np.minimum(a, top)] == rank[np.minimum(b, top)])).astype(np.int64) << k
        return out

    def stop(self, j: np.ndarray) -> np.ndarray:
        """The end of the document of each place j; a place past all words has none of its own."""
        return np.where(j < self.n, self.end[np.minimum(j, self.n - 1)], 0)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to and including i equal those up to j, for i < j; i may be one before its document."""
        out = np.zeros(len(i), np.int64)
        low = self.low[np.minimum(j, self.n - 1)]
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b, rank = i - out - (1 << k) + 1, j - out - (1 << k) + 1, self.ranks[k]
            inside = a >= low
            out += (inside & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def longest_previous(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF of each place and the earlier place that it copies from.

        In suffix order, the nearest neighbour on either side that lies earlier in the text has the longest match
        on that side. Each place follows its neighbours' pointers until it finds it, and carries the least common
        prefix on the way; it gives up where nothing in common is left.
        """
        n, sa = self.n, self.array
        length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n < 2:
            return length, source
        near = self.owner[sa[1:]] == self.owner[sa[:-1]]
        common = np.zeros(n + 1, np.int64)  # common[r]: of the suffixes of orders r - 1 and r
        a, b = np.minimum(sa[1:], sa[:-1])[near], np.maximum(sa[1:], sa[:-1])[near]
        common[1:n][near] = self.forward(a, b)
        for side in (-1, 1):
            to = np.arange(n) + side
            least = common[:n].copy() if side < 0 else common[1:].copy()
            open_ = np.flatnonzero(least > 0)
            while len(open_):
                open_ = open_[sa[to[open_]] > sa[open_]]
                over = to[open_]
                least[open_] = np.minimum(least[open_], least[over])
                to[open_] = to[over]
                open_ = open_[least[open_] > 0]
            good = np.flatnonzero(least > 0)
            better = good[least[good] > length[sa[good]]]
            length[sa[better]], source[sa[better]] = least[better], sa[to[better]]
        return length, source


def blocks(lpf: np.ndarray) -> np.ndarray:
    """Starts of the blocks: each is as long as the longest previous factor of its start, or one new word."""
    steps, out, i, n = np.maximum(lpf, 1).tolist(), [], 0, len(lpf)
    while i < n:
        out.append(i)
        i += steps[i]
    return np.array(out, np.int64)


def _touching(s: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of the runs that touch the start of a block or the end of a document."""
    ends = np.append(starts[1:], s.n)
    size = ends - starts
    first = starts == s.low[starts]
    last = np.flatnonzero(ends == s.end[starts])
    # boundaries, the block before each (0 words at the start of a document) and after (0 at the end)
    at = np.concatenate([starts, ends[last]])
    before = np.concatenate([np.where(first, 0, np.concatenate([[0], size[:-1]])), size[last]])
    after = np.concatenate([size, np.zeros(len(last), np.int64)])
    inside = np.concatenate([starts, starts[last]])  # a place of the document

    def candidates(most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(at)), most)
        q = np.arange(len(rows)) - np.repeat(np.cumsum(most) - most, most) + 1
        return at[rows], q, inside[rows]

    top = s.n - 1
    word = s.ranks[0]
    least = lambda q: np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    # A whole period lies before the boundary: the words before it repeat at distance q, or those after it.
    b, q, own = candidates((before + after) // (LEAST_PERIODS - 1))
    low, high = s.low[own], s.end[own]
    near = ((b < high) & (b - q >= low) & (word[np.minimum(b, top)] == word[np.maximum(b - q, 0)])) | ((b - 1 - q >= low) & (word[np.maximum(b - 1, 0)] == word[np.maximum(b - 1 - q, 0)]))
    b, q, high, low = b[near], q[near], high[near], low[near]
    right = np.where(b < high, s.forward(b - q, b), 0)
    left = np.where(b - 1 - q >= low, s.backward(b - 1 - q, b - 1), 0)
    good = q + left + right >= least(q)
    found = [(b[good] - q[good] - left[good], b[good] + right[good], q[good])]
    # A whole period lies after the boundary.
    b, q, own = candidates(after // (LEAST_PERIODS - 1))
    low, high = s.low[own], s.end[own]
    near = (b + q < high) & (word[b] == word[np.minimum(b + q, top)])
    b, q, low = b[near], q[near], low[near]
    right = s.forward(b, b + q)
    left = np.where(b - 1 >= low, s.backward(b - 1, b + q - 1), 0)
    good = q + left + right >= least(q)
    found.append((b[good] - left[good], b[good] + q[good] + right[good], q[good]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (exclusive) and smallest period of every run of each document, by start, then period.

    numbers: the words of all documents; first: the place of each document's first word, and the end.
    """
    s = Suffixes(numbers, first)
    if not s.n:
        return (np.zeros(0, np.int64),) * 3
    lpf, source = s.longest_previous()
    starts = blocks(lpf)
    a, b, q = _touching(s, starts)
    order = np.lexsort((q, b, a))  # of the periods of one stretch, the smallest comes first
    a, b, q = a[order], b[order], q[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    buckets: dict[int, dict[int, int]] = {}
    for x, y, z in zip(a[new].tolist(), b[new].tolist(), q[new].tolist(), strict=True):
        buckets.setdefault(x, {})[y] = z
    known = sorted(buckets)
    if known:
        ends = np.append(starts[1:], s.n)
        long = np.flatnonzero(ends - starts >= LEAST_WORDS + 2)
        for x, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            shift = x - int(source[x])
            k = bisect_right(known, x - shift)
            while k < len(known) and known[k] < end - 1 - shift:
                for y, z in list(buckets[known[k]].items()):
                    if y < end - shift:  # strictly inside the copied stretch
                        place = known[k] + shift
                        if place not in buckets:
                            buckets[place] = {}
                            insort(known, place)
                        buckets[place].setdefault(y + shift, z)
                k += 1
    rows = sorted((x, z, y) for x in known for y, z in buckets[x].items())
    return tuple(np.array([r[c] for r in rows], np.int64) for c in (0, 2, 1))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at some places, a blank after each, and where each begins."""
    size = ends[place] - starts[place] + 1
    total = np.zeros(len(place) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    out = np.append(data, np.uint8(32))[np.minimum(np.arange(total[-1]) + np.repeat(starts[place] - total[:-1], size), len(data))]
    out[total[1:] - 1] = 32
    return out, total


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, plant: bool) -> Iterator[tuple]:
    """doc_id, runs (start, length, period) and collapsed text (bytes) of each row."""
    starts, ends, first = word_spans(data, at)
    ids = rows.column("doc_id").to_pylist()
    place = planted(ids, first) if plant else np.arange(first[-1])
    numbers = word_numbers(data, starts, ends)[place]
    a, b, q = runs(numbers, first)
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, a + q, 1)
    np.add.at(gone, b, -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0) if len(numbers) else np.zeros(0, np.int64)
    text, total = joined(data, starts, ends, place[kept])
    cut = total[np.searchsorted(kept, first)].tolist()
    of = np.searchsorted(a, first).tolist()
    raw, shown, begin = text.tobytes(), list(zip(a.tolist(), (b - a).tolist(), q.tolist(), strict=True)), first.tolist()
    for k, doc in enumerate(ids):
        yield doc, [(x - begin[k], n, p) for x, n, p in shown[of[k] : of[k + 1]]], raw[cut[k] : max(cut[k], cut[k + 1] - 1)]


def find_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of each row of docs.

    Words are maximal stretches of other bytes than 0x20 and 0x09 to 0x0D; a run is a stretch of six words or more that
    holds its smallest period four times or more and cannot be longer. start, length and period are those of the run
    of the greatest length by period (ties: smallest start, then period), null without a run; runs_sha256 is of all
    runs, a line `start,length,period` each. collapsed_sha256 is of the words joined by one blank, less those that
    lie in a run after its first period. With plant, runs are planted into a tenth of the documents first (see
    planted). A null text has no words; null and repeated ids are kept, a null id gets nothing planted. An empty table
    gives no rows; other columns are not read. No shuffle takes place; a task holds one slice of about 2 MB or one long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches, limit=SLICE):
            out: list[tuple] = []
            for doc, found, text in _digest(rows, data, at, plant):
                best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                lines = "".join(f"{x},{n},{p}\n" for x, n, p in found).encode()
                out.append((doc, len(found), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(columns)], [c.split()[0] for c in _SCHEMA.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text (periodic runs cut to their first period, words joined by one blank) and runs (start, length, period)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for rows, data, at in text_slices(batches, limit=SLICE):
            out = list(_digest(rows, data, at, False))
            found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for _, f, _ in out]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([t.decode() for _, _, t in out], pa.string()), pa.array(found, kind)], ["doc_id", "text", "runs"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, text string, runs array<struct<start: long, length: long, period: long>>")
