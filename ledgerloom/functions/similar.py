"""Similarity of texts from 0 to 100 by common words and by common runs of letters, for many pairs at once.

Spark has no longest common subsequence; here thousands of pairs take their steps together, one 64-bit word a pair (more
for longer texts) and one letter a step, on Arrow batches. The functions on two texts are the definitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for x in b:
        hit = rest & places.get(x, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common letters over all letters; 100 for two empty texts."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and these with each text's other words; 0 if a text has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max([ratio(left, right)] + ([ratio(both, left), ratio(both, right)] if both else []))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a run of as many letters of the longer, or fewer at its ends."""
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 100.0
    ways = ((a, b), (b, a)) if len(a) == len(b) else (sorted((a, b), key=len),)
    return max(ratio(x, y[max(0, i) : i + len(x)]) for x, y in ways for i in range(1 - len(x), len(y)))


def _words(a: str) -> str:
    return " ".join(sorted(a.split()))


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios, each weighted by how much it forgives.

    The whole texts count in full and their sorted or common words at 0.95; if one text is 1.5 times as long as the
    other or more, the best run counts at 0.9 and runs of words at 0.855, or at 0.6 and 0.57 beyond eight times.
    """
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(ratio(_words(a), _words(b)), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    some = 100.0 if x & y else partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x)))
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * max(some, partial_ratio(_words(a), _words(b))))


# Many pairs at once

Texts = Sequence[str]
U64 = np.uint64
#: Pairs that step together, and entries of a table of letters' places.
_PAIRS, _ENTRIES = 1 << 14, 1 << 21


def _letters(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each text begins, and its length."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def _places(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, known: np.ndarray, words: int) -> np.ndarray:
    """places[t, l, w]: a bit for each place of letter l in word w of text t; the last letter is any other."""
    out = np.zeros((len(size), len(known) + 1, words), U64)
    order = np.argsort(-size, kind="stable")
    longest = size[order]
    for i in range(int(longest[0]) if len(longest) else 0):
        rows = order[: np.searchsorted(-longest, -i)]
        letter = np.searchsorted(known, codes[begin[rows] + i])
        out[rows, letter, i >> 6] |= U64(1) << U64(i & 63)
    return out


def _steps(places: np.ndarray, owner: np.ndarray, size: np.ndarray, letters: np.ndarray, begin: np.ndarray, count: np.ndarray, each: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """Common subsequences of texts (owner: their row of places, size) and stretches of letters (begin, count), for all pairs.

    each is told of every step: the letters taken, the pairs that took them and their lengths so far.
    """
    words = places.shape[2]
    order = np.argsort(-count, kind="stable")
    steps, owner, at = count[order], owner[order], begin[order]
    rest = np.full((len(order), words), ~U64(0))
    whole = np.clip(size[order][:, None] - 64 * np.arange(words), 0, 64).astype(U64)
    mask = np.where(whole == 64, ~U64(0), (U64(1) << (whole & U64(63))) - U64(1))
    for j in range(int(steps[0]) if len(steps) else 0):
        k = int(np.searchsorted(-steps, -j))
        hits = places[owner[:k], letters[at[:k] + j]]
        carry = np.zeros(k, U64)
        for w in range(words):
            v, m = rest[:k, w], hits[:, w]
            add = v & m
            total = v + add
            if words > 1:
                over = total < v
                total += carry
                carry = (over | ((total == 0) & (carry == 1))).astype(U64)
            rest[:k, w] = total | (v & ~m)
        if each is not None:
            each(j + 1, order[:k], (np.bitwise_count(~rest[:k] & mask[:k])).sum(1).astype(np.int64))
    out = np.zeros(len(order), np.int64)
    out[order] = np.bitwise_count(~rest & mask).sum(1)
    return out


def _chunks(a: Texts, b: Texts, work: Callable[[list[str], list[str]], np.ndarray], kind: type = np.int64) -> np.ndarray:
    """work on runs of pairs of about the same length, the shorter text of each first."""
    la, lb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
    order = np.lexsort((np.minimum(la, lb), (np.maximum(la, lb) + 63) // 64))
    words = (np.maximum(la, lb)[order] + 63) // 64
    out, i = np.zeros(len(a), kind), 0
    while i < len(order):
        j = min(i + max(1, _PAIRS // max(1, int(words[i]))), int(np.searchsorted(words, words[i], side="right")))
        rows = order[i:j].tolist()
        out[order[i:j]] = work([a[r] if la[r] <= lb[r] else b[r] for r in rows], [b[r] if la[r] <= lb[r] else a[r] for r in rows])
        i = j
    return out


def _tabled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """places of the distinct texts, each text's row in it, its length, and the letters known."""
    row, distinct = pd.factorize(np.array(texts, object))
    codes, begin, size = _letters(distinct.tolist())
    known = np.unique(codes)
    words = max(1, -(-int(size.max(initial=1)) // 64))
    return _places(codes, begin, size, known, words), row, size[row], known


def _known(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    spot = np.searchsorted(known, codes)
    return np.where((spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == codes), spot, len(known)) if len(known) else np.zeros(len(codes), np.int64)


class Places:
    """Places of the letters of some texts of up to 64, so that pairs with other texts need no strings."""

    def __init__(self, texts: list[str]):
        codes, begin, size = _letters([t if len(t) <= 64 else "" for t in texts])
        self.known = np.unique(codes)
        self.table, self.size = _places(codes, begin, size, self.known, 1), size
        self.usable = np.fromiter(map(len, texts), np.int64, len(texts)) <= 64

    def letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, begin, size = _letters(texts)
        return _known(codes, self.known), begin, size

    def common(self, rows: np.ndarray, letters: tuple[np.ndarray, np.ndarray, np.ndarray], others: np.ndarray) -> np.ndarray:
        """common of each of some of the texts and one of those that letters tells of."""
        codes, begin, size = letters
        return _steps(self.table, rows, self.size[rows], codes, begin[others], size[others])


def common_many(a: Texts, b: Texts) -> np.ndarray:
    """common of each pair."""

    def work(short: list[str], long: list[str]) -> np.ndarray:
        places, row, size, known = _tabled(long)
        if places.size > _ENTRIES and len(short) > 64:
            half = len(short) // 2
            return np.concatenate([work(short[:half], long[:half]), work(short[half:], long[half:])])
        codes, begin, count = _letters(short)
        return _steps(places, row, size, _known(codes, known), begin, count)

    return _chunks(a, b, work)


def _edits(table: np.ndarray, owner: np.ndarray, size: np.ndarray, letters: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Edit distances of texts of up to 64 letters (owner: their row of places, size) and stretches of letters, by bit vectors of rises and falls."""
    order = np.argsort(-count, kind="stable")
    steps, owner, at, size = count[order], owner[order], begin[order], size[order]
    rise, fall, out = np.full(len(order), ~U64(0)), np.zeros(len(order), U64), size.copy()
    last = np.maximum(size - 1, 0).astype(U64)
    one = U64(1)
    for j in range(int(steps[0]) if len(steps) else 0):
        k = int(np.searchsorted(-steps, -j))
        hit, p, m = table[owner[:k], letters[at[:k] + j], 0], rise[:k], fall[:k]
        up = hit | m
        across = (((hit & p) + p) ^ p) | hit
        more, less = m | ~(across | p), p & across
        out[:k] += ((more >> last[:k]) & one).astype(np.int64) - ((less >> last[:k]) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        rise[:k], fall[:k] = less | ~(up | more), more & up
    found = np.zeros(len(order), np.int64)
    found[order] = np.where(size > 0, out, steps)
    return found


def _long_edits(a: str, b: str) -> int:
    """The edit distance of two texts of any length, a row of the table at a time."""
    y, place = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32), np.arange(len(b) + 1)
    row = place.copy()
    for i, x in enumerate(np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32), 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != x))])
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def edits_many(a: Texts, b: Texts) -> np.ndarray:
    """The edit distance of each pair."""

    def work(short: list[str], long: list[str]) -> np.ndarray:
        out = np.zeros(len(short), np.int64)
        fit = np.flatnonzero(_sizes(short) <= 64)
        for r in np.flatnonzero(_sizes(short) > 64).tolist():
            out[r] = _long_edits(short[r], long[r])
        if len(fit):
            x, y = ([t[r] for r in fit.tolist()] for t in (short, long))
            places, row, size, known = _tabled(x)
            codes, begin, count = _letters(y)
            out[fit] = _edits(places, row, size, _known(codes, known), begin, count)
        return out

    return _chunks(a, b, work)


def edit_ratio_many(a: Texts, b: Texts) -> np.ndarray:
    """100 for equal texts, less by the share of the longer one's letters that must be edited; 0 for two empty texts."""
    longest = np.maximum(_sizes(a), _sizes(b))
    return np.where(longest > 0, 100.0 * (1 - edits_many(a, b) / np.maximum(1, longest)), 0.0)


def _sizes(texts: Texts) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _of(common_: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    both = la + lb
    return np.where(both > 0, 200.0 * common_ / np.maximum(both, 1), 100.0)


def ratio_many(a: Texts, b: Texts) -> np.ndarray:
    """ratio of each pair."""
    return _of(common_many(a, b), _sizes(a), _sizes(b))


def _sets(texts: Texts) -> tuple[np.ndarray, list[frozenset[str]], list[str]]:
    """Each text's place among the distinct ones, their words and these sorted in one text."""
    row, distinct = pd.factorize(np.array(texts, object))
    words = [frozenset(t.split()) for t in distinct.tolist()]
    return row, words, [" ".join(sorted(w)) for w in words]


def token_set_many(a: Texts, b: Texts) -> np.ndarray:
    """token_set_ratio of each pair. Common words lead both texts, so only the others' letters are compared."""
    (ra, wa, sa), (rb, wb, sb) = _sets(a), _sets(b)
    left, right, lead = [], [], np.zeros(len(a), np.int64)
    for k, (i, j) in enumerate(zip(ra.tolist(), rb.tolist(), strict=True)):
        if wa[i].isdisjoint(wb[j]):
            left.append(sa[i])
            right.append(sb[j])
        else:
            lead[k] = len(" ".join(wa[i] & wb[j]))
            left.append(" ".join(sorted(wa[i] - wb[j])))
            right.append(" ".join(sorted(wb[j] - wa[i])))
    la, lb = _sizes(left), _sizes(right)
    met = common_many(left, right)
    shared = lead > 0
    met += lead + (shared & (la > 0) & (lb > 0))
    la, lb = (lead + n + (shared & (n > 0)) for n in (la, lb))
    out = np.maximum(_of(met, la, lb), np.where(shared, np.maximum(_of(lead, lead, la), _of(lead, lead, lb)), 0.0))
    return np.where((la > 0) & (lb > 0), out, 0.0)


def _one_way(short: list[str], long: list[str], met: np.ndarray) -> np.ndarray:
    """The best ratio of each short text to a window of its long one; met: their common letters, which no window exceeds.

    Windows cut off by the long text's ends are its first and last letters, found in one pass each; two windows a place
    apart differ by one at most, so every fourth of the others is tried first, and those beside it where it may matter.
    """
    n, m = _sizes(short), _sizes(long)
    best = np.zeros(len(short))
    for way in (1, -1):
        texts, others = ([t[::way] for t in x] for x in (short, long))
        places, row, size, known = _tabled(texts)
        codes, begin, _ = _letters(others)

        def seen(taken: int, pairs: np.ndarray, found: np.ndarray) -> None:
            best[pairs] = np.maximum(best[pairs], 200.0 * found / (n[pairs] + taken))

        _steps(places, row, size, _known(codes, known), begin, np.minimum(n, m), seen)
    places, row, size, known = _tabled(short)
    codes, begin, _ = _letters(long)
    codes = _known(codes, known)

    def windows(pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = np.zeros(len(pairs), np.int64)
        for i in range(0, len(pairs), 1 << 16):
            p, x = pairs[i : i + (1 << 16)], at[i : i + (1 << 16)]
            found[i : i + (1 << 16)] = _steps(places, row[p], size[p], codes, begin[p] + x, n[p])
        np.maximum.at(best, pairs, 100.0 * found / n[pairs])
        return found

    open_ = np.flatnonzero((m > n) & (100.0 * np.minimum(met, n) > best * n))
    count = (m - n + 3)[open_] // 4  # windows 1, 5, 9, ... of the whole ones
    pairs = np.repeat(open_, count)
    at = np.minimum(1 + 4 * (np.arange(len(pairs)) - np.repeat(np.cumsum(count) - count, count)), (m - n)[pairs])
    found = windows(pairs, at)
    near = np.flatnonzero(100.0 * np.minimum(found + 2, met[pairs]) > best[pairs] * n[pairs])
    beside = (np.repeat(pairs[near], 4), (at[near][:, None] + np.array([-1, 1, 2, -2])).ravel())
    inside = (beside[1] >= 0) & (beside[1] <= (m - n)[beside[0]])
    windows(beside[0][inside], beside[1][inside])
    return best


def partial_many(a: Texts, b: Texts, least: np.ndarray | None = None, met: np.ndarray | None = None) -> np.ndarray:
    """partial_ratio of each pair; where it cannot reach `least`, a number below that will do. met: common_many of the pairs, if known."""
    met = common_many(a, b) if met is None else met
    la, lb = _sizes(a), _sizes(b)
    n, out = np.minimum(la, lb), np.zeros(len(a))
    top = 200.0 * met / np.maximum(1, n + met)  # a window of just the common letters
    rows = np.flatnonzero((met > 0) & ((top >= least) if least is not None else True))
    inside = np.array([met[r] == n[r] and (a[r] in b[r] or b[r] in a[r]) for r in rows.tolist()], bool)
    out[rows[inside]] = 100.0
    rows = rows[~inside]
    if not len(rows):
        return out
    done = np.zeros(len(rows))
    place = {r: k for k, r in enumerate(rows.tolist())}
    for turn in (False, True):  # of texts of one length, each is the window's side once
        some = rows[la[rows] == lb[rows]] if turn else rows
        if not len(some):
            continue
        short = [(b[r] if turn or la[r] > lb[r] else a[r]) for r in some.tolist()]
        long = [(a[r] if turn or la[r] > lb[r] else b[r]) for r in some.tolist()]
        words = (_sizes(short) + 63) // 64
        for w in np.unique(words).tolist():
            chosen = np.flatnonzero(words == w)
            step = max(1, _PAIRS // (2 * w))
            for i in range(0, len(chosen), step):
                part = chosen[i : i + step].tolist()
                got = _one_way([short[k] for k in part], [long[k] for k in part], met[some[part]])
                into = [place[int(some[k])] for k in part]
                done[into] = np.maximum(done[into], got)
    out[rows] = done
    return out


def weighted_many(a: Texts, b: Texts, least: np.ndarray | None = None) -> np.ndarray:
    """weighted_ratio of each pair; where it cannot reach `least`, a number below that will do."""
    la, lb = _sizes(a), _sizes(b)
    some = (la > 0) & (lb > 0)
    met = common_many(a, b)
    best = np.where(some, _of(met, la, lb), 0.0)
    longer = np.maximum(la, lb) / np.maximum(1, np.minimum(la, lb))
    rows = np.flatnonzero(some & (longer < 1.5))
    pick = lambda texts, rows: [texts[r] for r in rows.tolist()]
    if len(rows):
        x, y = pick(a, rows), pick(b, rows)
        words = ratio_many([_words(t) for t in x], [_words(t) for t in y])
        best[rows] = np.maximum(best[rows], 0.95 * np.maximum(words, token_set_many(x, y)))
    rows = np.flatnonzero(some & (longer >= 1.5))
    if len(rows):
        x, y = pick(a, rows), pick(b, rows)
        scale = np.where(longer[rows] <= 8, 0.9, 0.6)
        need = None if least is None else np.maximum(least[rows], best[rows])
        of = lambda share: None if need is None else need / (scale * share)
        (ra, wa, sa), (rb, wb, sb) = _sets(x), _sets(y)
        shared = np.array([not wa[i].isdisjoint(wb[j]) for i, j in zip(ra.tolist(), rb.tolist(), strict=True)], bool)
        run = scale * partial_many(x, y, of(1.0), met[rows])
        words = partial_many([_words(t) for t in x], [_words(t) for t in y], of(0.95))
        sets = np.where(shared, 100.0, 0.0)
        apart = np.flatnonzero(~shared)
        if len(apart):
            need_apart = of(0.95)
            sets[apart] = partial_many([sa[i] for i in ra[apart].tolist()], [sb[j] for j in rb[apart].tolist()], None if need_apart is None else need_apart[apart])
        best[rows] = np.maximum(best[rows], np.maximum(run, 0.95 * scale * np.maximum(sets, words)))
    return best


def rounded(x: np.ndarray) -> np.ndarray:
    """To four decimals, half up."""
    return np.floor(x * 1e4 + 0.5) / 1e4


def name_many(a: Texts, b: Texts, least: np.ndarray | None = None) -> np.ndarray:
    """By common words, or 55 parts of that and 45 of the common run, whichever is more; below `least` a lower number will do."""
    t = rounded(token_set_many(a, b))
    need = t if least is None else np.maximum(t, (least - 0.55 * t) / 0.45)
    return np.maximum(t, 0.55 * t + 0.45 * rounded(partial_many(a, b, np.minimum(need, 100.0) - 1e-3)))


@dataclass(frozen=True)
class Pairs:
    """What is known of many pairs before they are compared in full: arrays of one shape, or that broadcast.

    whole, sets and sorts: how long a common subsequence of the texts, of their distinct words in order, and of all their
    words in order can be; a, b: lengths of the texts; u, v: of their distinct words in one text; lead: how long the words
    that both have can be, 0 if they share none.
    """

    whole: np.ndarray
    sets: np.ndarray
    sorts: np.ndarray
    a: np.ndarray
    b: np.ndarray
    u: np.ndarray
    v: np.ndarray
    lead: np.ndarray


def _window(common_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No window shares more letters with the shorter text than the texts do, nor is its ratio more than that of those alone."""
    n = np.minimum(a, b)
    c = np.minimum(common_, n)
    return 200.0 * c / np.maximum(1, n + c)


def _share(common_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 200.0 * np.minimum(common_, np.minimum(a, b)) / np.maximum(1, a + b)


def _edit_top(p: Pairs) -> np.ndarray:
    """Letters of the longer text that are not in common, in this order, must be edited."""
    return 100.0 * np.minimum(p.whole, np.minimum(p.a, p.b)) / np.maximum(1, np.maximum(p.a, p.b))


def _set_top(p: Pairs) -> np.ndarray:
    return np.maximum(_share(p.sets, p.u, p.v), _window(p.lead, p.u, p.v))


def _name_top(p: Pairs) -> np.ndarray:
    t = _set_top(p)
    return np.maximum(t, 0.55 * t + 0.45 * _window(p.whole, p.a, p.b))


def _weighted_top(p: Pairs) -> np.ndarray:
    longer = np.maximum(p.a, p.b) >= 1.5 * np.minimum(p.a, p.b)
    words = 0.95 * np.maximum(_set_top(p), 200.0 * p.sorts / np.maximum(1, p.u + p.v))
    run = np.maximum(0.9 * _window(p.whole, p.a, p.b), np.where(p.lead > 0, 85.5, 0.855 * _window(np.maximum(p.sets, p.sorts), p.u, p.v)))
    return np.maximum(_share(p.whole, p.a, p.b), np.minimum(np.where(longer, run, words), 100.0))


@dataclass(frozen=True)
class Score:
    """A score of two text columns, of many pairs at once, and what it can be at most."""

    many: Callable[[Texts, Texts, np.ndarray | None], np.ndarray]
    top: Callable[[Pairs], np.ndarray]

    def __call__(self, a: Column, b: Column) -> Column:
        many = self.many

        @F.pandas_udf(DoubleType())
        def score(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(rounded(many(x.fillna("").tolist(), y.fillna("").tolist(), None)), dtype="float64")

        return score(a, b)


edits = Score(lambda a, b, least: edit_ratio_many(a, b), _edit_top)
token_set = Score(lambda a, b, least: token_set_many(a, b), _set_top)
partial = Score(partial_many, lambda p: _window(p.whole, p.a, p.b))
weighted = Score(weighted_many, _weighted_top)
name_score = Score(name_many, _name_top)


# How well lines fit


def _parts(texts: list[str]) -> list[list[str]]:
    """The words of three letters or more of texts that are label keys (text.tokens)."""
    return [[w for w in re.split(r"[ \t\n\x0b\f\r/\-]+", t) if len(w) >= 3] for t in texts]


def fit_many(code: Texts, words: Texts, seen: Texts, name: Texts) -> np.ndarray:
    """purchase.line_fit of each pair without quantities; all are label keys, seen is the description read as letters."""
    first, second = rounded(token_set_many(words, name)), rounded(token_set_many(seen, name))
    best = np.where(first >= 80, first, second)
    rows = np.flatnonzero(best < 80)
    pick = lambda texts: [texts[r] for r in rows.tolist()]
    d, s, n = pick(words), pick(seen), pick(name)
    holds = [any(a in b or b in a for a in x for b in y) for x, y in zip(_parts(s), _parts(n), strict=True)]
    best[rows] = np.maximum.reduce([first[rows], second[rows], np.where(np.array(holds, bool), 75.0, 0.0), rounded(partial_many(d, n)), rounded(partial_many(s, n))])
    for r, (k, d_, n_) in enumerate(zip(code, words, name, strict=True)):
        if not n_:
            best[r] = 0.0
        elif k not in NO_CODE and (k in n_ or n_ in k):
            best[r] = 100.0 if k == n_ else 92.0
        elif not d_:
            best[r] = 0.0
    return best


#: Fixed value: what stands for no code.
NO_CODE = ("", "1", "NO DISPONIBLE", "NONE", "NULL")
#: Pairs of a line and a name that are looked up at once, and scores that a worker keeps.
_AT_ONCE, _KEPT = 1 << 20, 1 << 18
_fits: dict[tuple[str, str, str, str], float] = {}


def _best_fits(lines: pa.Array, names: pa.Array) -> pa.Array:
    """For each row's lines (code, words, seen) the score of the best of the row's names; a pair is scored once a batch, or once a worker."""
    asked, offered = lines.flatten(), names.flatten()
    counts, sizes = (np.asarray(x.value_lengths(), np.int64) for x in (lines, names))
    ids, texts = zip(*((np.asarray(e.indices), e.dictionary.to_pylist()) for e in (asked.field(f).dictionary_encode() for f in ("code", "words", "seen"))), strict=True)
    keys, line = np.unique(np.stack(ids, 1), axis=0, return_inverse=True)
    of_name = offered.dictionary_encode()
    name, spelt = np.asarray(of_name.indices), of_name.dictionary.to_pylist()
    begin, size = (np.repeat(x, counts) for x in (np.cumsum(sizes) - sizes, sizes))
    best, ends, i = np.zeros(len(asked)), np.cumsum(size), 0
    while i < len(asked):
        done = ends[i] - size[i]
        j = max(i + 1, int(np.searchsorted(ends, done + _AT_ONCE, side="right")))
        at = ends[i:j] - size[i:j] - done
        each = np.repeat(begin[i:j] - at, size[i:j]) + np.arange(ends[j - 1] - done)
        pairs, back = np.unique(np.repeat(line.reshape(-1)[i:j], size[i:j]).astype(np.int64) * len(spelt) + name[each], return_inverse=True)
        full = [(*(t[k] for t, k in zip(texts, keys[p // len(spelt)].tolist(), strict=True)), spelt[p % len(spelt)]) for p in pairs.tolist()]
        found = {p: _fits[p] for p in full if p in _fits}
        new = [p for p in full if p not in found]
        if new:
            found |= zip(new, fit_many(*zip(*new, strict=True)).tolist(), strict=True)
            if len(_fits) + len(new) > _KEPT:
                _fits.clear()
            _fits.update((p, found[p]) for p in new[:_KEPT])
        best[i:j] = np.maximum.reduceat(np.array([found[p] for p in full])[back.reshape(-1)], at)
        i = j
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(best))


def fit(code: Column, words: Column, seen: Column, name: Column) -> Column:
    """fit_many of columns."""

    @F.pandas_udf(DoubleType())
    def score(k: pd.Series, d: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(fit_many(*(x.tolist() for x in (k, d, s, n))), dtype="float64")

    return score(code, words, seen, name)


def best_fits(lines: Column, names: Column) -> Column:
    """The best fit of each of a row's lines (structs of code, words and seen) among the row's names, of which there must be one at least."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def best(x: pa.Array, y: pa.Array) -> pa.Array:
        return _best_fits(x, y)

    return best(lines, names)
