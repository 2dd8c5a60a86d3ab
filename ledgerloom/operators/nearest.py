"""The best match of each name in a registry of any size, under scores by words, runs of letters or both.

Such a score says nothing about any single gram that two names must share, but much about their letters: two texts of a
and b letters that reach a ratio of s have at least s (a + b) / 200 letters in common, each counted as often as both have
it, and a run of letters needs its share of the shorter text's. So each text has a row of an index: a mark for its
first, second, third and fourth A, B, ..., the number of letters beyond these, its lengths and a sketch of its words.
A matrix product of two such indexes gives the common letters of all pairs of two blocks, a score's bound follows, and
pairs are taken in the order of their bounds until none that is left can win. Of a pair whose turn comes, the common
subsequences bound the score once more; only what passes is compared in full.

Names and registry are cut into blocks of bounded size, and each pair of blocks is a task's work of its own. A first
round compares each name with the most promising one of every block; what it finds bounds the second round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similar import Pairs, Places, Score, rounded
from ..sources.files import cut

#: Names of a block of each side, and pairs whose bounds are held at once.
QUERIES, NAMES, TILE = 8_192, 16_384, (512, 4_096)
#: Pairs compared at once, and pairs that wait for that at most.
STEP, WAITING = 1 << 13, 1 << 21
_BINS, _TIMES, _WORDS = 64, 4, 12
#: Bounds are single precision; pairs whose bound lies this much below what is needed are compared too.
_SLACK = 0.01


class Index:
    """Counted letters (marks, and how many lie beyond them), lengths and words of some texts.

    sets: their distinct words in order; once: whether no word comes twice, so that these are all words in order.
    """

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        letter = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % _BINS
        owner = np.repeat(np.arange(len(texts)), size)
        count = np.bincount(owner * _BINS + letter, minlength=len(texts) * _BINS).reshape(len(texts), _BINS)
        self.count = np.minimum(count, 255).astype(np.uint8)
        self.marks = np.concatenate([count >= k for k in range(1, _TIMES + 1)], axis=1)
        self.beyond = np.maximum(count - _TIMES, 0).sum(1).astype(np.float32)
        self.size = size.astype(np.float32)
        listed = [t.split() for t in texts]
        words = [set(w) for w in listed]
        self.texts, self.sets = texts, [" ".join(sorted(w)) for w in words]
        self.once = np.array([len(w) == len(x) for w, x in zip(words, listed, strict=True)], bool)
        self.words = np.fromiter(map(len, self.sets), np.float32, len(texts))
        # A text's words as numbers, and their lengths; texts of more words than that have a row of zeros.
        self.few = np.array([len(w) <= _WORDS for w in words], bool)
        self.numbers, self.lengths = np.zeros((len(texts), _WORDS), np.int64), np.zeros((len(texts), _WORDS), np.int64)
        for k, w in enumerate(words):
            if self.few[k] and w:
                self.numbers[k, : len(w)] = [hash(x) | 1 for x in w]
                self.lengths[k, : len(w)] = [len(x) for x in w]
        self.sketch = np.bitwise_or.reduce(np.where(self.lengths > 0, np.int64(1) << (self.numbers >> 1) % 63, 0), axis=1)
        self.sketch[~self.few] = -1


def tops(score: Score, q: Index, r: Index, rows: slice, columns: slice) -> np.ndarray:
    """What the score of each pair of some texts of q and some of r can be at most."""
    a, b = q.marks[rows], r.marks[columns]
    live = np.flatnonzero(a.any(0) & b.any(0))
    overlap = a[:, live].astype(np.float32) @ b[:, live].astype(np.float32).T
    overlap += np.minimum(q.beyond[rows, None], r.beyond[None, columns])
    lead = np.where((q.sketch[rows, None] & r.sketch[None, columns]) != 0, overlap, np.float32(0))
    return score.top(Pairs(overlap, overlap, overlap, q.size[rows, None], r.size[None, columns], q.words[rows, None], r.words[None, columns], lead))


class Search:
    """The best of some names so far: score, then smaller id."""

    def __init__(self, score: Score, q: Index, r: Index, ids: np.ndarray, least: np.ndarray):
        names, targets = q.texts, r.texts
        self.score, self.names, self.targets, self.ids, self.q, self.r = score, names, targets, ids, q, r
        self.whole, self.sets = Places(names), Places(q.sets)
        self.letters = self.whole.letters(targets), self.sets.letters(r.sets)
        self.least, self.best, self.found = least, np.full(len(names), -1.0), np.full(len(names), -1)

    def closer(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bounds of pairs by what both have in order: of the whole texts, of their common words, and of words if none is common."""
        q, r = self.q, self.r
        letters = np.minimum(q.count[a], r.count[b]).sum(1, dtype=np.int64)
        letters[(q.size[a] > 255) | (r.size[b] > 255)] = 1 << 40
        both = (q.numbers[a][:, :, None] == r.numbers[b][:, None, :]).any(2) & (q.lengths[a] > 0)
        lead = np.where(q.few[a] & r.few[b], (q.lengths[a] * both).sum(1) + np.maximum(0, both.sum(1) - 1), letters)
        fit = self.whole.usable[a] & (r.size[b] <= 4 * 64)
        whole, sets = letters.copy(), letters.copy()
        rows = np.flatnonzero(fit)
        whole[rows] = self.whole.common(a[rows], self.letters[0], b[rows])
        rows = np.flatnonzero(fit & (lead == 0))
        sets[rows] = self.sets.common(a[rows], self.letters[1], b[rows])
        sorts = np.where(q.once[a] & r.once[b] & (lead == 0), sets, letters)
        return self.score.top(Pairs(whole, sets, sorts, q.size[a], r.size[b], q.words[a], r.words[b], lead))

    def compare(self, q: np.ndarray, r: np.ndarray, top: np.ndarray) -> None:
        """Compares the pairs in order of their bounds, those that may still win."""
        order = np.argsort(-top, kind="stable")
        for i in range(0, len(order), STEP):
            part = order[i : i + STEP]
            part = part[top[part] >= self.least[q[part]] - _SLACK]
            part = part[self.closer(q[part], r[part]) >= self.least[q[part]] - _SLACK]
            if not len(part):
                continue
            a, b = q[part], r[part]
            got = rounded(self.score.many([self.names[k] for k in a.tolist()], [self.targets[k] for k in b.tolist()], self.least[a] - _SLACK))
            by = np.lexsort((self.ids[b], -got, a))
            head = by[np.concatenate([[True], a[by][1:] != a[by][:-1]])]
            a, b, got = a[head], b[head], got[head]
            held = self.found[a]
            wins = (got >= self.least[a]) & ((got > self.best[a]) | ((got == self.best[a]) & (self.ids[b] < self.ids[np.maximum(held, 0)])))
            self.best[a[wins]], self.found[a[wins]] = got[wins], b[wins]
            self.least[a[wins]] = got[wins]


def searched(score: Score, names: list[str], least: np.ndarray, targets: list[str], ids: np.ndarray, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each name among the targets and its place, -1 where none reaches what is needed.

    With first_only each name is compared with one target alone, that of the highest bound.
    """
    q, r = Index(names), Index(targets)
    s = Search(score, q, r, ids, least.copy())
    tiles = [(slice(i, i + TILE[0]), slice(j, j + TILE[1])) for i in range(0, len(names), TILE[0]) for j in range(0, len(targets), TILE[1])]
    most, where = np.full(len(names), -1.0), np.zeros(len(names), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def compare() -> None:
        if kept:
            s.compare(*(np.concatenate(c) for c in zip(*kept, strict=True)))
            kept.clear()

    for rows, columns in tiles:
        top = tops(score, q, r, rows, columns)
        if first_only:
            at = top.argmax(1)
            value = top[np.arange(len(top)), at]
            better = value > most[rows]
            most[rows] = np.where(better, value, most[rows])
            where[rows] = np.where(better, at + columns.start, where[rows])
            continue
        a, b = np.nonzero(top >= s.least[rows, None] - _SLACK)
        if len(a):
            kept.append((a + rows.start, b + columns.start, top[a, b]))
            waiting += len(a)
        if waiting > WAITING:
            compare()
            waiting = 0
    if first_only:
        kept.append((np.arange(len(names)), where, most))
    compare()
    return s.best, s.found


def best_names(names: DataFrame, targets: DataFrame, score: Score, threshold: float) -> DataFrame:
    """q, id, score: of each q the target with the highest score (ties: the smallest id), if the threshold is reached.

    names: q, distinct; targets: r, distinct, and id. Work is a few dozen nanoseconds for each pair of a name and a
    target, and a comparison for those whose bound reaches the best score found.
    """
    names, targets = cut(names.select("q")), cut(targets.select("r", F.col("id").cast("long").alias("id")))
    blocks = [max(1, -(-df.count() // size)) for df, size in ((names, QUERIES), (targets, NAMES))]

    def cells(asked: DataFrame) -> DataFrame:
        """qb, rb and the rows of both blocks: a text and what is needed, or a text and its id."""
        every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
        a = asked.select(F.pmod(F.xxhash64("q"), F.lit(blocks[0])).cast("int").alias("qb"), every[1].alias("rb"), F.col("q").alias("t"), F.col("least"), F.lit(None).cast("long").alias("id"))
        b = targets.select(every[0].alias("qb"), F.pmod(F.xxhash64("r"), F.lit(blocks[1])).cast("int").alias("rb"), F.col("r").alias("t"), F.lit(None).cast("double").alias("least"), "id")
        return a.unionByName(b)

    def work(first_only: bool):
        def run(table: pa.Table) -> pa.Table:
            ids = table.column("id").to_pandas()
            known = ids.notna().to_numpy()
            texts = np.array(table.column("t").to_pylist(), object)
            least = table.column("least").to_pandas().to_numpy(float, na_value=np.nan)[~known]
            asked, offered = texts[~known].tolist(), texts[known].tolist()
            numbers = table.column("id").drop_null().to_numpy()
            best, found = searched(score, asked, least, offered, numbers, first_only) if asked and offered else (np.zeros(0), np.zeros(0, np.int64))
            hit = np.flatnonzero(found >= 0)
            return pa.table({"q": pa.array([asked[k] for k in hit.tolist()], pa.string()), "id": pa.array(numbers[found[hit]] if len(hit) else [], pa.int64()), "score": pa.array(best[hit], pa.float64())})

        return run

    asked = names.withColumn("least", F.lit(float(threshold)))
    if blocks[1] > 1:
        seeds = cells(asked).groupBy("qb", "rb").applyInArrow(work(True), "q string, id long, score double").groupBy("q").agg(F.max("score").alias("seed"))
        asked = cut(asked.join(seeds, "q", "left").select("q", F.coalesce("seed", "least").alias("least")))
    found = cells(asked).groupBy("qb", "rb").applyInArrow(work(False), "q string, id long, score double")
    best = found.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("q", "b.id", (-F.col("b.s")).alias("score"))
