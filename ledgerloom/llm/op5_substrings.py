"""Repeated substrings by bucket-pointer refinement over sampled suffixes.

Every byte covered by a SPAN-byte string that also starts elsewhere goes. Of all suffixes, only anchors are sorted:
in each SPAN-byte window the GRAM-byte strings with the smallest hash. Equal windows have equal anchors at equal
places, so it is enough to compare suffixes within an anchor's bucket, together with what precedes them.

Initial buckets are the GRAM-byte strings at the anchors; single ones leave. Strings that fill more than a HOT-th of
all anchors are known to repeat and skip that test, so that no task gets all places of one string. Within a bucket, anchors with equal
surroundings (LEFT bytes before, SPAN after) form a class; a class of two or more repeats as a whole. Where a bucket
has several classes, one text of each is fetched and refined: positions start in buckets of 25 bytes, are sorted by
their own bucket and the bucket 25, 50 and 100 bytes on, and the pointers of each round serve the next, until
buckets mean 200 bytes. A window whose bucket has two classes repeats. Buckets of more than BUCKET classes are
first split by what the windows of each of some ranges have in common; parts that are still too large are refined
window by window in a grouped aggregation, so that no task holds one.

A bucket is named by one hash of its bytes and a class by that and a second, independent one over the surroundings,
128 bits together, as is a window of a split bucket. Refinement compares bytes: its first pointers are hashes that are
checked against the bytes they stand for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, HOT_LEAST, gram_hashes, loads, materialize, mix, span_hashes, spread_join, text_bytes, text_slices

SPAN, GRAM = 200, 64
LEFT = SPAN - GRAM
STEPS = (25, 50, 100)
BUCKET = 512
#: Windows in a range, where a large bucket is split.
RANGE = 17
#: Surroundings that a task refines at once.
TOGETHER = 512
#: Anchors of a task that are counted at once, and parts that the places of a hot string are dealt to.
COUNTED, SPREAD = 1 << 22, 1024


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The minimum or maximum of each `width` neighbours."""
    best, have = (np.minimum if least else np.maximum), 1
    while have * 2 <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of some documents."""
    windows = LEFT + 1
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(data, GRAM)
    inside = np.zeros(n + 1, np.int32)  # how many documents a window may start in: 1 or 0
    long = np.flatnonzero(np.diff(at) >= SPAN)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - SPAN + 1, -1)
    valid = np.cumsum(inside)[: n - SPAN + 1] > 0
    low = np.where(valid, _slide(grams, windows, True), np.uint64(0))
    padded = np.zeros(len(grams) + LEFT, np.uint64)
    padded[LEFT : LEFT + len(low)] = low
    high = _slide(padded, windows, False)  # for a gram: the largest minimum of the windows around it
    chosen = np.flatnonzero((high == grams) & (high > 0))
    return chosen, grams[chosen]


def keyed(docs: DataFrame) -> DataFrame:
    """k (names the row: hash of id and text), doc_id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def hot_grams(docs: DataFrame) -> np.ndarray:
    """The sorted hashes of the strings that more than one in HOT anchors have, so HOT of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def counted() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            often = n > 2
            return pa.RecordBatch.from_arrays([pa.array([None, *names[often].view(np.int64).tolist()], pa.int64()), pa.array([waiting, *n[often].tolist()], pa.int64())], ["h", "n"])

        for _, data, at in text_slices(batches):
            held.append(anchors(data, at)[1])
            waiting += len(held[-1])
            if waiting >= COUNTED:
                yield counted()
                held, waiting = [], 0
        yield counted()

    seen = materialize(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = seen.where("h is null").agg(F.max("n")).first()[0] or 0
    return np.array(sorted(r["h"] for r in seen.where(F.col("h").isNotNull() & (F.col("n") > max(HOT_LEAST, total // HOT))).collect()), np.int64)


def anchor_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(h, c, k, p, s) of each anchor: bucket, class, row, then place, bytes before and bytes after in one number, and the part of a hot string's places (0 if it is not hot)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, data, at in text_slices(batches):
            place, h = anchors(data, at)
            doc = np.searchsorted(at, place, side="right") - 1
            left = np.minimum(place - at[doc], LEFT)
            right = np.minimum(at[doc + 1] - place, SPAN)
            c = mix(span_hashes(data, place - left, place + right, 1) ^ left.astype(np.uint64))
            p = ((place - at[doc]) << 16) | (left << 8) | right
            bucket = h.view(np.int64)
            part = np.zeros(len(h), np.int64)
            if len(known):
                often = known[np.minimum(np.searchsorted(known, bucket), len(known) - 1)] == bucket
                part[often] = 1 + (mix(doc[often].astype(np.uint64) ^ mix(p[often].astype(np.uint64))) % np.uint64(SPREAD)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(c.view(np.int64)), rows.column("k").take(pa.array(doc)), pa.array(p), pa.array(part)], ["h", "c", "k", "p", "s"])

    return keyed(docs).select("k", "text").mapInArrow(run, "h long, c long, k long, p long, s long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by s and h without those whose h comes once and is not hot (s is 0); holds a batch."""
    waiting, running = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        h, hot = rows.column("h").to_numpy(), rows.column("s").to_numpy() > 0
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        keep = np.repeat(size > 1, size) | hot
        if running is not None:
            keep |= h == running
        if keep[-1]:
            waiting, running = None, h[-1]
        else:
            waiting, running = rows.slice(len(h) - 1, 1), None
        yield rows.filter(pa.array(keep)).select(["h", "c", "k", "p"])


_PARTS = {"place": "shiftright(p, 16)", "left": "shiftright(p, 8) & 255", "right": "p & 255"}


def surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, left, bytes, big) around the places that wanted (k, met: h, c, p, big) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_slices(batches):
            met = batch.column("met")
            owner = np.repeat(np.arange(batch.num_rows), met.value_lengths().to_numpy())
            flat = met.flatten()
            p = flat.field(2).to_numpy()
            place, left, right = at[owner] + (p >> 16), (p >> 8) & 255, p & 255
            for i in range(0, len(p), 20_000):
                cut = [data[a:b].tobytes() for a, b in zip((place - left)[i : i + 20_000].tolist(), (place + right)[i : i + 20_000].tolist(), strict=True)]
                part = flat.slice(i, 20_000)
                yield pa.RecordBatch.from_arrays([part.field(0), part.field(1), pa.array(left[i : i + 20_000]), pa.array(cut, pa.binary()), part.field(3)], ["h", "c", "left", "bytes", "big"])

    return keyed(docs).join(wanted, "k").select("text", "met").mapInArrow(run, "h long, c long, left long, bytes binary, big boolean")


def _numbers(keys: np.ndarray, top: int) -> np.ndarray:
    """A number from 0 on for each key, in the order of keys, which are below top; key and place are sorted as one number where they fit."""
    bits = max(1, (len(keys) - 1).bit_length())
    if int(top - 1).bit_length() + bits > 64:
        return np.unique(keys, return_inverse=True)[1].astype(np.int64)
    order = np.sort((keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64))
    place = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
    order >>= np.uint64(bits)
    out = np.zeros(len(keys), np.int64)
    out[place[1:]] = np.cumsum(order[1:] != order[:-1])
    return out


def _first_pointers(data: np.ndarray) -> np.ndarray:
    """A number for the STEPS[0] bytes from each place on, the same for the same bytes only."""
    n = len(data) - STEPS[0] + 1
    pointer = np.unique(gram_hashes(data, STEPS[0]), return_inverse=True)[1].astype(np.int64)
    one = np.zeros(n, np.int64)
    one[pointer] = np.arange(n)  # some place of each pointer
    one, words = one[pointer], np.ascontiguousarray(loads(data))
    for k in (*range(0, STEPS[0] - 8, 8), STEPS[0] - 8):
        if (words[k : n + k] != words[one + k]).any():  # two strings share a hash
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, STEPS[0]))
            return np.unique(windows.view(f"V{STEPS[0]}")[:, 0], return_inverse=True)[1].astype(np.int64)
    return pointer


def refine(data: np.ndarray, size: np.ndarray, left: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding, how many bytes before and after its anchor repeat; (-1, -1) if no window does."""
    begin = np.cumsum(size) - size
    lo, hi = np.full(len(size), -1, np.int64), np.full(len(size), -1, np.int64)
    windows = np.maximum(0, size - SPAN + 1)
    owner = np.repeat(np.arange(len(size)), windows)
    if not len(owner):
        return lo, hi
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    pointer = _first_pointers(data)
    top = len(data)
    for step in STEPS[:-1]:
        pointer = _numbers(pointer[:-step] * top + pointer[step:], top * top)
    start = begin[owner] + shift
    halves = _numbers(pointer[start] * top + pointer[start + STEPS[-1]], top * top)
    before = left[owner] - shift  # windows repeat at equal places before anchors of one bucket
    place = bucket[owner] * (LEFT + 1) + before
    found = _numbers(place * len(owner) + halves, (int(place.max()) + 1) * len(owner))
    hit = np.flatnonzero(np.bincount(found)[found] > 1)
    if len(hit):  # the rows of one surrounding lie together, the window farthest back first
        row = owner[hit]
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lo[row[edge]] = np.maximum.reduceat(before[hit], edge)
        hi[row[edge]] = SPAN - np.minimum.reduceat(before[hit], edge)
    return lo, hi


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> (h, c, lo, hi); holds a batch, the rest of a bucket, and refines about TOGETHER rows at once."""
    numbers = ("bucket", "h", "c", "left")

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        bucket, h, c, left = (rows.column(n).to_numpy() for n in numbers)
        data, at = text_bytes(rows.column("bytes"))
        lo, hi = refine(data, np.diff(at), left, np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])))
        found = np.flatnonzero(lo >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (h, c, lo, hi)], ["h", "c", "lo", "hi"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        bucket = rows.column("bucket").to_numpy()
        edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1  # the last bucket may go on
        done = 0
        while len(edges) and edges[-1] > done:
            stop = int(edges[min(np.searchsorted(edges, done + TOGETHER), len(edges) - 1)])
            yield solve(rows.slice(done, stop - done))
            done = stop
        rest = rows.slice(done)
    if rest is not None:
        yield solve(rest)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, h, c, left, bytes): surroundings cut to each range of windows; bucket names h and what the range has in common."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts, left = part.column("bytes").to_pylist(), part.column("left").to_numpy()
            size = np.array([len(t) for t in texts], np.int64)
            begin = np.cumsum(size) - size
            data = np.frombuffer(b"".join(texts), np.uint8)
            for low in range(0, LEFT + 1, RANGE):
                high = min(low + RANGE - 1, LEFT)
                has = np.flatnonzero((left >= low) & (size - left >= SPAN - high))
                anchor = begin[has] + left[has]
                core = span_hashes(data, anchor - low, anchor - high + SPAN, 1)
                bucket = mix(core ^ part.column("h").to_numpy()[has].view(np.uint64) ^ mix(np.array([low], np.uint64)))
                before = np.minimum(left[has], high)
                end = np.minimum(anchor - low + SPAN, begin[has] + size[has])
                cut = [data[a:b].tobytes() for a, b in zip((anchor - before).tolist(), end.tolist(), strict=True)]
                take = pa.array(has)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), part.column("h").take(take), part.column("c").take(take), pa.array(before), pa.array(cut, pa.binary())], ["bucket", "h", "c", "left", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, h, c, before, w): the hash of each window."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = part.column("bytes").to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            windows = np.maximum(0, size - SPAN + 1)
            owner = np.repeat(np.arange(len(texts)), windows)
            shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            hashes = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), SPAN)[(np.cumsum(size) - size)[owner] + shift] if len(owner) else np.zeros(0, np.uint64)
            spread = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*(part.column(n).take(spread) for n in ("bucket", "h", "c")), pa.array(part.column("left").to_numpy()[owner] - shift), pa.array(hashes.view(np.int64))], ["bucket", "h", "c", "before", "w"])


def covered(docs: DataFrame) -> DataFrame:
    """(k, runs): for each row with repeats, the set of (s, e) byte ranges to remove, overlapping ones included."""
    rows = anchor_rows(docs, hot_grams(docs)).repartition("h", "s").sortWithinPartitions("s", "h")
    repeated = materialize(rows.mapInArrow(_repeated, "h long, c long, k long, p long"))
    classes = repeated.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "p")).alias("eg")).select("h", "c", "n", "eg.k", "eg.p")
    classes = materialize(classes)
    several = classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    mixed = spread_join(classes, several.withColumn("size", F.col("m")), ["h"], classes.count(), "inner").withColumn("big", F.col("m") > BUCKET)
    wanted = mixed.groupBy("k").agg(F.collect_set(F.struct("h", "c", "p", "big")).alias("met"))  # as many as the text has anchors
    around = materialize(surroundings(docs, wanted))
    kind = "h long, c long, lo long, hi long"
    row = "bucket long, h long, c long, left long, bytes binary"
    plain = around.where("not big").select(F.col("h").alias("bucket"), "h", "c", "left", "bytes")
    split = around.where("big").select("h", "c", "left", "bytes").mapInArrow(_ranges, row)
    sizes = split.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    split = materialize(split.join(sizes, "bucket"))
    together = plain.unionByName(split.where(F.col("n") <= BUCKET).drop("n"))
    small = together.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refined, kind)
    each = split.where(F.col("n") > BUCKET).drop("n").mapInArrow(_windows, "bucket long, h long, c long, before long, w long")
    twice = each.groupBy("bucket", "before", "w").agg(F.count("*").alias("size")).where("size > 1")
    windows = RANGE * split.where(F.col("n") > BUCKET).count()
    large = spread_join(each, twice, ["bucket", "before", "w"], windows, "inner").groupBy("h", "c").agg(F.max("before").alias("lo"), (SPAN - F.min("before")).alias("hi"))
    whole = classes.where("n > 1").select("h", "c", F.expr(_PARTS["left"]).alias("lo"), F.expr(_PARTS["right"]).alias("hi")).where(F.col("lo") + F.col("hi") >= SPAN)
    extent = whole.unionByName(small).unionByName(large).groupBy("h", "c").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    extent = materialize(classes.select("h", "c", F.col("n").alias("size")).join(extent, ["h", "c"], "left"))
    runs = spread_join(repeated, extent, ["h", "c"], repeated.count(), "inner").where("lo is not null")
    runs = runs.select("k", (F.expr(_PARTS["place"]) - F.col("lo")).alias("s"), (F.expr(_PARTS["place"]) + F.col("hi")).alias("e"))
    return runs.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("runs"))  # a set, as rows that repeat share k


def removal(length: int, runs: np.ndarray | None) -> np.ndarray:
    """Which of `length` bytes go."""
    change = np.zeros(length + 1, np.int32)
    if runs is not None and len(runs):
        np.add.at(change, runs[:, 0], 1)
        np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change)[:length] > 0


def _cut(docs: DataFrame, kind: str, make) -> DataFrame:
    """mapInArrow over the rows with their runs; make(batch, data, at, gone) -> batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            runs = rows.column("runs")
            gone = []
            for i in range(rows.num_rows):
                r = runs[i].values
                pairs = None if r is None else np.stack([r.field(0).to_numpy(), r.field(1).to_numpy()], axis=1)
                gone.append(removal(int(at[i + 1] - at[i]), pairs))
            yield make(rows, data, at, gone)

    return keyed(docs).join(covered(docs), "k", "left").select("doc_id", "text", "runs").mapInArrow(run, kind)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of docs.

    A null or empty text has nothing to remove. Rows that repeat, id and all, are documents of their own, each a
    repeat of the other; null ids are kept; other columns are not read; an empty table gives no rows.
    """

    def make(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, gone: list[np.ndarray]) -> pa.RecordBatch:
        sha = [hashlib.sha256(data[at[i] : at[i + 1]][~g]).hexdigest() for i, g in enumerate(gone)]
        spans = [int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) for g in gone]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cut(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and kept (binary, as a cut may fall inside a character), defined as in digests."""

    def make(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, gone: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([data[at[i] : at[i + 1]][~g].tobytes() for i, g in enumerate(gone)], pa.binary())], ["doc_id", "kept"])

    return _cut(docs, "doc_id long, kept binary", make)
