"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's signature has COORDINATES minima of its shingle hashes. A pair with a Jaccard similarity of 0.75
agrees in fewer than MATCHES of 48 coordinates with a chance of about 1e-8, so a match threshold of MATCHES loses
next to nothing; and two signatures with that many matches share one of the COORDINATES - MATCHES + 1 first
coordinate-value pairs of each in any common order. In the order used here rare pairs come first, so a pair that
thousands of documents share, as in a common passage, is posted only by documents that consist of such.

Documents with equal shingle sets form a class; classes are posted, not documents. All classes posted with a
class's smallest fellow meet in that fellow's group. There the posting lists of each class are merged, skipping what
cannot reach MATCHES, until a fellow at or above it is found; classes with one are retained, their full sets compared,
and links leave as a spanning forest, never as all pairs. Groups beyond GROUP_SETS
or GROUP_SHINGLES are cut into blocks, each with the group's leader, so that near copies of one text are joined by
then. Of such a group the classes outside its largest component go on to meet all others, block by block; classes
already joined are not compared again. Only a group of many classes that do not link costs the square of its size.

Shingles are compared by two independent hashes, 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, materialize, mix, shingle_hashes, spread_join, text_slices, whole_rows
from .components import components

COORDINATES, MATCHES = 48, 16
PREFIX = COORDINATES - MATCHES + 1
SIMILAR = (75, 100)
GROUP_SETS, GROUP_SHINGLES = 2048, 1_500_000
#: Pairs of coordinate and value are hot from this share of the rows on, so that COORDINATES * HOT of them at most
#: are hot; those are broadcast (16 bytes each).
OFTEN_LEAST, SEEN_LEAST = 16, 3
_RNG = np.random.default_rng(7_7)
_FACTORS = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
_CLASS = _RNG.integers(0, 1 << 64, 2, dtype=np.uint64)


def distinct_sets(hashes: np.ndarray, twins: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sorted distinct hashes of each document, and their twins (the second hashes)."""
    sets, seconds = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        names, place = np.unique(hashes[a:b], return_index=True)
        sets.append(names)
        seconds.append(twins[a:b][place])
    return sets, seconds


def minima(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of coordinate values for each non-empty run of flat that begins at begin."""
    return np.stack([np.minimum.reduceat(flat * a, begin) for a in _FACTORS], axis=1) if len(begin) else np.zeros((0, COORDINATES), np.uint64)


def tokens(signatures: np.ndarray) -> np.ndarray:
    """One number for each pair of coordinate and value."""
    return mix(signatures ^ _PLACES)


def _fixed(kind: int, rows: np.ndarray) -> pa.Array:
    """Rows of equal length as a binary column."""
    data = np.ascontiguousarray(rows)
    at = np.arange(len(rows) + 1, dtype=np.int32) * kind
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    return data.reshape(-1, width)


def _key() -> tuple[Column, Column]:
    """What tells rows apart in a join: the id, with a stand-in for null, and the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th")


def signatures(docs: DataFrame) -> DataFrame:
    """id, th, n (shingles), cls (16 bytes naming the set; null if empty) and sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            sets, twins = distinct_sets(*shingle_hashes(data, at))
            n = np.array([len(s) for s in sets], np.int64)
            flat, twin = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (sets, twins))
            full = n > 0
            begin = (np.cumsum(n) - n)[full]
            sums = [np.add.reduceat(mix(x ^ c), begin) for x, c in zip((flat, twin), _CLASS, strict=True)] if len(begin) else [np.zeros(0, np.uint64)] * 2
            spread = np.cumsum(full) - 1
            take = pa.array(np.where(full, spread, 0), mask=~full)
            cls, sig = _fixed(16, np.stack([mix(s + n[full].astype(np.uint64)) for s in sums], axis=1)), _fixed(8 * COORDINATES, minima(flat, begin))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("th"), pa.array(n), cls.take(take), sig.take(take)], ["id", "th", "n", "cls", "sig"])

    return docs.select(*_key(), "text").mapInArrow(run, "id long, th long, n long, cls binary, sig binary")


def hot_tokens(classes: DataFrame, rows: int) -> dict[int, int]:
    """Coordinate-value pairs that many classes share, with how often they were seen; at most COORDINATES * HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, n = np.unique(tokens(_matrix(batch.column("sig"), COORDINATES)), return_counts=True)
            often = n >= SEEN_LEAST
            yield pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

    seen = classes.select("sig").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in seen.where(F.col("n") >= max(OFTEN_LEAST, rows // HOT)).collect()}


def postings(classes: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(token, hot, cls, n) for the PREFIX first tokens of each class, rare ones first."""
    spark = classes.sparkSession
    names = np.array(sorted(hot), np.int64)
    shared = spark.sparkContext.broadcast((names, np.array([hot[i] for i in names.tolist()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                found = np.sort(tokens(_matrix(batch.column("sig"), COORDINATES)), axis=1).view(np.int64)
                count = np.zeros(found.shape, np.int64)
                if len(known):
                    spot = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit = known[spot] == found
                    count[hit] = often[spot[hit]]
                chosen = np.argsort(count, axis=1, kind="stable")[:, :PREFIX]
                found, count = np.take_along_axis(found, chosen, 1), np.take_along_axis(count, chosen, 1)
                owner = pa.array(np.repeat(np.arange(batch.num_rows), PREFIX))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(count.ravel() > 0), batch.column("cls").take(owner), batch.column("n").take(owner)], ["token", "hot", "cls", "n"])

    return classes.select("sig", "cls", "n").mapInArrow(run, "token long, hot boolean, cls binary, n long")


def _fellows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and cls -> (leader, cls, n) of tokens that several classes post."""
    token, leader, size, wide = None, b"", 0, False
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for t, c, n in zip(batch.column("token").to_numpy().tolist(), batch.column("cls").to_pylist(), batch.column("n").to_numpy().tolist(), strict=True):
            if t != token:
                token, leader, size, wide = t, c, n, False
            elif c != leader:
                if not wide:
                    wide = True
                    for col, v in zip(out, (leader, leader, size), strict=True):
                        col.append(v)
                for col, v in zip(out, (leader, c, n), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["leader", "cls", "n"])


def groups(posted: DataFrame) -> DataFrame:
    """(leader, cls, n): the classes of each group, the leader among them."""
    kind = "leader binary, cls binary, n long"
    cold = posted.where("not hot").select("token", "cls", "n").repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_fellows, kind)
    warm = posted.where("hot").select("token", "cls", "n")
    least = warm.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("least"))
    met = warm.join(F.broadcast(least), "token").where("cls <> least.cls")  # a row per hot token at most is broadcast
    met = met.select(F.col("least.cls").alias("leader"), "cls", "n", F.col("least.n").alias("m"))
    met = met.select("leader", "cls", "n").unionByName(met.select("leader", F.col("leader").alias("cls"), F.col("m").alias("n")))
    return materialize(cold.unionByName(met).distinct())


def _blocks(sets: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(sets / GROUP_SETS), F.ceil(shingles / GROUP_SHINGLES)).cast("long")


def _upto(n: Column | str) -> Column:
    """0 to n - 1."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def within_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(leader, i, j, cls, part): each class in its block of the group (i = j), the leader in every block."""
    sized = spread_join(members, sizes.select("leader", "cut", F.col("sets").alias("size")), ["leader"], members.count(), "inner")
    own = F.when(F.col("cls") == F.col("leader"), _upto("cut")).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("cut"))))
    return sized.withColumn("i", F.explode(own)).select("leader", "i", F.col("i").alias("j"), "cls", F.col("cls").alias("part"))


def between_blocks(members: DataFrame, sizes: DataFrame, joined: DataFrame) -> DataFrame:
    """(leader, i, j, cls, part) for groups of several blocks: who may still link, by what is joined (cls, component).

    part is the component. Classes outside a group's largest component are dealt to blocks 0, 1, ... and meet in pairs
    of these; each of them meets every block of the largest component, numbered from there on.
    """
    large = spread_join(members, sizes.where("cut > 1").select("leader", F.col("sets").alias("size")), ["leader"], members.count(), "inner")
    named = large.join(joined, "cls", "left").withColumn("part", F.coalesce("component", "cls")).drop("component")
    named = materialize(named)
    parts = named.groupBy("leader", "part").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    top = F.max(F.struct("sets", "part", "shingles")).alias("top")
    cuts = parts.groupBy("leader").agg(top, F.sum("sets").alias("size"), F.sum("shingles").alias("all"))
    cuts = cuts.withColumn("rest", F.col("size") - F.col("top.sets")).where("rest > 0")
    few = F.when(F.col("rest") > 0, _blocks(2 * F.col("rest"), 2 * (F.col("all") - F.col("top.shingles"))))
    cuts = cuts.select("leader", "size", F.col("top.part").alias("most"), few.alias("few"), _blocks(2 * F.col("top.sets"), 2 * F.col("top.shingles")).alias("many"))
    sized = spread_join(named, cuts, ["leader"], named.count(), "inner")
    outside = F.col("part") != F.col("most")
    own = F.pmod(F.xxhash64("cls"), F.when(outside, F.col("few")).otherwise(F.col("many")))
    sized = sized.withColumn("own", F.when(outside, own).otherwise(F.col("few") + own))
    met = sized.withColumn("other", F.explode(F.when(outside, _upto(F.col("few") + F.col("many"))).otherwise(_upto("few"))))
    return met.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "part")


def set_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(leader, i, j, cls, part, shingles): the sets of the texts that wanted (id, th, cls, met) names, in each place of met.

    shingles holds the sorted first hashes, then the second ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            sets, twins = distinct_sets(*shingle_hashes(data, at))
            met = rows.column("met")
            owner = pa.array(np.repeat(np.arange(len(sets)), met.value_lengths().to_numpy()))
            places = met.flatten()
            shingles = pa.array([s.tobytes() + t.tobytes() for s, t in zip(sets, twins, strict=True)], pa.large_binary())
            names = ["leader", "i", "j", "cls", "part"]
            whole = pa.Table.from_arrays([*(places.field(k) for k in range(3)), rows.column("cls").take(owner), places.field(3)], names)
            for k in range(0, whole.num_rows, 256):  # a set in many groups is written out many times
                part = whole.slice(k, 256).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*part.columns, shingles.take(owner.slice(k, 256)).cast(pa.binary())], [*names, "shingles"])

    texts = docs.select(*_key(), "text").join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("cls", "met", "text")
    return texts.mapInArrow(run, "leader binary, i long, j long, cls binary, part binary, shingles binary")


def collisions(tokens: np.ndarray, part: np.ndarray, queries: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y), x of queries, of rows of different parts that share MATCHES tokens or more, by skip merging.

    part is sorted. Each query merges the posting lists of its tokens, all queries step together: no row before the
    MATCHES-th smallest head of a query's lists can be in MATCHES of them, so lists that lag behind it skip there by
    binary search. Rows of the query's own part are skipped as a whole. A query leaves when fewer than MATCHES of its
    lists have rows left, or when the caller closes it in open_.
    """
    m = len(tokens)
    flat = tokens.ravel()
    order = np.argsort(flat, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]]))
    size = np.diff(np.concatenate([new, [len(flat)]]))
    several = size > 1
    number = np.repeat(np.where(several, np.cumsum(several) - 1, several.sum()), size)  # the list of each token; single ones have none
    lists = number * (m + 1) + order // COORDINATES
    lists = np.concatenate([lists[np.repeat(several, size)], [np.iinfo(np.int64).max]])
    base = np.empty(len(flat), np.int64)
    base[order] = number * (m + 1)
    base = base.reshape(m, COORDINATES)[queries]
    beyond = np.searchsorted(part, part, side="right")
    x, head, target = queries, np.full(base.shape, -1, np.int64), np.zeros(len(queries), np.int64)

    def skip() -> None:
        late = head < target[:, None]
        start = base[late]
        head[late] = np.minimum(lists[np.searchsorted(lists, start + np.broadcast_to(target[:, None], head.shape)[late])] - start, m)

    while True:
        skip()
        target = np.partition(head, MATCHES - 1, axis=1)[:, MATCHES - 1]
        stay = (target < m) & open_[x]
        if not stay.any():
            return
        if not stay.all():
            x, head, base, target = x[stay], head[stay], base[stay], target[stay]
        skip()
        own = part[target] == part[x]
        hit = ~own & ((head == target[:, None]).sum(axis=1) >= MATCHES)
        if hit.any():
            yield x[hit], target[hit]
        target = np.where(own, beyond[target], target + 1)


def _numbered(parts: list[bytes]) -> np.ndarray:
    """A number for each different part."""
    return np.unique(np.array([p.ljust(16) for p in parts]), return_inverse=True)[1]


def shared_counts(sets: list[np.ndarray], twins: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each two of some sets share, from the elements that several sets have.

    With twins, an element is the same only if its twin is too.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat) + 1, bool)
    np.not_equal(flat[order[1:]], flat[order[:-1]], out=new[1:-1])
    if twins is not None:
        twin = np.concatenate(twins)
        if (~new[1:-1] & (twin[order[1:]] != twin[order[:-1]])).any():
            order = np.lexsort((twin, flat))
            new[1:-1] = (flat[order[1:]] != flat[order[:-1]]) | (twin[order[1:]] != twin[order[:-1]])
    owner = owner[order]
    begin = np.flatnonzero(new)
    size = np.diff(begin)
    begin, size = begin[:-1][size > 1], size[size > 1]
    counts = np.zeros((m, m), np.float32)
    if not len(begin):
        return counts
    place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    owner = owner[place]
    names = mix(np.arange(1, m + 1, dtype=np.uint64))
    pattern = np.add.reduceat(names[owner], np.cumsum(size) - size)  # elements of the same sets count together
    _, one, weight = np.unique(pattern, return_index=True, return_counts=True)
    step = max(1, 4_000_000 // m)
    starts = np.cumsum(size) - size
    for i in range(0, len(one), step):
        part = one[i : i + step]
        cols = np.repeat(np.arange(len(part)), size[part])
        rows = owner[np.arange(len(cols)) + np.repeat(starts[part] - (np.cumsum(size[part]) - size[part]), size[part])]
        grid = np.zeros((m, len(part)), np.float32)
        grid[rows, cols] = 1
        counts += (grid * weight[i : i + step].astype(np.float32)) @ grid.T
    return counts


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row it reaches."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def group_links(names: list[bytes], parts: list[bytes], sets: list[bytes]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among some retained classes of different parts, by their full sets."""
    if len(names) < 2:
        return []
    chosen, part = [np.frombuffer(s, np.uint64) for s in sets], _numbered(parts)
    n = np.array([len(s) // 2 for s in chosen], np.int64)
    both = shared_counts([s[: len(s) // 2] for s in chosen], [s[len(s) // 2 :] for s in chosen]).astype(np.int64)
    linked = (part[:, None] != part[None, :]) & (SIMILAR[1] * both >= SIMILAR[0] * (n[:, None] + n[None, :] - both))
    return [(names[a], names[b]) for a, b in enumerate(roots(linked).tolist()) if a != b]


def retained(names: list[bytes], parts: list[bytes], sigs: list[bytes], sizes: list[int]) -> list[tuple[bytes, bytes]]:
    """The classes that agree with one of another part in MATCHES coordinates and might in size; the merge of a class ends with its first such fellow."""
    if len(names) < 2:
        return []
    found, part = tokens(np.frombuffer(b"".join(sigs), np.uint64).reshape(-1, COORDINATES)), _numbered(parts)
    order = np.argsort(part, kind="stable")
    n, open_ = np.array(sizes, np.int64)[order], np.ones(len(names), bool)
    for x, y in collisions(found[order], part[order], np.arange(len(names)), open_):
        fit = SIMILAR[1] * np.minimum(n[x], n[y]) >= SIMILAR[0] * np.maximum(n[x], n[y])
        open_[x[fit]] = open_[y[fit]] = False
    return [(names[k], parts[k]) for k in np.sort(order[~open_]).tolist()]


def _by_group(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], solve: Callable[..., list], pack: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leader, i, j): what solve finds in each group; holds one group, whose size is bounded."""
    key, held = None, [[] for _ in columns]
    for batch in batches:
        found: list = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", *columns)), strict=True):
            if row[:3] != key:
                found += [(key, x) for x in solve(*held)]
                key, held = row[:3], [[] for _ in columns]
            for col, v in zip(held, row[3:], strict=True):
                col.append(v)
        yield pack(found)
    yield pack([(key, x) for x in solve(*held)])


def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack(found: list) -> pa.RecordBatch:
        cols = [[k[0] for k, _ in found], [k[1] for k, _ in found], [k[2] for k, _ in found], [c for _, (c, _) in found], [p for _, (_, p) in found]]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["leader", "i", "j", "cls", "part"])

    return _by_group(batches, ("cls", "part", "sig", "n"), retained, pack)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for _, (a, _) in found], pa.binary()), pa.array([b for _, (_, b) in found], pa.binary())], ["a", "b"])

    return _by_group(batches, ("cls", "part", "shingles"), group_links, pack)


def links(docs: DataFrame, one: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each place (leader, i, j) that placed (leader, i, j, cls, part) fills with classes of one."""
    place = ("leader", "i", "j")
    met = placed.join(one.select("cls", "sig", "n"), "cls").repartition(*place).sortWithinPartitions(*place)
    met = materialize(met.select(*place, "cls", "part", "sig", "n").mapInArrow(_retained, "leader binary, i long, j long, cls binary, part binary"))
    wanted = met.groupBy("cls").agg(F.collect_list(F.struct(*place, "part")).alias("met"))
    wanted = materialize(wanted.join(one.select("cls", "first"), "cls").select("first.id", "first.th", "cls", "met"))
    sets = set_rows(docs, wanted).repartition(*place).sortWithinPartitions(*place)
    return materialize(sets.mapInArrow(_links, "a binary, b binary"))


def classes(docs: DataFrame) -> DataFrame:
    """id, th, n, root (16 bytes naming the component; null without shingles) of each row."""
    sigs = materialize(signatures(docs))
    first = F.min(F.struct("id", "th")).alias("first")
    one = materialize(sigs.where("cls is not null").groupBy("cls").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), first, F.count("*").alias("copies")))
    members = groups(postings(one, hot_tokens(one, one.count())))
    sizes = members.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sizes = materialize(sizes.select("leader", "sets", _blocks(F.col("sets"), F.col("shingles")).alias("cut")))
    found = links(docs, one, within_blocks(members, sizes))
    joined = components(found).select(F.col("node").alias("cls"), "component")
    if not sizes.where("cut > 1").isEmpty():
        joined = materialize(joined)
        more = links(docs, one, between_blocks(members, sizes, joined))
        joined = components(joined.select(F.col("cls").alias("a"), F.col("component").alias("b")).unionByName(more)).select(F.col("node").alias("cls"), "component")
    named = one.select("cls", F.col("copies").alias("size")).join(joined, "cls")
    found = spread_join(sigs.select("id", "th", "n", "cls"), named, ["cls"], sigs.count())
    return found.select("id", "th", "n", F.coalesce("component", "cls").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    A null or empty text, or one of white space, has no shingles and is a component of its own; a text of one to
    four words is one shingle. Rows with null ids take part: a component's id is its smallest id that is not
    null, and null only if all are. Repeated ids keep a row each and may lie in different components; other
    columns are not read; an empty table gives no rows.
    """
    return _named(classes(docs)).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _named(found: DataFrame) -> DataFrame:
    real = F.when(F.col("id") != -(1 << 63), F.col("id"))
    found = materialize(found.withColumn("doc_id", real))
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("size"))
    joined = spread_join(found, least, ["root"], found.count())
    return joined.withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that are first, by id and text hash, in their component.

    Rows alike in id and text count once, null ids come before others, rows without shingles (null, empty or blank
    texts) are components of their own, other columns are kept as they are, and an empty table gives no rows.
    """
    first = _named(classes(docs)).where("root is null or struct(id, th) = first").select("id", "th").distinct()
    stay = docs.select(*_key(), whole_rows(docs).alias("whole")).join(first, ["id", "th"], "left_semi")
    return stay.dropDuplicates(["id", "th"]).select("whole.*")
