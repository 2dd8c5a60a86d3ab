"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction made of two code words, one for each half of the (randomly rotated) components: a random
product code. A vector is listed under every filter whose inner product with it exceeds a threshold, found by
decoding the halves' scores in order rather than trying all filters, and under every filter within MARGIN of its
best one, so that a vector in a thin spot of the code is listed too. Of 3,000 random pairs at a cosine of 0.98 all
shared a filter. Equal vectors form a class and are listed once, with a sketch of SKETCH sign bits. Within a filter
and label, blocks of at most BLOCK classes meet each other; classes whose sketch has no other within FAR bits leave
(a pair at 0.98 differs in 8 of 128 bits, and in more than FAR with a chance of about 1e-8). Only what is left
gets its vector; a link is counted only under the smallest filter that both are listed under, and leaves as a count
and a spanning forest, never as all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join
from .components import components
from .op7_minhash import roots, shared_counts
from .vectors import matrices, packed, unpacked

COSINE = 0.98
#: Filters per vector and code, independent codes, and vectors per filter over all labels.
LISTED, CODES, CROWD = 4, 2, 256
#: How far below its best filter a vector is always listed: over two deviations of the change between neighbours.
MARGIN = 0.5
BLOCK = 2048
SKETCH, FAR = 128, 26


class ProductCode:
    """CODES product codes for vectors of one length, made from a seed."""

    def __init__(self, dims: int, rows: int, seed: int = 9_9):
        chance = min(0.05, CROWD / max(1, rows))
        self.words = max(4, round((LISTED / chance) ** 0.5))
        self.least = NormalDist().inv_cdf(1 - chance)
        rng = np.random.default_rng((seed, dims))
        half = (dims + 1) // 2
        self.dims, self.half = dims, half
        self.codes = [(np.linalg.qr(rng.standard_normal((dims, dims)))[0], rng.standard_normal((half, self.words)), rng.standard_normal((dims - half, self.words))) for _ in range(CODES)]

    def listed(self, units: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted filters of each unit vector."""
        scores = []
        for turn, left, right in self.codes:
            turned = units @ turn
            a = turned[:, : self.half] @ left
            b = turned[:, self.half :] @ right
            rank = np.argsort(-b, axis=1)
            scores.append((a, np.take_along_axis(b, rank, 1), rank))
        for i in range(len(units)):
            out = []
            for c, (a, b, rank) in enumerate(scores):
                least = min(self.least, a[i].max() + b[i, 0] - MARGIN)
                need = least - a[i]
                rows = np.flatnonzero(need <= b[i, 0])
                n = np.searchsorted(-b[i], -need[rows], side="right")
                word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((c * self.words + np.repeat(rows, n)) * self.words + rank[i][word])
            yield np.sort(np.concatenate(out)).astype(np.int64)


def class_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, cls (16 bytes naming label and vector; null if the vector links with nothing), unit and kind of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names: list[bytes | None] = [None] * n
            units: list[bytes | None] = [None] * n
            kinds: list[str | None] = [None] * n
            labels = batch.column("label").to_pylist()
            for rows, values in matrices(batch.column("embedding")):
                power = np.frexp(np.abs(values).max(1))[1]  # a power of two changes no cosine, and norms stay in range
                scaled = np.ldexp(values, -power[:, None])
                for i, v, x in zip(rows.tolist(), values, scaled, strict=True):
                    if x.any() and labels[i] is not None:
                        kinds[i] = f"{values.shape[1]}:{labels[i]}"
                        units[i] = x.tobytes()
                        names[i] = hashlib.blake2b(kinds[i].encode() + (v + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(names, pa.binary()), pa.array(units, pa.binary()), pa.array(kinds, pa.string())], ["vec_id", "cls", "vec", "kind"])

    chosen = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return chosen.mapInArrow(run, "vec_id long, cls binary, vec binary, kind string")


def sketches(units: np.ndarray) -> np.ndarray:
    """The signs of SKETCH random projections, as bytes."""
    planes = np.random.default_rng((SKETCH, units.shape[1])).standard_normal((units.shape[1], SKETCH))
    return np.packbits(units @ planes > 0, axis=1)


def _units(batch: pa.RecordBatch, codes: dict[int, ProductCode], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows, unit vectors, filters) for each length of vector."""
    raw = batch.column("vec").to_pylist()
    width = np.array([len(v) // 8 for v in raw])
    for d in np.unique(width).tolist():
        at = np.flatnonzero(width == d)
        values = unpacked([raw[i] for i in at.tolist()])
        units = values / np.linalg.norm(values, axis=1, keepdims=True)
        yield at, units, list(codes.setdefault(d, ProductCode(d, rows)).listed(units))


def postings(classes: DataFrame, rows: int) -> DataFrame:
    """(kind, filter, cls, sketch) for each filter of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, ProductCode] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                for at, units, found in _units(batch, made, rows):
                    sizes = [len(f) for f in found]
                    owner = pa.array(np.repeat(at, sizes))
                    sketch = packed(sketches(units)).take(pa.array(np.repeat(np.arange(len(at)), sizes)))
                    yield pa.RecordBatch.from_arrays([batch.column("kind").take(owner), pa.array(np.concatenate(found)), batch.column("cls").take(owner), sketch], ["kind", "filter", "cls", "sketch"])

    return classes.mapInArrow(run, "kind string, filter long, cls binary, sketch binary")


def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block pair -> those whose sketch is close to another's."""
    key, held = None, ([], [], [])

    def done() -> list[tuple]:
        if len(held[0]) < 2:
            return []
        bits = np.unpackbits(unpacked(held[2], np.uint8), axis=1).astype(np.float32) * 2 - 1
        near = bits @ bits.T >= SKETCH - 2 * FAR
        np.fill_diagonal(near, False)
        if key[2] != key[3]:
            side = np.array(held[0])
            near &= side[:, None] != side[None, :]
        return [(*key, held[0][k], held[1][k]) for k in np.flatnonzero(near.any(1)).tolist()]

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["kind", "filter", "i", "j", "own", "cls"])

    for batch in batches:
        found: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "filter", "i", "j", "own", "cls", "sketch")), strict=True):
            if row[:4] != key:
                found += done()
                key, held = row[:4], ([], [], [])
            for col, v in zip(held, row[4:], strict=True):
                col.append(v)
        yield out(found)
    yield out(done())


def placed_vectors(classes: DataFrame, rows: int) -> DataFrame:
    """A row with vector and filters for each block pair in the column met of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, ProductCode] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                for at, _, found in _units(batch, made, rows):
                    met = batch.column("met").take(pa.array(at))
                    sizes = met.value_lengths().to_numpy()
                    owner, places = pa.array(np.repeat(at, sizes)), met.flatten()
                    lists = pa.array([f.tobytes() for f in found], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), sizes)))
                    yield pa.RecordBatch.from_arrays([batch.column("kind").take(owner), *(places.field(n) for n in range(4)), *(batch.column(c).take(owner) for c in ("cls", "copies", "vec")), lists], ["kind", "filter", "i", "j", "own", "cls", "copies", "vec", "filters"])

    return classes.mapInArrow(run, "kind string, filter long, i long, j long, own long, cls binary, copies long, vec binary, filters binary")


def block_links(i: int, j: int, filter_id: int, own: list[int], names: list[bytes], copies: list[int], vecs: list[bytes], filters: list[bytes]) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Links counted under this filter for each class of two blocks (or one, i = j), and a spanning forest."""
    if len(names) < 2:
        return {}, []
    x = unpacked(vecs)
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / size[:, None] / size[None, :] >= COSINE
    np.fill_diagonal(near, False)
    if i != j:
        side = np.array(own)
        near &= side[:, None] != side[None, :]
    some = np.flatnonzero(near.any(1))
    if not len(some):
        return {}, []
    near = near[np.ix_(some, some)]
    lists = [np.frombuffer(filters[k], np.int64) for k in some.tolist()]
    before = shared_counts([f[f < filter_id].view(np.uint64) for f in lists])
    counted = ((near & (before == 0)) * np.array(copies, np.int64)[some][None, :]).sum(1)
    forest = [(names[some[a]], names[some[b]]) for a, b in enumerate(roots(near).tolist()) if a != b]
    return {names[k]: n for k, n in zip(some.tolist(), counted.tolist(), strict=True) if n}, forest


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block pair -> (a, b, n): n more links of a, or a link of a and b."""
    key, held = None, ([], [], [], [], [])
    total: dict[bytes, int] = {}

    def out(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        a = [x for x, _ in pairs] + list(total)
        b = [x for _, x in pairs] + [None] * len(total)
        n = [0] * len(pairs) + list(total.values())
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def done() -> list[tuple[bytes, bytes]]:
        if key is None:
            return []
        counted, forest = block_links(key[2], key[3], key[1], *held)
        for c, n in counted.items():
            total[c] = total.get(c, 0) + n
        return forest

    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "filter", "i", "j", "own", "cls", "copies", "vec", "filters")), strict=True):
            if row[:4] != key:
                found += done()
                key, held = row[:4], ([], [], [], [], [])
            for col, v in zip(held, row[4:], strict=True):
                col.append(v)
        yield out(found)
    yield out(done())


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    A vector that is null, empty, zero or holds a null or a non-finite component, or whose label is null, links
    with nothing; so do vectors of different lengths. Components of any finite size count, those near the ends of
    double precision too. Rows with null ids count as links of others; a component's
    id is its smallest id that is not null. Repeated ids keep a row each; other columns are not read; an empty
    table gives no rows.
    """
    rows = materialize(class_rows(vectors))
    classes = materialize(rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("kind").alias("kind")))
    n = classes.count()
    posted = materialize(postings(classes, n))
    sizes = posted.groupBy("kind", "filter").agg(F.count("*").alias("n")).where("n > 1").select("kind", "filter", F.ceil(F.col("n") / BLOCK).alias("cut"), F.col("n").alias("size"))
    sized = spread_join(posted, sizes, ["kind", "filter"], posted.count(), "inner").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("cut")))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    place = ("kind", "filter", "i", "j")
    met = spread.select("kind", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "sketch")
    met = materialize(met.repartition(*place).sortWithinPartitions(*place).mapInArrow(_retained, "kind string, filter long, i long, j long, own long, cls binary"))
    met = met.groupBy("cls").agg(F.collect_list(F.struct("filter", "i", "j", "own")).alias("met"))  # its filters times the blocks of each
    placed = placed_vectors(classes.join(met, "cls"), n)
    met = placed.repartition(*place).sortWithinPartitions(*place)
    links = materialize(met.mapInArrow(_links, "a binary, b binary, n long"))
    joined = components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "component")
    counts = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    each = classes.select("cls", "copies").join(counts, "cls", "left").join(joined, "cls", "left")
    each = each.select("cls", F.col("copies").alias("size"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    total = rows.count()
    found = materialize(spread_join(rows.select("vec_id", "cls"), materialize(each), ["cls"], total).select("vec_id", "n_links", "root"))
    least = found.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    named = spread_join(found, least, ["root"], total).withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
