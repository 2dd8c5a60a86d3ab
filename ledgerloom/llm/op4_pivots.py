"""Exact top-k search by integer inner product with a pivot table.

The inner product s of two vectors and their distance d are tied by 2 s = |q|^2 + |c|^2 - d^2. Distances of every
row to PIVOTS fixed rows are computed once; for a query, the largest difference of its own and a candidate's
distance to a pivot bounds d from below and so s from above. Candidates lie in slabs of bounded size, a slab in
chunks of rows near the same pivot, which share a bound. A query visits chunks in order of their bound and stops
at the first that lies below its k-th score so far; within a chunk it scores only rows whose own bound, by the pivots
nearest to the query, reaches that score. The pivots are rows themselves, so their scores give the first k-th score.
Each length of vector has pivots and slabs of its own. Pivots are chosen far apart and travel to every slab as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread_join
from .vectors import matrices, packed, unpacked

SCALE, K, QUERY_STEP = 1024, 10, 100
#: Rows that serve as pivots, rows they are chosen from, and pivots that bound single rows.
PIVOTS, POOL, NEAREST = 192, 2048, 16
#: Least and most rows of a slab, rows of a chunk.
SLAB, CHUNK = (1 << 13, 1 << 15), 64
#: Sums of whole numbers below this are exact in double precision.
_EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, dims and v (bytes of 64-bit integers floor(SCALE x)) of each row that takes part.

    Floors beyond 64 bits become the nearest number of 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").cast(pa.int64())
            for rows, values in matrices(batch.column("embedding")):
                named = ids.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([named, pa.array(np.full(len(rows), values.shape[1])), packed(whole(values))], ["vec_id", "dims", "v"])

    chosen = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    rows = chosen.mapInArrow(run, "vec_id long, dims long, v binary")
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dims", "v"))


def whole(values: np.ndarray) -> np.ndarray:
    floor = np.floor(SCALE * values)
    edge = 2.0**63
    out = np.where(np.abs(floor) < edge, floor, 0).astype(np.int64)
    return np.where(floor >= edge, np.iinfo(np.int64).max, np.where(floor < -edge, np.iinfo(np.int64).min, out))


def far_apart(v: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows, each the farthest from those before."""
    x = v.astype(np.float64)
    chosen, apart = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(v)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and not -(1 << 63) <= exact.min() <= exact.max() < 1 << 63:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = v.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T))


class Slab:
    """Candidates of one slab, in chunks by nearest pivot, with their pivot table."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray):
        table = distances(v, pivots)
        near = table.argmin(1)
        order = np.lexsort((table[np.arange(len(v)), near], near))
        self.rows, self.ids, self.v, self.table = rows[order], ids[order], v[order], table[order]
        self.norms = (self.v.astype(np.float64) ** 2).sum(1)
        self.begin = np.arange(0, len(v), CHUNK)
        self.low, self.high = np.minimum.reduceat(self.table, self.begin), np.maximum.reduceat(self.table, self.begin)
        self.most = np.maximum.reduceat(self.norms, self.begin)

    def search(self, query: int, q: np.ndarray, to_pivots: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores) of this slab that reach `least`, fewer if fewer do, and how many rows were scored."""
        norm = float((q.astype(np.float64) ** 2).sum())
        gap = np.maximum(0, np.maximum(self.low - to_pivots, to_pivots - self.high).max(1))
        bound = (norm + self.most - gap * gap) / 2 * (1 + 1e-9) + 1e-3 * norm**0.5 + 1
        order = np.argsort(-bound)
        ids, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        near = np.argsort(to_pivots)[:NEAREST]
        i, step = 0, 4
        while i < len(order) and bound[order[i]] >= least:
            chunks = order[i : i + step]
            chunks = chunks[bound[chunks] >= least]
            i, step = i + step, step * 2
            rows = (self.begin[chunks][:, None] + np.arange(CHUNK)).ravel()
            rows = rows[rows < len(self.ids)]
            apart = np.abs(self.table[rows[:, None], near] - to_pivots[near]).max(1)
            own = (norm + self.norms[rows] - apart * apart) / 2 * (1 + 1e-9) + 1e-3 * norm**0.5 + 1
            rows = rows[(own >= least) & (self.rows[rows] != query)]
            got = inner(self.v[rows], q[None, :])[:, 0]
            scored += len(rows)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, got])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                least = max(least, float(scores[-1]))
        good = scores >= least
        return ids[good], scores[good], scored


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dims -> the pivots of each length; holds POOL rows."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        places = far_apart(unpacked([r[3] for r in held], np.int64), PIVOTS).tolist() if held else []
        return pa.RecordBatch.from_arrays([pa.array([held[k][c] for k in places], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["row", "vec_id", "dims", "v"])

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "dims", "v")), strict=True):
            if held and r[2] != held[0][2]:
                yield done()
                held = []
            held.append(r)
    yield done()


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dims, slab, kind: 0 pivot, 1 candidate, 2 query) -> best candidates of each query in each slab; holds one slab."""
    key, slab = None, None
    held: list[tuple[list, list, list]] = []
    pivots, pivot_rows = np.zeros((0, 1), np.int64), np.zeros(0, np.int64)
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for d, g, kind, row, i, v in zip(*(batch.column(c).to_pylist() for c in ("dims", "slab", "kind", "row", "vec_id", "v")), strict=True):
            if (d, g) != key:
                key, slab, held = (d, g), None, [([], [], []), ([], [], [])]
            if kind < 2:
                for col, x in zip(held[kind], (row, i, v), strict=True):
                    col.append(x)
                continue
            if slab is None:
                if not held[1][0]:
                    continue
                pivot_rows, pivots = np.array(held[0][0], np.int64), unpacked(held[0][2], np.int64)
                slab = Slab(np.array(held[1][0], np.int64), np.array(held[1][1], np.int64), unpacked(held[1][2], np.int64), pivots)
                held[1] = ([0], [], [])
            q = np.frombuffer(v, np.int64)
            seeds = np.sort(inner(pivots[pivot_rows != row], q[None, :])[:, 0])[::-1]
            least = float(seeds[k - 1]) if len(seeds) >= k else -np.inf
            found, scores, scored = slab.search(row, q, distances(q[None, :], pivots)[0], least, k)
            # a query without a candidate here still reports how many it scored
            out[0].extend([row] * max(1, len(found)))
            out[1].extend([i] * max(1, len(found)))
            out[2].extend(found.tolist() if len(found) else [None])
            out[3].extend(scores.tolist() if len(found) else [None])
            out[4].extend([scored] + [0] * (len(found) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "query_id", "vec_id", "score", "scored"])


def _pool(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """POOL rows of each length, or all: those with the least hashes among about twice as many, drawn by their hashes.

    Only what was drawn is shuffled and ranked. A hash is of the row's number too, so that copies of a vector are drawn
    no more often than other rows.
    """
    spot = F.pmod(F.xxhash64("v", "row"), F.lit(1 << 40)) / float(1 << 40)
    sized = spread_join(rows, counts.withColumn("share", 2.0 * POOL / F.col("size")), ["dims"], total, "inner")
    drawn = sized.where(spot < F.col("share")).withColumn("spot", spot).select(*rows.columns, "spot")
    nth = F.row_number().over(Window.partitionBy("dims").orderBy("spot", "row"))
    return drawn.withColumn("nth", nth).where(F.col("nth") <= POOL).select(*rows.columns)


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, evaluated: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by step.

    Rows whose vec_id is null, or whose vector is null, empty or holds a null or a non-finite component, take no
    part. A row's candidates are all rows but itself with a vector of its length; rows that share its vec_id, even
    copies of it, are among them, and each row of a repeated query id asks on its own. With evaluated, a last column
    tells how many products the query cost. An empty table gives no rows; other columns are not read.
    """
    rows = whole_vectors(vectors)
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"))
    slab_rows = F.least(F.lit(SLAB[1]), F.greatest(F.lit(SLAB[0]), F.floor(F.col("n") / 64)))
    counts = materialize(counts.select("dims", F.col("n").alias("size"), F.ceil(F.col("n") / slab_rows).cast("long").alias("slabs")))
    total = rows.count()
    pool = _pool(rows, counts, total)
    pivots = pool.repartition("dims").sortWithinPartitions("dims").mapInArrow(_chosen, "row long, vec_id long, dims long, v binary")

    def spread(df: DataFrame, kind: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1))
        return df.select("dims", every.alias("slab"), F.lit(kind).alias("kind"), "row", "vec_id", "v")

    sized = spread_join(rows, counts, ["dims"], total, "inner")
    candidates = sized.select("dims", F.pmod(F.xxhash64("row", "v"), F.col("slabs")).alias("slab"), F.lit(1).alias("kind"), "row", "vec_id", "v")
    met = candidates.unionByName(spread(pivots.join(counts, "dims"), 0)).unionByName(spread(sized.where(F.col("vec_id") % step == 0), 2))
    met = met.repartition("dims", "slab").sortWithinPartitions("dims", "slab", "kind")
    found = met.mapInArrow(lambda batches: _search(batches, k), "row long, query_id long, vec_id long, score long, scored long")
    own = Window.partitionBy("row")
    rank = F.row_number().over(own.orderBy(F.col("score").desc_nulls_last(), "vec_id"))
    found = found.withColumn("rank", rank.cast("int"))
    if evaluated:
        found = found.withColumn("evaluated", F.sum("scored").over(own))
    return found.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", *(["evaluated"] if evaluated else []))
