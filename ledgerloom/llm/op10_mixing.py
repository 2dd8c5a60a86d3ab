"""Mixing sources to target weights by Pfair scheduling of fixed-size blocks.

Source s has an integer weight a_s, all weights add up to a period W. Its block k (from 0) is released at
floor(k W / a_s) and due at ceil((k + 1) W / a_s). Earliest deadline first among the released blocks fills one
slot at a time, so that after t slots source s has had t a_s / W blocks, give or take less than one. When a source
runs dry, the rest go on with the same weights among themselves, and releases and deadlines follow. `block_slots`
makes any range of the schedule for any number of sources, so that tasks fill ranges apart; `phases` tells a small one by its repeating periods.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from functools import partial
from itertools import groupby, islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, whole_rows

OTHER = "\x00other"
BLOCK_DOCS = 32
#: Rows of a rank bucket: within a source, documents are ranked bucket by bucket.
BUCKET_ROWS = 4096
#: Slots in a range, at least, in all and for each source; and tasks that fill ranges at a time.
RANGE_SLOTS, SOURCE_SLOTS, RANGE_TASKS = 1 << 20, 16, 4096


def period_slots(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period; every weight is at least 1."""
    total = sum(weights.values())
    names = sorted(weights)
    waiting = [(0, -(-total // weights[s]), s, 0) for s in names]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in names}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        _, s, k = heapq.heappop(ready)
        out[s].append(slot)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], -(-(k + 2) * total // weights[s]), s, k + 1))
    return out


def exact_weights(shares: Sequence[float]) -> list[int]:
    """Whole numbers exactly in proportion to the shares, none rounded: a finite float is a whole number over a power of two."""
    ratios = [float(w).as_integer_ratio() for w in shares]
    common = max((d for _, d in ratios), default=1)
    return [n * (common // d) for n, d in ratios]


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """For each source and phase: source, first and last+1 block, first slot, period, slots of its blocks in a period."""
    done = dict.fromkeys(weights, 0)
    live = {s: w for s, w in weights.items() if blocks.get(s, 0) > 0}
    start, out = 0, []
    while live:
        period = sum(live.values())
        slots = period_slots(live)

        def slot_of(s: str, k: int, slots=slots, live=live, period=period) -> int:
            return k // live[s] * period + slots[s][k % live[s]]

        def had(s: str, t: int, slots=slots, live=live, period=period) -> int:
            whole, part = divmod(t, period)
            return whole * live[s] + sum(x < part for x in slots[s])

        end = min(slot_of(s, blocks[s] - done[s] - 1) for s in live) + 1
        for s in live:
            n = min(had(s, end), blocks[s] - done[s])
            if n:
                out.append((s, done[s], done[s] + n, start, period, slots[s]))
            done[s] += n
        start += end
        live = {s: w for s, w in live.items() if done[s] < blocks[s]}
    return out


def _source(docs: DataFrame, source: str) -> Column:
    return F.coalesce(F.col(f"`{source}`"), F.lit("")) if source in docs.columns else F.lit("")


def source_shares(docs: DataFrame, power: float = 0.7, source: str = "source") -> DataFrame:
    """source and share of every source: its row count, flattened by a power below 1."""
    n = docs.groupBy(_source(docs, source).alias("source")).count()
    return n.select("source", F.pow(F.col("count").cast("double"), F.lit(power)).alias("share"))


class Blocks:
    """The blocks of some sources with their releases and deadlines; holds a few numbers per source.

    Level v is the share of a block per weight that every live source has had: source s has had min(v weights[s],
    blocks[s]) blocks by then, which is its target, and the targets add up to the slot G(v). Block k of s may lie
    from slot floor(G(k / a_s)) to before ceil(G((k + 1) / a_s)), which keeps s within less than one block of its
    target at every slot, also when others have run dry. Unit jobs with whole releases and deadlines that a
    fluid schedule can meet are met by taking the earliest deadline among the released ones.
    """

    def __init__(self, weights: Sequence[int], blocks: Sequence[int]):
        self.weights, self.blocks = weights, blocks
        self.alive = sorted((s for s in range(len(weights)) if blocks[s] > 0), key=lambda s: Fraction(blocks[s], weights[s]))
        self.dry = [0]  # blocks of the sources that have run dry before each turn, and the weight of the others
        self.live = [sum(weights[s] for s in self.alive)]
        for s in self.alive:
            self.dry.append(self.dry[-1] + blocks[s])
            self.live.append(self.live[-1] - weights[s])
        self.turns = [blocks[s] / weights[s] for s in self.alive]
        self.total = self.dry[-1]

    def at(self, k: int, w: int) -> tuple[int, int]:
        """Floor and ceiling of G(k / w)."""
        alive, blocks, weights = self.alive, self.blocks, self.weights
        i = bisect_right(self.turns, k / w)
        while i and blocks[alive[i - 1]] * w > k * weights[alive[i - 1]]:  # the quotients are rounded
            i -= 1
        while i < len(alive) and blocks[alive[i]] * w <= k * weights[alive[i]]:
            i += 1
        whole, part = divmod(k * self.live[i], w)
        return self.dry[i] + whole, self.dry[i] + whole + (part > 0)

    def released(self, s: int, slot: int) -> int:
        """How many blocks of s are released before a slot."""
        return bisect_left(range(self.blocks[s]), slot, key=lambda k: self.at(k, self.weights[s])[0])

    def due(self, s: int, slot: int) -> int:
        """How many blocks of s have deadlines up to a slot."""
        return bisect_right(range(self.blocks[s]), slot, key=lambda k: self.at(k + 1, self.weights[s])[1])

    def fill(self, first: Mapping[int, int], begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(slot, source, block) from slot begin to before end, each source from block first on, earliest deadline first."""
        at, weights, blocks = self.at, self.weights, self.blocks
        waiting = []  # release, deadline, source, block, next release
        for s, k in first.items():
            if k < blocks[s]:
                then, due = at(k + 1, weights[s])
                waiting.append((at(k, weights[s])[0], due, s, k, then))
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        for slot in range(begin, end):
            while waiting and waiting[0][0] <= slot:
                _, due, s, k, then = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s, k))
                if k + 1 < blocks[s]:
                    free, due = at(k + 2, weights[s])
                    heapq.heappush(waiting, (then, due, s, k + 1, free))
            if ready:
                _, s, k = heapq.heappop(ready)
                yield slot, s, k

    def before(self, slot: int) -> dict[int, int]:
        """How many blocks each source has had before a slot, without the schedule up to there.

        Blocks due by then have been had, and of each source one block at most is under way: released, but not due.
        Which of these were had follows from the slots since the one where the slowest of their sources had a whole
        block less: of the jobs that are released since, those that earliest deadline first finds a slot for, in order
        of their deadlines, as many as there are slots left. A limit that reaches further back than that never binds:
        every source under way has then had a block in between, so as many slots are left there as blocks are under way.
        """
        had = {s: self.due(s, slot) for s in self.alive}
        under = [s for s, n in had.items() if self.released(s, slot) > n]
        left = slot - sum(had.values())
        if not left:
            return had
        since = min(self.at(had[s] - 1, self.weights[s])[0] if had[s] else 0 for s in under)
        first = {s: self.released(s, since) for s in self.alive}
        found = [(self.at(k + 1, self.weights[s])[1], s) for _, s, k in self.fill(first, since, slot) if k == had[s]]
        for _, s in sorted(found)[:left]:
            had[s] += 1
        return had


def block_slots(weights: Sequence[int], blocks: Sequence[int], begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(source, block) of the slots from begin to before end (the last, if None)."""
    made = Blocks(weights, blocks)
    for _, s, k in made.fill(made.before(begin), begin, made.total if end is None else min(end, made.total)):
        yield s, k


def _slots(targets: DataFrame) -> DataFrame:
    """pool, block and slot of every block of targets (pool, share, blocks).

    Slots are cut into ranges; a task that fills one finds out from the targets alone what every source had before.
    A range has a row per source and SOURCE_SLOTS times as many slots at least, so these rows stay fewer than blocks.
    Sources with a share of 0 come after all others, as equals.
    """
    out, offset = None, 0
    for part in (targets.where("share > 0"), targets.where("share = 0").withColumn("share", F.lit(1.0))):
        total, sources = part.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
        width = max(RANGE_SLOTS, SOURCE_SLOTS * sources)
        ranges = max(1, -(-total // width))
        dealt = part.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), "pool", "share", "blocks")
        dealt = dealt.repartition(min(ranges, RANGE_TASKS), "range").sortWithinPartitions("range", "pool")
        made = dealt.mapInArrow(partial(_fill_ranges, width, offset), "pool string, block long, slot long")
        out, offset = made if out is None else out.unionByName(made), offset + total
    return out


def _fill_ranges(width: int, offset: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, pool) -> the blocks of each range's slots; holds a row per source."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("range", "pool", "share", "blocks")), strict=True))
    for number, same in groupby(rows, key=lambda r: r[0]):
        _, pools, shares, blocks = zip(*same, strict=True)
        names, slot = pa.array(pools, pa.string()), number * width
        made = block_slots(exact_weights(shares), blocks, slot, slot + width)
        while chunk := list(islice(made, 1 << 16)):
            place = pa.array([s for s, _ in chunk], pa.int64())
            yield pa.RecordBatch.from_arrays([names.take(place), pa.array([k for _, k in chunk], pa.int64()), pa.array(range(offset + slot, offset + slot + len(chunk)), pa.int64())], ["pool", "block", "slot"])
            slot += len(chunk)


def _table(spark: SparkSession, shares: Mapping[str, float] | DataFrame) -> DataFrame:
    if isinstance(shares, DataFrame):
        return materialize(shares.select(F.coalesce("source", F.lit("")).alias("s"), F.col("share").cast("double").alias("share")))
    return spark.createDataFrame([(s, float(w)) for s, w in shares.items()], "s string, share double")


def _placed(docs: DataFrame, whole: Column, shares: Mapping[str, float] | DataFrame, block_docs: int, source: str) -> DataFrame:
    """(whole, pool, block, slot, place) of every row of docs."""
    given = _table(docs.sparkSession, shares)
    wrong = given.where("share is null or not (share >= 0 and share < double('Infinity'))").first()
    if wrong or given.count() > given.select("s").distinct().count():
        raise ValueError(f"shares must be finite, not negative, and one per source: {wrong}")
    mean = given.agg(F.avg("share")).first()[0] or 1.0
    buckets = max(1, min(1 << 31, docs.count() // BUCKET_ROWS))
    raw = _source(docs, source)
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    bucket = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets / (1 << 32))
    known = docs.select(raw.alias("s"), bucket.alias("bucket")).groupBy("s", "bucket").agg(F.count("*").alias("n")).join(given, "s", "left")
    pool = F.when(F.col("share").isNotNull(), F.col("s")).otherwise(F.lit(OTHER))
    sizes = materialize(known.groupBy(pool.alias("pool"), "bucket").agg(F.sum("n").alias("n"), F.coalesce(F.max("share"), F.lit(mean)).alias("share")))
    before = Window.partitionBy("pool").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pool", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    targets = sizes.groupBy("pool").agg(F.max("share").alias("share"), F.ceil(F.sum("n") / block_docs).alias("blocks"))
    low, high = F.floor(F.col("first") / block_docs), F.floor((F.col("first") + F.col("n") - 1) / block_docs)
    parts = offsets.select("pool", "bucket", "first", low.alias("low"), F.explode(F.sequence(low, high)).alias("block"))
    ahead = parts.join(_slots(targets), ["pool", "block"]).groupBy("pool", "bucket", "first", "low").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    rows = docs.select(whole.alias("whole"), raw.alias("s"), bucket.alias("bucket"), key.alias("key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    if sizes.where(F.col("pool") == OTHER).isEmpty():
        rows = rows.withColumnRenamed("s", "pool")
    else:
        rows = rows.join(given, "s", "left").withColumn("pool", pool)
    inside = Window.partitionBy("pool", "bucket").orderBy("key", "id", "th")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(materialize(ahead), ["pool", "bucket"]).withColumn("rank", F.col("first") + F.col("r"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_docs))
    slot = F.element_at("slots", (F.col("block") - F.col("low") + 1).cast("int"))  # a source's slots rise with its blocks
    return ranked.select("whole", F.when(F.col("pool") != OTHER, F.col("pool")).alias("pool"), "block", slot.alias("slot"), (F.col("rank") % block_docs).cast("int").alias("place"))


def schedule(docs: DataFrame, shares: Mapping[str, float] | DataFrame, block_docs: int = BLOCK_DOCS, source: str = "source") -> DataFrame:
    """doc_id, pool, block, slot and place (0 on, dense within its slot) of every row of docs.

    shares gives any number of sources a share, as a mapping or a table (source, share); rows of any other source,
    null included (as ''), share one pool (null in the result), weighted like the mean source. Sources with a share
    of 0 come after all others. In a pool documents lie in order of the md5 of doc_id and text hash; null and repeated
    ids are ids like others and repeated rows each have a place. An empty table gives no rows; other columns are not
    read, and without a source column all rows share the pool ''. Ranks are found per bucket of md5, so no pool is
    sorted in one task, nor one id with many texts; only rows alike in id and text share a bucket.
    """
    return _placed(docs, F.col("doc_id"), shares, block_docs, source).withColumnRenamed("whole", "doc_id")


def mix(docs: DataFrame, shares: Mapping[str, float] | DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of docs, all columns, range-partitioned and sorted in the order of the schedule.

    Every row stays, nulls, repeated rows and sources without a share included (see schedule); a table without a
    source column is one source; an empty table gives no rows.
    """
    shares = source_shares(docs) if shares is None else shares
    placed = _placed(docs, whole_rows(docs), shares, block_docs, "source")
    return placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("whole.*")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, text and position (0 on) of the rows of a mix that was written and read again.

    Scans pack files by size, so the order lies in the numbers of the files, which follow the ranges of the mix,
    and the rows within them. The driver holds a row per file. A table that is not read from files is written first.
    """
    try:
        rows = _filed(docs)
    except AnalysisException:
        rows = _filed(materialize(docs))
    sizes = [(r["file"], r["n"]) for r in rows.groupBy("file").agg(F.max("row") + 1).toDF("file", "n").collect()]
    first, starts = 0, []
    for file, n in sorted(sizes, key=lambda x: (int((re.findall(r"part-(\d+)", x[0]) or [0])[-1]), x[0])):
        starts.append((file, first))
        first += n
    before = docs.sparkSession.createDataFrame(starts, "file string, first long")
    return rows.join(F.broadcast(before), "file").select("doc_id", "text", (F.col("first") + F.col("row")).alias("position"))


def _filed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
