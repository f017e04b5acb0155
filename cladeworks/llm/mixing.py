"""Operator 3: mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents in hashed order. With target weight w its block j (from
0) may start at slot floor(j/w) and must be placed before slot ceil((j+1)/w); placing in every slot
the released block of the earliest deadline keeps each source within one block of its share at every slot. Weights are
fractions of a common denominator or, where that is large, of 2^62, so shares hold however many slots there are.

Slots are scheduled in ranges, in parallel. What earliest-deadline-first has placed before a slot T follows from the weights alone: all blocks
due by T, no block released at T or later, and of the others (one a source at most) those that it takes by deadline as long as for every slot s
no more blocks released from s on are placed than there are slots from s to T; only the s since the earliest release of such a block matter. So a range
starts from the counts at its first slot, without those before it.

A source that runs out leaves its slots empty. Once half of the slots would be empty, the sources that are left share anew (a stage ends: blocks due
later move to the next stage), so there are at most about twice as many slots as blocks. A block finds its place in the mix from running counts of documents over
slots, which are summed in parallel over small rows; documents are shuffled once, and none is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 16  # documents in a block
BUCKET_DOCS = 1_000  # documents of a source that are numbered together
RANGE_SLOTS = 1 << 18  # slots that are scheduled together, at least
LONGEST_RANGE = 1 << 26  # a source whose blocks lie farther apart leaves its stage in one range
SOURCES = 1 << 20  # sources at most: what is kept of them goes to every task
PART = 128  # slots that are summed together, then parts, then groups of parts
WHOLE = 62  # weights without a small common denominator are parts of 2^62
SMALL_WHOLE = 1 << 31
LAST_SLOT = (1 << 31) - 1  # slots of a stage at most: products with weights fit into 64 bits in two halves


@dataclass(frozen=True)
class Shares:
    """Weights as parts of a whole: exactly, if a common denominator of 31 bits does it, else out of 2^62."""

    parts: np.ndarray
    whole: int

    def before(self, slot: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """floor(w * slot) of the weights, exactly, and whether w * slot is more than that."""
        if self.whole <= SMALL_WHOLE:
            product = self.parts * slot
            return product // self.whole, product % self.whole != 0
        half = WHOLE // 2
        low = (self.parts & ((1 << half) - 1)) * slot
        high = (self.parts >> half) * slot + (low >> half)
        return high >> half, ((low | high) & ((1 << half) - 1)) != 0

    def released(self, i: int, block: int) -> int:
        return block * self.whole // int(self.parts[i])

    def releases(self, i: int, blocks: np.ndarray) -> np.ndarray:
        """released() of many blocks of a source, all before LAST_SLOT."""
        one = Shares(self.parts[i : i + 1], self.whole)

        def over(slot: np.ndarray) -> np.ndarray:
            whole, more = one.before(slot)
            return (whole > blocks) | ((whole == blocks) & more)

        slot = np.floor(blocks / (int(self.parts[i]) / self.whole)).astype(np.int64)  # right but for rounding
        slot -= over(slot)
        return slot + ~over(slot + 1)

    def due(self, i: int, block: int) -> int:
        return -(-(block + 1) * self.whole // int(self.parts[i]))


def whole_weights(weights: list[Fraction]) -> Shares:
    """Weights as shares: their sum is the whole. Out of 2^62 by largest remainders, one part at least."""
    total = sum(weights)
    exact = [w / total for w in weights]
    whole = 1
    for x in exact:
        whole = math.lcm(whole, x.denominator)
        if whole > SMALL_WHOLE:
            break
    else:
        return Shares(np.array([int(x * whole) for x in exact], dtype=np.int64), whole)
    exact = [x * (1 << WHOLE) for x in exact]
    parts = [max(1, x.numerator // x.denominator) for x in exact]
    spare = (1 << WHOLE) - sum(parts)
    by_rest = sorted(range(len(parts)), key=lambda i: parts[i] - exact[i])
    for i in by_rest[:spare] if spare > 0 else ():
        parts[i] += 1
    if spare < 0:  # very small weights were raised to one part
        parts[parts.index(max(parts))] += spare
    return Shares(np.array(parts, dtype=np.int64), 1 << WHOLE)


def placed_before(shares: Shares, slot: int) -> np.ndarray:
    """How many blocks of each source earliest-deadline-first has placed before a slot (ties of deadlines: the lower source).

    The work is that of the slots since the earliest release of a block that is open at the slot, the longest window at most.
    """
    done, between = shares.before(slot)
    spare = slot - int(done.sum())
    if not spare:
        return done
    open_ = np.nonzero(between)[0].tolist()
    release = np.array([shares.released(i, int(done[i])) for i in open_], dtype=np.int64)
    first = int(release.min())
    # for every slot from the first release on: the slots behind it that blocks released since and due by now don't need
    need = np.zeros(slot - first + 1, dtype=np.int64)
    for i, (from_, more) in enumerate(zip(*[x.tolist() for x in shares.before(first)])):
        since = shares.releases(i, np.arange(from_ + more, done[i]))
        np.add.at(need, since - first, 1)
    room = (slot - first - np.arange(len(need))) - np.cumsum(need[::-1])[::-1]
    # a block that is released at r is held by the room of all slots up to r: the least of each stretch between releases will do
    at = np.unique(release)
    least = np.minimum.reduceat(room[: int(at[-1]) - first + 1], np.append(0, at[:-1] - first + 1))
    place = np.searchsorted(at, release)
    for k in sorted(range(len(open_)), key=lambda k: (shares.due(open_[k], int(done[open_[k]])), open_[k])):
        if not spare:
            break
        if least[: place[k] + 1].min() > 0:
            least[: place[k] + 1] -= 1
            done[open_[k]] += 1
            spare -= 1
    return done


def scheduled(shares: Shares, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) of the slots of a range, earliest deadline first among released blocks."""
    # a block of a source is only ready once the one before it is placed
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    ready: list[tuple[int, int, int]] = []
    for i, block in enumerate(placed_before(shares, begin).tolist()):
        start = shares.released(i, block)
        if start <= begin:
            ready.append((shares.due(i, block), i, block))
        elif start < end:
            waiting.setdefault(start, []).append((shares.due(i, block), i, block))
    heapq.heapify(ready)
    for slot in range(begin, end):
        for entry in waiting.pop(slot, ()):
            heapq.heappush(ready, entry)
        _, i, block = heapq.heappop(ready)
        yield slot, i, block
        after = block + 1
        start = max(slot + 1, shares.released(i, after))
        if start < end:
            waiting.setdefault(start, []).append((shares.due(i, after), i, after))


@dataclass(frozen=True)
class Stage:
    """Slots that one set of sources shares: the sources, their weights, blocks placed before and at the end of the stage, first slot and number of slots."""

    sources: np.ndarray
    shares: Shares
    before: np.ndarray
    after: np.ndarray
    offset: int
    slots: int


def staged_plan(weights: list[Fraction], blocks: np.ndarray) -> list[Stage]:
    """The stages until all blocks are placed. A stage ends where the sources that ran out have half of the slots or more."""
    left, offset, out = blocks.copy(), 0, []
    while (active := np.nonzero(left)[0]).size:
        shares = whole_weights([weights[i] for i in active])
        over = [shares.due(k, int(left[i]) - 1) for k, i in enumerate(active)]
        order = sorted(range(len(active)), key=lambda k: over[k])
        gone, slots = 0, 0
        for k in order:
            gone += int(shares.parts[k])
            slots = int(min(over[k], LAST_SLOT))
            if 2 * gone >= shares.whole:
                break
        if len(active) == 1:
            slots = min(int(left[active[0]]), LAST_SLOT)
        done = np.minimum(shares.before(slots)[0], left[active])
        if not done.sum():  # no block is due yet, so go on until one is
            slots = min(shares.due(k, 0) for k in range(len(active)))
            done = np.minimum(shares.before(slots)[0], left[active])
        before = blocks[active] - left[active]
        out.append(Stage(active, shares, before, before + done, offset, slots))
        left[active] -= done
        offset += slots
    return out


def slots_of_blocks(spark, weights: list[Fraction], blocks: np.ndarray, range_slots: int) -> DataFrame:
    """(source: its number, block, slot) of all blocks: a task a range of slots."""
    stages = staged_plan(weights, blocks)
    ranges = []
    for k, s in enumerate(stages):
        # a range is as long as the longest window, so finding its start costs no more than the range itself
        length = max(range_slots, s.shares.whole // int(s.shares.parts.min()) + 1)
        length = s.slots if length > LONGEST_RANGE else length
        ranges += [(k, a, min(a + length, s.slots)) for a in range(0, s.slots, length)]
    known = spark.sparkContext.broadcast(stages)
    schema = "source int, block bigint, slot bigint"

    def schedule(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a, b in zip(*[batch.column(c).to_pylist() for c in ("stage", "begin", "end")]):
                stage = known.value[k]
                rows = np.array(list(scheduled(stage.shares, a, b)), dtype=np.int64).reshape(-1, 3)
                block = stage.before[rows[:, 1]] + rows[:, 2]
                rows, block = rows[kept := block < stage.after[rows[:, 1]]], block[kept]
                yield pa.RecordBatch.from_arrays([pa.array(stage.sources[rows[:, 1]], pa.int32()), pa.array(block), pa.array(rows[:, 0] + stage.offset)], ["source", "block", "slot"])

    table = spark.createDataFrame(ranges, "stage int, begin bigint, end bigint").repartition(max(1, len(ranges)), "stage", "begin") if len(ranges) > 1 else spark.createDataFrame(ranges, "stage int, begin bigint, end bigint")
    return table.mapInArrow(schedule, schema)


def _numbered(df: DataFrame, source: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with _source, _bucket and _row, their 0-based number there, and buckets with their _size and the _offset of their first row.

    A source's rows are spread over buckets by hash, as many as its size asks for; only rows of one
    bucket are sorted together, and buckets start where the counts of those before them end.
    """
    told_by = [c for c in ("doc_id", "text") if c in df.columns]
    named = df.withColumns({"_source": source, "_order": F.xxhash64(F.lit(17), *told_by)})
    counts = named.groupBy("_source").agg(F.count("*").alias("_total"))
    buckets = F.ceil(F.col("_total") / BUCKET_DOCS).cast("int")
    # one row per source, and target weights are given for sources: as small as the weights
    placed = named.join(F.broadcast(counts), "_source").withColumn("_bucket", F.pmod(F.shiftright("_order", 20), buckets))
    sizes = placed.groupBy("_source", "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_bucket", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", *[c for c in ("doc_id",) if c in df.columns])
    return placed.withColumn("_row", (F.row_number().over(inside) - 1).cast("long")), offsets


def numbered(df: DataFrame, source: Column) -> DataFrame:
    """Add _n, the 0-based number of a row in its source by hashed id."""
    rows, buckets = _numbered(df, source)
    return rows.join(buckets, ["_source", "_bucket"]).withColumn("_n", F.col("_offset") + F.col("_row"))


def named_source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _block_places(blocks: DataFrame) -> DataFrame:
    """Add _start, the documents before a row, to rows (slot, _offset, _docs), in order of slot, then offset."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("_docs").over(upto(w)), F.lit(0))
    parted = blocks.withColumn("_part", F.floor(F.col("slot") / PART))
    parts = parted.groupBy("_part").agg(F.sum("_docs").alias("_docs")).withColumn("_group", F.floor(F.col("_part") / PART))
    groups = parts.groupBy("_group").agg(F.sum("_docs").alias("_docs")).withColumn("_top", F.floor(F.col("_group") / PART))
    tops = groups.groupBy("_top").agg(F.sum("_docs").alias("_docs"))  # one row for PART * PART * PART slots
    high = tops.select("_top", before(Window.orderBy("_top")).alias("_high"))
    middle = groups.withColumn("_middle", before(Window.partitionBy("_top").orderBy("_group"))).join(high, "_top")
    low = parts.withColumn("_low", before(Window.partitionBy("_group").orderBy("_part"))).join(middle.select("_group", "_middle", "_high"), "_group")
    within = before(Window.partitionBy("_part").orderBy("slot", "_offset"))
    first = low.select("_part", (F.col("_low") + F.col("_middle") + F.col("_high")).alias("_first"))
    return parted.withColumn("_within", within).join(first, "_part").withColumn("_start", F.col("_first") + F.col("_within"))


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, range_slots: int = RANGE_SLOTS) -> DataFrame:
    """Add block, slot and position (0-based, dense: the mixed order) to every document.

    Target weights are per source; None takes size to the given power. Sources without a weight
    get the least given one; no weights at all, or one that is not above 0, is a ValueError, as are more than SOURCES sources. At every slot of a stage (see
    above; the first lasts until sources with half of the weight have run out) a source that hasn't run out has its weight's share of the slots to within one block. A null source is the source ''. Order inside a
    source is by hash of id and, where there is one, text, then id; rows alike in these are interchangeable. Input
    columns named block, slot or position are replaced, all others come back as they are; an empty table stays empty.
    """
    spark = df.sparkSession
    if weights is not None and (not weights or not all(w > 0 and math.isfinite(w) for w in weights.values())):
        raise ValueError("weights must name one source at least, each with a number above 0")
    out = df.drop("block", "slot", "position")
    sizes = df.groupBy(named_source().alias("s")).agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()  # a row a source
    if not sizes:
        return out.withColumns({c: F.lit(None).cast("long") for c in ("block", "slot", "position")})
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: give rare ones a common name")
    sizes = sorted((r.s, r.n) for r in sizes)
    least = min(weights.values()) if weights else 0
    exact = [Fraction(str(weights.get(s, least))) if weights else Fraction(n**power) for s, n in sizes]  # 0.1 means a tenth
    n_blocks = np.array([-(-n // BLOCK_DOCS) for _, n in sizes], dtype=np.int64)
    slots = slots_of_blocks(spark, exact, n_blocks, range_slots)
    numbers = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(sizes)], "_source string, source int")
    # the input row travels in one column, so its names can't clash with those used here
    told = [c for c in ("doc_id", "text") if c in out.columns]
    packed = out.select(F.struct(*[F.col(c) for c in out.columns]).alias("_all"), *told, named_source().alias("_mixed"))
    documents, buckets = _numbered(packed, F.col("_mixed"))
    per_block = F.lit(BLOCK_DOCS).cast("long")
    stop = F.col("_offset") + F.col("_size")
    spans = F.sequence(F.floor(F.col("_offset") / per_block), F.floor((stop - 1) / per_block))
    blocks = (
        buckets.withColumn("block", F.explode(spans)).join(F.broadcast(numbers), "_source")  # a row a source, SOURCES at most
        .withColumn("_docs", F.least(stop, (F.col("block") + 1) * per_block) - F.greatest("_offset", F.col("block") * per_block))
        .join(slots, ["source", "block"])
    )
    # back to one row per bucket: its blocks, few as its documents are, in order
    per_bucket = _block_places(blocks).groupBy("_source", "_bucket").agg(
        F.first("_offset").alias("_offset"), F.array_sort(F.collect_list(F.struct("block", "slot", "_start"))).alias("_blocks")
    )
    n = F.col("_offset") + F.col("_row")
    block = F.floor(n / per_block)
    mine = F.element_at("_blocks", (block - F.floor(F.col("_offset") / per_block) + 1).cast("int"))
    placed = documents.join(per_bucket, ["_source", "_bucket"]).withColumns({"_n": n, "block": block, "_mine": mine})
    position = F.col("_mine._start") + F.col("_n") - F.greatest("_offset", F.col("block") * per_block)
    return placed.select("_all.*", "block", F.col("_mine.slot").alias("slot"), position.alias("position"))
