"""Minimax contiguous partition: cut an ordered list of atomic groups into shards of the smallest largest size.

Rows with equal texts form one atomic group. Groups are ordered by a 64-bit hash of their text, which
needs no sort to start from: the key line is held on the driver as some thousand cells (a cell:
a range of keys, its total size). Filling shards greedily with cells as atoms bounds the least capacity
from above, and with cells of several groups cut anywhere, from below. Cells at the cuts of these two
fillings are counted again in finer cells, ROUND_CELLS at most a round, until the bounds meet.
Below that capacity the cuts are moved so that all shards are in use and as near to their mean as the
cells allow. Groups larger than a fair share have a shard each, and the rest is dealt as if they weren't there.
Every step is an aggregation over narrow rows; texts never move.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

FIRST_BITS = 14
STEP_BITS = 8
#: Cells counted again in one round: the driver gets 2 ** STEP_BITS rows for each at most.
ROUND_CELLS = 256
#: A cell of several groups holds this part of a fair share at most when cuts are placed.
GRAIN = 32

#: least key, largest key, size, number of groups, bits of the key that its groups share at least
Cell = tuple[int, int, int, int, int]


def _ends(cells: list[Cell]) -> list[int]:
    ends, total = [], 0
    for c in cells:
        ends.append(total := total + c[2])
    return ends


def _fill(cells: list[Cell], ends: list[int], capacity: int, shards: int, whole: bool) -> list[int] | None:
    """Numbers of the cells at which shards filled greedily end, or None if ``shards`` don't suffice. whole: a cell is
    never cut; else one of several groups is cut anywhere, so no true partition needs more shards."""
    cuts, at, base = [], 0, 0
    while True:
        at = bisect_right(ends, base + capacity, lo=at)
        if at >= len(ends):
            return cuts
        if len(cuts) == shards - 1:
            return None
        end = base + capacity if not whole and cells[at][3] > 1 else ends[at - 1] if at else 0
        if end <= base:
            return None
        cuts.append(at)
        base = end


def _least(cells: list[Cell], ends: list[int], low: int, shards: int, whole: bool) -> int:
    """The smallest capacity, ``low`` at least, for which ``shards`` suffice."""
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _fill(cells, ends, middle, shards, whole) is None:
            low = middle + 1
        else:
            high = middle
    return low


def search(cells: list[Cell], largest: int, shards: int, finer: Callable[[list[Cell]], list[Cell]]) -> tuple[int, list[int]]:
    """Least capacity and the keys that begin shards 1, 2, ... of near equal size within it; largest: size of the
    largest group; finer: counts cells again, each in 2 ** STEP_BITS finer ones at most."""
    while cells:
        ends = _ends(cells)
        floor = max(-(-ends[-1] // shards), largest)
        low = _least(cells, ends, floor, shards, False)
        high = _least(cells, ends, low, shards, True)
        split = sorted((i for i, c in enumerate(cells) if c[3] > 1 and c[2] * GRAIN * shards > ends[-1]), key=lambda i: -cells[i][2])[:ROUND_CELLS]
        if low == high and not split:
            return high, [cells[i][0] for i in _even(ends, high, shards)]
        if not split:
            split = _split(cells, [*_fill(cells, ends, low, shards, False), *_fill(cells, ends, high, shards, True)])
        # A filling with ``low`` cuts a cell of several groups, or it would be one of whole cells and low == high.
        assert 0 < len(split) <= ROUND_CELLS
        gone = set(split)
        cells = sorted([c for i, c in enumerate(cells) if i not in gone] + finer([cells[i] for i in split]))
    return 0, []


def _even(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Numbers of the cells that begin shards 1, 2, ...: each cut is the one nearest to an even division of what is left
    that lets the other shards stay within ``capacity``. As many shards as there are cells, ``shards`` at most."""
    shards = min(shards, len(ends))
    total = ends[-1]
    latest = [len(ends)]  # the first cell of the longest end of the line that 0, 1, ... shards can hold
    for _ in range(1, shards):
        # cell i may begin the shard if what lies before it, ends[i - 1], is at least that much
        least = (ends[latest[-1] - 1] if latest[-1] else 0) - capacity
        latest.append(bisect_left(ends, least) + 1 if least > 0 else 0)
    cuts, at, base = [], 0, 0
    for rest in range(shards - 1, 0, -1):
        first = max(at + 1, latest[rest])
        last = min(bisect_right(ends, base + capacity), len(ends) - rest)
        want = base + (total - base) / (rest + 1)
        near = min(max(bisect_left(ends, want), first), last)  # the shard ends before ``want`` or with the cell that holds it
        at = min((i for i in (near, near + 1) if first <= i <= last), key=lambda i: abs(ends[i - 1] - want))
        cuts.append(at)
        base = ends[at - 1]
    return cuts


def _split(cells: list[Cell], cuts: list[int]) -> list[int]:
    """Numbers of the cells of several groups that are nearest to the cuts, ROUND_CELLS at most."""
    found: dict[int, None] = {}
    for off in range(ROUND_CELLS):
        for at in cuts:
            for i in (at + off, at - off):
                if 0 <= i < len(cells) and cells[i][3] > 1:
                    found[i] = None
                    if len(found) == ROUND_CELLS:
                        return list(found)
    return list(found)


def boundaries(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and the keys that begin shards 1, 2, ...; groups: columns key (long), size (long), a row a group."""
    spark = groups.sparkSession
    order = F.col("key")
    sums = [F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("s"), F.count("*").alias("n")]
    rows = groups.groupBy(F.shiftright(order, 64 - FIRST_BITS).alias("cell")).agg(*sums, F.max("size").alias("most")).collect()

    def finer(cells: list[Cell]) -> list[Cell]:
        ranges = spark.createDataFrame([(c[0], c[1], min(64, c[4] + STEP_BITS)) for c in cells], "lo long, hi long, bits int")
        # equal leading FIRST_BITS put a key beside the few ranges that can hold it: an equi-join, then a check
        fine = groups.withColumn("top", F.shiftright("key", 64 - FIRST_BITS)).join(F.broadcast(ranges.withColumn("top", F.shiftright("lo", 64 - FIRST_BITS))), "top").where(order.between(F.col("lo"), F.col("hi")))
        return [(r.a, r.b, r.s, r.n, r.bits) for r in fine.groupBy("lo", "bits", F.expr("shiftright(key, 64 - bits)").alias("cell")).agg(*sums).collect()]

    return search(sorted((r.a, r.b, r.s, r.n, FIRST_BITS) for r in rows), max((r.most for r in rows), default=0), shards, finer)


def dealt(groups: DataFrame, shards: int) -> tuple[int, list[int], list[int]]:
    """Capacity, the keys of the groups that have a shard each, and the keys that begin shards 1, 2, ... of the others."""
    top = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    left = groups.agg(F.sum("size")).first()[0] or 0
    alone: list[int] = []
    for r in top:
        # the fair share of what is left falls with each group set apart
        if r["size"] * (shards - len(alone)) <= left or len(alone) == shards - 1:
            break
        alone.append(r.key)
        left -= r["size"]
    capacity, starts = boundaries(groups.where(~F.col("key").isin(alone)) if alone else groups, shards - len(alone))
    if alone and capacity > top[0]["size"]:
        whole, cuts = boundaries(groups, shards)
        if whole < capacity:
            return whole, [], cuts
    return max(capacity, top[0]["size"] if alone else 0), alone, starts


def minimax_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal documents to shards of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ('bytes'), shard, slot (from 0
    in each shard, no gaps), grown_shard (null). A null text counts as empty; repeated rows are rows of
    their own; an empty table gives an empty result; further columns of docs are ignored. A group larger than
    a fair share has a shard of its own: it isn't split, since equal texts stay together. The others are dealt to
    the shards that remain; no shard is empty if there are as many different texts.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = kept(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    groups = kept(rows.groupBy("key").agg(F.sum("size").alias("size")))
    _, alone, starts = dealt(groups, shards)
    shard = F.lit(len(alone))  # a shard each for the first ones
    for start in starts:
        shard = shard + F.when(F.col("key") >= F.lit(start), 1).otherwise(0)
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(key), i).otherwise(shard)
    # key and doc_id together spread a hot group over many partitions; ranks need only each partition's counts
    placed = kept(rows.withColumn("shard", shard.cast("int")).repartitionByRange("shard", "key", "doc_id").sortWithinPartitions("shard", "key", "doc_id", "text_crc32").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = [tuple(r) for r in counts.orderBy("shard", "part").collect()]  # a few per partition
    seen: dict[int, int] = {}
    shift = []
    for s, p, first, n in before:
        shift.append((s, p, seen.get(s, 0) - first))
        seen[s] = seen.get(s, 0) + n
    shifts = docs.sparkSession.createDataFrame(shift, "shard int, part long, shift long")
    return placed.join(F.broadcast(shifts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
