"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group, sized in bytes (UTF-8 length plus 1 a row).
Groups stand in the order of the MD5 of their text. The smallest capacity is sought at which
cutting greedily needs no more shards than asked for, and the order is cut there. A group larger
than an even share of what is left gets a shard to itself first, since it can't be split.

The search runs on sums of ranges of that order: Spark sums 4096 ranges, the driver searches
with bounds on what it can't see inside a range, and only the ranges in which a cut may fall are
summed again 4096 times finer, until the capacity is exact. The driver holds some ten thousand
sums whatever the number of groups.

Slots are numbered in cells, ranges of the order times salts of id and text, so that no cell holds a
large group whole; cells grow in number with the rows, and beyond BROADCAST_CELLS their first slots
are joined by a shuffle. Only rows that repeat both text and id share a cell whatever their number.

Defined results: a null text counts as empty; texts of any length are hashed whole; a null id sorts first within its shard; repeated
rows fall in the same shard and get slots of their own; fewer groups than shards leave shards
empty; equal texts and ids tie, in no order between them; an empty table gives no rows. Other columns
pass through; those named as what is added, in whatever case, give way.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, picked, restored, settled, small_side

SHARDS = 16
#: Hex digits by which a range is refined: 4096 ranges.
DIGITS = 3
#: Slots are numbered in cells of CELL_ROWS rows at most on average: ranges of the order, each split by salts of the id.
CELL_DIGITS, CELL_ROWS, LEAST_SALTS = 1, 1_000_000, 64
#: Cells up to which the table of their first slots (some 30 bytes a row) is broadcast.
BROADCAST_CELLS = 200_000


def measured(docs: DataFrame) -> DataFrame:
    """docs with size, text_crc32 and _key, the MD5 of the text in hex."""
    whole = F.coalesce("text", F.lit(""))
    raw = whole.cast("binary")
    return docs.withColumns({"size": (F.octet_length(whole) + 1).cast("long"), "text_crc32": F.crc32(raw), "_key": F.md5(raw)})


class Ranges:
    """Sums of consecutive ranges of the order: key prefix, bytes, and whether it is one group."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.edges = [0, *accumulate(size for _, size, _ in self.rows)]
        self.total = self.edges[-1]

    def at(self, x: int) -> int:
        """The last range that starts at or before x."""
        return bisect_right(self.edges, x) - 1

    def surely(self, capacity: int, shards: int) -> list[int]:
        """Where greedy cuts fall if ranges are never split."""
        cuts = [0]
        for _ in range(shards):
            cuts.append(self.edges[self.at(cuts[-1] + capacity)])
        return cuts

    def at_most(self, capacity: int, shards: int) -> list[int]:
        """A bound that greedy cuts don't pass if ranges of several groups may be split."""
        cuts = [0]
        for _ in range(shards):
            x = cuts[-1] + capacity
            i = self.at(x)
            whole = i == len(self.rows) or self.rows[i][2] == 1
            cuts.append(self.edges[i] if whole else x)
        return cuts


def least(low: int, high: int, holds) -> int:
    """The smallest number in low..high for which holds, given that it holds at high."""
    while low < high:
        middle = (low + high) // 2
        if holds(middle):
            high = middle
        else:
            low = middle + 1
    return low


def cut_keys(groups: DataFrame, shards: int) -> list[str]:
    """Key prefixes at which shards 1, 2, ... begin. groups: _key, bytes."""

    def summed(of: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        by = F.substring("_key", 1, digits)
        return [tuple(r) for r in of.groupBy(by.alias("p")).agg(F.sum("bytes"), F.count("*")).collect()]

    ranges, largest = Ranges(summed(groups, DIGITS)), groups.agg(F.max("bytes")).first()[0] or 0
    if not ranges.total:
        return []
    while True:
        low = max(largest, -(-ranges.total // shards))
        feasible = least(low, ranges.total, lambda c: ranges.surely(c, shards)[-1] >= ranges.total)
        possible = least(low, feasible, lambda c: ranges.at_most(c, shards)[-1] >= ranges.total)
        if possible == feasible:
            break
        finer: dict[int, list[str]] = {}
        for a, b in zip(ranges.surely(possible, shards), ranges.at_most(feasible, shards), strict=True):
            for prefix, _, n in ranges.rows[ranges.at(a) : ranges.at(b) + 1]:
                if n > 1:
                    finer.setdefault(len(prefix), []).append(prefix)
        if not finer:
            break
        split = {p for ps in finer.values() for p in ps}
        rows = [r for r in ranges.rows if r[0] not in split]
        for digits, prefixes in finer.items():
            rows += summed(groups.where(F.substring("_key", 1, digits).isin(prefixes)), digits + DIGITS)
        ranges = Ranges(rows)
    cuts = ranges.surely(feasible, shards)[1:]
    return [ranges.rows[i][0] for i in sorted({ranges.at(c) for c in cuts if c < ranges.total})]


def plan(measured_docs: DataFrame, shards: int = SHARDS) -> tuple[list[str], list[str]]:
    """Keys of the groups with a shard of their own, and the cuts between the other shards."""
    groups = settled(measured_docs.groupBy("_key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for key, size in groups.orderBy(F.desc("bytes"), "_key").limit(shards - 1).collect():
        if size * (shards - len(alone)) <= total:
            break
        alone.append(key)
        total -= size
    rest = groups.where(~F.col("_key").isin(alone)) if alone else groups
    return alone, cut_keys(rest, shards - len(alone))


def salt(salts: int) -> Column:
    """Which part of its cell a row is in, by id and text: rows without an id are dealt by their texts."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "_key"), F.lit(salts)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, adding: tuple[str, ...] = ("size", "text_crc32", "shard", "slot")) -> DataFrame:
    """docs with size, text_crc32, shard and slot, or those named, slots being gapless from 0 in each shard."""
    m = measured(apart(docs, "doc_id", "text"))
    # a group of any size is split: so many salts that a third of all rows is in cells of bounded size
    salts = max(LEAST_SALTS, -(-docs.count() // CELL_ROWS))
    alone, cuts = plan(m, shards)
    number = F.lit(len(alone))
    for cut in cuts:
        number = number + F.when(F.col("_key") >= cut, 1).otherwise(0)
    for i, key in enumerate(alone):
        number = F.when(F.col("_key") == key, i).otherwise(number)
    cells = m.withColumns({"shard": number.cast("int"), "_cell": F.substring("_key", 1, CELL_DIGITS), "_salt": salt(salts)})
    counts = cells.groupBy("shard", "_cell", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_cell", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_cell", "_salt").orderBy("_key", "doc_id")
    slotted = cells.join(small_side(settled(starts), BROADCAST_CELLS), ["shard", "_cell", "_salt"]).withColumn("slot", F.col("_start") + F.row_number().over(within) - 1)
    return restored(slotted, docs, *adding)


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    s = shard(picked(docs, "doc_id", "text"), shards)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
