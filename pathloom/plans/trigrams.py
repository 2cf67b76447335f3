"""Which blocks of the manifest hold a trigram: pruning for patterns that no statistics serve.

A trigram is a number of three bytes. The manifest's rows carry the number of their block, some BLOCK rows in the order they are written,
so a block's rows lie together and a condition on its number skips row groups and pages. For every
trigram of the folded bytes of paths, a posting list names the blocks that hold it. A pattern's literals,
where it has any of three characters or more, say which trigrams a match must hold; the lists of a few
trigrams are read, intersected, and become ranges of block numbers ahead of the pattern itself. The
pattern decides, so ranges may hold too much but never too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import Needed

BLOCK = 16_384
SCHEMA = [T.StructField("gram", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("blocks", T.ArrayType(T.LongType()))]
#: Bytes as they count: A-Z as a-z.
FOLDED = np.array([b + 32 * (65 <= b <= 90) for b in range(256)], np.int32)
#: Ranges in a condition; nearest ones are joined beyond.
RANGES = 64
#: Blocks that may match, beyond which the whole is read.
MOST = 100_000
#: Trigrams looked up for one literal: the first, the last and some between say most.
LOOKED_UP = 8


def block_number(commit: str, rows: int | None = None) -> Column:
    """For rows in the order they are written: different in every commit and task, rising by one every some rows."""
    task = F.shiftleft(F.pmod(F.xxhash64(F.lit(commit)), F.lit(1 << 31)), 32) + F.shiftleft(F.spark_partition_id().cast("long") % 65_536, 16)
    return task + F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / (rows or BLOCK)) % 65_536


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of each run of rows of one repository and block."""
    for b in batches:
        if not b.num_rows:
            continue
        paths, blocks = b.column("path").cast(pa.large_binary()), b.column("block").to_numpy()
        repos = b.column("repo").dictionary_encode()
        offsets = np.frombuffer(paths.buffers()[1], np.int64)[paths.offset : paths.offset + len(paths) + 1]
        data = FOLDED[np.frombuffer(paths.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.int32)
        offsets = offsets - offsets[0]
        changes = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(repos.indices.to_numpy()) != 0)) + 1
        for first, last in zip([0, *changes], [*changes, len(blocks)], strict=True):
            d, ends = data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
            codes = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
            within, ends = np.ones(len(codes) + 2, bool), ends[ends > 0]
            within[ends - 1] = within[np.maximum(ends - 2, 0)] = False  # these go on into the next path
            codes = np.unique(codes[within[: len(codes)]])
            n = len(codes)
            repo = repos.dictionary[repos.indices[first].as_py()].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([repo] * n, pa.string()), pa.array(codes, pa.int32()), pa.array(np.full(n, blocks[first]), pa.int64())], names=["repo", "gram", "block"])


def of(stored: DataFrame) -> DataFrame:
    """repo, gram, part, blocks: posting lists, one row a trigram and writing task, sorted by trigram."""
    met = stored.select("repo", "block", "path").mapInArrow(_met, "repo string, gram int, block long")
    lists = met.groupBy("repo", "gram", F.shiftright("block", 16).alias("part")).agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    return lists.repartitionByRange("repo", "gram", "part").sortWithinPartitions("repo", "gram", "part")


def looked_up(literal: str) -> list[int]:
    """Some trigrams of a literal (a byte a character, folded), spread over it."""
    data = literal.encode("latin-1")
    found = list(dict.fromkeys(int.from_bytes(data[i : i + 3]) for i in range(len(data) - 2)))
    if len(found) <= LOOKED_UP:
        return found
    return [found[round(i * (len(found) - 1) / (LOOKED_UP - 1))] for i in range(LOOKED_UP)]


def ranges(blocks: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Sorted runs that cover block numbers, the closest ones joined until there are few."""
    runs: list[list[int]] = []
    for b in sorted(blocks):
        if runs and b <= runs[-1][1] + 1:
            runs[-1][1] = b
        else:
            runs.append([b, b])
    if len(runs) > most:
        gaps = sorted(runs[i + 1][0] - runs[i][1] for i in range(len(runs) - 1))
        width = gaps[len(runs) - most - 1]
        joined = [runs[0]]
        for run in runs[1:]:
            if run[0] - joined[-1][1] <= width:
                joined[-1][1] = run[1]
            else:
                joined.append(run)
        runs = joined
    return [(a, b) for a, b in runs]


def narrowed(grams: DataFrame, needed: Needed, column: str = "block") -> Column | None:
    """A condition on block numbers that every match meets; None if the pattern needs no trigram.

    needed is a choice of sets of literals. Posting lists are intersected in Spark; at most MOST
    numbers of blocks reach the driver, since a pattern that more may match gains nothing by pruning.
    """
    wanted = [{g for literal in literals for g in looked_up(literal)} for literals in needed]
    if not wanted or not all(wanted):
        return None
    every = sorted(set().union(*wanted))
    lists = grams.where(F.col("gram").isin(every)).select("gram", F.explode("blocks").alias("block"))
    held = lists.groupBy("block").agg(F.collect_set("gram").alias("held"))
    may = F.lit(False)
    for grams_needed in wanted:
        may = may | (F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(grams_needed))))) == len(grams_needed))
    blocks = [r["block"] for r in held.where(may).select("block").limit(MOST + 1).collect()]
    if len(blocks) > MOST:
        return None
    out = F.lit(False)
    for low, high in ranges(blocks):
        out = out | F.col(column).between(low, high)
    return out
