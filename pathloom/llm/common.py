"""Helpers shared by the corpus operators: tables, cut lineage, checked broadcasts, components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without it a fresh local folder serves a local session; a cluster needs the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/") or tempfile.mkdtemp(prefix="pathloom-")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's own file system has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def configured(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """What runs meanwhile runs with another value of a setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame, dealt: bool = False) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder of spark.checkpoint.dir.

    dealt: df ends in a repartition by key, and what groups by that key later shall not move the
    rows again. A plan that is adapted while it runs doesn't say how its rows are dealt, so this
    one isn't.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if not dealt:
        return df.checkpoint()
    with configured(spark, "spark.sql.adaptive.enabled", "false"):
        return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark deletes shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, else as it is.

    df is evaluated to count it, so pass something settled or cheap.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def _by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with its columns as _0, _1, ... and the named ones, each found by its exact name if there is one, else whatever its case."""
    folded = [c.lower() for c in df.columns]
    at = [df.columns.index(n) if n in df.columns else folded.index(n.lower()) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), [F.col(f"_{i}").alias(n) for n, i in zip(names, at, strict=True)]


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else df holds: names that differ in case, dots, backticks."""
    plain, chosen = _by_place(df, *names)
    return plain.select(*chosen)


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs as _0, _1, ... and the needed ones under their own names too.

    Whatever names docs has, none clashes with what an operator adds; `restored` undoes it.
    """
    plain, chosen = _by_place(docs, *needed)
    return plain.select("*", *chosen)


def restored(df: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of docs again, and more; one of docs with a name in more, in whatever case, gives way."""
    given = {m.lower() for m in more}
    return df.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in given], *more)


def folded(array: Column, at: Column, item_type: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 256) -> Column:
    """The items, null left out, that step(at, element) makes along an array; step returns the next `at` and an item.

    Appending to an array copies it, so items are gathered in blocks of bounded size that are
    joined at the end: the work grows with the array, not with its square.
    """
    empty = F.array().cast(f"array<{item_type}>")

    def one(acc: Column, x: Column) -> Column:
        after, item = step(acc["at"], x)
        return F.struct(after.alias("at"), F.when(item.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(item))).alias("found"))

    def whole(a: Column) -> Column:  # a lambda's variable: the array is made once, not once a block
        def some(acc: Column, b: Column) -> Column:
            done = F.aggregate(F.slice(a, b * block + 1, F.lit(block)), F.struct(acc["at"].alias("at"), empty.alias("found")), one)
            return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["found"], F.array(d["found"])).alias("found")))[0]

        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        zero = F.struct(at.alias("at"), F.array().cast(f"array<array<{item_type}>>").alias("found"))
        return F.when(F.size(a) > 0, F.flatten(F.aggregate(blocks, zero, some, lambda acc: acc["found"]))).otherwise(empty)

    return F.transform(F.array(array), whole)[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node id that links reach), for every node of the edges.

    Large-star and small-star rounds, each one shuffle on a node id: a hub's links are rewritten
    to its smallest neighbour, so that no node keeps a long list and the number of rounds grows
    with the logarithm of the longest path. Each round is settled; nothing reaches the driver
    but one count.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    links = settled(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = settled(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum((F.xxhash64("v", "u") % 999_983))).first()
        if now == before:
            break
        before = now
    roots = links.select("v").distinct().select(F.col("v").alias("u"), "v")
    return links.union(roots).groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For 0..n-1 the smallest number that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys, from batches sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        at = np.flatnonzero(change)
        pieces = [batch.iloc[a:b] for a, b in zip(at, [*at[1:], len(batch)], strict=True)]
        for piece in pieces:
            if held and (held[-1][keys].iloc[-1] != piece[keys].iloc[0]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
