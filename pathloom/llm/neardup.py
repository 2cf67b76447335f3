"""Embedding near-duplicates: sign hashing in several tables, exact cosines, components.

1. Equal vectors form a class; only classes are compared.
2. Every class gets one key a table, the signs of its projections on a few random hyperplanes,
   and a sketch of 256 more signs. Bits a key grow with the logarithm of the number of vectors,
   and tables so that a pair at the threshold shares a key with probability RECALL.
3. In a bucket members are tied to leaders: the first member not near (by sketch, with five
   standard deviations to spare) any leader so far becomes one; members are tied to every leader
   they are near. All buckets of a batch go on at once. This runs first within each task
   that makes keys, so a bucket that holds a third of all rows is down to a few leaders before
   the shuffle, and again over the leaders of all tasks, which are read as a stream.
4. Connected components of the ties are the clusters in which vectors can link. Large clusters
   are cut into chunks; each pair of chunks is a group of bounded size in which every cosine is
   computed in double precision. Groups return one row a class: links and the root of its links.
5. Components of these roots are the result.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing; vectors of different lengths don't link, those of any length are read whole; ties of
ids go to the smallest; repeated rows are copies; a repeated id
gets a row each time; an empty table gives no rows. Columns but id and vector are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, picked, rooted, settled, small_side, whole_groups

COSINE, RECALL = 0.9, 0.99
SKETCH = 256
CHUNK = 2048
SEED = 6
#: Cluster members up to which (some 60 bytes a row) they are broadcast to the vectors.
BROADCAST_MEMBERS = 500_000


def layout(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits a key and tables for so many vectors."""
    bits = max(8, math.ceil(math.log2(max(2, vectors))) - 3)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def most_differing(cosine: float = COSINE) -> int:
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Doubles, or None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x if len(x) and np.isfinite(x).all() and x.any() else None
        out.append(x)
    return out


def key_of(x: np.ndarray) -> bytes:
    return hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()


def hyperplanes(n: int, length: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, n))


def hashed(classes: list[bytes], vectors: list[np.ndarray], bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (one row a vector, one column a table) and sketches (four words) of vectors of one length."""
    m = np.stack(vectors)
    signs = m @ hyperplanes(SKETCH + bits * tables, m.shape[1]) > 0
    sketches = np.packbits(signs[:, :SKETCH], axis=1).view(np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(bits, dtype=np.uint64))
    keys = signs[:, SKETCH:].reshape(len(m), tables, bits).astype(np.uint64) @ weights
    salt = np.arange(tables, dtype=np.uint64) * np.uint64(2**20) + np.uint64(m.shape[1] % 2**20)
    return (keys * np.uint64(0x9E3779B97F4A7C15) ^ salt * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64), sketches


def led(keys: np.ndarray, sketches: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ties (member, leader) by row, and which rows lead. Rows of a bucket follow each other; the first of them leads."""
    bucket = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)])) if len(keys) else np.empty(0, np.int64)
    open_, leads = np.ones(len(keys), bool), np.zeros(len(keys), bool)
    rows, ties = np.arange(len(keys)), []
    while len(rows):
        waiting = rows[open_[rows]]
        first = waiting[np.concatenate([[True], bucket[waiting[1:]] != bucket[waiting[:-1]]])] if len(waiting) else waiting
        if not len(first):
            break
        leads[first], open_[first] = True, False
        # rows of buckets with a new leader, and the leader's place for each
        at = np.searchsorted(bucket[first], bucket[rows])
        at[at == len(first)] = 0
        mine = (bucket[first][at] == bucket[rows]) & ~leads[rows]
        rows, leader = rows[mine], first[at[mine]]
        near = np.bitwise_count(sketches[rows] ^ sketches[leader]).sum(axis=1) <= most
        ties.append((rows[near], leader[near]))
        open_[rows[near]] = False
    member, leader = (np.concatenate([t[i] for t in ties]) if ties else np.empty(0, np.int64) for i in (0, 1))
    return member, leader, leads


TIES = "key long, class binary, sketch binary, hub binary"


def tied_in_task(bits: int, tables: int, most: int):
    """Per batch: ties within its buckets, and each bucket's leaders (hub null) to go on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_length: dict[int, dict[bytes, np.ndarray]] = {}
            for x in vectors_of(b.column("embedding")):
                if x is not None:
                    by_length.setdefault(len(x), {})[key_of(x)] = x
            for own in by_length.values():
                keys, sketches = hashed(list(own), list(own.values()), bits, tables)
                classes, packed = pa.array(list(own), pa.binary()), pa.array([x.tobytes() for x in sketches], pa.binary())
                for t in range(tables):
                    order = np.argsort(keys[:, t], kind="stable")
                    k = keys[order, t]
                    member, leader, leads = led(k, sketches[order], most)
                    for i, sketch, hub in ((member, None, leader), (np.flatnonzero(leads), packed, None)):
                        rows, none = pa.array(order[i]), pa.nulls(len(i), pa.binary())
                        columns = [pa.array(k[i]), classes.take(rows), sketch.take(rows) if sketch is not None else none, classes.take(pa.array(order[hub])) if hub is not None else none]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "class", "sketch", "hub"])

    return of


def tied_in_buckets(most: int):
    """Leaders of all tasks, sorted by bucket, read as a stream: only leaders stay in memory."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # leaders of the last bucket so far, which the next batch may go on with
        last, held, held_sketches = None, pa.array([], pa.binary()), np.empty((0, SKETCH // 64), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            k, ids = b.column("key").to_numpy(), b.column("class")
            sketches = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(len(k), -1)
            if last is not None and k[0] == last:
                k, ids, sketches = np.concatenate([np.full(len(held), last), k]), pa.concat_arrays([held, ids]), np.concatenate([held_sketches, sketches])
            member, leader, leads = led(k, sketches, most)
            last = k[-1]
            kept = np.flatnonzero(leads & (k == last))
            held, held_sketches = ids.take(pa.array(kept)), sketches[kept]
            if len(member):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(member)), ids.take(pa.array(leader))], names=["class", "hub"])

    return of


def compared(cosine: float):
    """class, links, root for the classes of each group of (cluster, lo, hi)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(batches, ["cluster", "lo", "hi"]):
            g = g.reset_index(drop=True)
            m = np.stack([np.asarray(v, np.float64) for v in g["vector"]])
            m = m / np.abs(m).max(axis=1, keepdims=True)
            m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
            chunk, copies, keys = g["chunk"].to_numpy(), g["copies"].to_numpy(), g["class"].to_numpy()
            lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
            left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
            near = m[left] @ m[right].T >= cosine
            if lo == hi:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            links = np.bincount(i, copies[j], len(g)) + np.bincount(j, copies[i], len(g))
            some = links > 0
            if some.any():
                yield pd.DataFrame({"class": keys[some], "links": links[some].astype(np.int64), "root": keys[rooted(len(g), i, j)][some]})

    return of


def joined(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    v = picked(vectors, vec_id, embedding).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    id_type = v.schema["vec_id"].dataType.simpleString()
    bits, tables = layout(v.count(), cosine, recall)
    most = most_differing(cosine)

    def with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [None if x is None else key_of(x) for x in vectors_of(b.column("embedding"))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary())], names=["vec_id", "class"])

    ids = settled(v.mapInArrow(with_class, f"vec_id {id_type}, class binary"))
    classes = settled(ids.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    local = settled(v.select("embedding").mapInArrow(tied_in_task(bits, tables, most), TIES))
    leaders = local.where("hub IS NULL").select("key", "class", "sketch").repartition("key").sortWithinPartitions("key")
    ties = local.where("hub IS NOT NULL").select("class", "hub").unionAll(leaders.mapInArrow(tied_in_buckets(most), "class binary, hub binary"))
    clusters = settled(components(ties, "class", "hub"))
    chunks = clusters.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = clusters.join(chunks, "component").withColumnRenamed("node", "class").join(classes.select("class", "copies"), "class")
    members = settled(members.select("class", F.col("component").alias("cluster"), "copies", "chunks", F.pmod(F.xxhash64("class"), "chunks").cast("int").alias("chunk")))

    def with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {key_of(x): x for x in vectors_of(b.column("embedding")) if x is not None}
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.list_(pa.float64()))], names=["class", "vector"])

    found = v.select("embedding").mapInArrow(with_vector, "class binary, vector array<double>").join(small_side(members, BROADCAST_MEMBERS), "class").dropDuplicates(["class"])
    placed = found.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("class", "cluster", "copies", "chunk", "vector", F.least("chunk", "_o").alias("lo"), F.greatest("chunk", "_o").alias("hi"))
    placed = placed.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    links = settled(placed.mapInPandas(compared(cosine), "class binary, links long, root binary"))
    groups = components(links.select("class", "root"), "class", "root").withColumnRenamed("node", "class").join(classes, "class")
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = groups.select("class", "component").join(smallest, "component").join(links.groupBy("class").agg(F.sum("links").alias("links")), "class")
    per_class = classes.join(linked.select("class", "component_id", "links"), "class", "left")
    per_class = per_class.select("class", F.coalesce("component_id", "first").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = ids.join(per_class, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
