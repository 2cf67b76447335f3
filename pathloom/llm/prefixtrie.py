"""Prefix tries of conversations: a double array a shard, shared upper nodes merged globally.

1. A turn becomes a key of 24 bytes, 16 of the digest of its role and text and 8 of the text's
   length; texts are read once and don't move. A conversation becomes its path, its keys joined.
2. Equal paths become one row, with their members' number, smallest id and the digest of all ids,
   which is made of sorted runs of ids of bounded length, so that a crowd of equal conversations is
   neither gathered nor sorted in one piece.
3. Paths are dealt by ranges, so a shard holds prefixes that lie next to each other; a common first
   turn is spread over as many shards as it needs. A task cuts its sorted paths into blocks of some
   BLOCK turns, and packs each into a double array: turn keys get dense numbers in the order they are
   met from the root down, BASE and CHECK take a node's children where their numbers fit, several
   children first and single ones in the holes. Walking the paths through the arrays yields the
   nodes and sums.
4. What other blocks may share lies on a block's first and last path. Those nodes' partial figures
   are merged by the digest of their prefix; sums over subtrees run up the merged nodes in
   doubling steps, so that a path of n turns takes log n rounds.

In the registered rebuilding, a conversation takes its first turns over from the one whose id is
the multiple of SPAN below, which makes prefixes that many share.

Defined results: null roles and texts are empty; turns follow each other by number, null first, then
by the digest of role and text, repeated rows included; rows without a conversation id belong to no
conversation, so no node counts them; texts are digested whole; a conversation is one path, and so
may hold some 10 million turns; a table without conversations has no nodes. Other columns count for
nothing, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, settled, small_side
from .merkle import CRC32

KEY = 24
#: Turns in one double array, but for a longer path, which has one of its own.
BLOCK = 100_000
#: Ids in a run.
IDS = 256
#: Registered rebuilding: which conversation lends its first turns, and how many at most.
SPAN, MOST_TAKEN = 5, 8
NOTHING = hashlib.sha256(b"").hexdigest()
#: Above so many shared nodes, joins with them shuffle.
FEW = 1_000_000


def conversations(log: DataFrame) -> DataFrame:
    """conv_id and turns, the hex keys of its turns in order."""
    t = picked(log, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.concat(F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    t = t.select("conv_id", F.struct(F.col("turn").isNotNull().alias("given"), "turn", F.lower(key).alias("key")).alias("t"))
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["key"]).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """conv_id and turns, the first of which come from the conversation that lends them."""
    c = convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % SPAN, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("int")})
    lent = F.max(F.when(F.col("conv_id") == F.col("_base"), F.slice("turns", 1, MOST_TAKEN))).over(Window.partitionBy("_base"))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return c.withColumn("_lent", F.coalesce(lent, F.array().cast("array<string>"))).select("conv_id", F.concat(F.slice("_lent", F.lit(1), F.col("_h")), own).alias("turns"))


CLASS = "path binary, n_convs long, conv_id long, ends_sha256 string"


def _one_a_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CLASS rows of runs sorted by path and first id: only the digest so far is kept."""
    path, n, low, ends = None, 0, None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "n_convs", "conv_id", "ends_sha256"])

    for b in batches:
        done = []
        for p, k, first, ids in zip(*[b.column(c).to_pylist() for c in ("path", "n", "first", "ids")], strict=True):
            if p != path:
                if path is not None:
                    done.append((path, n, low, ends.hexdigest()))
                path, n, low, ends = p, 0, first, hashlib.sha256()
            elif n:
                ends.update(b",")
            ends.update(ids.encode())
            n += k
        if done:
            yield made(done)
    if path is not None:
        yield made([(path, n, low, ends.hexdigest())])


def classes(convs: DataFrame) -> DataFrame:
    """CLASS: one row a distinct path."""
    path = F.unhex(F.array_join("turns", "")).alias("path")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    runs = convs.select("conv_id", path).groupBy("path", F.floor(F.col("conv_id") / IDS).alias("run")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))
    return runs.repartition("path").sortWithinPartitions("path", "first").select("path", "n", "first", "ids").mapInArrow(_one_a_path, CLASS)


class DoubleArray:
    """A trie over integer codes: node s has child t by code c if t is base[s] + c and check[t] is s. The root is 0."""

    def __init__(self, size: int):
        self.base = np.zeros(size + 1, np.int64)
        self.check = np.full(size + 1, -1, np.int64)
        self.check[0] = -2
        self.low, self.top = 1, 1  # no slot below low is free, none from top on is taken

    def _room(self, upto: int) -> None:
        if upto > len(self.check):
            more = max(upto, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _take(self, slots: np.ndarray, parents: np.ndarray, codes: np.ndarray) -> None:
        self.check[slots], self.base[parents] = parents, slots - codes
        self.top = max(self.top, int(slots.max()) + 1)

    def several(self, parent: int, codes: np.ndarray) -> None:
        """Place a node's children, codes ascending, at the first of some offsets where all fit, else behind all others."""
        steps = codes - codes[0]
        self._room(self.top + int(steps[-1]) + 65)
        free = np.flatnonzero(self.check[self.low : self.top + 1] == -1)[:64] + self.low
        fits = (self.check[free[:, None] + steps[None, :]] == -1).all(axis=1)
        at = int(free[fits.argmax()]) if fits.any() else self.top
        self._take(at + steps, np.full(len(codes), parent), codes)

    def singles(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Place the only children of nodes in the lowest free slots."""
        self._room(self.top + len(codes))
        slots = np.flatnonzero(self.check[self.low : self.top + len(codes)] == -1)[: len(codes)] + self.low
        self._take(slots, parents, codes)
        self.low = int(slots[-1]) + 1

    def next(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        found = self.base[states] + codes
        if not (self.check[found] == states).all():
            raise AssertionError("a path left the trie")
        return found


def packed(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The double array of paths, given as runs of codes, from the root down."""
    trie = DoubleArray(len(codes) + 1)
    states, depth, wide = np.zeros(len(lengths), np.int64), 0, int(codes.max(initial=0)) + 1
    active = np.flatnonzero(lengths > 0)
    while len(active):
        at = codes[starts[active] + depth]
        pairs = np.unique(states[active] * wide + at)
        parents, kids = pairs // wide, pairs % wide
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        count = np.diff(first, append=len(parents))
        for i in first[count > 1]:
            trie.several(int(parents[i]), kids[i : i + count[np.searchsorted(first, i)]])
        alone = first[count == 1]
        if len(alone):
            trie.singles(parents[alone], kids[alone])
        states[active] = trie.next(states[active], at)
        depth += 1
        active = active[lengths[active] > depth]
    return trie


def dense(keys: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 for turn keys, in the order they are met from the root down, and each key's bytes of text."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    by_level = np.argsort(depths, kind="stable")
    met = np.full(len(distinct), len(keys))
    np.minimum.at(met, inverse[by_level], np.arange(len(keys)))
    code = np.empty(len(distinct), np.int64)
    code[np.argsort(met, kind="stable")] = np.arange(1, len(distinct) + 1)
    size = np.frombuffer(keys.tobytes(), ">i8").reshape(-1, KEY // 8)[:, 2]
    return code[inverse], size.astype(np.int64)


#: shared: one of the nodes that blocks have in common, key its prefix's digest, and figures those of this block alone,
#: without shared children; else key is that of a shared parent, or null where parent_conv_id is known.
NODE = "block long, shared boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, ends_sha256 string"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(name, _TYPES[t]) for name, t in (f.split() for f in NODE.split(", "))])


def prefix_keys(path: bytes) -> list[bytes]:
    """The digest of every prefix, from the empty one on."""
    running = hashlib.sha256()
    keys = [running.digest()[:16]]
    for i in range(0, len(path), KEY):
        running.update(path[i : i + KEY])
        keys.append(running.digest()[:16])
    return keys


def block_nodes(block: int, paths: list[bytes], n: np.ndarray, ids: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """NODE rows of distinct paths in their order."""
    lengths = np.array([len(p) // KEY for p in paths], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keys = np.frombuffer(b"".join(paths), f"S{KEY}")
    codes, sizes = dense(keys, np.arange(len(keys)) - np.repeat(starts, lengths))
    trie = packed(codes, starts, lengths)

    room = trie.top
    convs, low, depth, size = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max), np.zeros(room, np.int64), np.zeros(room, np.int64)
    states, levels, at, active = np.zeros(len(paths), np.int64), [np.zeros(1, np.int64)], 0, np.arange(len(paths))
    shared: dict[int, int] = {0: 0}  # slot: depth, along the first and the last path
    route = {0: [0], len(paths) - 1: [0]}
    convs[0], low[0] = n.sum(), ids.min()
    while len(active := active[lengths[active] > at]):
        where = starts[active] + at
        slots = trie.next(states[active], codes[where])
        states[active] = slots
        np.add.at(convs, slots, n[active])
        np.minimum.at(low, slots, ids[active])
        at += 1
        depth[slots], size[slots] = at, sizes[where]
        levels.append(np.unique(slots))
        for i in route:
            if lengths[i] >= at:
                route[i].append(int(states[i]))
                shared[int(states[i])] = at

    own = np.zeros(room, bool)
    own[list(shared)] = True
    kids, leaves, saved = (np.zeros(room, np.int64) for _ in range(3))
    for slots in levels[:0:-1]:  # from the deepest level up; shared nodes keep what hangs on them to themselves
        slots = slots[~own[slots]]
        leaves[slots] += kids[slots] == 0
        saved[slots] += (convs[slots] - 1) * size[slots]
        parents = trie.check[slots]
        np.add.at(kids, parents, 1)
        np.add.at(leaves, parents, leaves[slots])
        np.add.at(saved, parents, saved[slots])

    name: dict[int, bytes] = {}
    for i, slots_of in route.items():
        name.update(zip(slots_of, prefix_keys(paths[i]), strict=True))
    nodes = np.concatenate(levels)
    parents = np.where(nodes == 0, 0, trie.check[nodes])
    is_shared, hangs = own[nodes], own[parents]
    digest = dict(zip(states.tolist(), ends, strict=True))
    key = [name[s if a else p] if a or h else None for s, p, a, h in zip(nodes.tolist(), parents.tolist(), is_shared.tolist(), hangs.tolist(), strict=True)]
    above = [name[p] if a and s else None for s, p, a in zip(nodes.tolist(), parents.tolist(), is_shared.tolist(), strict=True)]
    known = pa.array(low[parents], mask=hangs)
    figures = [convs[nodes], kids[nodes], leaves[nodes], saved[nodes], size[nodes]]
    columns = [np.full(len(nodes), block), is_shared, key, above, low[nodes], depth[nodes], known, *figures, [digest.get(s) for s in nodes.tolist()]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def tries(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """NODE rows of CLASS rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            p, n, ids, ends = zip(*held, strict=True)
            return block_nodes(number, list(p), np.array(n, np.int64), np.array(ids, np.int64), list(ends))

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("path", "n_convs", "conv_id", "ends_sha256")], strict=True):
                if held and turns + len(row[0]) // KEY > block:
                    yield made()
                    number, held, turns = number + 1, [], 0
                held.append(row)
                turns += len(row[0]) // KEY
        if held:
            yield made()

    return paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(of, NODE)


def subtree_sums(tree: DataFrame, *figures: str) -> DataFrame:
    """key and figures, summed over each node's subtree, of a settled tree (key, parent_key, depth, figures).

    After k rounds a node has the sums of what lies less than 2^k below it, and points 2^k up.
    """
    s = tree.select("key", F.col("parent_key").alias("up"), *figures)
    for _ in range(int(tree.agg(F.max("depth")).first()[0] or 0).bit_length()):
        below = s.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(*[F.sum(f).alias(f"_{f}") for f in figures])
        up = small_side(s.select(F.col("key").alias("up"), F.col("up").alias("_up")), FEW)
        s = s.join(below, "key", "left").join(up, "up", "left")
        s = settled(s.select("key", F.col("_up").alias("up"), *[(F.col(f) + F.coalesce(f"_{f}", F.lit(0))).alias(f) for f in figures]))
    return s.drop("up")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a node of the trie over conversations (conv_id, turns): COLUMNS."""
    found = settled(tries(settled(classes(convs)), block))
    parts = found.where("shared")
    merged = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("depth", "parent_key", "bytes", "ends_sha256")], *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    )
    merged = settled(merged)
    kids = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    own = {"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")}
    merged = settled(merged.withColumns(own))
    sums = subtree_sums(merged, "n_leaves", "saved")
    of_parent = small_side(merged.select(F.col("key").alias("_k"), F.col("conv_id").alias("_conv")), FEW)

    upper = merged.drop("n_leaves", "saved").join(sums, "key").join(of_parent, F.col("parent_key") == F.col("_k"), "left").withColumn("parent_conv_id", F.col("_conv"))
    # a block's nodes below shared ones meet their parents by block, however many blocks share these
    parents = parts.select("block", "key").join(of_parent, F.col("key") == F.col("_k")).select("block", "key", "_conv")
    hanging = found.where("NOT shared AND key IS NOT NULL").join(parents, ["block", "key"]).withColumn("parent_conv_id", F.col("_conv"))
    inner = found.where("NOT shared AND key IS NULL")

    def shown(df: DataFrame) -> DataFrame:
        return df.withColumns({"saved_tokens": F.col("saved"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))}).select(COLUMNS)

    return shown(upper).union(shown(hanging)).union(shown(inner))


def shared_prefixes(log: DataFrame) -> DataFrame:
    return nodes(rebuilt(conversations(log)))


ORACLE = f"""
WITH t AS (SELECT conv_id, strlen(COALESCE(text, '')) AS bytes, turn, substr(sha256(concat(strlen(COALESCE(role, '')), ':', COALESCE(role, ''), COALESCE(text, ''))), 1, 32) AS key FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS n FROM t),
c AS (SELECT conv_id, CAST({CRC32.format("conv_id::VARCHAR")} % 9 AS BIGINT) AS h, conv_id - conv_id % 5 AS b FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, n, key, bytes FROM c JOIN n ON n.conv_id = c.b AND n.n <= c.h UNION ALL SELECT c.conv_id, 1, n, key, bytes FROM c JOIN n ON n.conv_id = c.conv_id AND n.n > c.h),
s AS (SELECT c.conv_id, COALESCE(l.keys, []) AS keys, COALESCE(l.sizes, []) AS sizes FROM c LEFT JOIN (SELECT conv_id, list(key ORDER BY own, n) AS keys, list(bytes ORDER BY own, n) AS sizes FROM r GROUP BY conv_id) l USING (conv_id)),
p AS (SELECT conv_id, len(keys) AS len, d, array_to_string(keys[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(keys[1:d - 1], '') END AS up, COALESCE(sizes[d], 0) AS bytes FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM s)),
v AS (SELECT node, d, up, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MAX(bytes) AS bytes, sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256 FROM p GROUP BY node, d, up),
k AS (SELECT v.*, (SELECT COUNT(*) FROM v w WHERE w.up = v.node) AS n_children FROM v),
below AS (SELECT DISTINCT a.node AS top, b.node AS node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT top, COUNT(*) FILTER (n_children = 0) AS n_leaves, SUM((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM below JOIN k USING (node) GROUP BY top)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256 FROM k JOIN sums ON top = k.node LEFT JOIN v u ON u.node = k.up
"""
