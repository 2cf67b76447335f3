"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles (words are runs of other than space characters, A-Z
lower-cased; a text of one to four words is one shingle). Two documents link if the Jaccard
similarity of their sets is 0.8 or more.

1. Documents with equal sets form a class; only classes are compared.
2. Candidates: classes that agree on all 6 MinHash values of one of 28 bands. At similarity 0.8 a
   pair is missed once in 5,000; at 0.9 practically never. Band keys alone are shuffled, added up
   before they are sent, and each class is tied to the smallest of its bucket, so that buckets
   yield one row a member. Classes go by 64 bits here: a clash compares more, it can't link more.
3. Connected components of these ties are the clusters in which pairs can link; a pair of a cluster
   is compared whether or not it shares a bucket. A cluster of more than MOST_CHUNKS chunks, such as
   one that common passages chain together, is compared bucket by bucket instead, a pair in the
   first bucket that it shares. Clusters and buckets are cut into chunks, and each pair of chunks is
   one group of bounded size; the sets of members, and only theirs, are brought together there, with
   their MinHash values.
4. In a group the MinHash values are compared 28 at a time. After n values with m matches, a pair
   goes if P(similarity >= 0.8 | m, n), under a uniform prior, falls below 1e-6. What stays is
   verified on the sets themselves.
5. Groups return, for each class, how many documents it links with and the root of its links
   there: no pair leaves a group, so thousands of near copies cost one row each.

Defined results: a null or wordless text has no shingles, links with nothing and is its own class
member by id and text; rows with repeated id and text count as copies; ties go to the smallest id,
null first; texts of any length are shingled whole; an empty table gives no rows. Other columns pass through `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, apart, components, fold_ascii, picked, restored, rooted, settled, small_side, whole_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 28, 6
HASHES = BANDS * BAND_ROWS
STEP, TOLERANCE = 28, 1e-6
#: Classes and shingles in a chunk, on average: a group holds two chunks at most.
CHUNK, CHUNK_SHINGLES = 512, 1_000_000
#: Chunks of a cluster up to which all of them are compared with each other.
MOST_CHUNKS = 32
#: Cluster members up to which (some 80 bytes a row) they are broadcast to the documents.
BROADCAST_MEMBERS = 1_000_000
_random = np.random.default_rng(20_24)
XORS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
FACTORS = _random.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(fold_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, so that sums of word hashes spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of hashed words."""
    w = words.view(np.uint64)
    if not len(w):
        return w
    k, h = min(size, len(w)), np.zeros(max(1, len(w) - size + 1), np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed(w[i : i + len(h)])
    return np.unique(mixed(h))


def minhashes(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, over bijections of the upper half of its hashes."""
    upper, least = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(upper), 16_384):
        part = upper[a : a + 16_384]
        several = max(1, 65_536 // len(part))  # hashes at once: as many as a cache holds
        for i in range(0, HASHES, several):
            room = part ^ XORS[i : i + several, None]
            room *= FACTORS[i : i + several, None]
            np.minimum(least[i : i + several], room.min(axis=1), out=least[i : i + several])
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each signature."""
    rows = signatures.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for i in range(BAND_ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return h.view(np.int64)


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield values[a:b]


def fingerprinted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h (hash of the text), class (16 bytes of a hash of the set, null if empty), size of the set, bands."""
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), word_hashes(F.col(text)).alias("words"))
    schema = f"doc_id {hashed.schema['doc_id'].dataType.simpleString()}, h long, class binary, size int, bands array<long>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, signatures = [], [], []
            for words in lists(b.column("words")):
                s = shingle_set(words)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                if len(s):
                    signatures.append(minhashes(s))
            made = iter(band_keys(np.stack(signatures)) if signatures else ())
            bands = [next(made) if n else None for n in sizes]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "class", "size", "bands"])

    return hashed.mapInArrow(of, schema)


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n values compared, the fewest matches at which P(similarity or more) isn't below the tolerance.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), and its
    upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    found = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= tolerance:
                found[n] = m
                break
    return found


LEAST = least_matches()


def linked(sets: list[np.ndarray], signatures: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of left and right that link; if both are one array, each pair once."""
    same = left is right
    alive = np.triu(np.ones((len(left), len(right)), bool), 1) if same else np.ones((len(left), len(right)), bool)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int16)
    a, b = signatures[left], signatures[right]
    for n in range(STEP, HASHES + 1, STEP):
        for k in range(n - STEP, n):
            matches += a[i, k] == b[j, k]
        keep = matches >= LEAST[n]
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            return i, j
    used = np.unique(np.concatenate([left[i], right[j]]))
    codes = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)[1]
    ends = np.cumsum([len(sets[u]) for u in used])
    coded = dict(zip(used.tolist(), np.split(codes, ends[:-1]), strict=True))
    flag, keep = np.zeros(codes.max() + 1, bool), np.zeros(len(i), bool)
    starts = np.searchsorted(i, np.arange(len(left) + 1))
    for x in np.unique(i):
        part = slice(starts[x], starts[x + 1])
        mine, others = coded[int(left[x])], [coded[int(right[y])] for y in j[part]]
        flag[mine] = True
        sizes = np.array([len(o) for o in others])
        common = np.add.reduceat(flag[np.concatenate(others)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        keep[part] = common >= similarity * (len(mine) + sizes - common) - 1e-9
        flag[mine] = False
    return i[keep], j[keep]


#: What a group of `compared` has in common: a cluster (or a bucket of a large one) and two chunks.
GROUP = ["bucket", "cluster", "lo", "hi"]


def compared(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """class, links, root for the classes of each group. Groups are runs of GROUP."""
    for g in whole_groups(groups, GROUP):
        sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
        signatures = np.frombuffer(b"".join(g["signature"]), np.uint32).reshape(-1, HASHES)
        chunk, copies = g["chunk"].to_numpy(), g["copies"].to_numpy()
        left, right = np.flatnonzero(chunk == g["lo"].iloc[0]), np.flatnonzero(chunk == g["hi"].iloc[0])
        if g["lo"].iloc[0] == g["hi"].iloc[0]:
            right = left
        i, j = linked(sets, signatures, left, right)
        i, j = left[i], right[j]
        if g["bucket"].iloc[0] and len(i):  # other buckets have the pairs that share an earlier one
            keys = band_keys(signatures)
            first = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == g["cluster"].iloc[0]
            i, j = i[first], j[first]
        links = np.bincount(i, copies[j], len(g)) + np.bincount(j, copies[i], len(g))
        some = links > 0
        if some.any():
            keys = g["class"].to_numpy()
            yield pd.DataFrame({"class": keys[some], "links": links[some].astype(np.int64), "root": keys[rooted(len(g), i, j)][some]})


def joined(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h, class, root, class_id, component_id, n_links: one row a row of docs (h is the hash of its text).

    root is a class of the component: unlike component_id, an id of documents, it is of this component only.
    """
    prints = settled(fingerprinted(docs, text, doc_id))
    classes = settled(prints.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    node = F.xxhash64("class").alias("node")
    buckets = classes.select(node, F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    ties = buckets.join(hubs, "key").select("node", "hub").where("node <> hub").distinct()
    clusters = settled(components(ties, "node", "hub"))
    parts = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    chunk = F.pmod(F.xxhash64("class"), "chunks").cast("int").alias("chunk")
    sized = classes.withColumn("node", node).join(clusters, "node").select("class", F.col("component").alias("cluster"), "copies", "size", F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    members = settled(sized.join(sized.groupBy("cluster").agg(parts), "cluster").select("class", "cluster", "copies", "chunks", chunk, "_id", "_h"))
    rows = docs.select(F.col(doc_id).alias("_d"), F.xxhash64(F.col(text)).alias("_x"), F.col(text).alias("_t"))
    # one row a class even where id and text are repeated
    rows = rows.join(small_side(members, BROADCAST_MEMBERS), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_h")))
    rows = rows.select("class", "cluster", "copies", "chunks", "chunk", word_hashes(F.col("_t")).alias("words"))
    schema = "class binary, cluster long, copies long, chunks int, chunk int, set binary, signature binary"

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(w) for w in lists(b.column("words"))]
            made = [pa.array([x.tobytes() for x in of], pa.binary()) for of in (sets, map(minhashes, sets))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *made], names=[*b.schema.names[:5], "set", "signature"])

    sets = rows.mapInArrow(with_sets, schema).dropDuplicates(["class"])
    large = members.where(F.col("chunks") > MOST_CHUNKS)
    placed = sets.withColumn("bucket", F.lit(False))
    if not large.isEmpty():
        sets = settled(sets)
        at = classes.join(large.select("class"), "class").select("class", "size", F.explode("bands").alias("cluster"))
        cut = at.groupBy("cluster").agg(parts, F.count("*").alias("n")).where("n > 1").drop("n")
        at = at.join(cut, "cluster").select("class", "cluster", "chunks", chunk)
        by_bucket = sets.select("class", "copies", "set", "signature").join(at, "class").withColumn("bucket", F.lit(True))
        placed = sets.where(F.col("chunks") <= MOST_CHUNKS).withColumn("bucket", F.lit(False)).unionByName(by_bucket)
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("class", "cluster", "bucket", "copies", "chunk", "set", "signature", F.least("chunk", "_o").alias("lo"), F.greatest("chunk", "_o").alias("hi"))
    placed = placed.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = settled(placed.mapInPandas(compared, "class binary, links long, root binary"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select("class", "root"), "class", "root")
    named = groups.withColumnRenamed("node", "class").join(classes.select("class", F.col("first.doc_id").alias("_first")), "class")
    smallest = named.groupBy("component").agg(F.min(F.struct(F.col("_first").isNotNull(), "_first")).alias("_s"))
    linked_classes = named.join(smallest, "component").join(links, "class", "left").select("class", F.col("component").alias("root"), F.col("_s._first").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    per_class = classes.select("class", F.col("first.doc_id").alias("class_id"), "copies").join(linked_classes, "class", "left")
    per_class = per_class.select("class", F.coalesce("root", "class").alias("root"), "class_id", F.when(F.col("links").isNotNull(), F.col("component_id")).otherwise(F.col("class_id")).alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = prints.select("doc_id", "h", "class").join(per_class, "class", "left")
    own = lambda c: F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "h", "class", "root", own("class_id"), own("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, component_id, n_links, kept (whether it is the one of its component that stays)."""
    return joined(picked(docs, "doc_id", "text")).select("doc_id", "class_id", "component_id", "n_links", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of its smallest id, null first, then of the smallest hash of its text; wordless texts all stay.

    Components are told apart by their roots, not by ids, which may be null or repeated. A null id
    or one that is repeated with other texts loses no group.
    """
    j = settled(joined(picked(docs, "doc_id", "text")).where("class IS NOT NULL"))
    # the row that stays of each component: rows of equal id and text count as one here
    stays = j.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("s"), F.count("*").alias("n"))
    stays = settled(stays.where("n > 1").select("root", F.col("s.doc_id").alias("_first"), F.col("s.h").alias("_least")))
    pairs = j.select("root", F.col("doc_id").alias("_id"), F.col("h").alias("_g")).distinct().join(stays, "root")
    is_first = F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_g") == F.col("_least"))
    marked = settled(pairs.select("_id", "_g", is_first.alias("_once")))
    rows = apart(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = rows.join(small_side(marked, BROADCAST_MEMBERS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    # only rows that are repeated whole are brought together, each with its copies
    again = settled(j.groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_k")).agg(F.count("*").alias("n")).where("n > 1").select("_i", "_k"))
    rows = rows.where("_once IS NULL OR _once")
    if again.isEmpty():
        return restored(rows, docs)
    rows = rows.join(small_side(again, BROADCAST_MEMBERS), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_k")), "left")
    repeated = F.col("_once").isNotNull() & F.col("_k").isNotNull()
    once = rows.where(repeated).dropDuplicates(["doc_id", "_h"])
    return restored(rows.where(~repeated).unionAll(once), docs)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y, c = nx.n AND c = ny.n AS equal FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x, MIN(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, LEAST(d.doc_id, COALESCE((SELECT MIN(y) FROM l WHERE l.x = d.doc_id AND equal), d.doc_id)) AS class_id, k.component_id,
  (SELECT COUNT(*) FROM l WHERE l.x = d.doc_id)::BIGINT AS n_links, d.doc_id = k.component_id AS kept
FROM documents d JOIN k ON k.x = d.doc_id
"""
