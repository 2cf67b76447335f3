"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are read as words (letters and digits, lower-cased), edits are counted in words,
and an item is found where some run of a document's words is within a fifth of the item's words
of it (insertions, deletions, substitutions).

1. Windows of the items' sizes slide over every word of every document. By the q-gram lemma a
   window within k edits of an item of n words shares at least n - q + 1 - kq of its q-grams, so
   windows with fewer q-grams that occur in items of that size (a bitmap of fixed size for each
   class of sizes) can't match and are left. All others go on. Windows end with their document;
   one cut there goes on both as it is and moved inside.
2. These are embedded by the CGK random walk, which maps edit distance to Hamming distance: at
   step j it writes the word it stands on, and moves on or not by a random bit of (j, word).
   In each of WALKS walks, SAMPLED positions give a key. Windows at the distance allowed differ
   from the item at some 40 % of positions, so a walk's keys agree with probability 0.2 and some
   walk's with 0.999; at half that distance with practical certainty.
3. Items with an equal key are verified by the exact edit distance of the item to any run of words
   around the window (bit-parallel dynamic programming), once for windows that overlap.

Items are taken in blocks of bounded size, each broadcast and compared in one pass over the
documents, so a document's words never leave its task and nothing is shuffled.

Defined results: null or wordless texts and items match nothing; texts of any length are read whole; repeated rows are reported each;
of several places the one with fewest edits, then the first, is reported for a row and item; items
with equal words are each reported; empty tables give no rows. Other columns pass through `clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, picked, restored

RATE = 0.2
WALKS, SAMPLED = 32, 3
#: Items compared in one pass over the documents, and words of theirs, at most.
BLOCK, BLOCK_WORDS = 5_000, 500_000
BITMAP = 1 << 20
#: Documents screened at once in a task: arrays of all their words are made.
TOGETHER = 1024
#: Windows walked over at once: a row of WALKS keys each.
WALKED = 2048
#: Sizes in a class are within this ratio of its smallest.
CLASS_RATIO = 1.12


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(words: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(h)]
    return mixed(h)


def edits_allowed(n: int, rate: float = RATE) -> int:
    return math.floor(rate * n + 1e-9)


def gram_size(n: int, k: int) -> int:
    """The longest q-gram, up to 3, of which two or more must be shared, else the longest that must be."""
    sure = {q: n - q + 1 - k * q for q in (3, 2, 1) if n >= q}
    return next((q for q, s in sure.items() if s >= 2), next((q for q, s in sure.items() if s >= 1), 1))


def distance(item: list[int], words: list[int]) -> tuple[int, int]:
    """The fewest edits from the item to a run of words, and where the first such run ends."""
    m = len(item)
    full, top, equal = (1 << m) - 1, 1 << (m - 1), {}
    for i, w in enumerate(item):
        equal[w] = equal.get(w, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for at, w in enumerate(words, 1):
        eq = equal.get(w, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(across | up) & full, up & across
        score += (rise & top > 0) - (fall & top > 0)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(vertical | rise) & full, rise & vertical
        if score < best[0]:
            best = (score, at)
    return best


class Walk:
    """CGK walks over windows of n words and the positions sampled from them."""

    def __init__(self, n: int):
        rng = np.random.default_rng([10, n])
        self.n, self.steps = n, max(1, math.ceil(1.8 * n))
        # the top bit of a word's product with a random odd number says whether to move on
        self.odd = rng.integers(0, 2**63, (self.steps, WALKS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = np.sort(rng.integers(0, self.steps, (WALKS, SAMPLED)), axis=1)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """One key a window and walk, from windows as rows of n word hashes."""
        padded = np.column_stack([windows, np.zeros(len(windows), np.uint64)]).ravel()
        first = np.arange(len(windows)) * (self.n + 1)
        at = np.tile(first, (WALKS, 1))
        key = np.tile(np.arange(1, WALKS + 1, dtype=np.uint64)[:, None] * np.uint64(self.n), len(windows))
        for j in range(self.steps):
            x = padded.take(at)
            for walk, _ in np.argwhere(self.samples == j).tolist():
                key[walk] = mixed(key[walk] + x[walk])
            np.multiply(x, self.odd[j], out=x)
            np.right_shift(x, np.uint64(63), out=x)
            at += x.view(np.int64)
            np.minimum(at, first + self.n, out=at)
        return key.T


class Items:
    """A block of items: bitmaps of q-grams by class of sizes, and items by key."""

    def __init__(self, words: list[np.ndarray], rate: float = RATE):
        self.words, self.rate = [w.astype(np.int64).view(np.uint64) for w in words], rate
        self.lists = [w.tolist() for w in self.words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                by_size.setdefault(len(w), []).append(i)
        self.walks = {n: Walk(n) for n in by_size}
        self.keys: dict[int, dict[int, list[int]]] = {}
        for n, items in by_size.items():
            found: dict[int, list[int]] = {}
            for i, row in zip(items, self.walks[n].keys(np.stack([self.words[i] for i in items])), strict=True):
                for key in set(row.tolist()):
                    found.setdefault(key, []).append(i)
            self.keys[n] = found
        self.classes: list[tuple[int, list[int], int, int, np.ndarray]] = []
        left = sorted(by_size)
        while left:
            q = gram_size(left[0], edits_allowed(left[0], rate))
            sizes = [n for n in left if n <= left[0] * CLASS_RATIO and gram_size(n, edits_allowed(n, rate)) == q]
            left = [n for n in left if n not in sizes]
            bitmap = np.zeros(BITMAP, np.uint8)
            for n in sizes:
                for i in by_size[n]:
                    bitmap[(grams(self.words[i], q) % np.uint64(BITMAP)).astype(np.int64)] = 1
            # a window of the smallest size within one of a larger size misses its other q-grams
            least = min(n - q + 1 - edits_allowed(n, rate) * q - (n - sizes[0]) for n in sizes)
            self.classes.append((sizes[0], sizes, q, max(1, least), bitmap))

    def found(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each document (item, start, end, edits) in words, the best place of each item."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
        lengths = np.array([len(d) for d in docs], np.int64)
        if not lengths.sum():
            return [[] for _ in docs]
        text = np.concatenate(docs).astype(np.int64, copy=False).view(np.uint64)
        ends = np.cumsum(lengths)
        begins, end = ends - lengths, np.repeat(ends, lengths)
        hashes = {q: (grams(text, q) % np.uint64(BITMAP)).astype(np.int32) for q in {c[2] for c in self.classes}}
        for smallest, sizes, q, least, bitmap in self.classes:
            h = hashes[q]
            sums = np.zeros(len(text) + 1, np.int32)
            # a q-gram over the end of a document is none
            np.cumsum(bitmap[h] * (np.arange(len(h)) + q <= end[: len(h)]), out=sums[1 : len(h) + 1])
            sums[len(h) + 1 :] = sums[len(h)]
            starts = np.flatnonzero(self._counts(sums, np.arange(len(text)), smallest - q + 1, end) >= least)
            for n in sizes if len(starts) else ():
                # the window where a match begins has this many, whatever follows it
                enough = max(1, n - q + 1 - edits_allowed(n, self.rate) * q)
                mine = starts[self._counts(sums, starts, n - q + 1, end[starts]) >= enough]
                doc = np.searchsorted(ends, mine, side="right")
                self._verify(text, n, mine, doc, begins, ends, out)
        return [sorted((i, *place) for i, place in d.items()) for d in out]

    @staticmethod
    def _counts(sums: np.ndarray, starts: np.ndarray, wide: int, end: np.ndarray) -> np.ndarray:
        """q-grams of items among so many from each start on, up to the document's end."""
        return sums[np.minimum(starts + wide, end)] - sums[starts]

    def _verify(self, text, n, starts, doc, begins, ends, out) -> None:
        k = edits_allowed(n, self.rate)
        moved = np.clip(starts, begins[doc], np.maximum(begins[doc], ends[doc] - n))
        places = np.unique(np.column_stack([np.concatenate([doc, doc]), np.concatenate([starts, moved])]), axis=0)
        known = self.keys[n]
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for part in range(0, len(places), WALKED):
            doc, at = places[part : part + WALKED].T
            index = at[:, None] + np.arange(n)
            windows = np.where(index < ends[doc][:, None], text[np.minimum(index, len(text) - 1)], np.uint64(0))
            for row, d, s in zip(self.walks[n].keys(windows).tolist(), doc.tolist(), at.tolist(), strict=True):
                for i in {i for key in row for i in known.get(key, ())}:
                    a, b = max(int(begins[d]), s - 2 * k), min(int(ends[d]), s + n + 2 * k)
                    held = spans.setdefault((d, i), [])
                    if held and a <= held[-1][1]:  # windows come in order
                        held[-1][1] = max(b, held[-1][1])
                    else:
                        held.append([a, b])
        for (d, i), held in spans.items():
            for a, b in held:
                words = text[a:b].tolist()
                edits, end = distance(self.lists[i], words)
                if edits <= k:
                    back, length = distance(self.lists[i][::-1], words[:end][::-1])
                    place = (a + end - length - int(begins[d]), a + end - int(begins[d]), edits)
                    old = out[d].get(i)
                    if old is None or (edits, place[0]) < (old[2], old[0]):
                        out[d][i] = place


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple]]:
    """Items (id, words) in blocks of bounded size. The benchmark passes through the driver, and its words stay in broadcasts until the result is made: what is broadcast grows with the benchmark, not with the corpus."""
    rows = picked(benchmark, item_id, text).select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("words")).where("size(words) > 0")
    block: list[tuple] = []
    words = 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], np.array(r["words"], np.int64)))
        words += len(r["words"])
        if len(block) == size or words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def with_hits(docs: DataFrame, block: list[tuple], text: str, rate: float, id_type: str) -> DataFrame:
    """docs with _hits, places of the block's items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(f"array<struct<item:{id_type},start:int,end:int,edits:int>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, words_of = zip(*shared.value, strict=True)
        items = Items(list(words_of), rate)
        names = ("item", "start", "end", "edits")
        for words in batches:
            docs = list(words)
            parts = (items.found(docs[a : a + TOGETHER]) for a in range(0, len(docs), TOGETHER))
            yield pd.Series([[dict(zip(names, (ids[h[0]], *h[1:]), strict=True)) for h in row] for part in parts for row in part])

    return docs.withColumn("_hits", hits(word_hashes(F.col(text))))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits for every document and item found in it."""
    slim, found, id_type = picked(docs, "doc_id", "text"), None, benchmark.schema["item_id"].dataType.simpleString()
    for items in blocks(benchmark, "item_id", "text", block):
        hits = with_hits(slim, items, "text", rate, id_type).where("size(_hits) > 0").select("doc_id", F.explode("_hits").alias("h"))
        part = hits.select("doc_id", F.col("h.item").alias("item_id"), F.col("h.start").alias("start_word"), F.col("h.end").alias("end_word"), F.col("h.edits").alias("edits"))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return slim.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(0).alias(c) for c in ("start_word", "end_word", "edits")]).where("false")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item is found."""
    rows, id_type = apart(docs, "text"), benchmark.schema["item_id"].dataType.simpleString()
    for items in blocks(benchmark, "item_id", "text", block):
        rows = with_hits(rows, items, "text", rate, id_type).where("size(_hits) = 0").drop("_hits")
    return restored(rows, docs)
