"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are runs of other than space characters, A-Z lower-cased, and one end a text. Each word picks
a context restaurant of its own for the word that follows it, and a text's start has one; all share one
parent restaurant of words, whose base is uniform over the words known and one unknown. Given the seating,

    P(w | u) = (c_uw - d t_uw + (h + d t_u) P(w)) / (h + c_u)
    P(w)     = (t_w - e s_w + (g + e s) / (V + 1)) / (g + t)

with c customers, t tables of contexts (customers of the parent), s tables of the parent. The
discounts d and e come from the numbers of words met once and twice.

Seating is sampled by Gibbs, a dish at a time: all customers of a word in a restaurant stand up,
and their number of tables is drawn given everybody else,

    P(t) ~ S_d(c, t) p^t (h + d T) (h + d (T + 1)) ... (h + d (T + t - 1))

with T tables of the restaurant's other words, the generalised Stirling number S_d(c, t) that
counts the ways c customers fill t tables, and p the parent's prediction without this dish. Up to
EXACT customers the numbers are tabulated; beyond, few tables are weighed by the alternating sum
for S_d, many are drawn from the saddle point's normal law. Other tables and p are as the last
sweep left them, so sweeps go on in all buckets of words at once. After each, a bucket sends the tables
of its contexts to the parts that sum them over all buckets, and gets the sums of its own contexts back:
no task, broadcast or the driver holds a vector of all contexts. Each sweep's seating is written to the
shared folder. Predictive probabilities are averaged over the seatings after BURN_IN sweeps.

Spark moves each document's tokens once: packed by bucket of the word, with context, document and
count, a row a batch of documents and bucket. Words of more than a HOT-th of all tokens are dealt to
buckets by word and context, and their totals, a thousand at most, are shared, so a hot word's tokens
lie in many buckets; only one and the same pair of words stays together, four bytes a document at most.
Buckets that share a home are worked on one by one in one task, which adds up their sums a document.
Everything is counted over all training texts, and buckets grow in number with the bytes of text. Words
and contexts are told apart by hashes of 64 bits; rows name the most frequent contexts by 16-bit codes,
which a table undoes.

Defined results: a null text is empty and has its end as only token; texts of any length are scored
whole; held-out rows (crc32 of the id, modulo 7, is 2; a null id counts as empty text) are scored but
not learned; repeated rows are learned and scored each; without training rows every token has
probability 1; an empty table gives no rows. Columns but id and text are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, configured, fold_ascii, id_remainder, let_go, picked, settled

FOLDS, HELD_OUT = 7, 2
STRENGTH, PARENT_STRENGTH = 2.0, 2.0
SWEEPS, BURN_IN = 3, 1
#: Customers up to which the law of tables is tabulated; tables up to which it is summed beyond.
EXACT, FEW = 256, 24
#: A word is hot from a HOT-th of all tokens on.
HOT = 1000
#: Frequent words that rows of packed tokens name by a number; they name others by hash.
CODES = 2**16
#: Documents in a batch at most; 15 bits number them, one marks held-out ones.
BATCH = 4096
#: Buckets that share a home: their sums a document are added up before they are sent on.
SPREAD = 3
#: Batches whose sums a task holds (100 kB each) before it sends them on.
HELD = 512
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
NONE = np.empty(0, np.uint64)


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(fold_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, a plane for each byte of their items; hashes, which come sorted, by their differences."""
    arrays = [steps(a) if a.dtype == np.uint64 else a for a in arrays]
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"))
    at, out = 8 * (1 + len(types)), []
    for size, t in zip(np.frombuffer(raw[8:at], np.int64).tolist(), types, strict=True):
        width = np.dtype(t).itemsize
        planes = np.frombuffer(raw[at : at + size], np.uint8).reshape(width, size // width)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(t)
        out.append(np.cumsum(a, dtype=t) if t is np.uint64 else a)
        at += size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """From each number to the next, modulo their type's range; np.cumsum in that type undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def found(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of items in a sorted array, and whether they are there."""
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def homes(tokens: np.ndarray, context: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """Buckets of tokens: by their word, and those of hot words by their context too."""
    key = tokens * np.uint64(0x9E3779B97F4A7C15)
    spread = np.flatnonzero(found(hot, tokens)[1])
    key[spread] += context[spread] * np.uint64(0xC4CEB9FE1A85EC53)
    return (mixed(key) % np.uint64(buckets)).astype(np.uint16 if buckets < 2**16 else np.int32)


def packed(held: np.ndarray, words: list[np.ndarray], batch: int, buckets: int, hot: np.ndarray, codes: np.ndarray = NONE) -> Iterator[tuple]:
    """Rows (bucket, batch, payload) of a batch of documents; bucket -1 holds its ids."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 1)
    # a start before each text, so that every token's context stands before it
    line = np.full(int(lengths.sum()) + 2 * len(words), END, np.uint64)
    at = 0
    for w in words:
        line[at] = START
        line[at + 1 : at + 1 + len(w)] = w.view(np.uint64)
        at += len(w) + 2
    doc = np.repeat(np.arange(len(words), dtype=np.uint16), lengths + 1)
    place = np.arange(1, len(doc) + 1, dtype=np.int32)
    place += doc
    home = np.concatenate([np.empty(0, np.uint16), *(homes(line[i], line[i - 1], buckets, hot) for i in np.split(place, range(2**18, len(place), 2**18)))])
    order = np.argsort(home, kind="stable").astype(np.int32)
    home = home[order]
    held = np.asarray(held)
    cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(home) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        i = order[a:b]
        known, word = np.unique(line[place[i]], return_inverse=True)
        contexts, context = np.unique(line[place[i] - 1], return_inverse=True)
        code, coded = found(codes, contexts)
        context = np.where(coded, np.cumsum(coded), coded.sum() + np.cumsum(~coded))[context] - 1
        entries, counts = np.unique((word * len(contexts) + context) << 12 | doc[i], return_counts=True)
        word, context = np.divmod(entries >> 12, len(contexts))
        number = (entries & 0xFFF).astype(np.uint16)
        marked = number | held[number].astype(np.uint16) << np.uint16(15)
        yield int(home[a]), batch, pack(known, np.bincount(word).astype(np.uint32), steps(code[coded].astype(np.uint16)), contexts[~coded], steps(context.astype(np.uint32)), marked, counts.astype(np.uint32))
    yield -1, batch, pack(held.astype(np.uint8), (lengths + 1).astype(np.int64))


#: Words, entries of each, steps of contexts' codes, contexts without; by entry: the step to its context, its document, its count.
TYPES = (np.uint64, np.uint32, np.uint16, np.uint64, np.uint32, np.uint16, np.uint32)


def lists(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def hot_words(docs: DataFrame) -> np.ndarray:
    return frequent_words(docs)[0]


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted: of words of more than a HOT-th of all tokens, the end included; and of those to be named by a number.

    A hot word has that share of some batch, so batches tell only of words with half of it, or met often
    enough to be worth a number. Which have one changes no result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, 1024) for whole in batches for a in range(0, whole.num_rows, 1024)):
            values = np.concatenate([*lists(b.column("words")), np.empty(0, np.int64)])
            words, counts = np.unique(np.concatenate([values, np.full(b.num_rows, END, np.uint64).view(np.int64)]), return_counts=True)
            often = (counts * 2 * HOT > counts.sum()) | (counts > 3)
            yield pa.RecordBatch.from_arrays([pa.array([*words[often], 0], pa.int64()), pa.array([*counts[often], counts.sum()], pa.int64()), pa.array([False] * int(often.sum()) + [True], pa.bool_())], names=["word", "n", "all"])

    told = docs.select(word_hashes(F.col("text")).alias("words")).mapInArrow(of, "word long, n long, all boolean").groupBy("word", "all").agg(F.sum("n").alias("n"))
    rows = told.orderBy(F.desc("all"), F.desc("n")).limit(CODES + 1).toPandas()
    words, counts = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    return np.sort(words[1:][counts[1:] * HOT > counts[0]]) if len(rows) else NONE, np.sort(words[1:])


def tokenised(docs: DataFrame, buckets: int, hot: np.ndarray, codes: np.ndarray = NONE) -> DataFrame:
    """home, bucket, batch, payload, ids (bucket -1 only), dealt to partitions by home: that of SPREAD buckets, or the batch of its ids."""
    rows = docs.select("doc_id", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held"), word_hashes(F.col("text")).alias("words"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                b = whole.slice(a, BATCH)
                made = list(packed(b.column("held").to_numpy(zero_copy_only=False), lists(b.column("words")), batch, buckets, hot, shared.value))
                ids = [b.column("doc_id").to_pylist() if m[0] < 0 else None for m in made]
                bucket, number, payload = zip(*made, strict=True)
                home = [n if k < 0 else k // SPREAD for k, n in zip(bucket, number, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(bucket, pa.int32()), pa.array(number, pa.int64()), pa.array(payload, pa.binary()), pa.array(ids, pa.list_(b.schema.field("doc_id").type))], names=["home", "bucket", "batch", "payload", "ids"])
                batch += 1

    return rows.mapInArrow(of, f"home long, bucket int, batch long, payload binary, ids array<{id_type}>").repartition(4 * math.ceil(buckets / SPREAD), "home")


def bucket_size(text_bytes: int) -> int:
    """Bytes of text to a bucket: with the root of the corpus, as rows go by batch and bucket both, up to what a task holds easily."""
    return min(32_000_000, max(10_000_000, int(60 * math.sqrt(text_bytes))))


class Totals:
    """What all buckets share: figures of hot words and of the parent; and customers and tables of a bucket's contexts, in all buckets."""

    def __init__(self, rows: dict[int, tuple], hot: int = 0, number: int = 0):
        self.customers, self.tables = np.array([rows[k] for k in range(1 + max(rows, default=-1))], float).reshape(-1, 2).T
        of = lambda k: rows.get(k, (0, 0))
        self.tokens, self.words = of(-1)
        self.parent_customers, self.parent_tables = of(-2)
        # contexts' words met once and twice, and the parent's
        self.discount, self.parent_discount = (min(0.95, max(0.2, (a + 1) / (a + 2 * b + 2))) for a, b in (of(-3), of(-4)))
        shared = np.array([of(-10 - h) for h in range(hot)], float).reshape(hot, 2)
        self.hot_counts, self.hot_customers = shared[:, 0], shared[:, 1]
        self.words += int((self.hot_counts > 0).sum())
        self.hot_tables = np.where(self.hot_customers > 0, 1.0, 0.0)
        if number:
            others = np.full(hot, float(self.parent_tables))
            self.hot_tables = seated(self.hot_customers, others, np.full(hot, 1 / (self.words + 1)), PARENT_STRENGTH, self.parent_discount, np.random.default_rng([9, number])).astype(float)
        self.parent_tables += self.hot_tables.sum()

    def at(self, tables: np.ndarray, customers: np.ndarray | None = None) -> Totals:
        """The same for a bucket whose contexts have these figures."""
        own = copy(self)
        own.tables, own.customers = tables, customers
        return own


@lru_cache(4)
def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: row c, column t, up to EXACT."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            stay = np.where(t <= c, table[c] + np.log(np.maximum(c - discount * t, 0.0)), -np.inf)
            table[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], table[c, :-1]]))
    return table


def drawn(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column, counted from 1, for each row of logarithms of weights."""
    cdf = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return 1 + (cdf < rng.random(len(cdf))[:, None] * cdf[:, -1:]).sum(axis=1)


def seated(customers: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many customers, drawn given tables of the restaurant's other dishes and the parent's p."""
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    sizes = customers[order]
    for c in np.unique(sizes[(sizes > 1) & (sizes <= EXACT)]).astype(int):
        same = order[np.searchsorted(sizes, c) : np.searchsorted(sizes, c, side="right")]
        for a in range(0, len(same), 1 + 1_000_000 // c):
            i = same[a : a + 1 + 1_000_000 // c]
            opening = np.log(strength + discount * (others[i][:, None] + np.arange(c))) + np.log(p[i])[:, None]
            tables[i] = drawn(log_stirling(discount)[c, 1 : c + 1] + np.cumsum(opening, axis=1), rng)
    large = order[np.searchsorted(sizes, EXACT, side="right") :]
    if len(large):
        tables[large] = many_seated(customers[large], others[large], p[large], strength, discount, rng)
    return tables


def many_seated(c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The same beyond EXACT customers. t has the generating function [z^c] (1 - s p f(z))^-a, f(z) = 1 - (1 - z)^d."""
    a, d = strength / discount + others, discount
    low, high = np.full(len(c), -700.0 / (2 - d)), np.full(len(c), -1e-12)  # logarithms of 1 - z
    for _ in range(60):
        x = (low + high) / 2
        q = np.exp(x)
        enough = a * p * (1 - q) * d * np.exp((d - 1) * x) / (1 - p * (1 - q**d)) >= c
        low, high = np.where(enough, x, low), np.where(enough, high, x)
    q = np.exp(low)
    z, g = 1 - q, p * (1 - q**d)
    slope = p * z * d * np.exp((d - 1) * low)
    mean = a * g / (1 - g)
    across = a * slope / (1 - g) ** 2
    variance = a * g / (1 - g) ** 2 - across**2 / (a * slope * (1 + z * (1 - d) / q) / (1 - g) + a * slope**2 / (1 - g) ** 2)
    tables = np.clip(np.round(mean + np.sqrt(np.maximum(variance, 0)) * rng.standard_normal(len(c))), 1, c).astype(np.int64)
    few = np.flatnonzero(mean < FEW / 2)
    if len(few):
        # c!/(t! d^t) sum over j of (-1)^j C(t, j) [z^c] (1 - z)^(j d), all but what t doesn't enter
        j = np.arange(1, FEW + 1)
        gammas = np.array([0.0 if (k * d) % 1 == 0 else 1 / math.gamma(-k * d) for k in j])
        powers = gammas * np.exp(-(d * j)[None, :] * np.log(c[few])[:, None])
        signs = np.array([[(-1) ** k * math.comb(t, k) for k in j] for t in j], float)
        f = powers @ signs.T
        opening = np.cumsum(np.log(strength + d * (others[few][:, None] + j - 1)), axis=1) + j * (np.log(p[few])[:, None] - math.log(d))
        logs = np.where(f > 0, np.log(np.maximum(f, 1e-300)), -np.inf) + opening - np.array([math.lgamma(t + 1) for t in j])
        tables[few] = drawn(logs, rng)
    return tables


class Bucket:
    """The words of a bucket with their counts by context, and a seating."""

    def __init__(self, number: int, payloads: list[tuple[int, bytes]], hot: np.ndarray, codes: np.ndarray = NONE):
        batches = [(batch, *unpack(p, *TYPES)) for batch, p in sorted(payloads)]
        contexts = [np.concatenate([codes[np.cumsum(b[3], dtype=np.uint16)], b[4]]) for b in batches]
        self.number = number
        self.known = np.unique(np.concatenate([b[1] for b in batches]))
        self.contexts = np.unique(np.concatenate(contexts))
        width = len(self.contexts)
        key = np.concatenate([np.repeat(np.searchsorted(self.known, b[1]), b[2]) * width + np.searchsorted(self.contexts, c)[np.cumsum(b[5], dtype=np.uint32)] for b, c in zip(batches, contexts, strict=True)])
        # held-out texts' pairs are there too, with no customers
        self.pairs, self.where = np.unique(key, return_inverse=True)
        self.batches, self.marked, self.entry_counts = [(b[0], len(b[6])) for b in batches], *(np.concatenate([b[i] for b in batches]) for i in (6, 7))
        self.counts = np.bincount(self.where, np.where(self.marked < 2**15, self.entry_counts, 0), len(self.pairs))
        self.word, self.context = np.divmod(self.pairs, width)
        self.own_counts = np.bincount(self.word, self.counts, len(self.known))
        at, self.is_hot = found(hot, self.known)
        self.hot = at[self.is_hot]
        self.tables = (self.counts > 0).astype(float)
        self.own_parent_tables = (self.own_counts > 0).astype(float)

    def parts(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of the contexts that each part sums, in the order of their hashes."""
        part = (mixed(self.contexts * np.uint64(0xD1342543DE82EF95)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            yield int(part[i[0]]), i

    def whole(self, own: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Figures of words: a hot one's are those of all buckets."""
        out = own.copy()
        out[self.is_hot] = shared[self.hot]
        return out

    def parent(self, t: Totals, less: np.ndarray | None = None) -> np.ndarray:
        """The parent's prediction of each word, or of each pair's without its own tables."""
        customers = self.whole(np.bincount(self.word, self.tables, len(self.known)), t.hot_customers)
        tables = self.whole(self.own_parent_tables, t.hot_tables)
        gone = 0.0
        if less is not None:
            gone = less
            customers = np.maximum(customers[self.word] - less, 0)
            tables = np.minimum(tables[self.word], customers)
        base = (PARENT_STRENGTH + t.parent_discount * t.parent_tables) / (t.words + 1)
        return (customers - t.parent_discount * tables + base) / (PARENT_STRENGTH + t.parent_customers - gone)

    def sweep(self, t: Totals, number: int) -> None:
        rng = np.random.default_rng([9, number, self.number])
        others = np.maximum(0, t.tables[self.context] - self.tables)
        self.tables = seated(self.counts, others, self.parent(t, self.tables), STRENGTH, t.discount, rng).astype(float)
        customers = np.bincount(self.word, self.tables, len(self.known))
        others = np.maximum(0, t.parent_tables - self.own_parent_tables)
        self.own_parent_tables = seated(customers, others, np.full(len(self.known), 1 / (t.words + 1)), PARENT_STRENGTH, t.parent_discount, rng).astype(float)

    def state(self) -> bytes:
        return pack(self.tables.astype(np.uint32), self.own_parent_tables.astype(np.uint32))

    def restore(self, state: bytes) -> None:
        self.tables, self.own_parent_tables = (x.astype(float) for x in unpack(state, np.uint32, np.uint32))

    def of_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context in this bucket."""
        return np.bincount(self.context, self.counts, len(self.contexts)), np.bincount(self.context, self.tables, len(self.contexts))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """k, a, b: what Totals is made of, contexts first."""
        a, b = self.of_contexts()
        k = np.arange(len(a))
        customers, cold = np.bincount(self.word, self.tables, len(self.known)), ~self.is_hot
        more = [(-1, self.counts.sum(), (self.own_counts[cold] > 0).sum()), (-2, customers.sum(), self.own_parent_tables[cold].sum()), (-3, (self.counts == 1).sum(), (self.counts == 2).sum()), (-4, (customers[cold] == 1).sum(), (customers[cold] == 2).sum())]
        more += [(-10 - h, c, t) for h, c, t in zip(self.hot, self.own_counts[self.is_hot], customers[self.is_hot], strict=True)]
        return tuple(np.concatenate([x, np.array(y, float)]) for x, y in zip((k, a, b), zip(*more, strict=True), strict=True))

    def predicted(self, t: Totals) -> tuple[np.ndarray, np.ndarray]:
        """What is added to h + d t_u times the parent's prediction, for each pair; and that prediction."""
        return np.maximum(self.counts - t.discount * self.tables, 0), self.parent(t)


#: A row with part -1 has a bucket's state, and its sums as more. The others have tables of contexts, and as more what only sweep 0 tells.
MADE = "home long, bucket int, part int, sweep int, data binary, more binary"


def table_of(rows: list[tuple]) -> pa.Table:
    kinds = dict(home=pa.int64(), bucket=pa.int32(), part=pa.int32(), sweep=pa.int32(), data=pa.binary(), more=pa.binary())
    return pa.table([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def buckets_in(left: pa.Table, hot: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, Bucket]]:
    """A home's buckets, one by one."""
    home, number = left.column("home")[0].as_py(), left.column("bucket").to_numpy()
    for k in np.unique(number).tolist():
        mine = left.filter(pa.array(number == k))
        yield home, Bucket(k, list(zip(mine.column("batch").to_pylist(), mine.column("payload").to_pylist(), strict=True)), hot, codes)


def told(right: pa.Table) -> dict[tuple[int, int, int], tuple[bytes, bytes]]:
    """By bucket, part and sweep."""
    columns = (right.column(c).to_pylist() for c in ("bucket", "part", "sweep", "data", "more"))
    return {(bucket, part, sweep): (data, more) for bucket, part, sweep, data, more in zip(*columns, strict=True)}


def gathered(bucket: Bucket, news: dict, sweep: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers of a bucket's contexts, in all buckets; customers are those of sweep 0."""
    tables, customers = np.zeros(len(bucket.contexts)), np.zeros(len(bucket.contexts))
    for part, i in bucket.parts(parts):
        tables[i] = unpack(news[bucket.number, part, sweep][0], np.uint32)[0]
        if (bucket.number, part, 0) in news:
            customers[i] = unpack(news[bucket.number, part, 0][1], np.float64)[0]
    return tables, customers


def swept(tokens: DataFrame, hot: np.ndarray, codes: np.ndarray, parts: int, number: int, totals: Totals | None, before: DataFrame | None) -> DataFrame:
    """MADE: buckets' states after sweep number (0: one table a pair), and what they tell the parts of contexts."""
    shared = tokens.sparkSession.sparkContext.broadcast((totals, codes))

    def made(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        news, rows = {} if right is None else told(right), []
        for home, bucket in buckets_in(left, hot, shared.value[1]):
            if number:
                bucket.restore(news[bucket.number, -1, number - 1][0])
                bucket.sweep(shared.value[0].at(*gathered(bucket, news, number - 1, parts)), number)
            k, a, b = (x[len(bucket.contexts) :] for x in bucket.sums())
            rows.append((home, bucket.number, -1, number, bucket.state(), pack(k, a, b)))
            customers, tables = bucket.of_contexts()
            for part, i in bucket.parts(parts):
                rows.append((home, bucket.number, part, number, pack(tables[i].astype(np.uint32)), None if number else pack(bucket.contexts[i], customers[i])))
        return table_of(rows)

    rows = tokens.where("bucket >= 0").select("home", "bucket", "batch", "payload")
    if before is None:
        return settled(rows.groupBy("home").applyInArrow(lambda left: made(left), MADE))
    return settled(rows.groupBy("home").cogroup(before.groupBy("home")).applyInArrow(made, MADE))


def contexts_of(made: DataFrame) -> DataFrame:
    """MADE with the parts' sums over all buckets of sweep 0, for each bucket's contexts; and `spot`, their places among all contexts of the part."""

    def of(rows: pa.Table) -> pa.Table:
        tables, more = (rows.column(c).to_pylist() for c in ("data", "more"))
        hashes, customers = zip(*(unpack(m, np.uint64, np.float64) for m in more), strict=True)
        known, where = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = [np.bincount(where, np.concatenate(v), len(known)) for v in ([unpack(t, np.uint32)[0] for t in tables], customers)]
        spots = np.split(where, np.cumsum([len(h) for h in hashes])[:-1])
        rows = rows.set_column(4, "data", pa.array([pack(sums[0][i].astype(np.uint32)) for i in spots], pa.binary()))
        rows = rows.set_column(5, "more", pa.array([pack(sums[1][i]) for i in spots], pa.binary()))
        return rows.append_column("spot", pa.array([pack(steps(i.astype(np.uint32))) for i in spots], pa.binary()))

    return settled(made.where("part >= 0").groupBy("part").applyInArrow(of, MADE + ", spot binary"))


def contexts_again(made: DataFrame, first: DataFrame) -> DataFrame:
    """MADE with the parts' sums over all buckets of a later sweep, for each bucket's contexts."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        spots = {k: np.cumsum(unpack(s, np.uint32)[0], dtype=np.uint32) for k, s in zip(left.column("bucket").to_pylist(), left.column("spot").to_pylist(), strict=True)}
        mine = [spots[k] for k in right.column("bucket").to_pylist()]
        sums = np.bincount(np.concatenate(mine), np.concatenate([unpack(t, np.uint32)[0] for t in right.column("data").to_pylist()]))
        return right.set_column(4, "data", pa.array([pack(sums[i].astype(np.uint32)) for i in mine], pa.binary()))

    return settled(first.select("bucket", "part", "spot").groupBy("part").cogroup(made.where("part >= 0").groupBy("part")).applyInArrow(of, MADE))


def totals_of(made: DataFrame, hot: int, number: int) -> Totals:
    """What all buckets share, summed by Spark: four rows and one a hot word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("more"):
                k, x, y = unpack(s.as_py(), np.float64, np.float64, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(x), pa.array(y)], names=["k", "a", "b"])

    sums = made.where("part < 0").select("more").mapInArrow(of, "k int, a double, b double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return Totals({r["k"]: (r["a"], r["b"]) for r in sums.collect()}, hot, number)


def document_sums(tokens: DataFrame, hot: np.ndarray, codes: np.ndarray, parts: int, news: DataFrame, totals: dict[int, Totals]) -> DataFrame:
    """batch, sums: by document of the batch, log10 of the model and of the base, and known tokens."""
    shared = tokens.sparkSession.sparkContext.broadcast((totals, codes))

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        heard, seatings, held, batches, payloads = told(right), shared.value[0], {}, [], []

        def send() -> None:
            for batch, total in held.items():
                docs = np.flatnonzero(total[0])  # every token's probability is below one
                batches.append(batch)
                payloads.append(pack(docs.astype(np.uint16), *total[:2, docs], total[2, docs].astype(np.uint32)))
            held.clear()

        for _, bucket in buckets_in(left, hot, shared.value[1]):
            p = np.zeros(len(bucket.pairs))
            for number, all_buckets in seatings.items():
                bucket.restore(heard[bucket.number, -1, number][0])
                t = all_buckets.at(*gathered(bucket, heard, number, parts))
                mass, parent = bucket.predicted(t)
                p += (mass + (STRENGTH + t.discount * t.tables[bucket.context]) * parent[bucket.word]) / (STRENGTH + t.customers[bucket.context])
            c = bucket.whole(bucket.own_counts, t.hot_counts)
            values = np.log10(p / len(seatings)), (np.log10(c + 1) - math.log10(t.tokens + t.words + 1))[bucket.word], (c > 0).astype(float)[bucket.word]
            at = 0
            for batch, n in bucket.batches:
                if batch not in held and len(held) == HELD:
                    send()
                i, doc, count = bucket.where[at : at + n], bucket.marked[at : at + n] & (2**15 - 1), bucket.entry_counts[at : at + n]
                total = held.setdefault(batch, np.zeros((3, BATCH)))
                for k, v in enumerate(values):
                    total[k] += np.bincount(doc, v[i] * count, BATCH)
                at += n
        send()
        return pa.table([pa.array(batches, pa.int64()), pa.array(payloads, pa.binary())], names=["batch", "sums"])

    rows = tokens.where("bucket >= 0").select("home", "bucket", "batch", "payload")
    return rows.groupBy("home").cogroup(news.groupBy("home")).applyInArrow(of, "batch long, sums binary")


def scored(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    slim = picked(docs, "doc_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    in_batches = "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)  # a task holds the words of no more
    with configured(slim.sparkSession, *in_batches):
        hot, codes = frequent_words(slim)
    buckets = max(8 * SPREAD, math.ceil(size / (bucket_bytes or bucket_size(size))))
    parts = math.ceil(buckets / SPREAD)
    with configured(slim.sparkSession, *in_batches):
        tokens = settled(tokenised(slim, buckets, hot, codes), dealt=True)
    let_go(docs.sparkSession)
    made = swept(tokens, hot, codes, parts, 0, None, None)
    first = contexts_of(made)
    let_go(docs.sparkSession)
    totals, news, sums = {0: totals_of(made, len(hot), 0)}, made.where("part < 0").unionByName(first.drop("spot")), []
    for number in range(1, sweeps + 1):
        made = swept(tokens, hot, codes, parts, number, totals[number - 1], news)
        totals[number] = totals_of(made, len(hot), number)
        news = made.where("part < 0").unionByName(contexts_again(made, first))
        if number > burn_in:
            sums.append(news)
    customers = first.drop("spot")
    news = reduce(DataFrame.unionByName, sums, customers)
    trained = int(totals[0].tokens)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    heads = tokens.where("bucket < 0").select("batch", F.col("payload").alias("head"), "ids", F.lit(None).cast("binary").alias("sums"))
    sums = document_sums(tokens, hot, codes, parts, news, {n: t for n, t in totals.items() if n > burn_in}).select("batch", F.lit(None).cast("binary").alias("head"), F.lit(None).cast(f"array<{id_type}>").alias("ids"), "sums")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One batch's rows follow each other; its sums are added as they come."""
        number, head, total = None, None, np.zeros((3, BATCH))

        def done() -> pd.DataFrame:
            held, n_tokens = unpack(head[0], np.uint8, np.int64)
            n = len(held)
            return pd.DataFrame({"doc_id": pd.Series(list(head[1]), dtype=object), "held_out": held.astype(bool), "n_tokens": n_tokens, "n_known": total[2, :n].round().astype(np.int64), "train_tokens": np.full(n, trained, np.int64), "base_score": total[1, :n], "score": total[0, :n]})

        for b in batches:
            for batch, h, ids, s in zip(b["batch"], b["head"], b["ids"], b["sums"], strict=True):
                if batch != number:
                    if head is not None:
                        yield done()
                    number, head = batch, None
                    total[:] = 0
                if h is not None:
                    head = (h, ids)
                else:
                    docs, *values = unpack(s, np.uint16, np.float64, np.float64, np.uint32)
                    total[:, docs] += values
        if head is not None:
            yield done()

    together = heads.unionAll(sums).repartition("batch").sortWithinPartitions("batch")
    return together.mapInPandas(joined, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
