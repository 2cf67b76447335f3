"""Toxicity: a learned lexicon met through Levenshtein automata, weighed by context.

1. The lexicon is learned from labelled rows: for every word, and every word beginning of 4 to 7
   letters, the labelled texts of either class that hold it are counted over all of them, copies
   once, and all terms that tell toxic documents, by a smoothed log-odds ratio less its error, are
   kept (the only part that reaches driver and executors whole: evidence alone bounds it).
2. Terms form one trie. A word is read by the trie's Levenshtein automaton: states are sets of
   (trie node, edits), built as they are met and kept, so a word costs a dictionary look-up a
   character. Whole-word terms of 5 letters or more allow one edit, of 9 or more two; beginnings
   of 6 letters or more allow one.
3. Every hit counts its term's weight, with its context window: hits within quotation marks count
   apart from the rest, and so do misspelled ones; words of address near a hit count too.
4. A logistic model on these counts, fitted on at most FIT_ROWS labelled rows around a prior that
   holds hits as evidence, turns them into a score.

Labels of held-out rows (crc32 of the id, modulo 5, is 0) are never read. Source, language and id
are no inputs of a score.

Defined results: a null text counts as empty and scores by the bias alone; texts of any length are
read whole; words that meet several terms count the fewest edits, then the largest weight; rows with the same id
are scored each; labels that are null or of unknown documents are ignored, and repeated ones count
each, but of rows with other ids and the same text and label one id's count for the lexicon; without labels of both classes the lexicon is empty and every score is that of the prior's
bias; an empty table gives no rows. Other columns of the documents pass through `scored`, but for
those named as its own, in whatever case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, id_remainder, picked, restored, settled, small_side

FIT_ROWS = 20_000
FOLDS = 5
#: A term is in so many toxic texts, however many there are.
MIN_DOCS, MIN_WEIGHT, DEVIATIONS = 4, math.log(6.0), 1.645
REFINES = 0.7
#: Labels up to which (12 bytes a row) they are broadcast to the documents.
BROADCAST_LABELS = 2_000_000
#: Texts with copies up to which (20 bytes a row) they are broadcast.
BROADCAST_COPIED = 1_000_000
SPLIT = r"[^\p{L}\p{N}]+"
WORDS = re.compile(r"([^\W_]+)")
WINDOW = 6
OPENING, CLOSING = "\"“«„‘‹", "\"”»“’›"
ADDRESS = frozenset("you your yours youre u tu toi vous du dich dir ihr euch usted ustedes vosotros eres".split())
#: Prior means of bias, plain hits, misspelled hits, quoted hits, address near hits; and their spread.
PRIOR, SPREAD = np.array([-4.0, 3.5, 2.0, 0.5, 0.3]), np.array([2.0, 1.5, 1.0, 1.0, 0.5])


def training(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, text, toxic of labelled rows outside the held-out fold."""
    known = picked(labels, "doc_id", "toxic").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    kept = picked(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(id_remainder("doc_id", folds) != 0)
    return kept.join(small_side(known, BROADCAST_LABELS), F.col("doc_id") == F.col("_id")).drop("_id")


def once(train: DataFrame) -> DataFrame:
    """toxic and text of train, of rows with equal ones only those of the smallest id."""
    rows = train.withColumn("_h", F.xxhash64("text"))
    copied = rows.groupBy("_h", "toxic").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least <> _most")
    rows = rows.join(small_side(settled(copied.select("_h", "toxic", "_least")), BROADCAST_COPIED), ["_h", "toxic"], "left")
    return rows.where("_least IS NULL OR doc_id = _least").select("toxic", "text")


def lexicon(train: DataFrame, size: int | None = None) -> list[tuple[str, bool, float]]:
    """(term, whether it is a beginning, weight), the best first; all that the evidence bears, or size of them."""
    train = once(train)
    n = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = (n[0] or 0), (n[1] or 0)
    if not bad or not good:
        return []
    words = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), SPLIT))).alias("w")).where("w <> ''")
    seen = words.groupBy("w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    whole = seen.select(F.col("w").alias("term"), F.lit(False).alias("begins"), "bad", "good")
    cut = seen.where("length(w) > 4").select(F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("w") - 1, F.lit(7))), lambda k: F.substring(F.col("w"), 1, k))).alias("term"), "bad", "good")
    begun = cut.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).where("words > 1")
    terms = whole.unionAll(begun.select("term", F.lit(True).alias("begins"), "bad", "good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    terms = terms.withColumn("weight", odds - DEVIATIONS * error).where((F.col("bad") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT))
    best = terms.orderBy(F.desc(F.col("bad") * F.col("weight")), "begins", "term")
    kept: dict[tuple[str, bool], float] = {}
    for r in best.collect():
        # a beginning already kept speaks for its longer forms, unless they weigh much more
        shorter = [kept[b] for k in range(4, len(r["term"]) + 1) if (b := (r["term"][:k], True)) in kept]
        if not shorter or r["weight"] > max(shorter) + REFINES:
            kept[r["term"], r["begins"]] = r["weight"]
    return [(term, begins, weight) for (term, begins), weight in kept.items()][:size]


def allowed_edits(term: str, begins: bool) -> int:
    if begins:
        return int(len(term) >= 6)
    return 2 if len(term) >= 9 else int(len(term) >= 5)


class Automaton:
    """The lexicon's trie read with edits; states are made when first met."""

    MOST_STATES = 200_000

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # edits allowed to a whole word that ends here
        self.begins: list[int] = [-1]  # the same for a beginning
        self.slack: list[int] = [0]  # most edits allowed to anything at or below
        self.weight: dict[tuple[int, bool], float] = {}
        for term, begins, weight in terms:
            k, node = allowed_edits(term, begins), 0
            self.slack[0] = max(self.slack[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.begins.append(-1)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], k)
            table = self.begins if begins else self.ends
            table[node] = max(table[node], k)
            self.weight[node, begins] = weight
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.begun: list[tuple[int, float]] = []  # the best beginning met at a state: edits, -weight
        self.ended: list[tuple[int, float]] = []  # the best whole word
        self.start = self.name({0: 0})

    def name(self, found: dict[int, int]) -> int:
        """The number of a state, after letters of the lexicon that the word leaves out."""
        todo = list(found)
        while todo:
            node = todo.pop()
            edits = found[node] + 1
            if edits > self.slack[node]:
                continue
            for child in self.children[node].values():
                if edits <= self.slack[child] and edits < found.get(child, 9):
                    found[child] = edits
                    todo.append(child)
        key = tuple(sorted(found.items()))
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(found)
            self.moves.append({})
            for table, begins, best in ((self.begins, True, self.begun), (self.ends, False, self.ended)):
                best.append(min([(9, 0.0), *((e, -self.weight[node, begins]) for node, e in found.items() if e <= table[node])]))
        return self.names[key]

    def step(self, state: int, c: str) -> int:
        to = self.moves[state].get(c)
        if to is None:
            found: dict[int, int] = {}
            for node, edits in self.sets[state].items():
                if edits >= self.slack[node]:  # nothing below bears one more
                    child = self.children[node].get(c)
                    if child is not None and edits <= self.slack[child] and edits < found.get(child, 9):
                        found[child] = edits
                    continue
                for letter, child in self.children[node].items():
                    e = edits + (letter != c)
                    if e <= self.slack[child] and e < found.get(child, 9):
                        found[child] = e
                if edits + 1 < found.get(node, 9):
                    found[node] = edits + 1
            to = self.moves[state][c] = self.name(found) if found else -1
        return to

    def meet(self, word: str) -> tuple[int, float]:
        """The fewest edits with which the word meets a term, or -1, and the largest weight at that."""
        if len(self.sets) > self.MOST_STATES:
            self.reset()
        state, best, moves, begun = self.start, (9, 0.0), self.moves, self.begun
        for c in word:
            to = moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                break
            if begun[state] < best:
                best = begun[state]
        else:
            best = min(best, self.ended[state])
        return (best[0], -best[1]) if best[0] < 9 else (-1, 0.0)


class Reader:
    """Weights met in a text: by plain, misspelled and quoted hits, and by hits with a word of address near."""

    MOST_WORDS = 400_000

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.automaton, self.known = Automaton(terms), {}

    def meet(self, word: str) -> tuple[int, float]:
        e = self.known.get(word)
        if e is None:
            if len(self.known) > self.MOST_WORDS:
                self.known.clear()
            e = self.known[word] = self.automaton.meet(word)
        return e

    def counts(self, text: str) -> tuple[float, float, float, float]:
        parts = WORDS.split(text.lower())  # what is between words, and the words
        words = parts[1::2]
        hits = {w: e for w in set(words) if (e := self.meet(w))[0] >= 0}
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        plain = spelled = quoted = address = 0.0
        between = "".join(parts[::2])
        marks = [(o, c) for o, c in zip(OPENING, CLOSING, strict=True) if o in between and c in between]
        for i, word in enumerate(words):
            if word not in hits:
                continue
            edits, weight = hits[word]
            a, b = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            before, after = ("".join(parts[2 * a + 2 : 2 * i + 1 : 2]), "".join(parts[2 * i + 2 : 2 * b + 1 : 2])) if marks else ("", "")
            if any(before.count(o) > (before.count(c) if o != c else 0) and c in after for o, c in marks):
                quoted += weight
            elif edits:
                spelled += weight
            else:
                plain += weight
            address += weight * (not ADDRESS.isdisjoint(words[a : b + 1]))
        return tuple(math.log1p(x) for x in (plain, spelled, quoted, address))


def fitted(rows: list) -> np.ndarray:
    """Weights of bias and counts by Newton's method around the prior. rows: (times, toxic, four counts)."""
    w = PRIOR.copy()
    if not rows:
        return w
    data = np.array([list(r) for r in rows], dtype=float)
    times, y, x = data[:, 0], data[:, 1], np.column_stack([np.ones(len(data)), data[:, 2:]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - y)) + (w - PRIOR) / SPREAD**2
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(1 / SPREAD**2), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def counted(docs: DataFrame, terms: list, keep: list[str]) -> DataFrame:
    """The columns keep and the array _x of a text's counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("array<double>")
    def x(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value)
        for batch in texts:
            yield pd.Series([list(reader.counts(t or "")) for t in batch])

    return docs.withColumn("_x", x("text")).select(*[F.col(f"`{c}`") for c in keep], "_x")


def fit_sample(train: DataFrame, terms: list, rows: int) -> list[tuple]:
    """(times, toxic, four counts) of the first rows of train in the order of a hash of id and text.

    Hashes are chosen first, among those below a bound that some two times as many pass; only then
    are the texts read, where they lie, and rows alike come as one.
    """
    keyed = train.withColumn("_k", F.xxhash64("doc_id", "text"))
    share = min(1.0, 2.0 * rows / max(1, train.count()))
    passing = keyed.where(F.col("_k").cast("double") / 2.0**64 + 0.5 <= share) if share < 1 else keyed
    chosen = passing.select("_k", "toxic").orderBy("_k", "toxic").limit(rows).groupBy("_k", "toxic").agg(F.count("*").alias("_times"))
    # at most `rows` hashes
    found = counted(keyed.join(F.broadcast(chosen), ["_k", "toxic"]), terms, ["_k", "toxic", "_times"])
    alike = found.groupBy("_k", "toxic").agg(F.first("_times").alias("times"), F.first("_x").alias("x"))
    return [(r["times"], r["toxic"], *r["x"]) for r in alike.orderBy("_k", "toxic").collect()]


def _scored(docs: DataFrame, labels: DataFrame, size: int | None = None, fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> DataFrame:
    """docs with held_out, score and predicted."""
    train = training(docs, labels, folds)
    terms = lexicon(train, size)
    w = fitted(fit_sample(train, terms, fit_rows) if terms else [])
    z = F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in w[1:]]), lambda a, b: a * b), F.lit(float(w[0])), lambda a, v: a + v)
    s = counted(docs, terms, docs.columns).withColumn("score", 1 / (1 + F.exp(-z)))
    return s.drop("_x").withColumns({"held_out": id_remainder("doc_id", folds) == 0, "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with held_out, score and predicted; columns of these names give way."""
    return restored(_scored(apart(docs, "doc_id", "text"), labels, **options), docs, "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't predicted toxic, in their own columns whatever their names."""
    return restored(_scored(apart(docs, "doc_id", "text"), labels, **options).where("predicted = 0"), docs)


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return scored(picked(docs, "doc_id", "text"), labels, **options).select("doc_id", "held_out", "score", "predicted")
