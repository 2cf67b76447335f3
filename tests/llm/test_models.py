"""Toxicity, near-duplicates, Jaccard joins, language model, decontamination and the pipeline."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import common, contamination, jaccard, lm, neardup, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_automaton_is_levenshtein():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    terms = [(w, i % 4 == 0, 1.0) for i, w in enumerate(dict.fromkeys(words[:25]))]
    machine = toxicity.Automaton(terms)
    for w in words:
        found = [9]
        for term, begins, _ in terms:
            k = toxicity.allowed_edits(term, begins)
            e = min(distance(term, w[:n]) for n in range(len(w) + 1)) if begins else distance(term, w)
            found.append(e if e <= k else 9)
        assert machine.meet(w)[0] == (min(found) if min(found) < 9 else -1), w


def toxic_corpus(n=1500):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) * toxic):
            w = rng.choice(["scumbag", "worthless", "vile" + rng.choice(words)])
            text.insert(rng.randrange(len(text)), w)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    typo = [(10_000, "you are a scumbbag all of you scumbag"), (10_001, None), (10_002, ""), (10_002, ""), (None, "plain words here")]
    labels += [(None, 1, 1), (77_777, 1, 1), (3, None, None)]
    df = spark.createDataFrame(docs + typo, DOCS).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judged(df, lab).toPandas()
    assert len(got) == len(docs) + len(typo)
    truth = {i: t for i, _, t in labels[:1500]}
    held = got[got["held_out"] & got["doc_id"].isin(list(truth))]
    assert all(zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in held["doc_id"]) and len(held) > 200
    assert (held["predicted"] == [truth[i] for i in held["doc_id"]]).mean() > 0.97
    score = got.set_index("doc_id")["score"]
    assert score.loc[10_000] > 0.5 > score.loc[10_001] and score.loc[10_001] == score.loc[10_002].iloc[0]
    kept = toxicity.accepted(df, lab)
    assert kept.columns == df.columns and kept.count() == (got["predicted"] == 0).sum()
    # labels of held-out rows don't matter
    flipped = lab.withColumn("toxic", F.when(common.id_remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.judged(df, flipped).toPandas().sort_values(["doc_id", "score"])["score"].tolist() == got.sort_values(["doc_id", "score"])["score"].tolist()


def test_lexicon_grows_with_the_evidence(spark):
    rng = random.Random(4)
    slurs = list(dict.fromkeys("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(600)))
    rows = [(i, f"plain words {i}", 0) for i in range(9000)]
    rows += [(10_000 + i, " ".join([f"plain {i}", *[slurs[(i + 1000 * k) % len(slurs)] for k in range(4)]]), 1) for i in range(1000)]
    # copies of one text are no evidence for its words
    rows += [(20_000 + i, "copied quoteword", 1) for i in range(30)]
    terms = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    whole, begins = {t for t, b, _ in terms if not b}, {t for t, b, _ in terms if b}
    assert all(s in whole or any(s.startswith(b) for b in begins) for s in slurs) and len(whole) > 512
    assert "quoteword" not in whole and not any("quoteword".startswith(b) for b in begins)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.judged(df, none).collect()} == {0}
    assert toxicity.judged(df.limit(0), none).isEmpty()


def test_quotes_count_apart():
    reader = toxicity.Reader([("idiot", False, 2.0)])
    plain, quoted = reader.counts("you idiot go"), reader.counts('he said "what an idiot" and left')
    assert plain[0] > 0 == plain[2] and quoted[2] > 0 == quoted[0]
    assert reader.counts("an idiott")[1] > 0


def near_texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(2000)]
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), rng.choice([" ", "\n", "  "]).join(w)))
    return docs


def jaccard_of(texts):
    fold = str.maketrans(toxic_upper := "ABCDEFGHIJKLMNOPQRSTUVWXYZ", toxic_upper.lower())
    sets = []
    for t in texts:
        w = (t or "").translate(fold).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets


def test_jaccard_join_finds_every_link(spark):
    docs = near_texts() + [(9000, None), (9001, ""), (9002, "One"), (9003, "one"), (9004, "a b c d"), (9005, "a b c d e")]
    df = spark.createDataFrame(docs, DOCS).withColumn("class", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = jaccard.links(df).toPandas().set_index("doc_id")
    sets = jaccard_of([t for _, t in docs])
    ids = [i for i, _ in docs]
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    count = Counter()
    for a in range(len(ids)):
        for b in range(a):
            common_ = len(sets[a] & sets[b])
            if common_ and 5 * common_ >= 4 * (len(sets[a]) + len(sets[b]) - common_):
                count[ids[a]] += 1
                count[ids[b]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    assert got["n_links"].to_dict() == {i: count[i] for i in ids} and sum(count.values()) > 100
    assert got["component_id"].to_dict() == {i: find(i) for i in ids}
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in ids if find(i) == i)
    assert jaccard.links(df.limit(0)).isEmpty() and jaccard.deduplicated(df.limit(0)).isEmpty()


def test_repeated_rows_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (1, long + " more"), (1, "other words entirely here now"), (None, "quite different words stand here"), (None, "quite different words stand here"), (2, long), (7, None), (7, None)]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.deduplicated(df).collect()), key=str)
    # an id repeated with unrelated texts keeps a row of each: only copies and near copies go
    assert kept.count((7, None)) == 2 and kept.count((None, rows[4][1])) == 1 and sum(i == 1 for i, _ in kept) == 2 and (1, rows[3][1]) in kept and len(kept) == 5
    assert len(jaccard.links(df).collect()) == len(rows)


def test_null_ids_keep_a_row_a_group(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(50))
    alone = [(None, words(f"n{k}x")) for k in range(6)]
    # a group of two null ids, and one of a null id and another; copies; an id that begins a group of its own
    rows = [*alone, alone[0], (None, words("p")), (None, words("p") + " more"), (None, words("q")), (5, words("q") + " more"), (6, words("r")), (None, None), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.deduplicated(spark.createDataFrame(rows, DOCS)).collect()]
    assert all(kept.count(a) == 1 for a in alone) and kept.count((None, None)) == 2
    assert kept.count((None, words("p"))) + kept.count((None, words("p") + " more")) == 1
    assert kept.count((None, words("q"))) == kept.count((6, words("r"))) == 1 and len(kept) == 11


def test_groups_larger_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join([*base[:100], f"x{i}"])) for i in range(60)]
    got = jaccard.links(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(59, 0)}


def test_large_clusters_are_compared_by_bucket(spark, monkeypatch):
    df = spark.createDataFrame([*near_texts(), *[(5000 + i, " ".join([*(f"w{k}" for k in range(100)), f"x{i}"])) for i in range(60)]], DOCS)
    by_cluster = sorted(map(tuple, jaccard.links(df).collect()))
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "MOST_CHUNKS", 1)
    assert sorted(map(tuple, jaccard.links(df).collect())) == by_cluster


def test_a_chain_of_texts_is_no_group(spark):
    # each text shares 0.787 of its shingles with the next: tied from end to end, and no two link
    n = 20_000
    at = F.transform(F.sequence(F.lit(0), F.lit(45)), lambda k: F.concat(F.lit("w"), F.col("id") * 5 + k))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(at, " ").alias("text"))
    twin = spark.createDataFrame([(n + i, " ".join(f"w{i * 5 + k}" for k in range(45))) for i in (7, 11_000)], DOCS)
    got = jaccard.links(df.unionAll(twin)).where("n_links > 0").select("doc_id", "component_id", "n_links").collect()
    # 41 of 42 shingles with text i, 37 of 46 with the one before, 36 of 47 with the one after
    assert sorted(map(tuple, got)) == sorted(r for i in (7, 11_000) for r in [(i - 1, i - 1, 1), (i, i - 1, 1), (n + i, i - 1, 2)])


def test_pruning_bounds():
    for n, m in jaccard.LEAST.items():
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))  # noqa: E731, B023
        assert tail(m) >= jaccard.TOLERANCE > tail(m - 1)


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 24))
    v = [b + s * rng.standard_normal(24) for b in base for s in (0, 0.1, 0.2, 0.3, 0.45)] + [base[0]] * 5
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [math.nan] * 24), (904, [None, 1.0]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (906, [2.0, 4.0]), (907, [math.inf, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("class", F.lit("clash"))
    got = neardup.joined(df, recall=0.999).toPandas().set_index("vec_id")
    m = np.stack(v)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    assert got.loc[list(range(len(v))), "n_links"].tolist() == near.sum(1).tolist()
    reach = np.arange(len(v))
    for _ in range(len(v)):
        reach = np.array([min(reach[i], *reach[near[i]]) if near[i].any() else reach[i] for i in range(len(v))])
    assert got.loc[list(range(len(v))), "component_id"].tolist() == reach.tolist()
    assert all(got.loc[i, "n_links"] == 0 and got.loc[i, "component_id"] == i for i in (900, 901, 902, 903, 904, 907))
    assert got.loc[905, "n_links"] == 2 and set(got.loc[906, "component_id"]) == {905}
    assert neardup.joined(df.limit(0)).isEmpty()


def test_language_model(spark):
    rng = random.Random(2)

    def chain():
        at = rng.randrange(300)
        for _ in range(rng.randrange(1, 40)):
            yield f"w{at}"
            at = (at * 7 + rng.randrange(3)) % 300 if rng.random() < 0.8 else rng.randrange(300)

    rows = [(i, " ".join(chain())) for i in range(800)] + [(900, None), (901, "\t"), (None, "Zz zZ"), (902, "new words only"), (902, "new words only")]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = lm.scored(df, bucket_bytes=3000).toPandas()
    token = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in token(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(token(t)), sum(counts[w] > 0 for w in token(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t)), 6)) for i, t in rows)
    name = lambda i: "None" if i is None or i != i else str(int(i))
    assert sorted((name(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert got[got["held_out"]]["score"].sum() > got[got["held_out"]]["base_score"].sum()
    again = lm.scored(df, bucket_bytes=3000).toPandas()
    assert sorted(again["score"]) == pytest.approx(sorted(got["score"]), rel=1e-9)
    assert lm.scored(df.limit(0)).isEmpty()


def test_language_model_is_a_distribution():
    """Predictions of all known words and one unknown add up to one in every context."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 60, rng.integers(1, 30)).astype(np.int64) * 7919 for _ in range(200)]
    hot = np.array([7919 * 3], np.uint64)
    rows = list(lm.packed(np.zeros(200, bool), texts, 0, 1, hot))
    bucket = lm.Bucket(0, [(b, p) for home, b, p in rows if home == 0], hot)
    of = lambda number: lm.Totals({int(k): (a, b) for k, a, b in zip(*bucket.sums(), strict=True)}, 1, number)
    totals = of(0)
    for sweep in range(1, 3):
        bucket.sweep(totals, sweep)
        totals = of(sweep)
    own, parent = bucket.predicted(totals)
    unknown = (lm.PARENT_STRENGTH + totals.parent_discount * totals.parent_tables) / (totals.words + 1) / (lm.PARENT_STRENGTH + totals.parent_customers)
    assert parent.sum() + unknown == pytest.approx(1)
    for u in set(bucket.context.tolist()):
        back = lm.STRENGTH + totals.discount * totals.tables[u]
        mass = own[bucket.context == u].sum() + back * (parent.sum() + unknown)
        assert mass / (lm.STRENGTH + totals.customers[u]) == pytest.approx(1)


def tables_law(c, p, d, strength, others):
    """P(t tables | c customers), t = 1..c, by enumeration."""
    ways = np.array([0.0])  # logarithms
    for n in range(c):
        stay = ways + np.log(np.maximum(n - d * np.arange(n + 1), 1e-300))
        ways = np.logaddexp(np.append(stay, -1e9), np.insert(ways, 0, -1e9))
    logs = [ways[t] + sum(math.log(strength + d * (others + i)) for i in range(t)) + t * math.log(p) for t in range(1, c + 1)]
    weights = np.exp(np.array(logs) - max(logs))
    return weights / weights.sum()


@pytest.mark.parametrize(("c", "p", "d", "strength", "others"), [(2, 0.3, 0.5, 2.0, 0), (10, 0.1, 0.75, 2.0, 0), (60, 0.2, 0.75, 2.0, 0), (60, 0.05, 0.75, 2.0, 20), (200, 0.01, 0.6, 1.0, 100), (256, 0.3, 0.8, 2.0, 500), (400, 0.05, 0.75, 2.0, 20), (600, 0.001, 0.5, 2.0, 3000)])
def test_tables_are_drawn_from_their_conditional(c, p, d, strength, others):
    law, n = tables_law(c, p, d, strength, others), 4000
    mean = law @ np.arange(1, c + 1)
    spread = math.sqrt(law @ (np.arange(1, c + 1) - mean) ** 2)
    got = lm.seated(np.full(n, float(c)), np.full(n, float(others)), np.full(n, p), strength, d, np.random.default_rng(3))
    assert abs(got.mean() - mean) < 3 * spread / math.sqrt(n) and abs(got.std() - spread) < 0.1 * spread


def test_many_tables_and_few_customers():
    law, n = tables_law(700, 0.3, 0.8, 2.0, 500), 2000
    got = lm.seated(np.full(n, 700.0), np.full(n, 500.0), np.full(n, 0.3), 2.0, 0.8, np.random.default_rng(3))
    assert abs(got.mean() / (law @ np.arange(1, 701)) - 1) < 0.03
    assert lm.seated(np.array([1.0, 0.0, 1e7]), np.ones(3), np.full(3, 1e-9), 2.0, 0.5, np.random.default_rng(1)).tolist() == [1, 0, 1]


def seated_one_by_one(texts, discounts, sweeps, rng):
    """An independent sampler: every customer stands up and sits down again, tables and parent alike. Returns P(w | u), averaged."""
    d, e = discounts
    h = g = 2.0
    words = sorted({w for t in texts for w in t})
    v = len(words)
    tables, parent, seats = {}, {w: [] for w in words}, []

    def p_parent(w):
        n, s = sum(sum(x) for x in parent.values()), sum(len(x) for x in parent.values())
        return (sum(parent[w]) - e * len(parent[w]) + (g + e * s) / (v + 1)) / (g + n)

    def sit(where, w, new, discount):
        weights = [max(n - discount, 0) for n in where[w]] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(where[w]):
            where[w].append(0)
        where[w][k] += 1
        return where[w][k] == 1

    def leave(where, w):
        k = rng.choices(range(len(where[w])), where[w])[0]
        where[w][k] -= 1
        if not where[w][k]:
            del where[w][k]
            return True
        return False

    def add(u, w):
        r = tables.setdefault(u, {x: [] for x in words})
        if sit(r, w, (h + d * sum(len(x) for x in r.values())) * p_parent(w), d):
            sit(parent, w, (g + e * sum(len(x) for x in parent.values())) / (v + 1), e)

    for t in texts:
        for u, w in zip([None, *t], t):
            add(u, w)
            seats.append((u, w))
    mean, kept = Counter(), 0
    for sweep in range(sweeps):
        for u, w in seats:
            if leave(tables[u], w):
                leave(parent, w)
            add(u, w)
        if sweep >= sweeps // 4:
            kept += 1
            for u, r in tables.items():
                c, n = sum(sum(x) for x in r.values()), sum(len(x) for x in r.values())
                for w in words:
                    mean[u, w] += (sum(r[w]) - d * len(r[w]) + (h + d * n) * p_parent(w)) / (h + c)
    return {k: x / kept for k, x in mean.items()}


def test_scores_match_an_independent_sampler(spark):
    rng = random.Random(8)
    texts = [[f"w{min(11, int(rng.expovariate(0.4)))}" for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["score"] for r in lm.scored(df, sweeps=12, burn_in=2).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [[*t, "END"] for i, t in enumerate(texts) if not held(i)]
    hashes = {"END": lm.END, **{w: None for t in texts for w in t}}
    pairs = Counter((u, w) for t in train for u, w in zip([None, *t], t))
    assert hashes and pairs
    # discounts as the operator sets them, from one table a pair
    ones, twos = sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values())
    contexts = Counter(w for _, w in pairs)
    d = min(0.95, max(0.2, (ones + 1) / (ones + 2 * twos + 2)))
    a, b = sum(c == 1 for c in contexts.values()), sum(c == 2 for c in contexts.values())
    e = min(0.95, max(0.2, (a + 1) / (a + 2 * b + 2)))
    p = seated_one_by_one(train, (d, e), 60, random.Random(1))
    known = {w for t in train for w in t}
    want = {i: sum(math.log10(p[u, w]) for u, w in zip([None, *t], [*t, "END"])) for i, t in enumerate(texts) if set(t) <= known and all((u, t[0]) in p for u in [None, *t])}
    off = np.array([got[i] / want[i] - 1 for i in want])
    assert len(off) > 20 and abs(off.mean()) < 0.02 and abs(off).max() < 0.12


def test_a_hot_word_lies_in_many_buckets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(30) for w in ("the", f"x{rng.randrange(3000)}"))) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    hot = lm.hot_words(df)
    assert 1 <= len(hot) <= lm.HOT and df.select(F.xxhash64(F.lit("the")).alias("h")).first()["h"] in hot.view(np.int64).tolist()
    tokens = lm.tokenised(df, 12, hot).where("bucket >= 0").toPandas()
    the = np.uint64(np.int64(df.select(F.xxhash64(F.lit("the")).alias("h")).first()["h"]).view(np.uint64))
    assert len({b for b, p in zip(tokens["bucket"], tokens["payload"], strict=True) if the in lm.unpack(p, *lm.TYPES)[0]}) == 12
    few, many = (lm.scored(df, bucket_bytes=n).toPandas().set_index("doc_id")["score"].sort_index() for n in (10**9, 500))
    assert abs(few / many - 1).max() < 0.02


def run_distance(item, words):
    """Brute force over all runs."""
    return min(distance(item, words[a:b]) for a in range(len(words) + 1) for b in range(a, len(words) + 1))


def test_bit_parallel_distance():
    rng = random.Random(5)
    for _ in range(150):
        item, words = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        assert contamination.distance(item, words)[0] == run_distance(item, words)


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(1500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(8, 60)))) for i in range(30)] + [(98, None), (99, " !? ")]
    docs, planted = [], {}
    for d in range(300):
        text = rng.choices(words, k=rng.randrange(0, 200))
        if d % 3 == 0:
            item = rng.randrange(30)
            run = items[item][1].split()
            for _ in range(rng.randrange(0, len(run) // 10 + 1)):
                run[rng.randrange(len(run))] = rng.choice(words)
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.title() + rng.choice(["", ",", "."]) for w in run]
            planted[d] = item
        docs.append((d, " ".join(text)))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, items[0][1]), (902, items[0][1])], DOCS).withColumn("_hits", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.leaks(df, bench, block=7).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert set(planted.items()) | {(902, 0)} == found and sum(r["doc_id"] == 902 for r in got) == 2
    texts = dict(docs)
    for r in got[:40]:
        if r["doc_id"] in texts:
            norm = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
            run = norm(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]
            assert distance(norm(items[r["item_id"]][1]), run) == r["edits"]
    kept = contamination.clean(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs if d not in planted} | {900, 901}
    assert contamination.leaks(df, bench.limit(0)).isEmpty() and contamination.leaks(df.limit(0), bench).isEmpty()
    assert contamination.clean(df, bench.limit(0)).count() == df.count()


def test_edited_items_beside_exact_ones_and_at_the_end():
    rng = np.random.default_rng(12)
    item, other = (rng.integers(1, 2**40, 20) for _ in range(2))
    fresh = lambda n: rng.integers(2**41, 2**42, n)
    items = contamination.Items([item, other])
    beside = last = joined = 0
    for _ in range(200):
        edited = item.copy()
        edited[rng.choice(20, 4, replace=False)] = fresh(4)
        beside += [h[0] for h in items.found([np.concatenate([fresh(5), edited, other, fresh(5)])])[0]] == [0, 1]
        # the last document of a batch is shorter than its item
        short = np.delete(item, rng.choice(20, 3, replace=False))
        last += [h[0] for h in items.found([fresh(50), short])[1]] == [0]
        # an exact item begins the next document of the batch
        joined += [h[0] for h in items.found([np.concatenate([fresh(5), edited]), other])[0]] == [0]
    assert beside >= 190 and last >= 190 and joined >= 190
    # all places in reach are verified: no item straddles two documents
    assert items.found([item[:10], item[10:]]) == [[], []] and items.found([fresh(0), item[:1]]) == [[], []]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard_hint", F.lit("x"))
    held = docs
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    judged = toxicity.judged(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    held = stages["toxicity"](spark, docs, SF)
    assert {r["doc_id"] for r in held.collect()} == {r["doc_id"] for r in judged.where("predicted = 0").collect()}
    once = stages["near_duplicates"](spark, held, SF)
    rows = held.select("doc_id", "text").collect()
    sets = dict(zip([r["doc_id"] for r in rows], jaccard_of([r["text"] for r in rows]), strict=True))
    left = sorted(r["doc_id"] for r in once.collect())
    near = lambda a, b: 5 * (c := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - c)
    assert not [(a, b) for n, a in enumerate(left) for b in left[:n] if near(a, b)]
    clean = stages["decontamination"](spark, once, SF)
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r for r in clean.collect() if any(i in norm(r["text"]) for i in items)]
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns
    last = stages["sharding"](spark, mixed, SF)
    assert last.columns == [*docs.columns, "shard", "slot"] and last.count() == mixed.count()
    assert cp.run(spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["op1_filter_urls", "op3_mix_sources", "op7_format_chats", "op8_join_ngrams"])
def test_queries_match_sql(spark, name):
    from pathloom.llm import queries

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


def test_each_context_has_its_own_restaurant(spark):
    """Two words that a table of 65,535 contexts by hash would seat together keep what follows them apart."""
    words = [f"x{i}" for i in range(3000)]
    hashes = np.array([r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()], np.int64).view(np.uint64)
    by_bin: dict[int, list[str]] = {}
    for w, b in zip(words, (lm.mixed(hashes) % np.uint64(65_535)).tolist(), strict=True):
        by_bin.setdefault(b, []).append(w)
    a, b = next(ws for ws in by_bin.values() if len(ws) > 1)[:2]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    asked = dict(zip(held, (f"{a} p", f"{a} q", f"{b} q", f"{b} p"), strict=True))
    rows = [(i, asked.get(i, f"{a} p" if i % 2 else f"{b} q")) for i in range(400)]
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(rows, DOCS)).where(F.col("doc_id").isin(held)).collect()}
    assert got[held[0]] > got[held[1]] + 1 and got[held[2]] > got[held[3]] + 1


def test_contexts_are_summed_over_buckets(spark):
    """Customers and tables of a context in all buckets, whether a code or a hash names it."""
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(40)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    hot, codes = lm.frequent_words(df)
    codes = codes[::2]
    tokens = common.settled(lm.tokenised(df, 20, hot, codes), dealt=True)
    made = lm.swept(tokens, hot, codes, 5, 0, None, None)
    first = lm.contexts_of(made)
    again = lm.contexts_again(made.where("part >= 0"), first)
    names = {r["h"]: r["w"] for r in spark.createDataFrame([(w,) for w in {w for t in texts for w in t.split()}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            pairs.update(zip(t.split(), [*t.split()[1:], None]))
    customers, tables = Counter(), Counter(u for u, _ in pairs)
    for (u, _), n in pairs.items():
        customers[u] += n
    sums, seen = {(r["bucket"], r["part"]): r for r in first.collect()}, set()
    later = {(r["bucket"], r["part"]): r for r in again.collect()}
    for r in made.where("part >= 0").collect():
        mine = sums[r["bucket"], r["part"]]
        got = lm.unpack(mine["data"], np.uint32)[0]
        assert (lm.unpack(later[r["bucket"], r["part"]]["data"], np.uint32)[0] == got).all()
        for h, c, t in zip(lm.unpack(r["more"], np.uint64, np.float64)[0], lm.unpack(mine["more"], np.float64)[0], got, strict=True):
            if h != lm.START:
                seen.add(w := names[int(h.view(np.int64))])
                assert (c, t) == (customers[w], tables[w])
    assert seen >= set(customers)


def test_memory_of_packing_a_batch():
    import tracemalloc

    rng = np.random.default_rng(1)
    words = [(rng.zipf(1.3, 250) * 2_654_435_761 % 2**60).astype(np.int64) for _ in range(2000)]
    tracemalloc.start()
    rows = sum(1 for _ in lm.packed(np.zeros(2000, bool), words, 0, 40, np.empty(0, np.uint64)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 41 and peak < 45 * 2000 * 251


def test_one_python_worker_a_task_scores_texts(spark, capsys):
    """No Python node feeds another in the same stage: a task would need a worker for each."""
    lm.scored(spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], DOCS)).explain()
    nodes = [n for n in re.findall(r"\b(Exchange|MapInArrow|MapInPandas|FlatMapCoGroupsInArrow|FlatMapGroupsInArrow)\b", capsys.readouterr().out)]
    assert "FlatMapCoGroupsInArrow" in nodes
    assert all("Exchange" in pair for pair in zip(nodes, nodes[1:]))
