"""Prefix tries: every node against sequences grouped by hand."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import prefixtrie

LOG = "conv_id long, turn long, role string, text string"


def digest_of(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(ts, key=lambda x: (x[0], x[1], digest_of(x[2])))] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    out = []
    for node, ms in members.items():
        subtree = [m for m in members if m[: len(node)] == node]
        kids = {k: sum(m[:-1] == k for m in members if m) for k in subtree}
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in subtree if m)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), kids[node], sum(n == 0 for n in kids.values()), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def some_log(seed, convs=60, words=4):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é b", "", None, "long " * 50][:words])) for c in range(convs) for t in range(r.randrange(1, 12))]


ODD = [
    (1, None, "user", "first"), (1, 0, "user", "then"), (1, 0, "user", "then"), (1, 0, "user", "tie"), (None, 0, "user", "of none"), (None, 1, None, None), (7, 3, None, "x" * 300_000),
    (11, 0, "us", "er"), (16, 0, "u", "ser"), (3, 0, "a", "b"), (4, 0, "a", "b"), (2_000_001, 5, "a", "b"), (5, 1, "", ""), (5, 2, "", ""),
]


@pytest.mark.parametrize(("rows", "block"), [(some_log(1), 7), (some_log(2, words=2), 1), (some_log(3, words=5), 100_000), (ODD, 2), ([(c, t, "r", "same") for c in range(5, 900) for t in range(3)], 50)], ids=["small blocks", "one a block", "one block", "odd", "copies"])
def test_against_sequences(spark, rows, block):
    found = prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.conversations(spark.createDataFrame(rows, LOG))), block)
    assert found.columns == prefixtrie.COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(rows)


def test_many_shards(spark):
    rows = some_log(4, convs=300, words=3)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        found = prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.conversations(spark.createDataFrame(rows, LOG))), 40).collect()
    finally:
        spark.conf.unset(coalesced)
    assert sorted(map(tuple, found), key=str) == by_hand(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 3) for t in range(6_000)] + [(9, 0, "user", "turn 0")]
    found = prefixtrie.shared_prefixes(spark.createDataFrame(rows, LOG))
    # the rebuilt 3 equals 0, and 9 follows conversation 5, which isn't there
    assert found.count() == 6_001
    root = found.where("depth = 0").first()
    assert (root["n_convs"], root["n_leaves"]) == (3, 1) and root["saved_tokens"] >= sum(len(f"turn {t}") for t in range(6_000))
    assert found.where("depth = 6000").first()["n_convs"] == 2


def test_empty_and_other_columns(spark):
    assert prefixtrie.shared_prefixes(spark.createDataFrame([], LOG)).collect() == []
    log = spark.createDataFrame(some_log(5, convs=12), LOG)
    more = log.select("*", F.lit("x").alias("Text"), F.lit(1).alias("path"), F.lit(2).alias("b`t.c"), F.lit(3).alias("n_convs"))
    assert sorted(prefixtrie.shared_prefixes(more).collect(), key=str) == sorted(prefixtrie.shared_prefixes(log).collect(), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    r = np.random.default_rng(seed)
    paths = sorted({tuple(r.integers(1, (3, 40, 400)[seed % 3], r.integers(0, 9))) for _ in range(300)})
    lengths = np.array([len(p) for p in paths])
    starts, codes = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array([c for p in paths for c in p], np.int64)
    trie = prefixtrie.packed(codes, starts, lengths)
    slots = {(): 0}
    for p in paths:
        at = 0
        for d, c in enumerate(p, 1):
            at = int(trie.next(np.array([at]), np.array([c]))[0])
            assert slots.setdefault(p[:d], at) == at
    assert len(set(slots.values())) == len(slots) and (trie.check >= 0).sum() == len(slots) - 1
    assert trie.top < 4 * len(slots) + 400


def test_same_as_sql(spark):
    log = spark.createDataFrame(some_log(6, convs=80, words=5), LOG)
    con = duckdb.connect()
    con.register("conversations", log.toPandas().convert_dtypes())
    want = [tuple(None if x != x else x for x in row) for row in con.sql(prefixtrie.ORACLE).fetchall()]
    names = [c[0] for c in con.sql(prefixtrie.ORACLE).description]
    assert sorted(map(tuple, prefixtrie.shared_prefixes(log).select(names).collect()), key=str) == sorted(want, key=str)
