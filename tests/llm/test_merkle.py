"""Merkle manifest: every row against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pathloom.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    all_ = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        all_.append(nodes)
    return all_


def path(all_, i):
    """Siblings of node i, level by level, and what folding another node along them gives."""
    out = []
    for nodes in all_[:-1]:
        j = i - i % 3
        out.append((nodes[j:i], nodes[i + 1 : j + 3]))
        i //= 3
    return out


def by_hand(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built[s] = levels([leaf(*r) for r in trees[s]])
    top = levels([built[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            proof = path(built[s], i) + path(top, n)
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].replace("\n", ""))
            node = leaf(*changed)
            for left, right in proof:
                node = sha("".join([*left, node, *right]))
            out.append((r[0], leaf(*r), built[s][-1][0], top[-1][0], sha("".join(x for l, r_ in proof for x in [*l, *r_])), node, node == top[-1][0]))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("case", ["sizes", "odd", "many sources", "one", "repeats"])
def test_against_trees_by_hand(spark, case):
    rows = {
        # whole, short and lone last runs, on either side of a stored level
        "sizes": [(i, f"s{n}", "en", i, f"text {i}\nline") for n in (1, 2, 3, 4, 80, 81, 82, 83, 244, 729, 730) for i in range(n)],
        "odd": [(None, None, None, None, None), (1, "", "", 0, ""), (None, None, "x", 1, "a\nb"), (2, None, None, None, None), (2, "é", "de", -5, "\n" * 3), (2, "z", "de", 3, "words " * 60_000 + "\n")],
        "many sources": [(i, f"source {i % 301}", "en", 1, "x\ny") for i in range(700)],
        "one": [(7, "only", "en", 4, "text")],
        "repeats": [(5, "a", "en", 1, "same\n")] * 300 + [(6, "b", "en", 1, "other\n")],
    }[case]
    got = merkle.checked(spark.createDataFrame(rows, DOCS)).select(NAMES).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_empty_and_other_columns(spark):
    assert merkle.checked(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, "a", "en", 1, "x"), (3, "a", "en", 1, "y\nz")], DOCS)
    more = docs.select("*", F.lit("clash").alias("Text"), F.lit(1).alias("a`b.c"), F.lit(2).alias("node"), F.lit(3).alias("pos"), F.lit(4).alias("width"))
    assert sorted(merkle.checked(more).collect()) == sorted(merkle.checked(docs).collect())


def test_proofs_hold_and_tampering_shows(spark):
    rows = [(i, f"s{i % 3 * (i % 2)}", "en", i, f"a\n{i}") for i in range(500)]
    got = merkle.proofs(merkle.built(spark.createDataFrame(rows, DOCS))).withColumn("folded", merkle.folded_up(F.col("leaf"), F.col("proof")))
    assert got.where("folded <> root").isEmpty() and got.select("root").distinct().count() == 1
    # a level holds two siblings at most
    assert got.where(F.exists("proof", lambda p: F.length(p["left"]) + F.length(p["right"]) > 128)).isEmpty()
    assert got.where(merkle.folded_up(F.lit("0" * 64), F.col("proof")) == F.col("root")).isEmpty()


def test_one_large_source_is_spread(spark):
    from pathloom.llm.common import settled
    from pathloom.llm.ranks import numbered

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.lit(None).cast("long").alias("doc_id"))
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # so few rows would be dealt to one task
    try:
        at = numbered(settled(rows), "source", "doc_id").withColumn("part", F.spark_partition_id()).persist()
        at.count()
    finally:
        spark.conf.unset(coalesced)
    assert at.groupBy("part").count().agg(F.max("count")).first()[0] < 10_000
    places = at.groupBy("source", "group_no").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.max("width").alias("w"))
    assert places.where("n <> d OR low <> 0 OR high <> n - 1 OR w <> n").isEmpty()
    assert [r["group_no"] for r in places.orderBy("source").collect()] == list(range(places.count()))
