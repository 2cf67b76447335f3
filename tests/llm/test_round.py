"""What the operators promise beyond single rows: error rates, recall, exact probabilities, samplers, odd columns."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat, common, contamination, jaccard, lm, mixing, neardup, secrets, sharding, toxicity, urlfilter

NOUNS = "account address archive balance branch buffer cache client cluster column config counter customer database device document engine error event factory folder handler header index invoice item job key layer ledger list loader manager market message metric module network node number object order owner package page parser partner payment plugin policy process product profile project queue quarter record region report request result river sales schema score server service session signal socket source stage status stream student summary system table target task template thread ticket token total tracker user value vector vendor version video window worker writer".split()


def identifiers(n, rng):
    out = []
    while len(out) < n:
        words = [rng.choice(NOUNS) for _ in range(rng.randrange(3, 7))]
        number = str(rng.randrange(10 ** rng.randrange(1, 5)))
        kind = len(out) % 4
        if kind == 0:
            name = "".join(w.title() for w in words) + number
        elif kind == 1:
            name = "_".join([*words, number])
        elif kind == 2:
            name = "/".join([*words[:-1], words[-1] + number])
        else:
            name = "_".join(w.upper() for w in words) + "_" + number
        if len(name) >= 20:
            out.append(name)
    return out


def test_flagged_tokens_are_secrets(spark):
    rng = random.Random(5)
    names = identifiers(1000, rng)
    alphabets = [secrets.UPPER + secrets.LOWER + secrets.DIGITS, secrets.LOWER + secrets.DIGITS, secrets.UPPER + secrets.LOWER + secrets.DIGITS + "-_"]
    hidden = []
    while len(hidden) < 300:
        t = "".join(rng.choice(alphabets[len(hidden) % 3]) for _ in range(rng.randrange(24, 48)))
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and "AKIA" not in t:
            hidden.append(t)
    rows = list(enumerate(names + hidden))
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    flagged = {i for i, kinds in got.items() if 3 in kinds}
    assert len([i for i in flagged if i < 1000]) <= 50
    found = len([i for i in flagged if i >= 1000]) / len(hidden)
    assert found >= 0.9, found
    # names alone: hardly any is flagged
    got = secrets.scan(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).where("exists(spans, s -> s.kind = 3)").count()
    assert got <= 50


def test_secrets_in_long_texts(spark):
    """Time grows with the length of a text, and tokens next to pattern spans are judged right."""
    def took(n):
        text = " ".join(f"password=abc{i}defg other_token_number_{i}_of_many" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = secrets.digested(df).first()
        assert row["n_assign"] == n
        return time.time() - began

    took(100)
    small, large = took(2500), took(10_000)
    assert large < 8 * small + 5
    tokens = spark.createDataFrame([([(0, 5, "a"), (7, 12, "b"), (20, 30, "c"), (40, 45, "d")], [(4, 0, 8), (29, 1, 41), (29, 2, 31)])], "tokens array<struct<start:int,end:int,token:string>>, base array<struct<start:int,kind:int,end:int>>")
    assert tokens.select(secrets.clear_of(F.col("tokens"), F.col("base")).alias("t")).first()["t"] == []
    apart = spark.createDataFrame([([(0, 4, "a"), (8, 12, "b"), (20, 29, "c")], [(4, 0, 8), (29, 1, 41)])], tokens.schema)
    assert [t["token"] for t in apart.select(secrets.clear_of(F.col("tokens"), F.col("base")).alias("t")).first()["t"]] == ["a", "b", "c"]


def test_copies_have_the_fraction_as_probability(spark):
    """200 sources alike but for their names and ids stand for 200 seeds."""
    sizes = [900, 100, 60, 7, *[1] * 40]
    rows = [(1000 * k + i, "w " * n, f"s{k}") for k in range(200) for i, n in enumerate(sizes)] + [(10**6 + i, "w " * 700, "t") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs, weights=(1,)).where("source_size < 2000").select("doc_id", "copies", (F.col("target") / F.col("source_size")).alias("rate"), "taken", "target").toPandas()
    rate = got["rate"].iloc[0]
    f = rate % 1
    assert 0.05 < f < 0.95 or rate == 3.0
    means = got.groupby(got["doc_id"] % 1000)["copies"].mean()
    assert len(means) == len(sizes) and (abs(means - rate) <= 3.3 * (f * (1 - f) / 200) ** 0.5 + 1e-9).all()
    # and a source's words miss its target by its longest document at most, but for short ones' chance
    off = got.groupby(got["doc_id"] // 1000)["taken"].sum() - got["target"].iloc[0]
    assert abs(off).max() <= 900 + 5 * 40**0.5


def test_decontamination_recall():
    """Share of items found that are edited in 5, 10 and 20 % of their words, at the registered settings."""
    rng = np.random.default_rng(21)
    made = [rng.integers(1, 2**40, int(n)) for n in rng.integers(15, 90, 60)]
    items = contamination.Items(made)
    for rate in (0.05, 0.1, 0.2):
        found = 0
        for i, item in enumerate(made):
            run = item.tolist()
            for _ in range(int(rate * len(run))):
                at = int(rng.integers(0, len(run)))
                how = int(rng.integers(0, 3))
                run[at : at + (how != 1)] = [int(rng.integers(2**41, 2**42))] * (how != 2)
            text = np.concatenate([rng.integers(2**43, 2**44, 40), np.array(run, np.int64), rng.integers(2**43, 2**44, 40)])
            found += i in [h[0] for h in items.found([text])[0]]
        assert found >= 0.9 * len(made), (rate, found)


def test_near_duplicate_recall(spark):
    """Links of isolated pairs about the threshold, at the registered settings."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((1500, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal((1500, 48))
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.97, (1500, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * noise
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = neardup.joined(df).toPandas().set_index("vec_id")
    near = np.concatenate([a, b]) @ np.concatenate([a, b]).T >= neardup.COSINE
    np.fill_diagonal(near, False)
    assert (got.loc[range(3000), "n_links"].to_numpy() <= near.sum(1)).all()
    assert got["n_links"].sum() >= 0.97 * near.sum()


def test_hot_buckets_tie_to_every_near_leader():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 40, 600))
    sketches = rng.integers(0, 2**63, (12, 4), dtype=np.uint64)[rng.integers(0, 12, 600)] ^ (np.uint64(1) << rng.integers(0, 64, (600, 4)).astype(np.uint64))
    member, leader, leads = neardup.led(keys, sketches, 60)
    apart = lambda i, j: int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
    want = {(i, j) for i in np.flatnonzero(~leads) for j in np.flatnonzero(leads) if keys[i] == keys[j] and apart(i, j) <= 60}
    assert set(zip(member.tolist(), leader.tolist(), strict=True)) == want
    assert all(any(i == m for m, _ in want) for i in np.flatnonzero(~leads))


@pytest.mark.parametrize("linkers", [1, 2, 50, 1_000, 10_000])
def test_linkers_of_a_blocked_host_are_blocked(spark, linkers):
    link = '<a href="https://bad.net/z">'
    pages = [(0, "http://bad.net/es/", ""), (1, "http://bad.net/about", ""), (2, "http://calm.org/", '<a href="https://good.com/">'), (3, "http://good.com/", "")]
    pages += [(10 + i, f"http://farm{i}.org/", link) for i in range(linkers)]
    pages += [(4, "http://bad.net/es/2", ""), (5, "http://bad.net/fr/3", "")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[10 + i] == "block" for i in range(linkers)) and got[2] == got[3] == "allow"
    # three of bad.net's four pages are blocked by rules, and who links to it never clears it
    assert got[1] == "block"


def test_events_of_earlier_turns(spark):
    """Edits and regenerations that name a turn reach it across others, deltas go on where they belong."""
    log = [
        (1, 1, "user", "How?", "message", None), (1, 2, "assistant", "So", "delta", None), (1, 3, "user", "And?", "message", None), (1, 4, "assistant", "Thus", "message", None),
        (1, 5, "assistant", "Like", "edit", 2), (1, 6, "user", "Why?", "edit", 1), (1, 7, "assistant", " that", "delta", 2), (1, 8, "assistant", None, "regenerate", 4), (1, 9, "assistant", "Hence", "delta", 4),
        (1, 10, "user", "lost", "edit", 77), (2, 1, "assistant", "x", None, None),
    ]
    df = spark.createDataFrame(log, "Conv_ID long, turn long, role string, text string, kind string, ref long")
    got = chat.messages(df, conv="Conv_ID", kind="kind", ref="ref").orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Why?"), (1, 1, "assistant", "Like that"), (1, 2, "user", "And?"), (1, 3, "assistant", "Hence"), (1, 4, "user", "lost"), (2, 0, "assistant", "x")]


def test_names_clash_whatever_their_case(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long, "a", 7), (2, "short text", None, 8), (None, None, "a", 9)], "doc_id long, text string, source string, Shard int").withColumn("SIZE", F.lit("x")).withColumn("Score", F.lit(1))
    placed = sharding.shard(docs)
    assert placed.columns == ["doc_id", "text", "source", "Score", "size", "text_crc32", "shard", "slot"] and placed.count() == 3
    assert sharding.shard(docs, adding=("shard", "slot")).columns == ["doc_id", "text", "source", "SIZE", "Score", "shard", "slot"]
    assert mixing.mix(docs).columns == docs.columns
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels).columns == ["doc_id", "text", "source", "Shard", "SIZE", "held_out", "score", "predicted"]
    bench = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    kept = contamination.clean(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2, None]
    assert zlib.crc32(long.encode()) in {r["text_crc32"] for r in placed.collect()} and common.shared_folder(spark)


def test_one_bad_link_among_many_is_no_evidence(spark):
    """A directory, whose links are many hosts' and one a blocked one's; a chain that ends at a blocked host; SQL alike."""
    import duckdb

    page = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    many = [f"site{i}.org" for i in range(500)]
    pages = [(1, "http://bad.net/es/", None), (2, "http://list.org/", page("bad.net", *many)), (3, "http://half.org/", page("bad.net", "site1.org")), (4, "http://near.org/", page("half.org"))]
    pages += [(10 + i, f"http://chain{i}.org/", page(f"chain{i + 1}.org" if i < 40 else "bad.net")) for i in range(41)]
    pages += [(100 + i, f"http://farm{i}.org/", page("bad.net")) for i in range(3_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judged(df).collect()}
    assert got[2] == "allow" and got[3] == got[4] == "block" and all(got[100 + i] == "block" for i in range(3_000))
    # the first of the chain are further off than a walk goes
    assert got[10] == "allow" and got[50] == got[45] == "block"
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert dict(con.sql(f"SELECT page_id, verdict FROM ({urlfilter.ORACLE})").fetchall()) == got


def test_long_pages_and_urls(spark):
    html = " filler" * 200_000 + '<a href="http://bad.net/">'
    pages = [(1, "http://bad.net/es/", None), (2, "http://far.org/" + "x" * 100_000, html)]
    got = {r["page_id"]: (r["verdict"], len(r["path"])) for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2] == ("block", 100_001)


def test_masked_text_is_what_the_spans_hold(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|turn|>assistant\nno", "a\\<|end|>b", "", "é\n<|im_start|>", "\\", "[INST", "<"]
    log = spark.createDataFrame([(c, t, ("user", "assistant", "assistant\n", "<|turn|>assistant")[t % 4], tricky[(c + t) % len(tricky)]) for c in range(6) for t in range(9)], "conv_id long, turn long, role string, text string")
    r = chat.rendered(chat.messages(log)).select("formatted", chat.spans(F.col("formatted")).alias("spans"), chat.under_mask(F.col("formatted")).alias("held")).collect()
    assert len(r) == 6 and all(row["held"] == [row["formatted"][s["start"] : s["end"]] for s in row["spans"]] for row in r)
    assert all(len(row["held"]) == 2 for row in r)


def test_a_long_conversation_takes_linear_time(spark):
    import hashlib
    import time

    texts = [f"turn {i} says <s> and \\ " + "word " * 15 for i in range(24_000)]
    log = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    log = log.withColumns({"formatted": F.lit(1), "mask": F.lit(2), "_turn": F.lit(3), "p": F.lit(4)})  # names that the operator uses
    began = time.time()
    row = chat.digested(log).first()
    assert time.time() - began < 60
    said = "".join(texts[1::2])
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (24_000, len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("more", [["Text", "TEXT", "Doc_Id"], ["a`b", "x.y", "`", "text`"], ["_0", "_1", "size", "class", "h", "words", "start"]], ids=["case", "quotes", "own names"])
def test_names_of_other_columns_count_for_nothing(spark, more):
    rows = [(1, "one two three four five six seven", "a"), (2, "one two three four five six seven", None), (3, None, "a"), (None, "token = abcdef123456 x", "b")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = plain.select(*[F.lit(i).alias(m) for i, m in enumerate(more)], "*")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int").select("*", F.lit(0).alias("Toxic"))
    bench = spark.createDataFrame([(1, "two three four five six seven")], "item_id long, text string").select("*", F.lit("x").alias("Text"))
    both = lambda f: tuple(sorted((tuple(r) for r in f(d).collect()), key=str) for d in (docs, plain))
    for f in (mixing.taken, sharding.placed, secrets.digested, jaccard.links, lm.scored, lambda d: contamination.leaks(d, bench), lambda d: toxicity.judged(d, labels)):
        got, want = both(f)
        assert got == want and len(want)
    for f in (mixing.mix, jaccard.deduplicated, lambda d: contamination.clean(d, bench), lambda d: toxicity.accepted(d, labels), lambda d: sharding.shard(d, adding=("shard", "slot"))):
        out = f(docs)
        names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
        assert out.columns[: len(names)] == names
        assert sorted((tuple(r)[len(more) :] for r in out.collect()), key=str) == sorted((tuple(r) for r in f(plain).collect()), key=str)
    pages = spark.createDataFrame([(1, "http://x.net/es/", None), (2, "http://y.org/", '<a href="//x.net/">')], "page_id long, url string, html string").select("*", *[F.lit(i).alias(m) for i, m in enumerate(["URL", "Html", "host", "a`b"])])
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judged(pages).collect()} == {1: "block", 2: "block"}
    log = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").select("*", *[F.lit(i).alias(m) for i, m in enumerate(["Text", "ROLE", "a`b"])])
    assert chat.digested(log).first()["n_turns"] == 1
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>").select("*", *[F.lit(i).alias(m) for i, m in enumerate(["VEC_ID", "class", "a`b"])])
    assert [r["n_links"] for r in neardup.joined(vectors).collect()] == [1, 1]


def test_rows_without_ids_are_dealt_by_their_texts(spark):
    docs = spark.range(6_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 4_001).alias("text"))
    m = sharding.measured(docs)
    cells = m.groupBy(F.substring("_key", 1, 1).alias("c"), sharding.salt(16).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    assert cells.count() == 256 and cells.agg(F.max("n"), F.max("nulls")).first()[0] < 60
    placed = sharding.placed(docs)
    slots = placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("high"))
    assert slots.where("n <> d OR high <> n - 1").isEmpty() and placed.count() == 6_000
