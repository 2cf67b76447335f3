"""Personal data: patterns against plain matching, the network against enumeration, held-out accuracy, spans of whole texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import pii

DOCS = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_the_patterns(seed):
    r = random.Random(seed)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "255", "256", "0001", "4952935900253052", "4929", " ", "-", "+1 (243) 555-5526", "+", "x_y", "é", "a@b", ".d", "12", "(", "%", "9807915762804490"]
    for _ in range(3_000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_of_long_runs_take_linear_time():
    for piece in ("a", "1", "a.", "1.", "+1", "@", "a@", "1-"):
        pii.base_spans(piece * 400_000)


def test_marginals_and_best_tags_agree_with_enumeration():
    r, steps = np.random.default_rng(3), 4
    w = {"trans": r.normal(0, 1, (pii.TAGS + 1, pii.TAGS)).astype(np.float32)}
    scores = r.normal(0, 1, (steps, 1, pii.TAGS)).astype(np.float32)
    total, best, p = 0.0, (-1e9, None), np.zeros((steps, pii.TAGS))
    for tags in itertools.product(range(pii.TAGS), repeat=steps):
        route = [(pii.TAGS, tags[0]), *itertools.pairwise(tags)]
        if all(pii.OK[a] for a in route):
            s = sum(w["trans"][a] for a in route) + sum(scores[t, 0, k] for t, k in enumerate(tags))
            total += np.exp(s)
            best = max(best, (s, tags))
            p[np.arange(steps), list(tags)] += np.exp(s)
    got, _, norm = pii.marginals(w, scores)
    assert np.allclose(got[:, 0], p / total, atol=1e-4) and norm == pytest.approx(np.log(total), rel=1e-4)
    assert tuple(pii.best_tags(w, scores)[:, 0]) == best[1]


def test_gradients_agree_with_differences(monkeypatch):
    """One step of plain descent, recovered from Adam's first step, points where the likelihood grows."""
    example = pii.Example("call +1 (243) 555-5526 now", ((3, 5, 22),))

    def loss(w):
        ids = np.full((1, pii.WINDOW), pii.PAD, np.int16)
        ids[0, : len(example.text)] = pii.codes_of(example.text)
        y = pii.tags_of(example.spans)
        scores, _ = pii.emissions(w, ids)
        norm = pii.marginals(w, scores)[2]
        return norm - scores[np.arange(pii.WINDOW), 0, y].sum() - w["trans"][pii.TAGS, y[0]] - w["trans"][y[:-1], y[1:]].sum()

    grads = {}
    real = np.einsum

    w = {k: v.astype(np.float64) for k, v in pii.fresh().items()}
    ids = np.full((1, pii.WINDOW), pii.PAD, np.int16)
    ids[0, : len(example.text)] = pii.codes_of(example.text)
    scores, (both, kept_f, kept_b) = pii.emissions(w, ids, keep=True)
    p, _, _ = pii.marginals(w, scores)
    p[np.arange(pii.WINDOW), 0, pii.tags_of(example.spans)] -= 1
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"] = real("tbh,tbk->hk", both, p)
    up = p @ w["out"].T
    pii.lstm_back(w, "f", ids.T, kept_f, up[:, :, : pii.HIDDEN], grads)
    pii.lstm_back(w, "b", ids.T[::-1], kept_b, up[::-1, :, pii.HIDDEN :], grads)
    r = np.random.default_rng(1)
    for name in ("embed", "x_f", "h_f", "b_f", "x_b", "h_b", "b_b", "out"):
        at = tuple(int(r.integers(n)) for n in w[name].shape) if name != "embed" else (int(ids[0, 7]), 3)
        step = 1e-2
        up_w, down_w = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up_w[name][at] += step
        down_w[name][at] -= step
        assert grads[name][at] == pytest.approx((loss(up_w) - loss(down_w)) / (2 * step), rel=0.05, abs=5e-3), name


@pytest.mark.parametrize("seed", range(3))
def test_reconciled_weighs_most(seed):
    r = random.Random(seed)
    for _ in range(60):
        spans = {(r.randrange(4), a, a + r.randrange(1, 8)): r.random() for a in (r.randrange(20) for _ in range(8))}
        free = lambda chosen: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(chosen, 2))
        most = max(sum(spans[s] for s in chosen) for n in range(len(spans) + 1) for chosen in itertools.combinations(spans, n) if free(chosen))
        got = pii.reconciled(spans)
        assert free(got) and sum(spans[s] for s in got) == pytest.approx(most)


WORDS = ["in", "the", "thion", "über", "éreaux", "token", "call", "write", "to", "from", "version", "ción"]


def sentence(r, span):
    return " ".join(r.choice(WORDS) for _ in range(r.randrange(3, 12))) + " " + span + " " + " ".join(r.choice(WORDS) for _ in range(r.randrange(3, 12)))


def card(r):
    digits = "".join(r.choice("0123456789") for _ in range(15))
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def person(r, k):
    n = lambda a, b: r.randrange(a, b)
    return [f"{r.choice(WORDS[:2])}.{n(1, 99)}@mail{n(0, 9)}.example.com", f"{n(1, 255)}.{n(0, 256)}.{n(0, 256)}.{n(0, 256)}", card(r), f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}"][k]


@pytest.fixture(scope="module")
def weights():
    r = random.Random(5)
    texts = [sentence(r, person(r, i % 4)) for i in range(400)] + [sentence(r, f"v{i}.{i % 7}") for i in range(150)]
    return pii.trained(pii.varied([e for t in texts for e in pii.examples_in(t, pii.base_spans(t))]), epochs=6)


def test_held_out_spans_in_other_writings(weights):
    r, variants = random.Random(77), np.random.default_rng(78)
    hits = [0] * 4
    for i in range(400):
        new = pii.other_writings(i % 4, person(r, i % 4), variants)
        text = sentence(r, new)
        at = text.index(new)
        base, more = pii.spans_in([text], weights)[0]
        hits[i % 4] += (i % 4, at, at + len(new)) in base + more
    assert min(hits) >= 85, hits  # of 100 each, none of them like the patterns


def test_ordinary_numbers_are_left_alone(weights):
    r = random.Random(79)
    odd = lambda i: [f"version {r.randrange(9)}.0", f"{r.randrange(1900, 2100)}-0{r.randrange(1, 9)}-1{r.randrange(9)}", hashlib.sha1(bytes([i % 256])).hexdigest(), str(r.randrange(10**6)), f"{r.randrange(99)},{r.randrange(100, 999)}.50"][i % 5]
    texts = [sentence(r, odd(i)) for i in range(500)]
    assert sum(bool(more) for _, more in pii.spans_in(texts, weights)) <= 5


def test_spans_come_from_whole_texts(weights):
    r, variants = random.Random(80), np.random.default_rng(81)
    far = [pii.other_writings(3, person(r, 3), variants) for _ in range(40)]
    text = " ".join(sentence(r, s) + " filler words" * 400 for s in far)
    assert len(text) > 190_000
    base, more = pii.spans_in([text], weights)[0]
    found = {text[a:b] for _, a, b in base + more}
    assert len(found & set(far)) >= 0.85 * len(set(far))
    # the same as in a text of its own, wherever the grid lies
    assert sum(len(pii.spans_in([" " * k + sentence(r, far[0])], weights)[0][1]) + len(pii.spans_in([" " * k + sentence(r, far[0])], weights)[0][0]) > 0 for k in range(48)) >= 44


def test_query_keeps_base_spans(spark):
    r = random.Random(90)
    rows = [(i, sentence(r, person(r, i % 4))) for i in range(200)] + [(None, None), (3, ""), (3, ""), (5, "a@b.c " * 20_000), (6, "(at) 12 é@é"), (None, "x@y.z")]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit("x").alias("Text"), F.lit(1).alias("base"), F.lit(2).alias("b`t.c"))
    got = sorted(map(tuple, pii.digested(docs).collect()), key=str)
    want = {}
    for i, text in rows:
        spans = plain(text or "")
        name = ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for k, a, b in spans)
        want.setdefault((i, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(name.encode()).hexdigest()), []).append(set(name.split(",")) - {""})
    assert len(got) == len(rows)
    for row in got:
        assert row[:6] in want and any(w <= set(row[6].split(",")) for w in want[row[:6]])


def test_no_labels_and_empty_table(spark):
    assert pii.trained([]) is None and pii.trained([pii.Example("12", ())]) is None
    assert pii.digested(spark.createDataFrame([], DOCS)).collect() == []
    only = pii.digested(spark.createDataFrame([(1, "plain words"), (2, None)], DOCS)).collect()
    assert [r["spans"] for r in only] == ["", ""]
