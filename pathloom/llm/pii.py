"""Personal data: patterns with checks, and a character-level BiLSTM with a CRF for what patterns miss.

1. Base spans are those of four kinds' patterns that pass their kind's check, found in time linear in
   a text.
2. The model is trained in numpy on the driver, from labelled spans in windows of text: by default the
   base spans of a bounded sample (FIT_DOCS ids by hash, FIT_WINDOWS windows by hash) and the same
   spans in other writings (an at in brackets, no plus, other separators), with windows that hold
   numbers but no spans. Characters are embedded, read by an LSTM in either direction, and tagged by a
   CRF (outside, or begin and inside of each kind).
3. Every span holds a digit, an @ or an at in brackets, so only windows whose middle holds one of
   these are decoded; all windows of a text are laid on one grid and overlap by half. Spans cut by a
   window's edge are left to its neighbour. What windows say is reconciled over the whole text: of
   all candidates with a mean marginal of ACCEPT that pass their kind's check in any writing, those
   without overlap that weigh most together.
4. Base spans stay; the model's are added where they overlap none.

Each task decodes its own texts with the same few thousand weights; nothing is shuffled.

Defined results: a null text is empty and has no spans; texts are read whole, whatever their length;
repeated rows and ids have a row each; a table without labelled spans trains no model, and base
spans alone are found; an empty table gives no rows. Positions are code points, ends exclusive. Other
columns count for nothing, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked


KINDS = ("email", "ip", "card", "phone")
#: A window and what of it is its own; the rest is context on either side.
WINDOW, MIDDLE = 96, 48
MARGIN = (WINDOW - MIDDLE) // 2
#: Bounds of the sample to train on: documents looked at, windows kept.
FIT_DOCS, FIT_WINDOWS = 20_000, 1_200
EMBED, HIDDEN = 12, 20
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Mean marginal that a span needs.
ACCEPT = 0.8
#: Windows decoded at once.
AT_ONCE = 2_048
OUTSIDE = 0
TAGS = 1 + 2 * len(KINDS)
AT = r"[\[({<]\s?[aA][tT]\s?[\])}>]"
SIGN = re.compile(rf"[0-9@]|{AT}")
#: The same for the JVM.
SIGN_JAVA = rf"[0-9@]|{AT}".replace("<", "\\<").replace(">", "\\>")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octets(numbers: list[str]) -> bool:
    return len(numbers) == 4 and all(len(n.lstrip("0")) < 4 and int(n) < 256 for n in numbers)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns that pass their checks, by kind, then start."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # a match begins where the run of local characters before its @ does, or where the last match ended
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((0, start, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    for m in NUMBERS.finditer(text):
        # a chain of numbers, four a match
        parts = list(DIGITS.finditer(text, m.start(), m.end()))
        fours = [parts[i : i + 4] for i in range(0, len(parts) - 3, 4)]
        found += [(1, four[0].start(), four[3].end()) for four in fours if octets([p[0] for p in four])]
    for m in CARD.finditer(text):
        digits = re.sub(r"[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return found


def plausible(kind: int, s: str) -> bool:
    """Whether a string can be of its kind in any writing."""
    if s != s.strip():
        return False
    numbers = DIGITS.findall(s)
    if kind == 0:
        return re.fullmatch(rf"[\w.%+-]+\s?(?:@|{AT})\s?[A-Za-z0-9-]+(?:(?:\s?[.]\s?|\s?[\[({{<]\s?(?:[dD][oO][tT]|\.)\s?[\])}}>]\s?)[A-Za-z0-9-]+)+", s) is not None
    if kind == 1:
        return octets(numbers) and s[0].isdigit() and s[-1].isdigit() and not re.search(r"[A-Za-z]{4}", s)
    digits = "".join(numbers)
    if not s[-1].isdigit() or re.search(r"[^\W\d_]", s):
        return False
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15 and (s[0] in "+(0" or len(numbers) > 2)


def other_writings(kind: int, s: str, r: np.random.Generator) -> str:
    """A span as it might be written to escape a pattern."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    if kind == 0:
        name, _, host = s.partition("@")
        dot = pick(".", " . ", "[.]", " [dot] ", "(dot)")
        return name + pick(" @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", "@ ") + host.replace(".", dot)
    if kind == 1:
        return s.replace(".", pick("[.]", " . ", "(.)", ". "))
    if kind == 2:
        digits, gap = re.sub(r"\D", "", s), pick(".", "/", "_", "  ", " - ", "–")
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = DIGITS.findall(s)
    gap = pick("-", " ", ".", "/", " / ")
    return pick(lambda: "00" + gap.join(groups), lambda: f"({groups[0]}) " + gap.join(groups[1:]), lambda: gap.join(groups), lambda: "+ " + gap.join(groups))()


@dataclass(frozen=True)
class Example:
    """A window's text and its labelled spans, from its own beginning."""

    text: str
    spans: tuple[Span, ...]


def examples_in(text: str, spans: list[Span]) -> Iterator[Example]:
    """A window around each span, and around signs that lie in no span's window."""
    covered = -1
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        begin = max(0, start - (WINDOW - (end - start)) // 2)
        if end - start < WINDOW - 4 and start > covered:
            covered = begin + WINDOW
            inside = tuple((k, a - begin, b - begin) for k, a, b in spans if a >= begin and b <= covered)
            # one that the window cuts would be a wrong label
            if not any(a < begin < b or a < covered < b for _, a, b in spans):
                yield Example(text[begin:covered], inside)
    last = -WINDOW
    for m in SIGN.finditer(text):
        begin = max(0, m.start() - MARGIN)
        if begin >= last + WINDOW and not any(a < begin + WINDOW and b > begin for _, a, b in spans):
            last = begin
            yield Example(text[begin : begin + WINDOW], ())


def varied(examples: list[Example], times: int = 2) -> list[Example]:
    """examples and copies whose spans are in other writings."""
    out, r = list(examples), np.random.default_rng(7)
    for e in examples:
        for _ in range(times if e.spans else 0):
            text, spans, at = "", [], 0
            for k, a, b in sorted(e.spans, key=lambda s: s[1]):
                text += e.text[at:a]
                new = other_writings(k, e.text[a:b], r)
                spans.append((k, len(text), len(text) + len(new)))
                text, at = text + new, b
            text += e.text[at:]
            out.append(Example(text[:WINDOW], tuple(s for s in spans if s[2] <= WINDOW)))
    # numbers of other kinds, as what they stand beside
    shapes = [lambda: f"{r.integers(1900, 2100)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}", lambda: f"v{r.integers(9)}.{r.integers(20)}.{r.integers(30)}", lambda: hashlib.sha1(r.bytes(4)).hexdigest(), lambda: str(r.integers(10, 10**int(r.integers(2, 13)))), lambda: f"{r.integers(99)},{r.integers(999):03}.{r.integers(99):02}"]
    for e in [e for e in examples if not e.spans or len(e.spans) == 1][: max(50, len(examples) // 4)]:
        cut = e.spans[0][1:] if e.spans else (len(e.text) // 2,) * 2
        out.append(Example((e.text[: cut[0]] + shapes[int(r.integers(len(shapes)))]() + e.text[cut[1] :])[:WINDOW], ()))
    return out


# ---- the network


CODES = 132


def codes_of(text: str) -> np.ndarray:
    """A character's own code if it is ASCII, else one for letters, spaces or the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(points, 128).astype(np.int16)
    for i in np.flatnonzero(points >= 128):
        out[i] = 128 if text[i].isalpha() else 129 if text[i].isspace() else 130
    return out


PAD = 131


def tags_of(spans: tuple[Span, ...]) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for k, a, b in spans:
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def allowed() -> np.ndarray:
    """Whether a tag may follow another: inside only what has begun."""
    ok = np.ones((TAGS + 1, TAGS), bool)  # the last row: at the beginning of a window
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        ok[TAGS, 2 + 2 * k] = True  # a window may begin within a span
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


Weights = dict[str, np.ndarray]


def fresh(seed: int = 5) -> Weights:
    r = np.random.default_rng(seed)
    w = {"embed": r.normal(0, 0.3, (CODES, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS + 1, TAGS))}
    for d in "fb":
        w |= {f"x_{d}": r.normal(0, 0.25, (EMBED, 4 * HIDDEN)), f"h_{d}": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b_{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    return {k: v.astype(np.float32) for k, v in w.items()}


def lstm(w: Weights, d: str, ids: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of one direction, and if kept, all that the way back needs; ids are (T, B) in reading order."""
    table = w["embed"] @ w[f"x_{d}"] + w[f"b_{d}"]
    n = ids.shape[1]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, kept = np.empty((len(ids), n, HIDDEN), np.float32), []
    for t, row in enumerate(ids):
        z = table[row] + h @ w[f"h_{d}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * before + i * g
        squashed = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, before, squashed, h))
        h = o * squashed
        states[t] = h
    return states, kept


def lstm_back(w: Weights, d: str, ids: np.ndarray, kept: list, grad: np.ndarray, into: Weights) -> None:
    dh, dc, dz_all = 0.0, 0.0, np.empty((*ids.shape, 4 * HIDDEN), np.float32)
    for t in range(len(ids) - 1, -1, -1):
        i, f, o, g, before, squashed, h = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        into[f"h_{d}"] += h.T @ dz
        dh, dc = dz @ w[f"h_{d}"].T, dc * f
    table = np.zeros((CODES, 4 * HIDDEN), np.float32)
    np.add.at(table, ids.ravel(), dz_all.reshape(-1, 4 * HIDDEN))
    into["embed"] += table @ w[f"x_{d}"].T
    into[f"x_{d}"] += w["embed"].T @ table
    into[f"b_{d}"] += table.sum(axis=0)


def emissions(w: Weights, ids: np.ndarray, keep: bool = False):
    """Scores (T, B, TAGS) of windows (B, T)."""
    there = ids.T
    ahead, kept_f = lstm(w, "f", there, keep)
    behind, kept_b = lstm(w, "b", there[::-1], keep)
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    return both @ w["out"] + w["out_b"], (both, kept_f, kept_b)


OK = allowed()


def marginals(w: Weights, scores: np.ndarray):
    """Tag probabilities (T, B, TAGS), expected transitions, and the log of the normaliser, by scaled sums forward and back."""
    peak = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - peak)
    a = np.where(OK, np.exp(w["trans"]), 0)
    steps, n, _ = scores.shape
    ahead, norm = np.empty_like(e), np.empty((steps, n, 1), np.float32)
    for t in range(steps):
        now = e[t] * (a[TAGS] if t == 0 else ahead[t - 1] @ a[:TAGS])
        norm[t] = now.sum(axis=1, keepdims=True)
        ahead[t] = now / norm[t]
    behind, pairs = np.ones_like(e), np.zeros_like(a)
    for t in range(steps - 1, 0, -1):
        out = e[t] * behind[t] / norm[t]
        pairs[:TAGS] += a[:TAGS] * (ahead[t - 1].T @ out)
        behind[t - 1] = out @ a[:TAGS].T
    p = ahead * behind
    pairs[TAGS] = p[0].sum(axis=0)
    return p, pairs, (np.log(norm) + peak).sum()


def trained(examples: list[Example], epochs: int = EPOCHS) -> Weights | None:
    """Weights fitted by Adam on the CRF's likelihood; None without a labelled span."""
    if not any(e.spans for e in examples):
        return None
    ids = np.full((len(examples), WINDOW), PAD, np.int16)
    for row, e in zip(ids, examples, strict=True):
        row[: len(e.text)] = codes_of(e.text)[:WINDOW]
    tags = np.stack([tags_of(e.spans) for e in examples])
    w, r = fresh(), np.random.default_rng(11)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, least = 0, 150  # few examples are gone through more often
    rounds = max(epochs, -(-least * BATCH // len(examples)))
    for e in range(rounds):
        order = r.permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            chosen = order[at : at + BATCH]
            x, y = ids[chosen], tags[chosen].T
            scores, (both, kept_f, kept_b) = emissions(w, x, keep=True)
            p, pairs, _ = marginals(w, scores)
            grad = p
            np.add.at(grad, (np.arange(WINDOW)[:, None], np.arange(len(chosen))[None, :], y), -1)
            grad /= len(chosen)
            g = {k: np.zeros_like(v) for k, v in w.items()}
            np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), -1)
            np.add.at(pairs, (np.full(len(chosen), TAGS), y[0]), -1)
            g["trans"] = np.where(OK, pairs / len(chosen), 0).astype(np.float32)
            g["out"], g["out_b"] = np.einsum("tbh,tbk->hk", both, grad), grad.sum(axis=(0, 1))
            dboth = grad @ w["out"].T
            lstm_back(w, "f", x.T, kept_f, dboth[:, :, :HIDDEN], g)
            lstm_back(w, "b", x.T[::-1], kept_b, dboth[::-1, :, HIDDEN:], g)
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            rate = RATE * (1 - 0.9 * e / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in w:
                v = g[k] * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] = (w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return w


def best_tags(w: Weights, scores: np.ndarray) -> np.ndarray:
    """The likeliest tags (T, B) under the transitions."""
    a = np.where(OK, w["trans"], -1e9).astype(np.float32)
    best, back = a[TAGS] + scores[0], []
    for row in scores[1:]:
        through = best[:, :, None] + a[None, :TAGS]
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + row
    at = best.argmax(axis=1)
    tags = [at]
    for b in reversed(back):
        at = b[np.arange(len(at)), at]
        tags.append(at)
    return np.stack(tags[::-1])


# ---- texts


def windows_of(text: str) -> list[int]:
    """Where windows begin whose middle holds a sign; the first may begin before the text."""
    return sorted({cell * MIDDLE - MARGIN for m in SIGN.finditer(text) for cell in range(m.start() // MIDDLE, (m.end() - 1) // MIDDLE + 1)})


def candidates(w: Weights, texts: list[str]) -> list[dict[Span, float]]:
    """For each text, spans that any of its windows tags, with their best weight: characters by mean marginal."""
    found: list[dict[Span, float]] = [{} for _ in texts]
    codes: dict[int, np.ndarray] = {}

    def decoded(jobs: list[tuple[int, int]]) -> None:
        ids = np.full((len(jobs), WINDOW), PAD, np.int16)
        for row, (i, begin) in zip(ids, jobs, strict=True):
            piece = codes[i][max(0, begin) : begin + WINDOW]
            row[max(0, -begin) : max(0, -begin) + len(piece)] = piece
        scores, _ = emissions(w, ids)
        tags, (p, _, _) = best_tags(w, scores), marginals(w, scores)
        sure = np.take_along_axis(p, tags[:, :, None], axis=2)[:, :, 0]
        opens = np.argwhere((tags % 2 == 1).T)
        for b, a in opens:
            kind, end = int(tags[a, b] - 1) // 2, int(a) + 1
            while end < WINDOW and tags[end, b] == 2 + 2 * kind:
                end += 1
            i, begin = jobs[b]
            mean = float(sure[a:end, b].mean())
            if mean < ACCEPT or (end == WINDOW and begin + WINDOW < len(texts[i])):
                continue
            span = (kind, begin + int(a), begin + end)
            if span[2] <= len(texts[i]) and plausible(kind, texts[i][span[1] : span[2]]) and SIGN.search(texts[i], span[1], span[2]):
                found[i][span] = max(found[i].get(span, 0.0), mean * (end - a))

    waiting: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        begins = windows_of(text)
        if begins:
            codes[i] = codes_of(text)
        for begin in begins:
            waiting.append((i, begin))
            if len(waiting) == AT_ONCE:
                decoded(waiting)
                waiting = []
                codes = {i: codes[i]}
    if waiting:
        decoded(waiting)
    return found


def reconciled(weights: dict[Span, float]) -> list[Span]:
    """The spans without overlap that weigh most together; of equal choices the one that ends first."""
    spans = sorted(weights, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for s in spans:
        before = int(np.searchsorted(ends, s[1], side="right"))
        with_it = best[before] + weights[s]
        take.append(before if with_it > best[-1] else None)
        best.append(max(best[-1], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1] is None:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = take[i - 1]
    return out[::-1]


def apart_from(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of spans that overlap none of base."""
    if not base:
        return spans
    order = sorted(base, key=lambda s: s[1])
    starts, reach = np.array([s[1] for s in order]), np.maximum.accumulate([s[2] for s in order])
    before = [int(np.searchsorted(starts, end, side="left")) for _, _, end in spans]
    return [s for s, k in zip(spans, before, strict=True) if k == 0 or reach[k - 1] <= s[1]]


def spans_in(texts: list[str], w: Weights | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and the model's further ones, of each text."""
    base = [base_spans(t) for t in texts]
    more = [apart_from(reconciled(c), b) for c, b in zip(candidates(w, texts), base, strict=True)] if w else [[] for _ in texts]
    return list(zip(base, more, strict=True))


# ---- tables


def labelled(docs: DataFrame, text: str = "text", key: str = "doc_id") -> list[Example]:
    """At most FIT_WINDOWS windows of at most FIT_DOCS ids, base spans as labels; chosen by hash, copies once."""
    d = picked(docs, key, text).select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text"))
    last = d.select("h").distinct().orderBy("h").limit(FIT_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e.text, ",".join(f"{k}:{a}:{z}" for k, a, z in e.spans)) for t in b["text"] for e in examples_in(t, base_spans(t))]
            yield pd.DataFrame(rows, columns=["window", "spans"])

    windows = d.where((F.col("h") <= last) & F.col("text").rlike(SIGN_JAVA)).select("text").mapInPandas(of, "window string, spans string").distinct()
    # windows with spans first: they are rarer
    rows = windows.orderBy(F.when(F.col("spans") == "", 1).otherwise(0) * F.pmod(F.xxhash64("window"), F.lit(3)), F.xxhash64("window"), "window").limit(FIT_WINDOWS).collect()
    return [Example(r["window"], tuple(tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s)) for r in rows]


FOUND = "base array<struct<kind:int,start:int,end:int>>, more array<struct<kind:int,start:int,end:int>>"


def found(docs: DataFrame, weights: Weights | None) -> DataFrame:
    """doc_id, base and more: spans of the patterns and the model's further ones. Texts without a sign don't leave the JVM."""
    d = picked(docs, "doc_id", "text").select("doc_id", F.when(F.col("text").rlike(SIGN_JAVA), F.col("text")).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {FOUND}"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, held = b["doc_id"], np.flatnonzero(b["text"].notna())
            base, more = [[] for _ in range(len(b))], [[] for _ in range(len(b))]
            for i, (x, y) in zip(held, spans_in([b["text"].iloc[i] for i in held], weights), strict=True):
                base[i], more[i] = ([{"kind": k, "start": a, "end": z} for k, a, z in s] for s in (x, y))
            yield pd.DataFrame({"doc_id": ids, "base": base, "more": more})

    return d.mapInPandas(of, schema)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans as text."""
    f = found(docs, trained(varied(labelled(docs))))

    def shown(spans):
        named = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]))
        return F.array_join(named, ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return f.select("doc_id", *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.concat("base", "more")).alias("spans"))
