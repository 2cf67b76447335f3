"""Secret scan with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Patterns give spans of kinds `assign`, `access` and `hex`. Besides, every token of 20 or more
characters that holds letters and digits is tested twice. The smallest encoding that fits it (hex,
base32, base36, base62, base64) sets its alphabet.

1. Drawn at random? A chi-squared test of uniformity over quarters of the alphabet (so that each
   expects five characters or more), a runs test about the alphabet's middle and a serial
   correlation test give p-values, which Fisher's method joins. A token below FIT is none.
2. An ordinary identifier? These are a chain of character classes (vowel, consonant, capital,
   digit, other) with the transition rates of words, camel case, snake case, paths and dates. The
   likelihood ratio of the random draw to that chain exceeds x with probability 1 / x at most if
   the token is ordinary, so its inverse, times the number of encodings, is a p-value for "ordinary".

Which tokens are secrets is decided over the whole corpus by Benjamini and Hochberg's procedure on
the second p-value (1 for tokens that fail the first), separately for each class of length: of the
tokens flagged, the share of ordinary ones is expected to be FALSE_DISCOVERIES at most. They are
spans of kind `random` unless they overlap a pattern's span. The procedure runs on counts in 400
steps of p, so it needs no sorting of tokens.

Positions are code points, ends exclusive. Defined results: a null text is empty and has no
spans; repeated rows give repeated results and count each in the procedure; tokens of equal p fall
together; an empty table gives no rows; columns other than the id and the text are left out,
whatever their names. Texts of any length are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, picked, settled

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than these never count, so the patterns can ask for the length at once.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet: what a token must look like, and the alphabet in its own order.
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    (r"^[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
#: Classes of characters, and for ordinary identifiers how often each follows the row's.
CLASSES = {"v": "aeiou", "c": "bcdfghjklmnpqrstvwxyz", "U": UPPER, "d": DIGITS, "o": "+/-_"}
ORDINARY = {
    "v": (0.13, 0.68, 0.06, 0.04, 0.09),
    "c": (0.48, 0.35, 0.05, 0.03, 0.09),
    "U": (0.32, 0.38, 0.26, 0.02, 0.02),
    "d": (0.04, 0.10, 0.08, 0.60, 0.18),
    "o": (0.24, 0.42, 0.16, 0.14, 0.04),
}
#: Share of ordinary tokens that is allowed for among those flagged, and the p below which a token isn't random.
FALSE_DISCOVERIES, FIT = 0.05, 0.01
STEPS, BINS = 400, 4
_SPAN = "struct<start:int,end:int,token:string>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, token) of every leftmost match, token being the group asked for.

    What lies between matches gives their positions: split and extract_all walk alike.
    """
    between, whole, token = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), token.alias("t")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["w"]).alias("w"), x["t"].alias("t")))

    def step(at, x):
        start = at + x["b"]
        end = start + x["w"]
        return end, F.struct(start.alias("start"), end.alias("end"), x["t"].alias("token"))

    return F.when(F.rlike(text, F.lit(pattern)), folded(parts, F.lit(0), _SPAN, step)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def clear_of(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no span of base: one pass for spans that begin before them, one back for those after."""
    both = (F.size(base) > 0) & (F.size(tokens) > 0)
    line = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("t"), b["end"].alias("end"), F.lit("").alias("token"))), F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("t"), t["end"].alias("end"), t["token"].alias("token")))))
    ahead = folded(line, F.lit(0), "struct<start:int,t:int,end:int,token:string>", lambda at, x: (F.when(x["t"] == 0, F.greatest(at, x["end"])).otherwise(at), F.when((x["t"] == 0) | (x["start"] >= at), x)))
    back = folded(F.reverse(ahead), F.lit(2**31 - 1), _SPAN, lambda at, x: (F.when(x["t"] == 0, x["start"]).otherwise(at), F.when((x["t"] == 1) & (x["end"] <= at), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token")))))
    return F.when(both, F.reverse(back)).otherwise(tokens)


def upper_normal(z: Column) -> Column:
    """P(Z > z) to 1e-7, by the rational approximation of Hastings."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def of_encoding(make) -> Column:
    """What make gives for the alphabet of the smallest encoding that fits the token; null if none does."""
    return F.coalesce(*[F.when(F.rlike("token", F.lit(look)), make(a)) for look, a in ENCODINGS])


def log_ratios(alphabet: str) -> Column:
    """25 logarithms: how much likelier a class is in a random draw than after another in an ordinary token."""
    letters = alphabet if any(c in alphabet for c in LOWER) else alphabet.lower()
    share = [sum(c in members for c in letters) / len(letters) for members in CLASSES.values()]
    return F.array(*[F.lit(math.log(max(q, 1e-6) / p)) for row in ORDINARY.values() for q, p in zip(share, row, strict=True)])


def expected(alphabet: str) -> Column:
    """Share of the alphabet's symbols in each of its quarters."""
    places = [BINS * i // len(alphabet) for i in range(len(alphabet))]
    return F.array(*[F.lit(places.count(b) / len(alphabet)) for b in range(BINS)])


def randomness(tokens: DataFrame) -> DataFrame:
    """tokens (column token) with n, the length tested, p, small if it isn't random, and ordinary, small if it isn't ordinary."""
    bare = F.regexp_replace("token", "=+$", "")
    t = tokens.withColumns({"_s": bare, "_a": of_encoding(F.lit)})
    t = t.where("_a IS NOT NULL").withColumns({"n": F.length("_s"), "_k": F.length("_a").cast("double"), "_ratios": of_encoding(log_ratios), "_expected": of_encoding(expected)})
    plain = F.when(F.rlike("_s", F.lit("[a-z]")), F.col("_s")).otherwise(F.lower("_s"))
    kinds = F.translate(plain, "".join(CLASSES.values()), "".join(str(i) * len(m) for i, m in enumerate(CLASSES.values())))
    t = t.withColumns({"_c": F.expr("transform(sequence(1, n), i -> double(locate(substr(_s, i, 1), _a) - 1))"), "_kinds": kinds})
    t = t.withColumn("_steps", F.expr("transform(sequence(1, n), i -> int(substr(_kinds, i, 1)))"))
    n, k = F.col("n").cast("double"), F.col("_k")
    t = t.withColumn("_bins", F.transform("_c", lambda x: F.floor(x * BINS / k).cast("int")))
    uneven = F.expr(f"aggregate(sequence(0, {BINS - 1}), 0D, (a, b) -> a + pow(double(size(filter(_bins, x -> x = b))), 2) / (n * _expected[b])) - n")
    df = BINS - 1.0
    wilson = (F.pow(F.greatest(uneven, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = total(F.transform("_c", lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0)))
    turns = F.expr("aggregate(sequence(1, n - 1), 1D, (a, i) -> a + if((_c[i] >= _k / 2) = (_c[i - 1] >= _k / 2), 0D, 1D))")
    t = t.withColumns({"_wilson": wilson, "_high": high, "_runs": turns, "_mean": total(F.col("_c")) / n})
    between = 2 * F.col("_high") * (n - F.col("_high")) / n
    t = t.withColumns({
        "_zruns": (F.col("_runs") - between - 1) / F.sqrt(F.greatest(between * (between - 1) / (n - 1), F.lit(1e-9))),
        "_var": total(F.transform("_c", lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))),
        "_cov": F.expr("aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (_c[i] - _mean) * (_c[i - 1] - _mean))"),
        "_log": F.expr("aggregate(sequence(1, n - 1), 0D, (a, i) -> a + _ratios[5 * _steps[i - 1] + _steps[i]])"),
    })
    serial = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var") * F.sqrt(n)).otherwise(40.0)
    ps = [upper_normal(F.col("_wilson")), 2 * upper_normal(F.abs("_zruns")), 2 * upper_normal(F.abs(serial))]
    half = -sum((F.log(F.greatest(p, F.lit(1e-12))) for p in ps), F.lit(0.0))
    t = t.withColumn("_half", half)
    p = F.exp(-F.col("_half")) * (1 + F.col("_half") + F.col("_half") * F.col("_half") / 2)
    ordinary = F.least(F.lit(1.0), len(ENCODINGS) * F.exp(-F.col("_log")))
    return t.select(*tokens.columns, "n", p.alias("p"), ordinary.alias("ordinary"))


def step_of(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log(F.greatest(p, F.lit(1e-300)))), F.lit(STEPS)).cast("int")


def flagged_from(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """length_class, from_step: Benjamini-Hochberg on steps of p, per class of length. At most 401 rows a class."""
    counts = tested.groupBy("length_class", "step").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("length_class").orderBy(F.desc("step"))
    c = counts.withColumns({"i": F.sum("n").over(smaller), "m": F.sum("n").over(Window.partitionBy("length_class"))})
    return c.where(F.exp(-F.col("step") / 10) <= rate * F.col("i") / F.col("m")).groupBy("length_class").agg(F.min("step").alias("from_step"))


def of_kind(column: str, number: int) -> Column:
    return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id and spans: an array of (start, kind number, end), in order. One row a row of docs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = picked(docs, doc_id, text).select(
        F.col(doc_id).alias("doc_id"),
        F.filter(matches(whole, ASSIGN, 2), lambda m: F.length(m["token"]) >= 6).alias("assign"),
        matches(whole, ACCESS).alias("access"),
        matches(whole, HEX).alias("hex"),
        F.filter(matches(whole, TOKEN), lambda m: F.rlike(m["token"], F.lit("[0-9]")) & F.rlike(m["token"], F.lit("[A-Za-z]"))).alias("tokens"),
    )
    base = F.array_sort(F.concat(*[of_kind(k, i) for i, k in enumerate(KINDS[:3])]))
    # a lambda's variable: spans are made once, though named several times
    clear = F.transform(F.array(F.struct(base.alias("base"), "tokens")), lambda x: F.struct(x["base"].alias("base"), clear_of(x["tokens"], x["base"]).alias("tokens")))[0]
    found = settled(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", clear.alias("x")).select("row", "doc_id", "x.base", "x.tokens"))
    tested = randomness(found.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.token"))
    p = F.when(F.col("p") < FIT, 1.0).otherwise(F.col("ordinary"))
    tested = tested.select("row", "start", "end", F.floor(2 * F.log2("n")).cast("int").alias("length_class"), step_of(p).alias("step"))
    # some 30 classes of length at most
    kept = tested.join(F.broadcast(flagged_from(tested, rate)), "length_class").where("step >= from_step")
    more = kept.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
    # tokens of one row only: their number is bounded by one text
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    plain, some = found.where(F.size("tokens") == 0), found.where(F.size("tokens") > 0)
    return plain.select("doc_id", F.col("base").alias("spans")).unionAll(some.join(more, "row", "left").select("doc_id", spans.alias("spans")))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digested(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    of = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scan(docs, **options).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
