import ctypes
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions import patterns, predicates, text

LIBC = ctypes.CDLL(None)
PATHNAME, CASEFOLD = 1, 16


def fnmatch(pattern, subject, fold=False):
    return LIBC.fnmatch(pattern.encode(), subject.encode(), PATHNAME | CASEFOLD * fold) == 0


def test_globs_agree_with_libc(spark):
    """Thousands of generated pairs in one Spark job, apart from corners that are decided otherwise."""
    pairs = []

    @settings(max_examples=3000, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="ab*?[]!^-/\\.B:", max_size=7), st.text(alphabet="ab/.-B]", max_size=5))
    def collect(glob, subject):
        if "[." not in glob and "[=" not in glob and "[:" not in glob:
            pairs.append((glob, subject))

    collect()
    pairs += [("/usr/bin/*.so", "/usr/bin/a.so"), ("*.h", "a/b.h"), ("[[:digit:]]x", "3x"), ("a[b", "a[b"), ("*", ".a")]
    for fold in (False, True):
        rows = [(g, s, patterns.glob_to_regex(g, fold), fnmatch(g, s, fold)) for g, s in pairs]
        df = spark.createDataFrame(rows, "g string, s string, r string, want boolean")
        wrong = df.where(F.expr("s rlike r") != F.col("want")).collect()
        assert len(wrong) <= len(pairs) // 200, [tuple(w) for w in wrong[:10]]
        assert df.where("want").count() > 100


@pytest.mark.parametrize(
    ("pattern", "subject", "matches"),
    [("[[:alpha:]]z", "bz", True), ("[[:alpha:]]z", "1z", False), ("a.b", "a\x85b", False), ("a..b", "a\x85b", True), ("^a$", "a\n", True), ("[a&&b]", "&", True), ("[[a]", "[", True), ("(?P<n>x)y", "xy", True), ("É", "É", True), ("[]a]", "]", True)],
)
def test_perl_patterns_match_bytes(spark, pattern, subject, matches):
    df = spark.createDataFrame([(subject,)], "path string")
    assert df.select(predicates.regex(pattern)).first()[0] is matches


def test_folding_is_ascii_only(spark):
    df = spark.createDataFrame([("ÉA",)], "path string")
    assert df.select(patterns.ascii_fold(F.col("path"))).first()[0] == "Éa"
    assert not df.select(predicates.regex("éa", True)).first()[0]


@pytest.mark.parametrize("pattern", ["(*COMMIT)a", "(*UTF8)a", "a(?C1)b", "[[:nope:]]", "(?(R)a|b)", "(?&none)", r"(a)\2", "a)", "(a", "[a", "*a", "a{2,1}", "(?<n", "\\"])
def test_unsupported(pattern):
    with pytest.raises(patterns.PatternError):
        patterns.perl_to_java(pattern)


def test_literal_prefix():
    assert patterns.literal_prefix("/usr/bin/*") == "/usr/bin/"
    assert patterns.literal_prefix("[a]") == ""


def test_bins_take_files_only(spark):
    bins = ("/bin", "/sbin", "/usr/bin")
    rows = [("/bin/foo", False, True), ("/usr/bin/a/b", False, True), ("/usr/bin/", True, False), ("/USR/bin/x", False, False), ("/lib/x", False, False)]
    df = spark.createDataFrame(rows, "path string, is_dir boolean, want boolean")
    assert df.where(predicates.in_bins(bins) != F.col("want")).count() == 0
    assert df.where(predicates.in_bins(())).count() == 0


def test_figures(spark):
    df = spark.createDataFrame([(0,), (1000,), (1024,), (2048,), (2049,), (3 << 20,), (5 << 30,)], "n long")
    got = [tuple(r) for r in df.select(text.humanized_total(F.col("n")), text.humanized_progress(F.col("n"))).collect()]
    assert got == [("0.0 B", "0 B"), ("1000.0 B", "1000 B"), ("1024.0 B", "1.0 KiB"), ("2048.0 B", "2.0 KiB"), ("2.0 KiB", "2.0 KiB"), ("3.0 MiB", "3.0 MiB"), ("5.0 GiB", "5.0 GiB")]
    rates = spark.createDataFrame([(7.25 * 1024,), (48.0 * 2**30,), (305.0,), (float("inf"),)], "v double").select(text.rate(F.col("v"))).collect()
    assert [r[0] for r in rates] == ["7.25K/s", "48.0G/s", "305B/s", "----"]
    one = spark.createDataFrame([(" \ta b\n", "extra.files", 86_400, 5, 10)], "s string, f string, t long, n long, m long")
    assert tuple(one.select(text.trimmed(F.col("s")), text.repo_of_file(F.col("f")), text.utc(F.col("t")), text.bar(F.col("n"), F.col("m"), 4)).first()) == ("a b", "extra", "1970-01-02 00:00:00 UTC", "==> ")
    assert [r[0] for r in spark.createDataFrame([(25,), (0,), (99,), (100,), (-3,)], "n long").select(text.bar(F.col("n"), F.lit(100))).collect()] == ["=====>".ljust(20), " " * 20, "=" * 19 + ">", "=" * 20, " " * 20]
    names = spark.createDataFrame([(n,) for n in (".files", "extra.files.000", "extra", ".db_version")], "f string").select(text.repo_of_file(F.col("f"))).collect()
    assert [r[0] for r in names] == [None] * 4


def test_figures_round_as_c_does(spark):
    values = [k / 256 for k in range(0, 3000, 7)] + [k / 4 for k in range(40)] + [k / 100 + d for k in range(5, 1000, 15) for d in (0, 1e-16, -1e-16)]
    values += [0.5, 1.5, 2.5, 2.05, 1.005, 0.15, 9.995, 99.95, 2**-30, 5e-324, 1023.95, 2047.25, 2**45 + 0.25]
    values += [-v for v in values if v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[text.fixed(F.col("v"), d) for d in range(3)]).collect()
    assert [tuple(r) for r in got] == [(v, f"{v:.0f}", f"{v:.1f}", f"{v:.2f}") for v, *_ in got]
    n = spark.createDataFrame([(576 * 4096,), (704 * 4096,), (320 * 4096,), (4160 << 10,)], "n long")
    assert [tuple(r) for r in n.select(text.humanized_total(F.col("n")), text.humanized_progress(F.col("n"))).collect()] == [("2.2 MiB", "2.2 MiB"), ("2.8 MiB", "2.8 MiB"), ("1280.0 KiB", "1.2 MiB"), ("4.1 MiB", "4.1 MiB")]
    assert [r[0] for r in spark.createDataFrame([(1.125 * 1024,), (10.25 * 1024,), (2.5,), (300.5,)], "v double").select(text.rate(F.col("v"))).collect()] == ["1152B/s", "10.2K/s", "2.50B/s", "300B/s"]


def test_padding_counts_bytes(spark):
    df = spark.createDataFrame([("é", 4)], "s string, w int")
    assert df.select(text.padded(F.col("s"), F.col("w"))).first()[0] == "é  "
    assert re.fullmatch("é {2}", "é  ")
