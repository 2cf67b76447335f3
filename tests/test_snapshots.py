"""Commits of the index: whole or not at all, while others read and write; what reads skip; damaged files."""

import glob
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from pathloom.operators import inspection, listing, search
from pathloom.options import Match, Options
from pathloom.plans import catalog, shuffles, statistics, trigrams
from pathloom.plans.catalog import FileIndex, write_repos, write_version
from pathloom.plans.manifest import with_names

RAW = "repo string, pkg_ord int, pkg string, version string, file_ord int, path string"


def manifest(spark, rows):
    return with_names(spark.createDataFrame(rows, RAW))


def one(repo, mark, files=3):
    """A repository all of whose rows say which version they are of."""
    return [(repo, 0, f"{repo}-{mark}", f"{mark}-1", i, f"/usr/{mark}/file{i}") for i in range(files)]


def marks(index, repo):
    """The versions that a search, a listing and the counts see."""
    found = {r["entry"].split("/")[2] for r in search.search(index, "/usr/*/file*", Options(match=Match.GLOB, verbose=True, repo=repo)).collect()}
    listed = {r["prefix"].split("-")[-1] for r in listing.list_files(index, f"{repo}/.", Options(match=Match.REGEX)).collect()}
    return found, listed, {r["pkg"].split("-")[-1] for r in index.packages.where(f"repo = '{repo}'").collect()}


@pytest.fixture
def path(spark, tmp_path):
    at = str(tmp_path / "index")
    write_repos(manifest(spark, one("core", "old") + one("extra", "old")), at)
    write_version(spark, at)
    return at


@pytest.mark.parametrize("broken", ["of", "by_repo"])
def test_a_write_that_ends_between_tables_changes_nothing(spark, path, monkeypatch, broken):
    before = FileIndex.open(spark, path)

    def fails(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(trigrams if broken == "of" else statistics, broken, fails)
        with pytest.raises(RuntimeError):
            write_repos(manifest(spark, one("core", "new")), path)
    assert len(os.listdir(f"{path}/manifest")) == 2 + os.listdir(f"{path}/manifest").count("._SUCCESS.crc")  # its rows are there
    for index in (before, FileIndex.open(spark, path)):
        assert marks(index, "core") == ({"old"}, {"old"}, {"old"})
    write_repos(manifest(spark, one("core", "new")), path)
    assert marks(FileIndex.open(spark, path), "core") == ({"new"},) * 3 and marks(before, "core") == ({"old"},) * 3
    # what the broken write left goes once it is old, what readers may hold stays until then
    assert catalog.collect(spark, path, retention=3600) == []
    gone = catalog.collect(spark, path, retention=-5)
    assert any("manifest/commit=" in g for g in gone) and marks(FileIndex.open(spark, path), "core") == ({"new"},) * 3
    assert marks(FileIndex.open(spark, path), "extra") == ({"old"},) * 3


def test_readers_see_one_version_while_a_writer_works(spark, path):
    stop, seen, errors = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                found = marks(FileIndex.open(spark, path), "core")
                seen.add(tuple(sorted(found[0])))
                if len(set(map(frozenset, found))) != 1 or len(found[0]) != 1:
                    errors.append(found)
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    threads = [threading.Thread(target=read) for _ in range(2)]
    for t in threads:
        t.start()
    for n in range(4):
        write_repos(manifest(spark, one("core", f"v{n}")), path)
        catalog.collect(spark, path)
    stop.set()
    for t in threads:
        t.join()
    assert not errors and len(seen) > 1


def test_writers_at_once_both_count(spark, path):
    errors = []

    def write(repo):
        try:
            write_repos(manifest(spark, one(repo, "x")), path)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(f"r{n}",)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and catalog.stored_repos(spark, path) == {"core", "extra", "r0", "r1", "r2", "r3"}
    assert catalog.snapshot(spark, path).number == 5
    assert FileIndex.open(spark, path, number=1).packages.count() == 2  # an earlier one, still there


def test_odd_names_and_emptied_repositories(spark, tmp_path):
    at, names = str(tmp_path / "index"), ["a b", "x=y", "50%", "é", "a*[b]", "c#d:e", "01"]
    write_repos(manifest(spark, [row for n in names for row in one(n, "v")]), at)
    write_version(spark, at)
    assert {r["repo"] for r in FileIndex.open(spark, at).manifest.select("repo").distinct().collect()} == set(names)
    state = spark.createDataFrame([(5, 7, 2, "x=y")], catalog.STATE)
    write_repos(manifest(spark, []), at, state, repos=["a b"])
    index = FileIndex.open(spark, at)
    assert index.packages.where("repo IN ('a b', 'x=y')").isEmpty() and index.packages.count() == len(names) - 2
    assert [tuple(r) for r in index.state.collect()] == [(5, 7, 2, "x=y")] and catalog.stored_repos(spark, at) == set(names)
    catalog.remove_repos(spark, at, ["50%", "none"])
    assert "50%" not in catalog.stored_repos(spark, at)


def test_damaged_files_are_named_and_the_rest_is_read(spark, path):
    assert [r["status"] for r in catalog.health(spark, path).collect()] == ["good", "good"]
    file = next(f for f in glob.glob(f"{path}/manifest/commit=*/repo=core/*.parquet"))
    with open(file, "rb+") as f:
        f.truncate(os.path.getsize(file) // 2)
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    assert {r["repo"]: r["status"] for r in catalog.health(spark, path).collect()} == {"core": "manifest has 0 rows of 3", "extra": "good"}
    with pytest.warns(catalog.Damaged, match="core is left out") as warned:
        index = FileIndex.open(spark, path, check=True)
    assert sum(w.category is catalog.Damaged for w in warned) == 1 and index.damaged.keys() == {"core"} and marks(index, "extra") == ({"old"},) * 3
    assert search.search(index, "file1").count() == 1
    for folder in glob.glob(f"{path}/packages/commit=*/repo=extra"):
        os.rename(folder, f"{path}/elsewhere")
    assert {r["repo"]: r["status"] for r in catalog.health(spark, path).collect()}["extra"] == "packages is gone"


def scanned(df):
    """Rows that leave a query's scans, in a run of its own."""
    df = df.select("*")
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
    metrics = [leaf.metrics().get("numOutputRows") for leaf in leaves if "Scan parquet" in leaf.nodeName()]
    return sum(m.get().value() for m in metrics if m.isDefined())


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Forty packages of 1,500 files in small row groups and blocks."""
    at = str(tmp_path_factory.mktemp("large") / "index")
    rows = [("core", p, f"pkg-{p:02}", "1-1", i, f"/usr/{'lib' if i % 3 else 'bin'}/{chr(97 + i % 26)}{chr(97 + p % 26)}x{i:04}{'.needle' if (p, i) == (7, 777) else ''}") for p in range(40) for i in range(1500)]
    rows += [("small", 0, "pkg-07", "2-1", 0, "/usr/bin/ÉTÉ-needle")]
    settings = {"parquet.block.size": "65536", "parquet.page.size": "8192", "parquet.block.size.row.check.min": "50", "parquet.page.size.row.check.min": "50"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    block, trigrams.BLOCK = trigrams.BLOCK, 500
    try:
        write_repos(manifest(spark, rows), at)
    finally:
        trigrams.BLOCK = block
        for k in settings:
            spark.conf.unset(k)
    write_version(spark, at)
    return FileIndex.open(spark, at)


def test_a_listing_reads_the_package(spark, large):
    for target, options, rows in [("core/pkg-07", Options(), 1500), ("pkg-07", Options(), 1501), ("core/PKG-07", Options(ignore_case=True), 1500), ("core/-07$", Options(match=Match.REGEX), 1500), ("core/pkg-0[12]", Options(match=Match.GLOB), 3000)]:
        found = listing.list_files(large, target, options)
        assert found.count() == rows
        assert scanned(found) <= rows + 6_000, target  # of 60,001
    # more packages than are looked up ahead
    few, listing.FEW = listing.FEW, 3
    try:
        joined = listing.list_files(large, "pkg-*[05]", Options(match=Match.GLOB))
        assert "Join" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 8 * 1500
        assert listing.list_files(large, "pkg-0", Options(match=Match.REGEX)).count() == 10 * 1500 + 1
        assert listing.list_files(large, "PKG-07", Options(ignore_case=True)).count() == 1501
    finally:
        listing.FEW = few


@pytest.mark.parametrize(
    ("query", "options", "most"),
    [
        ("needle", Options(match=Match.REGEX), 5_000), ("/usr/bin/*.needle", Options(match=Match.GLOB), 5_000), ("/usr/bin/*NEEDLE", Options(match=Match.GLOB, ignore_case=True), 5_000),
        ("(needle|zzx0001)$", Options(match=Match.REGEX), 9_000), ("n.?eedle", Options(match=Match.REGEX, verbose=True), 5_000), ("bin/a?a", Options(match=Match.REGEX), 60_001), (".", Options(match=Match.REGEX), 60_001),
        ("ÉTÉ-", Options(match=Match.REGEX), 5_000), ("nothing like it", Options(match=Match.REGEX), 0), ("needle", Options(match=Match.REGEX, repo="small"), 1),
    ],
)
def test_trigrams_prune_and_change_nothing(spark, large, query, options, most):
    from dataclasses import replace

    whole, pruned = (search.search(large, query, replace(options, prune=p)) for p in (False, True))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pruned.collect()))
    assert scanned(pruned) <= most
    if most < 60_000 and not options.repo:
        assert scanned(whole) == 60_001


def test_ranges_cover_and_stay_few():
    import random

    r = random.Random(1)
    for n in (0, 1, 10, 500):
        blocks = sorted(r.sample(range(5_000), n))
        runs = trigrams.ranges(blocks)
        assert len(runs) <= trigrams.RANGES and all(any(a <= b <= z for a, z in runs) for b in blocks)
        assert n > trigrams.RANGES or sum(z - a + 1 for a, z in runs) == n


def test_summary_reads_no_row(spark, path, monkeypatch):
    write_repos(manifest(spark, one("core", "new", files=5)), path, spark.createDataFrame([(86_400, 4096, 2, "core")], catalog.STATE))
    index = FileIndex.open(spark, path)
    got = inspection.summary(index)
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    counted = statistics.by_repo(index.manifest).select("repo", *statistics.COUNTS)
    assert sorted(map(tuple, got.select("repo", *statistics.COUNTS).collect())) == sorted(map(tuple, counted.collect()))
    source = inspection.sources(index).where("repo = 'core'").first()
    assert source["source_time"] == "1970-01-02 00:00:00 UTC" and source["source_size"] == "4.0 KiB" and source["files"] == 5
    assert inspection.total(index).first()["files"] == 8
    assert time.strptime(source["indexed"], "%Y-%m-%d %H:%M:%S UTC")


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    def there():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    before, at = there(), str(tmp_path / "index")
    kept = spark.conf.get(shuffles.FREED, None)
    write_repos(manifest(spark, [row for n in range(20) for row in one(f"r{n}", "x", files=50)]), at)
    for _ in range(100):  # files go in the background
        if not there() - before:
            break
        time.sleep(0.1)
    assert not there() - before
    assert spark.conf.get(shuffles.FREED, None) == kept and os.listdir(f"{at}/incoming") == []
    # nor a Bloom filter of 1 MiB a file
    assert sum(os.path.getsize(f) for f in glob.glob(f"{at}/packages/*/*/*.parquet")) < 20 * 10_000


def test_the_setting_stays_until_the_last_has_ended(spark):
    kept = spark.conf.get(shuffles.FREED, None)
    first, second = shuffles.freed(spark), shuffles.freed(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(shuffles.FREED) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(shuffles.FREED, None) == kept


def test_counts_of_odd_paths(spark):
    paths = ["/", "/usr/", "/usr", "/usr/bin/a", "/usr//bin/b", "/a//", "/a///", "//x", "/usr/bin/a/b/", "", "rel/x", "/p", "/é/ü", "/usr/bin/"]
    m = manifest(spark, [("r", 0, "p", "1-1", i, p) for i, p in enumerate(paths)] + [("s", 1, "q", "2-1", 0, "/1/2/3/3/3"), ("s", 2, "q", "2-2", 0, "/1/2/3")])
    nodes = statistics.path_nodes(m)
    of = lambda df, *which: {r["repo"]: tuple(r)[1:] for r in df.groupBy("repo").agg(*which).collect()}
    files, names = of(m, F.count_distinct("pkg_ord"), F.count("*")), of(statistics.basenames(m), F.count("*"), F.count_if("single"))
    strings, paths = of(statistics.strings(m, nodes), F.count("*"), F.sum(F.octet_length("string"))), of(nodes, F.count("*"))
    assert {r["repo"]: tuple(r)[1:] for r in statistics.by_repo(m).collect()} == {r: files[r] + names[r] + paths[r] + strings[r] for r in ("r", "s")}
