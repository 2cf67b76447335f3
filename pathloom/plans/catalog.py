"""The index on disk: immutable tables a commit, and snapshots that say which commit each repository is at.

A write puts the rows of its repositories into new folders, `<table>/commit=<id>/repo=<name>`, of
every table; nothing that a reader may hold is touched. Once all tables are whole, one file renamed
into `snapshots/` makes them current: a snapshot lists every repository with its commit and facts. Of
two writers that commit at once, the second finds its number taken, takes up what the first changed
and commits after it. Readers pin the snapshot they open. Folders that no recent snapshot names are
collected after a retention time, so a search that began before an update ends on what it began with.

| table | clustered by | for |
|-|-|-|
| manifest | repository, basename | searches: statistics, Bloom filters and block numbers skip row groups |
| by_package | repository, package | listings: a package is a run of rows |
| packages | repository, package | which packages there are |
| grams | repository, trigram | blocks of the manifest in which a trigram occurs |
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs, statistics, trigrams
from .manifest import COLUMNS, CORE, SCHEMA, last_part, packages, with_names
from .shuffles import freed
from .store import Store

FORMAT_VERSION = 2
MARKER, SNAPSHOTS, INCOMING = "version.json", "snapshots", "incoming"
TABLES = ("manifest", "by_package", "packages", "grams")
#: Folders of earlier formats.
EARLIER = ("repo_state",)
#: Seconds that a folder stays once no snapshot of that time names it.
RETENTION = 3600.0
HINT = "an update may be needed first"

_repo = T.StructField("repo", T.StringType(), False)
_commit = T.StructField("commit", T.StringType(), False)
_of = {f.name: f for f in SCHEMA}
STORED = {
    "manifest": T.StructType([*[_of[c] for c in COLUMNS if c != "repo"], T.StructField("block", T.LongType()), _commit, _repo]),
    "by_package": T.StructType([*[_of[c] for c in ("pkg_ord", "pkg", "version", "file_ord", "path", "is_dir")], _commit, _repo]),
    "packages": T.StructType([*[_of[c] for c in ("pkg_ord", "pkg", "version")], T.StructField("files_count", T.LongType()), _commit, _repo]),
    "grams": T.StructType([*trigrams.SCHEMA, _commit, _repo]),
}
STATE = T.StructType([T.StructField("source_mtime", T.LongType()), T.StructField("file_size", T.LongType()), T.StructField("format_version", T.IntegerType()), T.StructField("repo", T.StringType())])


class CannotOpen(Exception):
    """The index can't be opened."""


class NotFound(CannotOpen):
    pass


class NotADirectory(CannotOpen):
    pass


class VersionMissing(CannotOpen):
    pass


class WrongVersion(CannotOpen):
    pass


class Damaged(UserWarning):
    """A repository's files can't be read, or hold other than was written."""


def read_version(spark: SparkSession, path: str) -> int | None:
    try:
        return int(json.loads(Store(spark).read(f"{path}/{MARKER}"))["format_version"])
    except (OSError, ValueError, KeyError, TypeError):
        return None


def write_version(spark: SparkSession, path: str, version: int = FORMAT_VERSION) -> None:
    Store(spark).write(f"{path}/{MARKER}", json.dumps({"format_version": version}).encode())


# ---- snapshots


@dataclass(frozen=True)
class Snapshot:
    """What is current: for each repository its commit, folder, counts and facts about its source."""

    number: int = 0
    repos: dict[str, dict] = field(default_factory=dict)


def _numbers(store: Store, path: str) -> dict[int, int]:
    """Snapshots and when they were committed, in milliseconds."""
    return {int(e.name[:-5]): e.modified for e in store.entries(f"{path}/{SNAPSHOTS}") if e.name.endswith(".json") and e.name[:-5].isdigit()}


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """The latest snapshot, or a given one; an empty one before the first commit."""
    store = Store(spark)
    if number is None:
        number = max(_numbers(store, path), default=0)
    if number == 0:
        return Snapshot()
    repos = (json.loads(line) for line in store.read(f"{path}/{SNAPSHOTS}/{number:012}.json").splitlines())
    return Snapshot(number, {r.pop("repo"): r for r in repos})


def committed(spark: SparkSession, path: str, change: Callable[[dict[str, dict]], dict[str, dict]]) -> Snapshot:
    """Make a changed list of repositories current, after whatever others have committed meanwhile."""
    store = Store(spark)
    store.make(f"{path}/{SNAPSHOTS}")
    while True:
        before = snapshot(spark, path)
        after = Snapshot(before.number + 1, change(dict(before.repos)))
        lines = "\n".join(json.dumps({"repo": name, **facts}) for name, facts in sorted(after.repos.items()))
        if store.write_new(f"{path}/{SNAPSHOTS}/{after.number:012}.json", lines.encode()):
            return after


# ---- reading


@dataclass(frozen=True)
class FileIndex:
    """The tables that searches read, all of one snapshot, each opened when it is first asked for."""

    table: Callable[[str], DataFrame | None]
    pinned: Snapshot | None = None
    #: Repositories left out, with what is wrong with them.
    damaged: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(manifest: DataFrame) -> FileIndex:
        return FileIndex({"manifest": manifest, "packages": packages(manifest), "by_package": manifest}.get)

    @cached_property
    def manifest(self) -> DataFrame:
        return self.table("manifest")

    @cached_property
    def packages(self) -> DataFrame:
        return self.table("packages")

    @cached_property
    def by_package(self) -> DataFrame:
        return self.table("by_package")

    @cached_property
    def grams(self) -> DataFrame | None:
        return self.table("grams")

    @cached_property
    def state(self) -> DataFrame | None:
        return self.table("state")

    @staticmethod
    def open(spark: SparkSession, path: str, number: int | None = None, check: bool = False) -> FileIndex:
        """The latest snapshot or a given one; with check, repositories whose files are damaged are named and left out."""
        store = Store(spark)
        root = store.entry(path)
        if root is None:
            raise NotFound(f"{path}: no such directory")
        if not root.is_dir:
            raise NotADirectory(f"{path}: not a directory")
        version = read_version(spark, path)
        if version is None:
            raise VersionMissing(f"{path}: no version marker ({HINT})")
        if version != FORMAT_VERSION:
            raise WrongVersion(f"{path}: version {version}, not {FORMAT_VERSION} ({HINT})")
        pinned = snapshot(spark, path, number)
        damaged = {}
        if check:
            damaged = {r["repo"]: r["status"] for r in health(spark, path, pinned).where("status <> 'good'").collect()}
            for repo, status in sorted(damaged.items()):
                warnings.warn(f"{path}: repository {repo} is left out: {status}", Damaged, stacklevel=2)
        repos = {name: facts for name, facts in pinned.repos.items() if name not in damaged}

        def table(name: str) -> DataFrame:
            if name != "state":
                return _read(spark, path, name, repos)
            known = [(f["source_mtime"], f.get("file_size"), f.get("format_version"), repo) for repo, f in repos.items() if f.get("source_mtime") is not None]
            return spark.createDataFrame(known, STATE)

        return FileIndex(table, Snapshot(pinned.number, repos), damaged)

    @cached_property
    def files(self) -> int | None:
        """Rows of the manifest, if the snapshot knows."""
        return None if self.pinned is None else sum(r["files"] for r in self.pinned.repos.values())

    def within(self, repo: str) -> FileIndex:
        """One repository's rows."""

        def table(name: str) -> DataFrame | None:
            whole = getattr(self, name)
            return None if whole is None else whole.where(F.col("repo") == repo)

        pinned = self.pinned and Snapshot(self.pinned.number, {n: r for n, r in self.pinned.repos.items() if n == repo})
        return FileIndex(table, pinned, self.damaged)


def _read(spark: SparkSession, path: str, name: str, repos: dict[str, dict], skip_corrupt: bool = False) -> DataFrame:
    folders = [f"{path}/{name}/commit={f['commit']}/{f['folder']}" for f in repos.values() if f["files"]]
    if not folders:
        return spark.createDataFrame([], STORED[name])
    return spark.read.schema(STORED[name]).option("basePath", f"{path}/{name}").option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(*folders)


def health(spark: SparkSession, path: str, pinned: Snapshot | None = None) -> DataFrame:
    """repo, status: `good`, or which table holds other than was written.

    Rows are counted with unreadable files passed over. Counting takes no column, so the job reads
    footers; a file that is cut short, gone or not Parquet lacks its rows, however large the rest is.
    A folder that is gone is told from the listing before.
    """
    pinned = pinned or snapshot(spark, path)
    store, missing, there = Store(spark), {}, {}
    kept = [c for c in TABLES if c != "grams"]
    for name, facts in pinned.repos.items():
        gone = [t for t in kept if facts["files"] and not store.exists(f"{path}/{t}/commit={facts['commit']}/{facts['folder']}")]
        if gone:
            missing[name] = f"{gone[0]} is gone"
        else:
            there[name] = facts
    wanted = spark.createDataFrame([(n, t, f["packages" if t == "packages" else "files"]) for n, f in there.items() for t in kept], "repo string, table string, wanted long")
    counts = None
    for t in kept:
        c = _read(spark, path, t, there, skip_corrupt=True).groupBy("repo").agg(F.count("*").alias("rows")).withColumn("table", F.lit(t))
        counts = c if counts is None else counts.unionByName(c)
    compared = wanted.join(counts, ["repo", "table"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    wrong = F.when(F.col("rows") != F.col("wanted"), F.format_string("%s has %d rows of %d", "table", "rows", "wanted"))
    found = compared.groupBy("repo").agg(F.coalesce(F.min(wrong), F.lit("good")).alias("status"))
    return found.union(spark.createDataFrame(list(missing.items()), "repo string, status string"))


# ---- writing


def write_repos(manifest: DataFrame, path: str, state: DataFrame | None = None, repos: Iterable[str] | None = None) -> Snapshot:
    """Replace the repositories that manifest and state hold, and those named in repos, in one step.

    A repository named but without rows is kept as an empty one. The manifest is evaluated once and
    kept as it comes, since dealing by ranges reads rows twice; then its rows are dealt by ranges of
    (repo, basename) and sorted, so one large repository fills several files; the other tables are
    made from what has been written, at once. No step's shuffle files outlast it.
    """
    with freed(manifest.sparkSession):
        return _write_repos(manifest, path, state, repos)


def _write_repos(manifest: DataFrame, path: str, state: DataFrame | None, repos: Iterable[str] | None) -> Snapshot:
    spark = manifest.sparkSession
    commit = f"{time.time_ns():x}-{uuid.uuid4().hex[:8]}"

    def at(name: str) -> str:
        return f"{path}/{name}/commit={commit}"

    def written(df: DataFrame, name: str, *blooms: str) -> None:
        # a filter has the size its values need; otherwise each is 1 MiB, more than most repositories' rows
        w = df.select([c for c in STORED[name].names if c != "commit"]).write.partitionBy("repo").option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in blooms:
            w = w.option(f"parquet.bloom.filter.enabled#{column}", "true")
        w.parquet(at(name))

    core, incoming = [f for f in SCHEMA if f.name in CORE], f"{path}/{INCOMING}/{commit}"
    try:
        manifest.select(*CORE).write.parquet(incoming)
        dealt = spark.read.schema(T.StructType(core)).parquet(incoming).repartitionByRange("repo", last_part(), "pkg_ord")
        ordered = with_names(dealt).sortWithinPartitions("repo", "basename", "pkg_ord")
        written(ordered.withColumn("block", trigrams.block_number(commit)), "manifest", "basename", "basename_ci")
    finally:
        Store(spark).delete(incoming)
    folders = {unquote(e.name[5:]): e.name for e in Store(spark).entries(at("manifest")) if e.name.startswith("repo=")}
    facts: dict[str, dict] = {name: {"commit": commit, "folder": folders.get(name), "files": 0, "packages": 0} for name in {*folders, *(repos or ())}}
    if state is not None:
        for r in state.select("repo", "source_mtime", "file_size", "format_version").collect():
            own = facts.setdefault(r["repo"], {"commit": commit, "folder": None, "files": 0, "packages": 0})
            own |= {"source_mtime": r["source_mtime"], "file_size": r["file_size"], "format_version": r["format_version"]}
    if folders:
        stored = _read(spark, path, "manifest", {n: {"commit": commit, "folder": f, "files": 1} for n, f in folders.items()})
        jobs = [
            lambda: written(stored.repartitionByRange("repo", "pkg", "pkg_ord", "file_ord").sortWithinPartitions("repo", "pkg", "pkg_ord", "file_ord"), "by_package", "pkg"),
            lambda: written(packages(stored).repartitionByRange("repo", "pkg", "pkg_ord").sortWithinPartitions("repo", "pkg", "pkg_ord"), "packages"),
            lambda: written(trigrams.of(stored), "grams"),
            lambda: [facts[r["repo"]].update(r.asDict()) for r in statistics.by_repo(stored).collect()],
        ]
        with ThreadPoolExecutor(len(jobs)) as pool:
            for done in [pool.submit(job) for job in jobs]:
                done.result()
    now = int(time.time())
    new = {name: {k: v for k, v in f.items() if k != "repo"} | {"indexed_at": now} for name, f in facts.items()}
    return committed(spark, path, lambda before: before | new)


def remove_repos(spark: SparkSession, path: str, repos: Iterable[str]) -> None:
    """Make repositories no longer current; their files are collected later."""
    gone = set(repos)
    if gone & stored_repos(spark, path):
        committed(spark, path, lambda before: {n: f for n, f in before.items() if n not in gone})


def stored_repos(spark: SparkSession, path: str) -> set[str]:
    return set(snapshot(spark, path).repos)


def collect(spark: SparkSession, path: str, retention: float = RETENTION) -> list[str]:
    """Delete what no snapshot of the last retention seconds names; returns the folders and snapshots deleted.

    The current snapshot always counts, and so does the one that was current when the time began.
    Folders younger than that stay, since a write that has yet to commit may be filling them.
    """
    store, oldest = Store(spark), (time.time() - retention) * 1000
    numbers = _numbers(store, path)
    current = max((n for n, at in numbers.items() if at <= oldest), default=0)
    kept = [n for n in numbers if n >= current]
    live = {(f["commit"], f["folder"]) for n in kept for f in snapshot(spark, path, n).repos.values()}
    commits = {c for c, _ in live}
    deleted = []
    for table in TABLES:
        for e in store.entries(f"{path}/{table}"):
            at = f"{path}/{table}/{e.name}"
            if not e.is_dir or e.modified > oldest:
                continue
            commit = e.name.removeprefix("commit=")
            if commit not in commits:
                deleted.append(at)
            else:
                deleted += [f"{at}/{r.name}" for r in store.entries(at) if r.name.startswith("repo=") and (commit, r.name) not in live]
    deleted += [f"{path}/{SNAPSHOTS}/{n:012}.json" for n in numbers if n not in kept]
    for at in deleted:
        store.delete(at)
    return deleted


def tidy(spark: SparkSession, path: str, known: set[str], retention: float = RETENTION) -> bool:
    """Drop repositories that aren't known; refuse if the folder holds directories that no index has."""
    store = Store(spark)
    entries = store.entries(path)
    if {e.name for e in entries if e.is_dir} - {*TABLES, *EARLIER, SNAPSHOTS, INCOMING, jobs.FOLDER}:
        return False
    remove_repos(spark, path, stored_repos(spark, path) - known)
    for e in entries:
        if e.name in EARLIER or not e.is_dir and e.name not in (MARKER, f".{MARKER}.crc"):
            store.delete(f"{path}/{e.name}")
    collect(spark, path, retention)
    return True
