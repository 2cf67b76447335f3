"""What an index holds: counts, packages, files, basenames and where they are, paths and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import humanized_total, utc
from ..plans import statistics
from ..plans.catalog import FileIndex


def package_table(index: FileIndex) -> DataFrame:
    return index.packages.select("repo", "pkg", "version", "files_count")


def package_files(index: FileIndex, repo: str, pkg: str) -> DataFrame:
    """file_ord, flag, path of the first package of that name, in the archive's order."""
    first = index.packages.where((F.col("repo") == repo) & (F.col("pkg") == pkg)).groupBy("repo").agg(F.min("pkg_ord").alias("pkg_ord"))
    rows = index.by_package.where((F.col("repo") == repo) & (F.col("pkg") == pkg)).join(first, ["repo", "pkg_ord"], "left_semi")
    return rows.select("file_ord", F.when(F.col("is_dir"), "d").otherwise("f").alias("flag"), "path")


def basenames(index: FileIndex) -> DataFrame:
    """repo, basename, postings, single: a basename met once needs no list of its own."""
    return statistics.basenames(index.manifest)


def postings(index: FileIndex, basename: str) -> DataFrame:
    return index.manifest.where(F.col("basename") == basename).select("repo", F.when(F.col("is_dir"), "d").otherwise("f").alias("flag"), "pkg", "path")


def path_nodes(index: FileIndex) -> DataFrame:
    """repo, path: every listed path and every prefix of one, without trailing slashes."""
    return statistics.path_nodes(index.manifest)


def path_trie(index: FileIndex) -> DataFrame:
    """repo, id, parent, name, resolved: nodes numbered in the order of their paths, parents by number."""
    nodes = path_nodes(index).withColumn("id", F.row_number().over(Window.partitionBy("repo").orderBy("path")) - 1)
    up = F.substring("path", F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1)
    named = nodes.select("repo", "id", F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("resolved"), up.alias("up"))
    parents = nodes.select("repo", F.col("path").alias("up"), F.col("id").alias("parent"))
    return named.join(parents, ["repo", "up"], "left").select("repo", "id", "parent", "name", "resolved")


def strings(index: FileIndex) -> DataFrame:
    """repo, string: path components, package names, versions and the repository's own name."""
    return statistics.strings(index.manifest)


def counted(index: FileIndex) -> DataFrame:
    """repo and its counts: as the snapshot has them, or counted where there is none."""
    if index.pinned is None:
        return statistics.by_repo(index.manifest)
    rows = [(name, *[int(f[c]) for c in statistics.COUNTS]) for name, f in index.pinned.repos.items() if f["files"]]
    return index.manifest.sparkSession.createDataFrame(rows, "repo string, " + ", ".join(f"{c} long" for c in statistics.COUNTS))


def _with_ratios(counts: DataFrame) -> DataFrame:
    ratios = {"files_per_path": F.round(F.col("files") / F.col("paths"), 2), "single_percent": F.round(100.0 * F.col("single") / F.col("basenames"), 1)}
    return counts.withColumns(ratios)


def summary(index: FileIndex) -> DataFrame:
    """One row a repository: counts, bytes of names, and ratios. Of an index on disk no row is read: counts are kept with the snapshot."""
    return _with_ratios(counted(index))


def sources(index: FileIndex) -> DataFrame:
    """One row a repository: its archive's time and bytes, when it was indexed, and how many files and bytes of names it holds."""
    known = index.pinned.repos if index.pinned else {}
    rows = [(name, f.get("source_mtime"), f.get("file_size"), f.get("indexed_at"), f["files"], f.get("string_bytes", 0)) for name, f in known.items()]
    df = index.manifest.sparkSession.createDataFrame(rows, "repo string, mtime long, size long, indexed long, files long, string_bytes long")
    return df.select("repo", utc(F.col("mtime")).alias("source_time"), humanized_total(F.col("size")).alias("source_size"), utc(F.col("indexed")).alias("indexed"), "files", "string_bytes")


def total(index: FileIndex) -> DataFrame:
    """One row over all repositories, of what adds up: packages, files, paths and bytes of names are counted a repository."""
    c = counted(index)
    return c.agg(F.count("*").alias("repos"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("packages", "files", "paths", "string_bytes")])
