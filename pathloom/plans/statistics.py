"""Counts of a repository's packages, files, names and paths: made once at writing, since a repository's rows don't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifest import packages

#: What a repository's facts hold besides its source's.
COUNTS = ("packages", "files", "basenames", "single", "paths", "strings", "string_bytes")


def basenames(manifest: DataFrame) -> DataFrame:
    """repo, basename, postings, single: a basename met once needs no list of its own."""
    return manifest.groupBy("repo", "basename").agg(F.count("*").alias("postings")).withColumn("single", F.col("postings") == 1)


def path_nodes(manifest: DataFrame) -> DataFrame:
    """repo, path: every listed path and every prefix of one, without trailing slashes."""
    parts = F.split(F.regexp_replace("path", "^/|/$", ""), "/")
    distinct = manifest.select("repo", F.regexp_replace("path", "/$", "").alias("path")).distinct()
    prefix = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/")))
    return distinct.select("repo", parts.alias("parts")).select("repo", F.explode(prefix).alias("path")).distinct()


def strings(manifest: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """repo, string: path components, package names, versions and the repository's own name."""
    parts = (path_nodes(manifest) if nodes is None else nodes).select("repo", F.substring_index("path", "/", -1).alias("string"))
    names = packages(manifest).select("repo", F.explode(F.array("repo", "pkg", "version")).alias("string"))
    return parts.union(names).distinct()


def by_repo(manifest: DataFrame) -> DataFrame:
    """repo and COUNTS.

    All paths cross the network once, as a name in a folder. The names of nodes are the parts of paths, so a row a
    name says what it counts for: how many nodes, how many listed files, whether it is a string.
    """
    node = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("path", "/$", ""), "^/|/$", ""))
    name = F.substring_index(node, "/", -1)
    folder = F.substring(node, F.lit(1), F.length(node) - F.length(name) - 1)
    listed = manifest.select("repo", name.alias("name"), folder.alias("folder"), "basename")
    row = lambda name, folder, text, posted: ("repo", name.alias("name"), folder.alias("folder"), F.lit(text).alias("text"), posted.cast("long").alias("posted"))
    nowhere, one, none = F.lit(None).cast("string"), F.lit(1), F.lit(0)

    parts = F.split(F.substring("folder", F.lit(2), F.length("folder")), "/")
    above = listed.select("repo", "folder").distinct().where("folder <> ''").select("repo", parts.alias("parts"))
    step = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(F.element_at("parts", n).alias("name"), F.array_join(F.slice(F.concat(F.array(F.lit("")), "parts"), F.lit(1), n), "/").alias("folder")))
    above = above.select("repo", F.explode(step).alias("up"))
    whole = packages(manifest)
    words = whole.select("repo", F.explode(F.array("repo", "pkg", "version")).alias("word"))

    same = F.col("basename") == F.col("name")
    rows = listed.select(*row(F.col("name"), F.col("folder"), True, same))
    rows = rows.union(listed.where(~same).select(*row(F.col("basename"), nowhere, False, one)))
    rows = rows.union(above.select(*row(F.col("up.name"), F.col("up.folder"), True, none))).union(words.select(*row(F.col("word"), nowhere, True, none)))
    nodes = rows.groupBy("repo", "name", "folder").agg(F.max("text").alias("text"), F.sum("posted").alias("posted"))
    names = nodes.groupBy("repo", "name").agg(F.count("folder").alias("nodes"), F.max("text").alias("text"), F.sum("posted").alias("posted"))
    counts = names.groupBy("repo").agg(
        F.count_if(F.col("posted") > 0).alias("basenames"), F.count_if(F.col("posted") == 1).alias("single"), F.sum("nodes").alias("paths"),
        F.count_if("text").alias("strings"), F.sum(F.when(F.col("text"), F.octet_length("name"))).alias("string_bytes"),
    )
    by_package = whole.groupBy("repo").agg(F.count("*").alias("packages"), F.sum("files_count").alias("files"))
    return by_package.join(counts, "repo").select("repo", *COUNTS)
