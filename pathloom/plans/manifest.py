"""The manifest: one row for each path of each package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import ascii_fold

_f = T.StructField
SCHEMA = T.StructType([
    _f("pkg_ord", T.IntegerType(), False), _f("pkg", T.StringType(), False), _f("version", T.StringType(), False), _f("file_ord", T.IntegerType(), False),
    _f("path", T.StringType(), False), _f("is_dir", T.BooleanType(), False), _f("basename", T.StringType(), False), _f("basename_ci", T.StringType(), False), _f("repo", T.StringType(), False),
])
COLUMNS = SCHEMA.names
#: What the rest of a manifest follows from: rows travel as these.
CORE = ("repo", "pkg_ord", "pkg", "version", "file_ord", "path")


def last_part() -> Column:
    """A path's last part."""
    return F.substring_index(F.regexp_replace("path", "/$", ""), "/", -1)


def with_names(paths: DataFrame) -> DataFrame:
    """repo, pkg_ord, pkg, version, file_ord, path to the whole manifest: a path that ends in / is a directory."""
    p = paths.withColumns({"is_dir": F.col("path").endswith("/"), "basename": last_part()})
    return p.withColumn("basename_ci", ascii_fold(F.col("basename"))).select(COLUMNS)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest over the star tables: region is repository, supplier package, part file.

    Immediate parents stand for directories. Small dimensions are left to the optimizer to
    broadcast by size. Occurrences are dealt by supplier once, as folder and file only; suppliers join, and paths are
    made distinct and numbered, where they then lie.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    kind = F.col("p_size") % 5
    folder = (
        F.when(kind == 0, "/usr/bin/")
        .when(kind == 1, F.concat(F.lit("/usr/lib/"), F.lower("p_type"), F.lit("/")))
        .when(kind == 2, F.concat(F.lit("/usr/share/doc/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/")))
        .when(kind == 3, "/etc/")
        .otherwise("/usr/sbin/")
    )
    file = F.concat(F.when(F.col("p_partkey") % 7 == 0, F.upper(name)).otherwise(name), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("."), F.col("p_partkey"))).otherwise(""))
    part = part.select("p_partkey", folder.alias("folder"), file.alias("file"))
    places = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    places = places.select("s_suppkey", F.col("r_name").alias("repo"), F.col("s_suppkey").cast("int").alias("pkg_ord"), F.col("s_name").alias("pkg"), F.concat_ws(".", F.col("s_suppkey"), F.concat(F.col("s_nationkey"), F.lit("-1"))).alias("version"))
    pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    key = ["l_suppkey", "repo", "pkg_ord", "pkg", "version"]
    files = pairs.join(part, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "folder", "file").repartition("l_suppkey")
    occurrences = files.join(places, F.col("s_suppkey") == F.col("l_suppkey")).select(*key, "folder", "file")
    both = occurrences.select(*key, F.explode(F.array("folder", F.concat("folder", "file"))).alias("path")).distinct()
    return with_names(both.withColumn("file_ord", (F.row_number().over(Window.partitionBy("l_suppkey", "repo").orderBy("path")) - 1).cast("int")))


def packages(manifest: DataFrame) -> DataFrame:
    """repo, pkg_ord, pkg, version, files_count."""
    return manifest.groupBy("repo", "pkg_ord", "pkg", "version").agg(F.count("*").alias("files_count"))


MANIFEST_SQL = """
pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
occ AS (SELECT DISTINCT r.r_name AS repo, CAST(s.s_suppkey AS INTEGER) AS pkg_ord, s.s_name AS pkg, concat(s.s_suppkey, '.', s.s_nationkey, '-1') AS version,
    CASE p.p_size % 5 WHEN 0 THEN '/usr/bin/' WHEN 1 THEN concat('/usr/lib/', lower(p.p_type), '/') WHEN 2 THEN concat('/usr/share/doc/', replace(lower(p.p_brand), '#', '-'), '/') WHEN 3 THEN '/etc/' ELSE '/usr/sbin/' END AS folder,
    concat(CASE WHEN p.p_partkey % 7 = 0 THEN upper(replace(p.p_name, ' ', '-')) ELSE replace(p.p_name, ' ', '-') END, CASE WHEN p.p_partkey % 2 = 1 THEN concat('.', p.p_partkey) ELSE '' END) AS file
  FROM pairs l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
paths AS (SELECT DISTINCT repo, pkg_ord, pkg, version, concat(folder, file) AS path FROM occ UNION SELECT DISTINCT repo, pkg_ord, pkg, version, folder FROM occ),
manifest AS (SELECT *, ends_with(path, '/') AS is_dir, regexp_replace(regexp_replace(path, '/$', ''), '^.*/', '') AS basename,
    translate(regexp_replace(regexp_replace(path, '/$', ''), '^.*/', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS basename_ci,
    CAST(ROW_NUMBER() OVER (PARTITION BY repo, pkg_ord ORDER BY encode(path)) - 1 AS INTEGER) AS file_ord FROM paths)
"""
