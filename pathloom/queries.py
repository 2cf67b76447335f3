"""The registered queries over the manifest of the star tables and over the event log, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import inspection, listing, search, upkeep
from .options import Match, Options
from .plans import render
from .plans.catalog import FileIndex, write_repos, write_version
from .plans.manifest import COLUMNS, MANIFEST_SQL, from_tables
from .sources import archives

BINS = ("/usr/bin/", "/usr/sbin/")
_stored: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a local session without it has a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='pathloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, sf_dir: str) -> FileIndex:
    """The manifest of sf_dir, written as an index in the shared folder the first time a session asks."""
    return FileIndex.open(spark, stored_path(spark, sf_dir))


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = scratch(spark, "index")
        write_repos(from_tables(spark, sf_dir), path)
        write_version(spark, path)
        _stored[key] = path
    return _stored[key]


def searching(target: str, **options):
    o = Options(bins=BINS, **options)
    return lambda spark, d: search.search(stored_index(spark, d), target, o)


def listed(target: str, **options):
    o = Options(bins=BINS, **options)
    return lambda spark, d: listing.list_files(stored_index(spark, d), target, o)


def inspected(what, *args):
    return lambda spark, d: what(stored_index(spark, d), *args)


def logs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Archives, state and configurations read out of the event log: a user is a repository.

    Views date archives, clicks what is stored; who purchases more often than signing up is enabled
    now, who signs up more often than erring was before.
    """
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("repo"), "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    n = e.groupBy("repo").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("purchase", "signup", "error")])
    return {
        "sources": of("view").groupBy("repo").agg(F.max("at").alias("mtime")),
        "state": of("click").groupBy("repo").agg(F.max("at").alias("source_mtime")),
        "config": n.where("purchase > signup").select("repo"),
        "old": n.where("signup > error").select("repo"),
        "jobs": e.select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("done").alias("status")),
    }


def over_logs(f):
    return lambda spark, d: f(logs(spark, d))


def formatted(spark: SparkSession, d: str) -> DataFrame:
    """Figures of each package as people read them."""
    p = stored_index(spark, d).packages
    n = F.col("files_count")
    return p.select("repo", "pkg", text.humanized_total(n * 4096).alias("size"), text.humanized_progress(n * 4096).alias("progress_size"), text.utc(n * 86_400).alias("time"), text.bar(n % 100, F.lit(100)).alias("bar"), text.repo_of_file(F.concat(F.col("pkg"), F.lit(".files"))).alias("name"))


QUERIES = {
    "search_basename": searching("small-ring"),
    "search_basename_verbose": searching("small-ring", verbose=True),
    "search_basename_quiet": searching("small-ring", quiet=True),
    "search_basename_bins_verbose": searching("small-ring", verbose=True, binaries=True),
    "search_basename_dirs": searching("bin", directories=True),
    "search_path": searching("/usr/bin/small-ring"),
    "search_path_dir": searching("/usr/bin/", directories=True),
    "search_ci": searching("SMALL-ring", ignore_case=True),
    "search_ci_path": searching("/USR/BIN/small-ring", ignore_case=True, verbose=True),
    "search_glob": searching("/usr/lib/*/*.1*", match=Match.GLOB),
    "search_glob_verbose": searching("/usr/s?in/[a-m]*-[!x]*.[[:digit:]]*", match=Match.GLOB, verbose=True),
    "search_glob_ci": searching("/USR/bin/SMALL*", match=Match.GLOB, ignore_case=True, verbose=True),
    "search_regex": searching(r"bin/(small|large)-\w+\.\d{2}$", match=Match.REGEX, verbose=True),
    "search_regex_ci": searching("SMALL-[a-r]+$", match=Match.REGEX, ignore_case=True),
    "search_regex_bins": searching("ring", match=Match.REGEX, binaries=True, verbose=True),
    "search_repo": searching("small-ring", repo="ASIA", verbose=True),
    "list_exact": listed("Supplier#000000003"),
    "list_repo": listed("MIDDLE EAST/Supplier#000000003"),
    "list_ci": listed("SUPPLIER#000000003", ignore_case=True),
    "list_glob": listed("Supplier#00000000[1-4]", match=Match.GLOB),
    "list_regex": listed("#0+[12]$", match=Match.REGEX),
    "list_quiet": listed("Supplier#000000003", quiet=True),
    "list_bins": listed("Supplier#00000000*", match=Match.GLOB, binaries=True),
    "rendered_search": lambda spark, d: render.lines(searching("small-ring", verbose=True)(spark, d)),
    "rendered_list": lambda spark, d: render.lines(listed("Supplier#00000000*", match=Match.GLOB)(spark, d)),
    "inspect_summary": inspected(inspection.summary),
    "inspect_packages": inspected(inspection.package_table),
    "inspect_files": inspected(inspection.package_files, "AMERICA", "Supplier#000000005"),
    "inspect_basenames": inspected(inspection.basenames),
    "inspect_postings": inspected(inspection.postings, "small-ring"),
    "inspect_path_trie": inspected(inspection.path_trie),
    "inspect_strings": inspected(inspection.strings),
    "formatted_packages": formatted,
    "manifest": lambda spark, d: stored_index(spark, d).manifest.select(COLUMNS),
    "archives_parsed": lambda spark, d: archives.from_contents(archives.packed(stored_index(spark, d).manifest)).drop("pkg_ord"),
    "archives_listed": lambda spark, d: archives.from_contents(archives.packed(stored_index(spark, d).manifest)).groupBy("repo").agg(F.count_distinct("pkg", "version").alias("packages")),
    "sync_enabled": over_logs(lambda t: upkeep.enabled(t["sources"], t["config"])),
    "sync_stale": over_logs(lambda t: upkeep.stale(t["sources"], t["state"])),
    "sync_forced": over_logs(lambda t: upkeep.stale(t["sources"], t["state"], force=True)),
    "tidy_unknown": over_logs(lambda t: upkeep.unknown(t["state"], t["config"])),
    "config_added": over_logs(lambda t: upkeep.added(t["old"], t["config"])),
    "config_removed": over_logs(lambda t: upkeep.removed(t["old"], t["config"])),
    "job_outcome": over_logs(lambda t: upkeep.outcome(t["jobs"])),
}

_NAME, _FULL = "concat(repo, '/', pkg)", "concat(repo, '/', pkg, ' ', version)"
_BIN = "NOT is_dir AND (starts_with(path, '/usr/bin/') OR starts_with(path, '/usr/sbin/'))"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _m(body: str) -> str:
    return f"WITH {MANIFEST_SQL} {body}"


def _each(where: str) -> str:
    return _m(f"SELECT repo, {_FULL} AS prefix, path AS entry FROM manifest WHERE {where}")


def _packages(where: str, name: str = _NAME) -> str:
    return _m(f"SELECT repo, {name} AS prefix, '' AS entry FROM (SELECT DISTINCT repo, pkg_ord, pkg, version FROM manifest WHERE {where})")


def _list(where: str) -> str:
    return _m(f"SELECT {_NAME} AS prefix, path AS entry FROM manifest WHERE {where}")


_NODES = """, parts AS (SELECT DISTINCT repo, string_split(regexp_replace(regexp_replace(path, '/$', ''), '^/', ''), '/') AS p FROM manifest),
nodes AS (SELECT DISTINCT repo, concat('/', array_to_string(p[1:i], '/')) AS path FROM (SELECT repo, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
packages AS (SELECT repo, pkg_ord, pkg, version, COUNT(*) AS files_count FROM manifest GROUP BY ALL),
names AS (SELECT repo, basename, COUNT(*) AS postings FROM manifest GROUP BY ALL),
strings AS (SELECT repo, regexp_replace(path, '^.*/', '') AS string FROM nodes UNION SELECT repo, repo FROM packages UNION SELECT repo, pkg FROM packages UNION SELECT repo, version FROM packages)"""
_LOGS = """WITH e AS (SELECT concat('u', user_id) AS repo, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS seen FROM events),
sources AS (SELECT repo, MAX(seen) AS mtime FROM e WHERE event_type = 'view' GROUP BY repo), state AS (SELECT repo, MAX(seen) AS source_mtime FROM e WHERE event_type = 'click' GROUP BY repo),
n AS (SELECT repo, COUNT(*) FILTER (event_type = 'purchase') AS p, COUNT(*) FILTER (event_type = 'signup') AS s, COUNT(*) FILTER (event_type = 'error') AS x FROM e GROUP BY repo),
config AS (SELECT repo FROM n WHERE p > s), old AS (SELECT repo FROM n WHERE s > x) """
_WIDE = "concat(prefix, repeat(' ', MAX(strlen(prefix)) OVER () - strlen(prefix)), chr(9), entry) AS line"
_SIZE = "printf('%.1f {1}', n / {0}.0)"

ORACLE_SQL = {
    "search_basename": _packages("basename = 'small-ring' AND NOT is_dir"),
    "search_basename_verbose": _each("basename = 'small-ring' AND NOT is_dir"),
    "search_basename_quiet": _packages("basename = 'small-ring' AND NOT is_dir", "pkg"),
    "search_basename_bins_verbose": _each(f"basename = 'small-ring' AND {_BIN}"),
    "search_basename_dirs": _packages("basename = 'bin'"),
    "search_path": _m(f"SELECT repo, {_NAME} AS prefix, '' AS entry FROM manifest WHERE path = '/usr/bin/small-ring'"),
    "search_path_dir": _m(f"SELECT repo, {_NAME} AS prefix, '' AS entry FROM manifest WHERE path = '/usr/bin/'"),
    "search_ci": _packages("basename_ci = 'small-ring' AND NOT is_dir"),
    "search_ci_path": _each(f"{_FOLD.format('path')} = '/usr/bin/small-ring' AND NOT is_dir"),
    "search_glob": _packages("regexp_full_match(path, '/usr/lib/[^/]*/[^/]*[.]1[^/]*') AND NOT is_dir"),
    "search_glob_verbose": _each("regexp_full_match(path, '/usr/s[^/]in/[a-m][^/]*-[^x/][^/]*[.][0-9][^/]*') AND NOT is_dir"),
    "search_glob_ci": _each(f"regexp_full_match({_FOLD.format('path')}, '/usr/bin/small[^/]*') AND NOT is_dir"),
    "search_regex": _each(r"regexp_matches(path, 'bin/(small|large)-\w+\.\d{2}$') AND NOT is_dir"),
    "search_regex_ci": _packages(f"regexp_matches({_FOLD.format('path')}, 'small-[a-r]+$') AND NOT is_dir"),
    "search_regex_bins": _each(f"contains(path, 'ring') AND {_BIN}"),
    "search_repo": _each("basename = 'small-ring' AND NOT is_dir AND repo = 'ASIA'"),
    "list_exact": _list("pkg = 'Supplier#000000003'"),
    "list_repo": _list("pkg = 'Supplier#000000003' AND repo = 'MIDDLE EAST'"),
    "list_ci": _list("pkg = 'Supplier#000000003'"),
    "list_glob": _list("regexp_full_match(pkg, 'Supplier#00000000[1-4]')"),
    "list_regex": _list("regexp_matches(pkg, '#0+[12]$')"),
    "list_quiet": _m("SELECT path AS prefix, '' AS entry FROM manifest WHERE pkg = 'Supplier#000000003'"),
    "list_bins": _list(f"starts_with(pkg, 'Supplier#00000000') AND {_BIN}"),
    "rendered_search": _m(f"SELECT *, {_WIDE} FROM (SELECT repo, {_FULL} AS prefix, path AS entry FROM manifest WHERE basename = 'small-ring' AND NOT is_dir)"),
    "rendered_list": _m(f"SELECT *, {_WIDE} FROM (SELECT {_NAME} AS prefix, path AS entry FROM manifest WHERE starts_with(pkg, 'Supplier#00000000'))"),
    "inspect_summary": _m(f"""{_NODES}, p AS (SELECT repo, COUNT(*) AS packages, SUM(files_count)::BIGINT AS files FROM packages GROUP BY repo),
b AS (SELECT repo, COUNT(*) AS basenames, COUNT(*) FILTER (postings = 1) AS single FROM names GROUP BY repo), n AS (SELECT repo, COUNT(*) AS paths FROM nodes GROUP BY repo), s AS (SELECT repo, COUNT(*) AS strings, SUM(strlen(string))::BIGINT AS string_bytes FROM strings GROUP BY repo)
SELECT repo, packages, files, basenames, single, paths, strings, string_bytes,
  round(files / paths, 2) AS files_per_path, round(100.0::DOUBLE * single / basenames, 1) AS single_percent FROM p JOIN b USING (repo) JOIN n USING (repo) JOIN s USING (repo)"""),
    "inspect_packages": _m(f"{_NODES} SELECT repo, pkg, version, files_count FROM packages"),
    "inspect_files": _m("SELECT file_ord, CASE WHEN is_dir THEN 'd' ELSE 'f' END AS flag, path FROM manifest WHERE repo = 'AMERICA' AND pkg = 'Supplier#000000005'"),
    "inspect_basenames": _m(f"{_NODES} SELECT repo, basename, postings, postings = 1 AS single FROM names"),
    "inspect_postings": _m("SELECT repo, CASE WHEN is_dir THEN 'd' ELSE 'f' END AS flag, pkg, path FROM manifest WHERE basename = 'small-ring'"),
    "inspect_path_trie": _m(f"""{_NODES}, t AS (SELECT repo, path, CAST(ROW_NUMBER() OVER (PARTITION BY repo ORDER BY encode(path)) - 1 AS INTEGER) AS id, regexp_replace(path, '/[^/]*$', '') AS up FROM nodes)
SELECT t.repo, t.id, q.id AS parent, regexp_replace(t.path, '^.*/', '') AS name, t.path AS resolved FROM t LEFT JOIN t q ON q.repo = t.repo AND q.path = t.up"""),
    "inspect_strings": _m(f"{_NODES} SELECT repo, string FROM strings"),
    "formatted_packages": _m(f"""{_NODES}, f AS (SELECT repo, pkg, files_count * 4096 AS n, files_count AS c FROM packages), g AS (SELECT *, CAST(floor(20 * (c % 100) / 100.0) AS INTEGER) AS w FROM f)
SELECT repo, pkg, CASE WHEN n <= 2048 THEN {_SIZE.format(1, 'B')} WHEN n / 1024.0 <= 2048 THEN {_SIZE.format(1024, 'KiB')} ELSE {_SIZE.format(1048576, 'MiB')} END AS size,
  CASE WHEN n < 1024 THEN printf('%.0f B', n / 1.0) WHEN n < 1048576 THEN {_SIZE.format(1024, 'KiB')} ELSE {_SIZE.format(1048576, 'MiB')} END AS progress_size,
  strftime(epoch_ms(c * 86400000), '%Y-%m-%d %H:%M:%S UTC') AS time, rpad(CASE WHEN w > 0 THEN concat(repeat('=', w), '>') ELSE '' END, 20, ' ') AS bar, pkg AS name FROM g"""),
    "manifest": _m("SELECT * FROM manifest"),
    "archives_parsed": _m("SELECT repo, pkg, version, file_ord, path, is_dir, basename, basename_ci FROM manifest"),
    "archives_listed": _m("SELECT repo, COUNT(DISTINCT pkg_ord)::BIGINT AS packages FROM manifest GROUP BY repo"),
    "sync_enabled": _LOGS + "SELECT * FROM sources WHERE repo IN (SELECT repo FROM config)",
    "sync_stale": _LOGS + "SELECT repo, mtime FROM sources LEFT JOIN state USING (repo) WHERE source_mtime IS NULL OR source_mtime < mtime",
    "sync_forced": _LOGS + "SELECT * FROM sources",
    "tidy_unknown": _LOGS + "SELECT * FROM state WHERE repo NOT IN (SELECT repo FROM config)",
    "config_added": _LOGS + "SELECT repo FROM config EXCEPT SELECT repo FROM old",
    "config_removed": _LOGS + "SELECT repo FROM old EXCEPT SELECT repo FROM config",
    "job_outcome": "SELECT COUNT(*) AS jobs, COUNT(*) FILTER (event_type = 'view') AS running, COUNT(*) FILTER (event_type = 'error') AS failed FROM events",
}
