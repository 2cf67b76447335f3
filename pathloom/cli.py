"""The command line: search, list, update, sync and inspect."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.patterns import PatternError
from .operators import inspection, listing, search
from .options import Match, Options, path_bins
from .plans import refresh, render
from .plans.catalog import CannotOpen, FileIndex
from .plans.store import Store
from .sources.config import load_config
from .streaming.changes import CONTROLS, ChangeLog
from .streaming.sync import Sync


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description="Search the file lists of packages.")
    mode = p.add_argument_group("operations")
    for letters, value in ((("-s", "--search"), "search"), (("-l", "--list"), "list")):
        mode.add_argument(*letters, dest="mode", action="store_const", const=value, default="search")
    mode.add_argument("-u", "--update", action="count", default=0, help="twice: whether newer or not")
    mode.add_argument("--watch", metavar="ARCHIVES", help="keep the index in step with a folder of archives")
    mode.add_argument("--oneshot", action="store_true")
    mode.add_argument("--force", action="store_true", help="with --watch, begin by indexing every archive whatever its time")
    mode.add_argument("--control", choices=CONTROLS, help="what the stream that keeps the index in step shall do")
    mode.add_argument("--inspect", choices=("summary", "sources", "total", "packages", "files", "basenames", "postings", "paths", "strings"), help="files takes repo/package, postings a basename as target")
    p.add_argument("-g", "--glob", dest="match", action="store_const", const=Match.GLOB, default=Match.EXACT)
    p.add_argument("-r", "--regex", dest="match", action="store_const", const=Match.REGEX)
    for letter, name in (("-i", "ignorecase"), ("-b", "binaries"), ("-d", "directories"), ("-q", "quiet"), ("-v", "verbose"), ("-w", "raw"), ("-0", "null")):
        p.add_argument(letter, f"--{name}", action="store_true")
    p.add_argument("-z", "--compress", nargs="?", help=argparse.SUPPRESS)
    p.add_argument("-R", "--repo", default="")
    p.add_argument("-o", "--output", metavar="FOLDER", help="write what would be printed as text files, in the order of their names")
    p.add_argument("-C", "--config", default="/etc/pacman.conf")
    p.add_argument("-D", "--cachedir", default="file-index")
    p.add_argument("target", nargs="?")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if something was found or done, 1 if not, 2 (from argparse) for wrong usage."""
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
    if a.control:
        ChangeLog(spark, f"{a.cachedir.rstrip('/')}.changes", "").control(a.control)
        return 0
    if a.update or a.watch:
        try:
            config = load_config(a.config, Store(spark))
        except OSError as error:
            print(f"error: {a.config}: {error.strerror}", file=sys.stderr)
            return 1
        if a.update:
            return refresh.refresh(spark, config, a.cachedir, force=a.update > 1)
        sync = Sync(spark, a.config, a.watch, a.cachedir)
        try:
            sync.start(a.force)
        except refresh.NewerVersion as error:
            print(f"error: {error}", file=sys.stderr)
            return 1
        if not a.oneshot:
            sync.watch(f"{a.cachedir}.checkpoint").awaitTermination()
        return 0
    if not a.target and not a.inspect:
        print("error: no target (see --help)", file=sys.stderr)
        return 1
    try:
        index = FileIndex.open(spark, a.cachedir, check=True)
    except CannotOpen as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if a.inspect:
        if a.inspect in ("files", "postings") and not a.target:
            print(f"error: --inspect {a.inspect} needs a target", file=sys.stderr)
            return 1
        if a.inspect == "files":
            shown = inspection.package_files(index, *a.target.partition("/")[::2])
        elif a.inspect == "postings":
            shown = inspection.postings(index, a.target)
        else:
            shown = {"summary": inspection.summary, "sources": inspection.sources, "total": inspection.total, "packages": inspection.package_table, "basenames": inspection.basenames, "paths": inspection.path_trie, "strings": inspection.strings}[a.inspect](index)
        # basenames by how often they occur, everything else by its columns
        order = [F.desc("postings"), "basename", "repo"] if a.inspect == "basenames" else shown.columns
        for row in shown.orderBy(*order).toLocalIterator():
            print(*row, sep="\t")
        return 0
    options = Options(a.match, a.ignorecase, a.directories, a.binaries, path_bins(os.environ.get("PATH")), a.repo, a.verbose, a.quiet, a.raw, "\0" if a.null else "\n")
    try:
        found = search.search(index, a.target, options) if a.mode == "search" else listing.list_files(index, a.target, options)
    except PatternError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if a.output:
        render.written(found, a.output, options.raw, options.eol)
        return int(spark.read.text(a.output).isEmpty())
    nothing = True
    for line in render.printed(found, options.raw, options.eol):
        nothing = False
        sys.stdout.write(line)
    return int(nothing)


if __name__ == "__main__":
    sys.exit(main())
