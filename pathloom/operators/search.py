"""Which packages own a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals, perl, predicates
from ..functions.patterns import as_bytes_view, compiled, fold, glob_literals, perl_to_java
from ..options import Match, Options
from ..plans import trigrams
from ..plans.catalog import FileIndex

#: Rows of a manifest from which looking trigrams up is cheaper than reading every path.
LARGE = 20_000_000


def checked(index: FileIndex, query: str, options: Options) -> None:
    """Raise PatternError before anything runs if the query doesn't compile."""
    if options.match is Match.REGEX:
        compiled(index.manifest.sparkSession, perl_to_java(as_bytes_view(query), options.ignore_case))


def shown(options: Options, repo: str = "repo", pkg: str = "pkg", version: str = "version") -> Column:
    """How a search names a package; verbose wins over quiet."""
    if options.verbose:
        return F.format_string("%s/%s %s", repo, pkg, version)
    return F.col(pkg) if options.quiet else F.concat_ws("/", repo, pkg)


def matching(query: str, options: Options) -> Column:
    if options.match is Match.GLOB:
        return predicates.glob(query, options.ignore_case)
    if options.match is Match.REGEX:
        return predicates.regex(query, options.ignore_case)
    if options.binaries and options.exe_suffix and not query.lower().endswith(".exe"):
        query += ".exe"
    return predicates.exact(query, options.ignore_case, options.directories)


def needed(query: str, options: Options) -> literals.Needed:
    """Literals that a path found by a glob or regular expression holds."""
    if options.match is Match.GLOB:
        return tuple(frozenset(map(fold, choice)) for choice in glob_literals(as_bytes_view(query)))
    return perl.needed(as_bytes_view(query)) if options.match is Match.REGEX else literals.ANYTHING


def pruned(index: FileIndex, query: str, options: Options) -> DataFrame:
    """The manifest, or of a large one the blocks that can hold a match of a glob or regular expression."""
    use = options.prune if options.prune is not None else (index.files or 0) >= LARGE
    if not use or options.match is Match.EXACT or index.grams is None:
        return index.manifest
    condition = trigrams.narrowed(index.grams, needed(query, options))
    return index.manifest if condition is None else index.manifest.where(condition)


def one_a_package(query: str, options: Options) -> bool:
    """Only exact whole paths, and what is verbose, keep a row an occurrence."""
    return not options.verbose and (options.match is not Match.EXACT or options.ignore_case or "/" not in query)


def search(index: FileIndex, query: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """repo, prefix, entry in no order; see `ordered`."""
    checked(index, query, options)
    rows = pruned(index.within(options.repo) if options.repo else index, query, options)
    if not options.directories:
        rows = rows.where(~F.col("is_dir"))
    if options.binaries:
        rows = rows.where(predicates.in_bins(options.bins))
    rows = rows.where(matching(query, options))
    if one_a_package(query, options):
        # name and version follow from the package's number; as part of the key they are hashed, not sorted
        rows = rows.select("repo", "pkg_ord", "pkg", "version").distinct()
    entry = F.col("path") if options.verbose else F.lit("")
    return rows.select("repo", shown(options).alias("prefix"), entry.alias("entry"))


def ordered(found: DataFrame) -> DataFrame:
    """A search's rows as they are printed: by repository, then name and path, byte-wise."""
    return found.orderBy("repo", "prefix", "entry")
