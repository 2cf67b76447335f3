"""Which files a package holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.patterns import ascii_fold, fold, literal_prefix
from ..options import Match, Options, list_target
from ..plans.catalog import FileIndex
from .search import checked

#: Packages that are looked up ahead and become a condition that reaches the scan; more are joined.
FEW = 500


def packages_named(index: FileIndex, name: str, options: Options) -> DataFrame:
    """repo, pkg_ord of the packages that a name, glob or regular expression means.

    An exact name means the first package of that name in each repository, ignoring case the
    first in the order of names.
    """
    meant = index.packages.where(named(name, options))
    if options.match in (Match.GLOB, Match.REGEX):
        return meant.select("repo", "pkg_ord")
    return meant.groupBy("repo").agg(F.min(F.struct("pkg", "pkg_ord")).alias("first")).select("repo", "first.pkg_ord")


def named(name: str, options: Options) -> Column:
    """Whether column pkg is what a name, glob or regular expression means."""
    if options.match is Match.GLOB:
        return predicates.glob(name, options.ignore_case, "pkg")
    if options.match is Match.REGEX:
        return predicates.regex(name, options.ignore_case, "pkg")
    return ascii_fold(F.col("pkg")) == fold(name) if options.ignore_case else F.col("pkg") == name


def package_rows(index: FileIndex, name: str, options: Options) -> DataFrame:
    """The rows, clustered by package, of the packages that a name means.

    Packages are few against paths, so they are looked up first. Where they are few indeed, their
    names reach the scan, where sorted statistics and Bloom filters leave the row groups that hold
    them; more are joined, behind what a glob begins with.
    """
    rows = index.by_package
    first = index.packages.where(named(name, options)).select("repo", "pkg", "pkg_ord").limit(FEW + 1).collect()
    if len(first) > FEW:
        if options.match is Match.GLOB and not options.ignore_case and (prefix := literal_prefix(name)):
            rows = rows.where(F.col("pkg").startswith(prefix))
        return rows.join(packages_named(index, name, options), ["repo", "pkg_ord"], "left_semi")
    of: dict[str, list[tuple[str, int]]] = {}
    for repo, pkg, number in first:
        of.setdefault(repo, []).append((pkg, number))
    if options.match is Match.EXACT:
        of = {repo: [min(found)] for repo, found in of.items()}
    meant = F.lit(False)
    for repo, found in of.items():
        meant = meant | ((F.col("repo") == repo) & F.col("pkg_ord").isin([number for _, number in found]))
    names = sorted({pkg for found in of.values() for pkg, _ in found})
    return rows.where(F.col("repo").isin(list(of)) & F.col("pkg").isin(names) & meant)


def list_files(index: FileIndex, target: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """prefix, entry of every path; directories and verbose make no difference here."""
    repo, name = list_target(target, options.repo)
    checked(index, name, options)
    rows = package_rows(index.within(repo) if repo else index, name, options)
    if options.binaries:
        rows = rows.where(predicates.in_bins(options.bins))
    if options.quiet:
        return rows.select(F.col("path").alias("prefix"), F.lit("").alias("entry"))
    return rows.select(F.concat_ws("/", "repo", "pkg").alias("prefix"), F.col("path").alias("entry"))


def ordered(found: DataFrame) -> DataFrame:
    """A listing's rows as they are printed: all repositories together."""
    return found.orderBy("prefix", "entry")
