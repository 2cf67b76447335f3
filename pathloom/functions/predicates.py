"""Predicates on occurrences, as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import as_bytes_view, ascii_fold, fold, glob_to_regex, literal_prefix, matches_bytes, perl_to_java


def directory(is_dir: str = "is_dir") -> Column:
    return F.col(is_dir)


def in_bins(bins: tuple[str, ...], path: str = "path", is_dir: str = "is_dir") -> Column:
    """A file under one of the prefixes, at any depth; always case-sensitive."""
    if not bins:
        return F.lit(False)
    return ~F.col(is_dir) & reduce(or_, [F.col(path).startswith(b) for b in bins])


def glob(pattern: str, ignore_case: bool = False, subject: str = "path") -> Column:
    matches = matches_bytes(F.col(subject), glob_to_regex(as_bytes_view(pattern), ignore_case))
    prefix = literal_prefix(pattern)
    # a literal beginning can be pushed to the scan, which the expression can't
    return F.col(subject).startswith(prefix) & matches if prefix and not ignore_case else matches


def regex(pattern: str, ignore_case: bool = False, subject: str = "path") -> Column:
    return matches_bytes(F.col(subject), perl_to_java(as_bytes_view(pattern), ignore_case))


def exact(query: str, ignore_case: bool = False, directories: bool = False) -> Column:
    """A basename, or with a slash in it a whole path.

    A path that doesn't start with a slash never matches, nor do / and //; one that ends in a
    slash means a directory and needs directories. Ignoring case, the basename has to match as
    well as the whole path.
    """
    if "/" not in query:
        return F.col("basename_ci") == fold(query) if ignore_case else F.col("basename") == query
    if not query.startswith("/") or query.strip("/") == "" and len(query) < 3 or query.endswith("/") and not directories:
        return F.lit(False)
    if not ignore_case:
        return (F.col("basename") == query.removesuffix("/").rpartition("/")[2]) & (F.col("path") == query)
    return (F.col("basename_ci") == fold(query.removesuffix("/").rpartition("/")[2])) & (ascii_fold(F.col("path")) == fold(query))
