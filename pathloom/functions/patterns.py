"""Shell globs and Perl-style patterns as Java regular expressions, and byte-wise comparison."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import literals, perl
from .literals import Needed
from .perl import NEVER, POSIX, PatternError, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """A-Z lower-cased; other letters differ from their capitals, as byte-wise comparison has it."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def bytes_view(c: Column) -> Column:
    """One character a byte, so that `.` and `?` stand for bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def matches_bytes(c: Column, java: str) -> Column:
    """Whether the pattern is found in the bytes of c; plain ASCII needs no other view of them."""
    return F.when(F.octet_length(c) == F.length(c), c.rlike(java)).otherwise(bytes_view(c).rlike(java))


def as_bytes_view(pattern: str) -> str:
    return pattern.encode("utf-8").decode("latin-1")


def _bracket(glob: str, at: int, ignore_case: bool) -> tuple[str, int] | None:
    """The Java form of the bracket expression that opens at `at`, and where it ends; None if it never closes."""
    i, members, negated = at + 1, [], False
    if i < len(glob) and glob[i] in "!^":
        negated, i = True, i + 1
    first = True
    while i < len(glob):
        c = glob[i]
        if c == "]" and not first:
            body = "".join(members)
            if not body:
                return ("[^/]" if negated else NEVER), i + 1
            return f"(?!/)[{'^' * negated}{body}]", i + 1
        first = False
        if c == "[" and glob[i + 1 : i + 2] in (".", "="):
            raise PatternError(f"collating elements aren't supported: {glob}")
        if c == "[" and glob[i + 1 : i + 2] == ":" and (end := glob.find(":]", i + 2)) > 0:
            name = glob[i + 2 : end]
            if name not in POSIX:
                return NEVER, end + 2
            # folding lowers the subject first, so that upper never matches
            members += [POSIX[name]] * (not (ignore_case and name == "upper"))
            i = end + 2
            continue
        if c == "\\" and i + 1 < len(glob):
            i += 1
            c = glob[i]
        i += 1
        if glob[i : i + 1] == "-" and i + 1 < len(glob) and glob[i + 1] != "]":
            i += 1
            high = glob[i]
            if high == "\\" and i + 1 < len(glob):
                i += 1
                high = glob[i]
            i += 1
            if c <= high:
                members.append(f"{quoted(c)}-{quoted(high)}")
            continue
        members.append(quoted(c))
    return None


def glob_to_regex(glob: str, ignore_case: bool = False) -> str:
    """A regular expression for whole paths; wildcards don't cross slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            if glob[i + 1 : i + 3] == "\\/":
                return NEVER
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i + 1 == len(glob):
                return NEVER
            i += 1
            out.append(quoted(glob[i]))
        elif c == "[":
            found = _bracket(glob, i, ignore_case)
            if found is None:
                if glob.endswith("-"):
                    return NEVER
                out.append(quoted(c))
            else:
                out.append(found[0])
                i = found[1] - 1
        else:
            out.append(quoted(c))
        i += 1
    return f"(?{'di' if ignore_case else 'd'})\\A(?:{''.join(out)})\\z"


def glob_literals(glob: str) -> Needed:
    """The literal stretches of a glob, between wildcards and brackets."""
    out, run, i = literals.ANYTHING, "", 0
    while i < len(glob):
        c, ends = glob[i], None
        if c == "[" and (found := _bracket(glob, i, False)):
            ends = found[1]
        elif c in "*?":
            ends = i + 1
        if ends is None:
            i += c == "\\" and i + 1 < len(glob)
            run += glob[i]
            i += 1
        else:
            out, run, i = literals.both(out, literals.of_text(run)), "", ends
    return literals.both(out, literals.of_text(run))


def literal_prefix(glob: str) -> str:
    """What every match of the glob begins with."""
    return re.split(r"[*?\[\\]", glob, maxsplit=1)[0]


def perl_to_java(pattern: str, ignore_case: bool = False) -> str:
    """An unanchored Java pattern that means what the Perl-style one does to bytes."""
    return perl.java(pattern, ignore_case)


def compiled(spark: SparkSession, java: str) -> str:
    """The pattern, once it is known to compile."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError as error:
        raise PatternError(f"failed to compile regex: {java}") from error
    return java
