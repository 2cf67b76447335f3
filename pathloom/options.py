"""What a search asks for."""

from __future__ import annotations

import enum
import os
from dataclasses import dataclass, field


class Match(enum.Enum):
    EXACT = "exact"
    GLOB = "glob"
    REGEX = "regex"


@dataclass(frozen=True)
class Options:
    """How targets match and what is shown. bins are literal path prefixes of executables."""

    match: Match = Match.EXACT
    ignore_case: bool = False
    directories: bool = False
    binaries: bool = False
    bins: tuple[str, ...] = ("/bin/", "/usr/bin/")
    repo: str = ""
    verbose: bool = False
    quiet: bool = False
    raw: bool = False
    eol: str = field(default="\n")
    exe_suffix: bool = False
    #: Whether patterns look their trigrams up; None: where the index is large.
    prune: bool | None = None


def path_bins(path_variable: str | None) -> tuple[str, ...]:
    """Sorted prefixes from a PATH variable: absolute, not under /home, links resolved, ending in a slash."""
    found = set()
    for part in (path_variable or "").split(":"):
        if part.startswith("/") and not part.startswith("/home"):
            try:
                found.add(os.path.realpath(part).rstrip("/") + "/")
            except OSError:
                continue
    return tuple(sorted(found))


def list_target(target: str, repo: str = "") -> tuple[str, str]:
    """(repo, name) of a listing's target; `repo/name` wins over repo, a leading slash is no repo."""
    head, slash, tail = target.partition("/")
    return (head, tail) if slash and head else (repo, target)
