"""Literals that whatever matches a pattern must hold."""

from __future__ import annotations

from collections.abc import Iterable

#: A choice of sets of literals: a match holds all of at least one set. A set may be empty: then nothing is known.
Needed = tuple[frozenset[str], ...]

ANYTHING: Needed = (frozenset(),)
#: Sets in a choice, beyond which it counts for nothing.
CHOICES = 16


def both(a: Needed, b: Needed) -> Needed:
    """What a match of a and of b must hold."""
    if len(a) * len(b) > CHOICES:
        return min(a, b, key=len)
    return tuple(dict.fromkeys(x | y for x in a for y in b))


def either(choices: Iterable[Needed]) -> Needed:
    """What a match of any one must hold."""
    out = tuple(dict.fromkeys(s for c in choices for s in c))
    return ANYTHING if len(out) > CHOICES or frozenset() in out else out


def of_text(text: str) -> Needed:
    return (frozenset([text]),) if len(text) > 2 else ANYTHING
