"""Results as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded


def lines(found: DataFrame, raw: bool = False) -> DataFrame:
    """found with `line`: the prefix alone where there are no entries, else padded to the widest prefix.

    The width is one number over all rows: it is aggregated apart and joined, so that no window
    gathers the rows in one task.
    """
    facts = found.agg(F.max(F.octet_length("prefix")).alias("_width"), F.coalesce(F.max(F.col("entry") != ""), F.lit(False)).alias("_two"))
    width = F.lit(0) if raw else F.col("_width")
    line = F.when(F.col("_two"), F.concat(padded(F.col("prefix"), width), F.lit("\t"), F.col("entry"))).otherwise(F.col("prefix"))
    # one row: the aggregate has no keys
    return found.join(F.broadcast(facts)).select(*found.columns, line.alias("line"))


def printed(ordered: DataFrame, raw: bool = False, eol: str = "\n") -> Iterator[str]:
    """Lines one by one, in the order the rows have; a partition at a time reaches the driver."""
    names = [c for c in ("repo", "prefix", "entry") if c in ordered.columns]
    for row in lines(ordered.select(names), raw).orderBy(*names).select("line").toLocalIterator():
        yield row[0] + eol


def written(found: DataFrame, folder: str, raw: bool = False, eol: str = "\n") -> None:
    """The lines as text files whose contents, joined in the order of their names, are what `printed` yields.

    Rows are dealt by ranges of their order and written where they lie, so a result of any size
    is ordered and padded alike without passing through the driver.
    """
    names = [c for c in ("repo", "prefix", "entry") if c in found.columns]
    lines(found.select(names), raw).orderBy(*names).select("line").write.option("lineSep", eol).text(folder)
