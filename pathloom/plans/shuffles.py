"""Shuffle files of what the library writes: gone with each query, not when the driver next collects its garbage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = Lock()
#: How many hold the setting in a session, and what it was before the first.
_held: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin meanwhile drop their shuffle files as they end.

    An index goes through several shuffles of all its rows, which would all lie on disk at once. Another query of the
    session that begins meanwhile and is asked for its rows twice shuffles twice.
    """
    with _lock:
        n, before = _held.get(spark, (0, None))
        if n == 0:
            before = spark.conf.get(FREED, None)
            spark.conf.set(FREED, "true")
        _held[spark] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _held.pop(spark)
            if n > 1:
                _held[spark] = n - 1, before
            elif before is None:
                spark.conf.unset(FREED)
            else:
                spark.conf.set(FREED, before)
