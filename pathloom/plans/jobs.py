"""What became of each repository in each run of an update: running, done or failed, kept beside the index."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .store import Store

FOLDER = "jobs"
SCHEMA = "run string, repo string, status string, note string, began long, ended long"
#: Runs kept.
KEPT = 100


class Run:
    """One run's file, replaced as the run goes on; a run whose driver is lost stays `running`."""

    def __init__(self, spark: SparkSession, index_path: str, repos: Iterable[str]):
        self.store, self.folder = Store(spark), f"{index_path.rstrip('/')}/{FOLDER}"
        self.name, self.began = f"{time.time_ns():020}-{uuid.uuid4().hex[:8]}", int(time.time())
        self.repos: dict[str, tuple[str, str | None]] = {repo: ("running", None) for repo in repos}
        self.store.make(self.folder)
        self._write()

    def _write(self) -> None:
        rows = [{"run": self.name, "repo": r, "status": s, "note": note, "began": self.began, "ended": None if s == "running" else int(time.time())} for r, (s, note) in sorted(self.repos.items())]
        self.store.write(f"{self.folder}/{self.name}.json", "\n".join(map(json.dumps, rows)).encode())

    def failed(self, repos: dict[str, str]) -> None:
        """Repositories with what is wrong."""
        self.repos.update({repo: ("failed", note) for repo, note in repos.items()})
        self._write()

    def done(self, repos: Iterable[str]) -> None:
        """Repositories that are current, whatever becomes of the others."""
        self.repos.update({repo: ("done", None) for repo in repos})
        self._write()

    def end(self, error: BaseException | None = None) -> None:
        """Whatever still runs is done, or failed with the whole run."""
        status = ("done", None) if error is None else ("failed", f"{type(error).__name__}: {error}".splitlines()[0])
        self.repos = {r: status if s[0] == "running" else s for r, s in self.repos.items()}
        self._write()
        for old in sorted(e.name for e in self.store.entries(self.folder) if e.name.endswith(".json"))[:-KEPT]:
            self.store.delete(f"{self.folder}/{old}")

    @property
    def bad(self) -> bool:
        return any(s == "failed" for s, _ in self.repos.values())


def jobs(spark: SparkSession, index_path: str) -> DataFrame:
    """SCHEMA: a row for each repository of each run."""
    folder = f"{index_path.rstrip('/')}/{FOLDER}"
    if not Store(spark).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.json").json(folder)
