"""Archives from mirrors: each repository is one task, which tries its mirrors in turn and resumes what one left undone.

What a mirror sends goes to the landing folder in pieces of bounded size as it comes, so no archive is
held in memory. If a mirror breaks off, the next one is asked for the rest, under the condition that it
has the same archive (its time and length); one that has another sends it whole, from the beginning.
Once all bytes are there the pieces become `<repo>.files`.
"""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
from collections.abc import Iterator
from email.utils import formatdate, parsedate_to_datetime

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "repo string, status string, length long, mtime long, url string"
#: Bytes in a piece.
PIECE = 16 << 20
TIMEOUT = 60.0


def url_of(server: str, repo: str, architecture: str) -> str:
    return f"{server.replace('$arch', architecture).replace('$repo', repo)}/{repo}.files"


class Landing:
    """The pieces of one archive so far, on a local folder or a store that Arrow opens by URI."""

    def __init__(self, folder: str, repo: str):
        self.store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        self.store.create_dir(at, recursive=True)
        self.name, self.pieces, self.length = f"{at}/{repo}.files", 0, 0
        self.stamp: str | None = None  # the archive's time, as its mirror gives it
        self.total: int | None = None

    def _piece(self, n: int) -> str:
        folder, _, file = self.name.rpartition("/")
        return f"{folder}/_{file}.{n}"

    def restart(self, stamp: str | None, total: int | None) -> None:
        for n in range(self.pieces):
            self.store.delete_file(self._piece(n))
        self.pieces, self.length, self.stamp, self.total = 0, 0, stamp, total

    def take(self, answer) -> None:
        """Keep what comes, a piece at a time; what came before an error is kept too."""
        while True:
            data, error = b"", None
            try:
                while len(data) < PIECE and (block := answer.read(min(1 << 16, PIECE - len(data)))):
                    data += block
            except http.client.IncompleteRead as broken:
                data, error = data + broken.partial, broken
            except OSError as broken:
                error = broken
            if data:
                with self.store.open_output_stream(self._piece(self.pieces)) as out:
                    out.write(data)
                self.pieces, self.length = self.pieces + 1, self.length + len(data)
            if error:
                raise error
            if not data:
                return

    @property
    def whole(self) -> bool:
        return self.total is None or self.length == self.total

    def finish(self) -> None:
        temporary = self._piece(-1)
        with self.store.open_output_stream(temporary) as out:
            for n in range(self.pieces):
                with self.store.open_input_stream(self._piece(n)) as piece:
                    while block := piece.read(1 << 20):
                        out.write(block)
        self.store.move(temporary, self.name)
        length = self.length
        self.restart(None, None)
        self.length = length


def seconds(stamp: str | None) -> int | None:
    return int(parsedate_to_datetime(stamp).timestamp()) if stamp else None


def fetch(repo: str, servers: list[str], architecture: str, since: int | None, folder: str, timeout: float = TIMEOUT) -> tuple:
    """status `ok`, `uptodate` or `error`, with the length and time of what has landed."""
    landing = Landing(folder, repo)
    for server in servers:
        url = url_of(server, repo, architecture)
        headers = {} if since is None else {"If-Modified-Since": formatdate(since, usegmt=True)}
        if landing.length and landing.stamp:
            headers = {"Range": f"bytes={landing.length}-", "If-Range": landing.stamp}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                stamp, size = answer.headers.get("Last-Modified"), answer.headers.get("Content-Length")
                mtime, span = seconds(stamp), answer.headers.get("Content-Range", "")
                if since is not None and mtime is not None and mtime <= since:
                    return repo, "uptodate", None, mtime, url
                # the rest of what has come, or another archive from its beginning
                if answer.status != 206 or span != f"bytes {landing.length}-{(landing.total or 0) - 1}/{landing.total}":
                    if answer.status == 206:
                        continue
                    landing.restart(stamp, int(size) if size else None)
                landing.take(answer)
                if landing.whole:
                    landing.finish()
                    return repo, "ok", landing.length, mtime, url
        except urllib.error.HTTPError as error:
            if error.code == 304:
                return repo, "uptodate", None, since, url
        except (OSError, ValueError, http.client.HTTPException):
            continue
    landing.restart(None, None)
    return repo, "error", None, None, None


def fetched(config: DataFrame, state: DataFrame, architecture: str, folder: str, force: bool = False) -> DataFrame:
    """FETCHED for repositories (repo, servers); state: what is stored (repo, source_mtime). Archives land when this is evaluated."""
    since = F.lit(None).cast("long") if force else F.col("source_mtime")
    jobs = config.join(state.select("repo", "source_mtime"), "repo", "left").select("repo", "servers", since.alias("since"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo, servers, s in zip(b["repo"], b["servers"], b["since"], strict=True):
                row = fetch(repo, list(servers), architecture, None if pd.isna(s) else int(s), folder)
                yield pd.DataFrame([row], columns=["repo", "status", "length", "mtime", "url"]).astype({"mtime": "Int64", "length": "Int64"})

    return jobs.repartition("repo").mapInPandas(of, FETCHED)
