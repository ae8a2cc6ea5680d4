"""Remote sources behind a transport: result pages of a search, and the chain of full-text sources.

A transport is a function (url, params) -> (status, headers, body) that raises OSError where nothing answers. There is
none for the network in here; tests and offline runs give their own. Paging is a Python data source, read by one
task: the service allows a few requests a second, whoever asks.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader

Transport = Callable[[str, dict], tuple[int, dict, bytes]]
MOST_IDS, PAGE = 10_000, 500


class RemoteError(Exception):
    pass


@dataclass
class Client:
    """Requests at a bounded rate, tried again on silence, 429 and 5xx; a stated Retry-After is waited for."""

    transport: Transport
    per_second: float = 3.0
    tries: int = 5
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float = float("-inf")

    def get(self, url: str, params: dict) -> bytes:
        reason = ""
        for attempt in range(self.tries):
            wait = self._last + 1 / self.per_second - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                status, headers, body = self.transport(url, params)
            except OSError as e:
                status, headers, reason = 0, {}, str(e)
            else:
                if status < 400:
                    return body
                reason = f"HTTP {status}"
                if status != 429 and status < 500:
                    raise RemoteError(reason)
            try:
                pause = max(0.0, float(headers.get("Retry-After", "")))
            except ValueError:
                pause = 2**attempt * (0.5 + random.random() / 2)
            self.sleep(pause)
        raise RemoteError(f"no answer after {self.tries} tries: {reason}")

    def pages(self, url: str, query: str, most: int = 1000, page: int = PAGE) -> Iterator[tuple[int, list[str]]]:
        """(total, ids) of each page until the ids asked for, the total or an empty page is reached."""
        if not query.strip() or most <= 0 or page <= 0:
            raise ValueError("a query and positive sizes are needed")
        most, at, seen = min(most, MOST_IDS), 0, set()
        while len(seen) < most:
            body = self.get(url, {"term": query, "retmode": "json", "retstart": at, "retmax": min(page, most - len(seen)), "usehistory": "y"})
            try:
                result = json.loads(body)["esearchresult"]
            except (ValueError, KeyError, TypeError) as e:
                raise RemoteError("the answer isn't a search result") from e
            if "ERROR" in result:
                raise RemoteError(f"invalid query: {result['ERROR']}")
            ids, total = result.get("idlist", []), int(result.get("count", 0))
            if not ids:
                return
            yield total, ids
            seen.update(ids)
            at += len(ids)
            if at >= total:
                return


class SearchSource(DataSource):
    """``spark.read.format("paged_search").option("query", ...)``: rows (pos, pmid, total_count), ids as pages repeat them.

    The option ``transport`` is ``module:function``; it is looked up where the reader runs.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "pos long, pmid string, total_count long"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        import importlib

        module, _, name = self.options["transport"].partition(":")
        client = Client(getattr(importlib.import_module(module), name), float(self.options.get("persecond", "3")))
        pos = 0
        for total, ids in client.pages(self.options.get("url", ""), self.options["query"], int(self.options.get("most", "1000")), int(self.options.get("page", str(PAGE)))):
            for pmid in ids:
                yield pos, pmid, total
                pos += 1


def full_text(sources: list[tuple[str, Callable[[str], bytes | None]]], key: str, required: bool = False) -> tuple[str, bytes | None]:
    """The first source (name, fetch) that has the paper; else metadata only, or an error if the text is required."""
    for name, fetch in sources:
        try:
            if data := fetch(key):
                return name, data
        except (RemoteError, OSError):
            continue
    if required:
        raise RemoteError(f"no full text of {key}")
    return "metadata", None


def efetch(client: Client, url: str, db: str = "pmc") -> Callable[[str], bytes | None]:
    """A source for ``full_text``: the article's XML from the service, None where it has no body (for records: whatever comes)."""

    def fetch(key: str) -> bytes | None:
        data = client.get(url, {"db": db, "id": key, "retmode": "xml"})
        return data if db != "pmc" or b"<body" in data else None

    return fetch
