"""Closed tracker items from a dump, or page by page through a fetch function.

The paged form is a Python data source: the protocol (newest first, a page at a
time, stop at the wanted number, at an empty page or at the tracker's depth
limit, wait and repeat when rate-limited) runs in a task.  How a page is
fetched is up to the caller, so nothing here opens a connection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from gleaner.operators.items import latest_closed, parse_items

# Fixed values.
MAX_ITEMS = 5000  # of a live fetch, unless the option says otherwise
PAGE_ITEMS = 100
PAGE_PAUSE_SEC = 0.5
RATE_LIMIT_SLACK_SEC = 5
TOO_DEEP = 422
FORBIDDEN = 403


@dataclass(frozen=True)
class Page:
    """One reply: status, one JSON text per item, and what a rate limit said."""

    status: int = 200
    items: list[str] = field(default_factory=list)
    rate_limited: bool = False
    reset_at: int = 0


# (repo, page number from 1, page size) -> Page
Fetch = Callable[[str, int, int], Page]


def pages(fetch: Fetch, repo: str, max_items: int, pause: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """JSON items of a repository, at most max_items."""
    page, left = 1, max_items
    while left > 0:
        reply = fetch(repo, page, PAGE_ITEMS)
        if reply.status == FORBIDDEN and reply.rate_limited:
            pause(max(0, reply.reset_at - int(time.time())) + RATE_LIMIT_SLACK_SEC)
            continue
        if reply.status == TOO_DEEP:
            return
        if reply.status >= 400:
            raise RuntimeError(f"the tracker answered {reply.status}")
        if not reply.items:
            return
        yield from reply.items[:left]
        left -= len(reply.items)
        page += 1
        pause(PAGE_PAUSE_SEC)


def tracker_source(fetch: Fetch, name: str = "tracker", pause: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A data source class with the columns repo and json; register it with spark.dataSource."""

    class Reader(DataSourceReader):
        def __init__(self, repo: str, max_items: int):
            self.repo, self.max_items = repo, max_items

        def read(self, partition) -> Iterator[tuple[str, str]]:
            for item in pages(fetch, self.repo, self.max_items, pause):
                yield self.repo, item

    class Tracker(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "repo string, json string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["repo"], int(self.options.get("max_items", MAX_ITEMS)))

    return Tracker


def read_dump(spark: SparkSession, path: str, max_items: int | None = None) -> DataFrame:
    """Closed items of a dump with one JSON object per line: all, or those updated last."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "json")
    return latest_closed(parse_items(raw), max_items)
