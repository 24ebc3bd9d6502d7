"""Tracker items as a stream: every trigger reads what was updated since the last one.

An offset is the time of the newest update that was read.  A micro-batch reads
pages, newest first, down to the offset of its predecessor, so its range is fixed
by two times and a failed task, or a query that was stopped, reads the same range
again; Structured Streaming keeps the offsets in its checkpoint.  An item that is
updated again while it is read belongs to the next batch.

Times are compared as the ISO 8601 text in UTC that trackers send, to the second.
Updates younger than `settle_sec` wait for the next trigger: more may come with
the same second.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gleaner.sources.tracker import FORBIDDEN, PAGE_ITEMS, RATE_LIMIT_SLACK_SEC, Fetch, pages

SETTLE_SEC = 2
_ALL = 1 << 62


@dataclass
class Updates(InputPartition):
    """Items updated after `after`, up to `upto`."""

    after: str
    upto: str


def _updated(item: dict) -> str:
    return item.get("updated_at") or ""


def updates(fetch: Fetch, repo: str, after: str, upto: str, pause: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """JSON items updated in a range of times, each once; items without a time come with the first range."""
    seen = set()
    for text in pages(fetch, repo, _ALL, pause):
        item = json.loads(text)
        when = _updated(item)
        if after and when <= after:
            return
        # Pages shift while they are read: an item can show up on two of them.
        if when <= upto and item.get("number") not in seen:
            seen.add(item.get("number"))
            yield text


def newest(fetch: Fetch, repo: str, settled: str, pause: Callable[[float], None] = time.sleep) -> str:
    """Time of the newest update that is not younger than `settled`, empty if there is none."""
    page = 1
    while True:
        reply = fetch(repo, page, PAGE_ITEMS)
        if reply.status == FORBIDDEN and reply.rate_limited:
            pause(max(0, reply.reset_at - int(time.time())) + RATE_LIMIT_SLACK_SEC)
            continue
        if reply.status >= 400 and page == 1:
            raise RuntimeError(f"the tracker answered {reply.status}")
        if reply.status >= 400 or not reply.items:
            return ""
        times = [t for t in (_updated(json.loads(text)) for text in reply.items) if t <= settled]
        if times:
            return max(times)
        page += 1


def tracker_stream(
    fetch: Fetch,
    name: str = "tracker_stream",
    pause: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.time,
    settle_sec: float = SETTLE_SEC,
) -> type[DataSource]:
    """A streaming source with the columns repo and json; register it with spark.dataSource."""

    class Reader(DataSourceStreamReader):
        def __init__(self, repo: str):
            self.repo, self.last = repo, ""

        def initialOffset(self) -> dict:
            return {"updated_at": ""}

        def latestOffset(self) -> dict:
            settled = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(clock() - settle_sec))
            self.last = max(self.last, newest(fetch, self.repo, settled, pause))
            return {"updated_at": self.last}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            # A source that was opened anew must not fall behind the checkpoint.
            self.last = max(self.last, end["updated_at"])
            return [Updates(start["updated_at"], end["updated_at"])]

        def read(self, partition: Updates) -> Iterator[tuple[str, str]]:
            for item in updates(fetch, self.repo, partition.after, partition.upto, pause):
                yield self.repo, item

        def commit(self, end: dict) -> None:
            pass

    class TrackerStream(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "repo string, json string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options["repo"])

    return TrackerStream
