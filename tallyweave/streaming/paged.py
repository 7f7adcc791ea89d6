"""A source over a paged pull service, for batches and streams, as a Python data source.

The service answers (since, skip or after, top, watermark) with a page of items, by ingest time and id, and its own time. Offsets
of a stream are the service's ingest times, and a micro-batch is what it ingested after one, less a lookback, and up to the next:
the cursor moves only after a batch. A batch read takes bounds on SyncTimestamp into its requests
(spark.sql.python.filterPushdown.enabled), so that the service sends no more than is asked for. Call load() anew for each query
then: Spark keeps the bounds of the last query with what load() has given.

What lies between two bounds is cut into ranges of time, which executors read page by page; the driver asks for the service's
time and for counts alone. A service that counts (count) has its ranges halved until none holds more than its share, so the first
pull of a full log is spread however long the time before it was empty; else ranges are equally long. A service that says where a
page ends (next) is asked for what comes after that time and id, so that rows that come in meanwhile shift no page; else pages
are skipped by number. Without a time of the service's own the cursor moves by this machine's clock.

Options: url (of the service), page (rows in one page), lookback_ms, ranges (of one batch), since (ms). Any callable can stand in for the service in tests.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from ..schemas import WIRE

PAGE, LOOKBACK_MS, RANGES = 1000, 10_000, 16
COLUMNS = WIRE.split(", ")


def post(url: str, body: dict, timeout_s: float = 30) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout_s) as answer:
        return json.loads(answer.read() or b"{}")


def pull(fetch, since_ms: int, page: int = PAGE, lookback_ms: int = LOOKBACK_MS) -> tuple[list[dict], int]:
    """All pages after since_ms less the lookback, and the service's time at the first page, which bounds the later ones."""
    begin, skip, until, items = max(0, since_ms - lookback_ms), 0, None, []
    while True:
        answer = fetch({"since": begin, "skip": skip, "top": page, "watermark": until})
        got = answer.get("items") or []
        if until is None:
            until = int(answer.get("serverTimestamp") or since_ms)
        items += got
        if len(got) < page:
            return items, until if items else since_ms
        skip += page


def row(item: dict) -> tuple:
    def value(name: str):
        v = item.get(name)
        if name == "SyncTimestamp" and v is not None:  # milliseconds or ISO text; watermarks go by it
            return datetime.fromtimestamp(v / 1000, timezone.utc) if isinstance(v, int | float) else datetime.fromisoformat(v.replace("Z", "+00:00"))
        return v if v is None or name == "Timestamp" else str(v)

    return tuple(value(c.split()[0]) for c in COLUMNS)


class PagedReader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.url, self.page, self.lookback = options["url"], int(options.get("page", PAGE)), int(options.get("lookback_ms", LOOKBACK_MS))
        self.since = int(options.get("since", 0))

    def fetch(self, body: dict) -> dict:
        return post(self.url, body)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.since}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, until = pull(self.fetch, start["at"], self.page, self.lookback)
        return iter([row(x) for x in items]), {"at": until}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        def bounded(body: dict) -> dict:
            return self.fetch(body | {"watermark": end["at"]})

        return iter([row(x) for x in pull(bounded, start["at"], self.page, self.lookback)[0]])


class Range(InputPartition):
    """What was ingested after `since` and up to `until`."""

    def __init__(self, since: int, until: int) -> None:
        self.since, self.until = since, until


def milliseconds(at) -> int | None:
    """A time that is a number, ISO text or a datetime, in ms; None if it is none of these."""
    if isinstance(at, str):
        try:
            at = datetime.fromisoformat(at.replace("Z", "+00:00"))
        except ValueError:
            return int(at) if at.isdigit() else None
    if isinstance(at, datetime):
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
    return int(at) if at else None


class _Ranges:
    """What batches and streams have in common: the service, ranges of time, and their pages."""

    def __init__(self, options) -> None:
        self.url, self.page = options["url"], int(options.get("page", PAGE))
        self.ranges, self.since = int(options.get("ranges", RANGES)), int(options.get("since", 0))

    def fetch(self, body: dict) -> dict:
        return post(self.url, body)

    def clock(self) -> int:
        return int(time.time() * 1000)

    def now(self, since: int) -> int:
        """The service's time, else ours."""
        answer = self.fetch({"since": since, "skip": 0, "top": 1, "watermark": None})
        return milliseconds(answer.get("serverTimestamp")) or self.clock()

    def count(self, since: int, until: int) -> int | None:
        return self.fetch({"since": since, "skip": 0, "top": 0, "watermark": until, "count": True}).get("count")

    def cut(self, begin: int, until: int, counted: bool = True) -> list[Range]:
        """Ranges of what was ingested after begin and up to until; none that the service says is empty."""
        if until <= begin:
            return []
        total = self.count(begin, until) if counted else None
        if total is None:
            n = min(self.ranges, until - begin)
            cuts = [begin + (until - begin) * i // n for i in range(n + 1)]
            return [Range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        share, todo, out = -(-total // self.ranges), [(begin, until, total)], []
        while todo:
            a, b, n = todo.pop()
            if n <= share or b - a == 1:
                out += [Range(a, b)] if n else []
            else:
                middle = (a + b) // 2
                left = self.count(a, middle)
                todo += [(middle, b, n - left), (a, middle, left)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        skip, after = 0, None
        while True:
            body = {"since": partition.since, "skip": skip, "top": self.page, "watermark": partition.until}
            answer = self.fetch(body if after is None else body | {"after": after})
            got = answer.get("items") or []
            yield from map(row, got)
            if len(got) < self.page:
                return
            after = answer.get("next")
            skip = 0 if after is not None else skip + self.page


class RangeReader(_Ranges, DataSourceStreamReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.lookback, self.counted = int(options.get("lookback_ms", LOOKBACK_MS)), str(options.get("count", "")).lower() == "true"
        self.last = self.since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.since}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        self.last = max(self.last, self.now(self.last))
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [] if end["at"] <= start["at"] else self.cut(max(0, start["at"] - self.lookback), end["at"], self.counted)


class BatchReader(_Ranges, DataSourceReader):
    """What the service has ingested within the bounds of a query, up to its time now."""

    def __init__(self, options) -> None:
        super().__init__(options)
        self.until, self.counted = None, str(options.get("count", "")).lower() == "true"

    def pushFilters(self, filters):  # noqa: N802
        """Takes bounds on SyncTimestamp; Spark tests all others. Times finer than ms widen the request, and Spark tests these too."""
        for f in filters:
            at = milliseconds(f.value) if getattr(f, "attribute", None) == ("SyncTimestamp",) and isinstance(getattr(f, "value", None), datetime) else None
            if at is not None and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.since = max(self.since, at - (0 if isinstance(f, GreaterThan) else 1))
            if at is not None and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.until = min(at + (f.value.microsecond % 1000 > 0), at + 1 if self.until is None else self.until)
            if at is None or f.value.microsecond % 1000 or isinstance(f, LessThan | EqualTo | GreaterThanOrEqual):
                yield f

    def partitions(self) -> list[Range]:
        now = self.now(self.since)
        return self.cut(max(0, self.since), now if self.until is None else min(now, self.until), self.counted) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return super().read(partition) if partition.until > partition.since else iter(())


class PagedPull(DataSource):
    """spark.dataSource.register(PagedPull); spark.read or spark.readStream, .format("paged_pull").option("url", ...).load()

    count=true: the service counts.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_pull"

    def schema(self) -> str:
        return ", ".join(COLUMNS)

    def streamReader(self, schema) -> RangeReader:  # noqa: N802
        return RangeReader(self.options)

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)
