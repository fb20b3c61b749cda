"""Server-sent events as a stream: a job's events over HTTP, resumed where they ended.

Registered as data source ``strandline_events``.  A read takes what arrives
within a time, or so many events; the events are part of the offset that Spark
writes before they count, so a restart reads the same batch again, and the
connection goes on after the last event's id.

A connection that is cut, or a server that can't answer now (5xx), ends a read
with what has come; ``maxFailures`` such reads in a row without an event fail the
query.  What the server refuses (4xx) fails it at once.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from http.client import HTTPException

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def event_blocks(lines: Iterable[bytes]) -> Iterator[tuple[str | None, str, str]]:
    """(id, event, data) of each block of lines; comments are passed over, and a block that never ends isn't one."""
    last, event, data = None, "", []
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            if data:
                yield last, event or "message", "\n".join(data)
            event, data = "", []
            continue
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "id":
            last = value
        elif name == "event":
            event = value
        elif name == "data":
            data.append(value)


class EventsReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.key = options["url"], options.get("key")
        self.most, self.seconds = int(options.get("maxeventspertrigger", 1000)), float(options.get("maxwaitseconds", 5))
        self.failures, self.most_failures = 0, int(options.get("maxfailures", 10))

    def initialOffset(self) -> dict:
        return {"n": 0, "id": None, "skip": 0, "events": []}

    def read(self, start: dict):
        request = urllib.request.Request(self.url, headers={"Accept": "text/event-stream"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}) | ({"Last-Event-ID": start["id"]} if start["id"] else {}))
        rows, until, last, skip = [], time.monotonic() + self.seconds, start["id"], start["skip"]
        try:
            with urllib.request.urlopen(request, timeout=self.seconds) as answer:
                # Without ids a server begins anew each time: what was read before is passed over.
                for seen, (name, event, data) in enumerate(event_blocks(answer)):
                    if name is None and seen < skip:
                        continue
                    rows.append((start["n"] + len(rows), name, event, data))
                    last = name or last
                    if len(rows) >= self.most or time.monotonic() > until:
                        break
            self.failures = 0
        except TimeoutError:
            self.failures = 0  # nothing more for now
        except (urllib.error.URLError, ConnectionError, HTTPException) as error:
            waited = isinstance(getattr(error, "reason", None), TimeoutError)
            refused = isinstance(error, urllib.error.HTTPError) and error.code < 500
            self.failures = 0 if rows or waited else self.failures + 1
            if refused or self.failures >= self.most_failures:
                raise
        skip = skip + len(rows) if last is None else 0
        return iter(rows), {"n": start["n"] + len(rows), "id": last, "skip": skip, "events": [list(row) for row in rows]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([tuple(row) for row in end["events"]])


class Events(DataSource):
    """Options: url, key, maxEventsPerTrigger, maxWaitSeconds, maxFailures."""

    @classmethod
    def name(cls) -> str:
        return "strandline_events"

    def schema(self) -> str:
        return "seq long, id string, event string, data string"

    def simpleStreamReader(self, schema) -> EventsReader:
        return EventsReader({k.lower(): v for k, v in self.options.items()})
