"""Results and states posted to a service by a writing data source.

Registered as ``strandline_posts``; rows have ``reference`` (a path, URL or
transfer's id), ``body`` and perhaps ``post_id`` and ``content_type``.  Every post
carries an idempotency key: the writer's ``name`` and the row's post_id, or a
digest of its reference and body.  A task that is tried again, a batch that is
replayed after a restart, or a post whose answer was lost sends the same key, so
the service counts it once.  What the service can't take now (5xx, a broken
connection) is tried again, ``tries`` times in all; what it won't take (4xx)
fails the task, but for 409, a job that was canceled, which is passed over and
counted.  Commit messages say how many posts each task has made, and the
driver hands their sums on, once a batch, to ``<report>`` if that is given.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .http import Canceled, Client


@dataclass
class Posted(WriterCommitMessage):
    """What a task has posted, and what was canceled before."""

    posts: int
    canceled: int


def post_key(name: str, row: dict) -> str:
    """The same for the same post, whoever sends it; rows without an id are told by what they say."""
    own = row.get("post_id")
    if own is None:
        body = row.get("body")
        said = body.encode() if isinstance(body, str) else bytes(body or b"")
        own = hashlib.sha256(f"{row['reference']}\n".encode() + said).hexdigest()
    return f"{name}:{own}"


class _Posting:
    def __init__(self, options: dict):
        self.url, self.key, self.name = options["url"], options.get("key"), options.get("name", "strandline")
        self.tries, self.pause = max(1, int(options.get("tries", 5))), float(options.get("pauseseconds", 0.5))
        self.report = options.get("report")

    def write(self, rows: Iterator) -> Posted:
        client, done = Client(self.url, self.key), Posted(0, 0)
        for row in rows:
            try:
                self._sent(client, row.asDict())
                done.posts += 1
            except Canceled:
                done.canceled += 1
        return done

    def _sent(self, client: Client, row: dict) -> None:
        body = row.get("body")
        body = body.encode() if isinstance(body, str) else bytes(body or b"")
        for left in range(self.tries - 1, -1, -1):
            try:
                client.call("POST", row["reference"], body, row.get("content_type") or "application/json", {"Idempotency-Key": post_key(self.name, row)})
                return
            except (urllib.error.URLError, ConnectionError, TimeoutError) as error:
                refused = isinstance(error, urllib.error.HTTPError) and error.code < 500
                if refused or not left:
                    raise
                time.sleep(self.pause)

    def _told(self, messages: list, batch: int | None, ended: str) -> None:
        if self.report:
            sums = {c: sum(getattr(m, c) for m in messages if m is not None) for c in ("posts", "canceled")}
            said = json.dumps({"batch": batch, "state": ended, **sums})
            self._sent(Client(self.url, self.key), {"reference": self.report, "body": said, "post_id": f"batch {batch} {ended}"})


class StreamPosting(_Posting, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._told(messages, batchId, "committed")

    def abort(self, messages: list, batchId: int) -> None:
        self._told(messages, batchId, "aborted")


class BatchPosting(_Posting, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._told(messages, None, "committed")

    def abort(self, messages: list) -> None:
        self._told(messages, None, "aborted")


class Posts(DataSource):
    """Options: url, key, name, tries, pauseSeconds, report."""

    @classmethod
    def name(cls) -> str:
        return "strandline_posts"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def streamWriter(self, schema, overwrite: bool) -> StreamPosting:
        return StreamPosting(self._options())

    def writer(self, schema, overwrite: bool) -> BatchPosting:
        return BatchPosting(self._options())
