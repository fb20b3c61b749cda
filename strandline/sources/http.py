"""A job service over HTTP as a source, and its status and result calls as a sink.

The protocol: ``POST /api/jobs/claim`` (types, max_wait_seconds) gives a job or
204; ``POST /api/jobs/<id>/payload`` and ``/result`` give a transfer channel;
``POST /api/jobs/<id>/status`` takes a state; 409 means that the job was
canceled.  Registered as data source ``strandline_jobs``, it is read as a
stream; claims happen on the driver, so a job is claimed once.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.client import HTTPException

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


#: States that end a job.
ENDED = ("completed", "failed", "canceled")


class Canceled(RuntimeError):
    """The service says that the job was canceled."""


class Client:
    def __init__(self, base_url: str, key: str | None = None, timeout: float = 60.0):
        self.base, self.key, self.timeout = base_url.rstrip("/"), key, timeout

    def url(self, reference: str) -> str:
        if reference.startswith(("http://", "https://")):
            return reference
        return f"{self.base}{reference}" if "/" in reference else f"{self.base}/api/transfer/{reference}"

    def call(self, method: str, reference: str, body: bytes | None = None, content_type: str = "application/json", headers: dict | None = None) -> bytes | None:
        """The answer's content, None if there is none."""
        request = urllib.request.Request(self.url(reference), data=body, method=method, headers=headers or {})
        request.add_header("Content-Type", content_type)
        if self.key:
            request.add_header("Authorization", f"Bearer {self.key}")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return None if answer.status == 204 else answer.read()
        except urllib.error.HTTPError as error:
            if error.code == 409:
                raise Canceled(reference) from error
            raise

    def post(self, reference: str, body: dict) -> dict | None:
        found = self.call("POST", reference, json.dumps(body).encode())
        return json.loads(found) if found else None

    def create(self, kind: str, metadata: dict | None = None) -> dict | None:
        return self.post("/api/jobs", {"type": kind, "metadata": metadata or {}})

    def get(self, job_id: str) -> dict | None:
        found = self.call("GET", f"/api/jobs/{job_id}")
        return json.loads(found) if found else None

    def ended(self, job_id: str) -> bool:
        """Whether the service knows the job in a state that ends it."""
        try:
            return ((self.get(job_id) or {}).get("state") or "") in ENDED
        except urllib.error.HTTPError:
            return False

    def cancel(self, job_id: str) -> None:
        self.post(f"/api/jobs/{job_id}/cancel", {})

    def channel(self) -> dict | None:
        """A new transfer channel: channel_id, expires_at."""
        return self.post("/api/transfer", {})

    def claim(self, types: list[str] | None = None, max_wait: float | None = None) -> dict | None:
        asked = {k: v for k, v in (("types", types), ("max_wait_seconds", max_wait)) if v is not None}
        return self.post("/api/jobs/claim", asked)

    def payload(self, job_id: str) -> bytes:
        channel = self.post(f"/api/jobs/{job_id}/payload", {}) or {}
        return self.call("GET", channel.get("reader_url") or channel["url"]) or b""

    def status(self, job_id: str, state: str, payload: dict | None = None) -> None:
        self.post(f"/api/jobs/{job_id}/status", {"state": state, **(payload or {})})

    def result(self, job_id: str, content: bytes, content_type: str) -> None:
        channel = self.post(f"/api/jobs/{job_id}/result", {}) or {}
        self.call("POST", channel.get("writer_url") or channel["url"], content, content_type)


class JobsReader(SimpleDataSourceStreamReader):
    """Claims jobs. Those of a batch are in its end offset, which Spark writes before they count, so a restart finds them."""

    def __init__(self, options: dict):
        self.client = Client(options["url"], options.get("key"))
        self.types = [t for t in options.get("types", "").split(",") if t] or None
        self.most, self.wait = int(options.get("maxjobspertrigger", 100)), float(options.get("maxwaitseconds", 30))

    def initialOffset(self) -> dict:
        return {"claimed": 0, "jobs": []}

    def read(self, start: dict):
        rows: list[tuple] = []
        # The service holds the first call until there is a job; the others take what there is.
        while len(rows) < self.most:
            try:
                job = self.client.claim(self.types, 0 if rows else self.wait)
            except (OSError, HTTPException, ValueError):
                if not rows:
                    raise
                break  # what is claimed must come into the offset; the next read meets the failure, if it lasts
            if not job:
                break
            rows.append((str(job.get("job_id") or job.get("id")), job.get("type"), json.dumps(job.get("metadata") or {})))
        return iter(rows), {"claimed": start["claimed"] + len(rows), "jobs": [list(row) for row in rows]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([tuple(row) for row in end["jobs"]])


class Jobs(DataSource):
    """Options: url, key, types (with commas), maxJobsPerTrigger, maxWaitSeconds."""

    @classmethod
    def name(cls) -> str:
        return "strandline_jobs"

    def schema(self) -> str:
        return "job_id string, type string, metadata string"

    def simpleStreamReader(self, schema) -> JobsReader:
        return JobsReader({k.lower(): v for k, v in self.options.items()})


def handled(client: Client, handler, content_type: str = "application/json", on_state=None):
    """A foreachBatch function that runs ``handler(job, payload) -> bytes`` for each job on the executors and reports its states.

    A job is claimed, waits for its payload, runs, waits for its result's
    channel and is completed; ``on_state(job_id, state)`` hears of each.  A
    failing job is reported as failed and stops nothing; a canceled one is left.
    A job that has ended already, as one whose task is tried again, is left too.
    """

    def one(row) -> None:
        def reached(state: str, post: bool = True, **more) -> None:
            if post:
                client.status(row.job_id, state, more or None)
            if on_state is not None:
                on_state(row.job_id, state)

        try:
            if client.ended(row.job_id):
                return
            reached("claimed")
            reached("awaiting_payload", post=False)
            payload = client.payload(row.job_id)
            reached("running")
            found = handler(row.asDict(), payload)
            reached("awaiting_result", post=False)
            client.result(row.job_id, found, content_type)
            reached("completed")
        except Canceled:
            return
        except Exception as error:
            code = "http_error" if isinstance(error, urllib.error.URLError) else "handler_error"
            try:
                reached("failed", error={"code": code, "message": str(error) or type(error).__name__})
            except (Canceled, urllib.error.URLError, ConnectionError, TimeoutError):
                return  # the service can't be told; its claim runs out

    def each(frame, _batch: int) -> None:
        frame.foreach(one)

    return each


DOWNLOADED = "reference string, content binary, error string"


def downloaded(references: DataFrame, client: Client, column: str = "reference") -> DataFrame:
    """DOWNLOADED: what each reference (a URL, a path or a transfer's id) holds; one that fails has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reference in batch.column(0).to_pylist():  # a row at a time: contents can be large
                try:
                    row = (reference, client.call("GET", reference) or b"", None)
                except Exception as error:  # one transfer's failure is its own
                    row = (reference, None, str(error) or type(error).__name__)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.string()), strict=True)], names=["reference", "content", "error"])

    return references.select(F.col(column).cast("string").alias("reference")).mapInArrow(run, DOWNLOADED)


def uploaded(client: Client, content_type: str = "application/octet-stream"):
    """A foreachBatch function that posts ``content`` to ``reference``, or to a new channel where that is null, a row at a time on the executors."""

    def one(row) -> None:
        reference = row.reference or (client.channel() or {})["channel_id"]
        client.call("POST", reference, bytes(row.content or b""), content_type)

    def each(frame, _batch: int) -> None:
        frame.select("reference", "content").foreach(one)

    return each
