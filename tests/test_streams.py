import json
import os
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pyspark.sql import functions as F

from strandline.operators import chunks, speakers
from strandline.sources import events, http, posting, readers, writers
from strandline.streaming import stateful

from .test_speakers import ROW


def run(stream, name, tmp_path, **trigger):
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(**(trigger or {"availableNow": True})).start()


def test_speakers_stream_equals_batch(spark, tmp_path):
    rows = [(k % 2, k, 1 + k // 6, str(k % 3), k * 3.0, k * 3.0 + 2.0, "words", [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(24)]
    settings = speakers.Settings(seed_seconds=2.0)
    data = spark.createDataFrame(rows, ROW)
    observed = speakers.observations(data, settings).select("recording_id", "seq", "chunk_index", "local_speaker", "seconds", "vector")
    for k in range(3):
        path = tmp_path / f"in/{k}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps(r.asDict()) + "\n" for r in observed.collect() if r.seq // 8 == k))
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    source = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(stateful.speakers(source, settings), "speakers", tmp_path).awaitTermination(120)
    got = {r.seq: r.emitted_speaker for r in spark.table("speakers").collect()}
    assert got == {r.seq: r.emitted_speaker for r in speakers.resolved_speakers(data, settings).collect()} and len(got) == 24


def test_heartbeats_until_the_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda k, rows: (tmp_path / f"in/{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    write(0, [{"job": "a", "state": "running"}, {"job": "b", "state": "completed"}])
    source = spark.readStream.schema("job string, state string").json(str(tmp_path / "in"))
    query = run(stateful.heartbeats(source, "job", "state", 0.5), "beats", tmp_path, processingTime="1 second")
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("beats").count():
            time.sleep(0.5)
        # Other events in between don't put a beat off.
        for k in range(1, 9):
            write(k, [{"job": "a", "state": f"running {k}"}])
            time.sleep(0.4)
        until = time.time() + 30
        while time.time() < until and spark.table("beats").count() < 6:
            time.sleep(0.5)
        beats = spark.table("beats").orderBy("n").collect()
        assert {r.job for r in beats} == {"a"} and [r.n for r in beats] == list(range(1, len(beats) + 1)) and len(beats) >= 6
        assert beats[0].state == "running" and beats[-1].state.startswith("running ")
    finally:
        query.stop()


def test_throttle_stream_keeps_whole_rows(spark, tmp_path):
    import datetime as dt

    big, when = 9_007_199_254_740_993, dt.datetime(2026, 1, 2, 3, 4, 5, 678901)
    data = spark.createDataFrame([(1, 0, 1.0, 0.0, big, when), (1, 1, 1.1, 0.1, None, when), (None, 0, 2.0, 0.0, big + 2, None), (None, 1, 9.0, 0.1, None, when)], "job long, n long, progress double, at double, id long, ts timestamp")
    data.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    run(stateful.throttled(source, "job", "n", "progress", "at", keep_seconds=None), "whole", tmp_path).awaitTermination(120)
    assert sorted((r.job or 0, r.n, r.id, r.ts) for r in spark.table("whole").collect()) == [(0, 0, big + 2, None), (0, 1, None, when), (1, 0, big, when)]


def given(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(folder / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)


def waited(condition, seconds=90):
    until = time.time() + seconds
    while time.time() < until and not condition():
        time.sleep(0.3)
    assert condition()


def test_tombstones_and_last_values_go(spark, tmp_path):
    """Before its time is over an ended job's later events are void; then its state is gone, and it's a new job."""
    schema, folder = "job string, n long, progress double, at double, state string", tmp_path / "in"
    event = lambda job, n, progress, state: {"job": job, "n": n, "progress": progress, "at": 0.0, "state": state}
    given(folder, 0, [event("a", 0, 1.0, "running"), event("a", 1, 9.0, "completed"), event("b", 0, 1.0, "running")])
    source = spark.readStream.schema(schema).json(str(folder))
    query = run(stateful.throttled(source, "job", "n", "progress", "at", "state", keep_seconds=20), "tombs", tmp_path, processingTime="500 milliseconds")
    state = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "state-tombs")).option("stateVarName", name).load()
    try:
        waited(lambda: spark.table("tombs").count() >= 3)
        given(folder, 1, [event("a", 2, 50.0, "running"), event("b", 1, 1.1, "running"), event("c", 0, 1.0, "running")])
        waited(lambda: spark.table("tombs").where("job = 'c'").count() == 1)
        assert sorted((r.job, r.n) for r in spark.table("tombs").collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
        assert {r.key["__key"] for r in state("ended").collect()} == {"ka"} and {r.key["__key"] for r in state("last").collect()} == {"kb", "kc"}
        time.sleep(22)
        given(folder, 2, [event("a", 3, 1.0, "running"), event("d", 0, 1.0, "running")])
        waited(lambda: spark.table("tombs").where("n = 3").count() == 1)
        waited(lambda: state("ended").count() == 0 and {r.key["__key"] for r in state("last").collect()} == {"ka", "kd"})
    finally:
        query.stop()


def chunk(recording, index, last=False):
    start = 2.0 * index
    return {"recording_id": recording, "chunk_index": index, "chunk_start": start, "chunk_end": start + 4.0, "is_last": last, "segments": [{"start": start + 0.5, "end": start + 2.0, "text": f"first of {index}", "speaker": None}, {"start": start + 2.5, "end": start + 4.0, "text": f"second of {index}", "speaker": "SPEAKER_00"}]}


def test_chunks_in_any_order(spark, tmp_path):
    """Over any split and order of arrival, the stream emits what the batch does."""
    rows = [chunk(r, k, k == 6) for r in ("r0", "r1", None) for k in range(1, 7)]
    random.Random(7).shuffle(rows)
    for k in range(4):
        given(tmp_path / "in", k, rows[k::4])
    source = spark.readStream.schema(stateful.CHUNK).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(stateful.emitted(source, 2.0, patience_seconds=None), "shuffled", tmp_path).awaitTermination(180)
    shape = lambda df: sorted((str(r.recording_id), r.chunk_index, r.emit_idx, r.reason, r.seg.text) for r in df.collect())
    batch = chunks.emitted(spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", stateful.CHUNK).alias("c")).select("c.*"), 2.0)
    assert shape(spark.table("shuffled")) == shape(batch.where("reason <> 'finalize-tail'"))


def test_a_missing_chunk_is_not_waited_for_forever(spark, tmp_path):
    given(tmp_path / "in", 0, [chunk("r", 1), chunk("r", 3), chunk("r", 4)])
    source = spark.readStream.schema(stateful.CHUNK).json(str(tmp_path / "in"))
    query = run(stateful.chained(source, patience_seconds=12).select(F.col("c.chunk_index").alias("i"), F.col("b.chunk_index").alias("before")), "patient", tmp_path, processingTime="500 milliseconds")
    seen = lambda: [(r.i, r.before) for r in spark.table("patient").collect()]
    try:
        waited(lambda: len(seen()) >= 1)
        assert seen() == [(1, None)]  # 3 and 4 wait for 2
        waited(lambda: len(seen()) >= 3)
        assert sorted(seen()) == [(1, None), (3, 1), (4, 3)]
        given(tmp_path / "in", 1, [chunk("r", 2), chunk("r", 5)])
        waited(lambda: len(seen()) >= 5)
        assert sorted(seen())[1:] == [(2, None), (3, 1), (4, 3), (5, 4)] or sorted(seen(), key=lambda x: x[0]) == [(1, None), (2, None), (3, 1), (4, 3), (5, 4)]
    finally:
        query.stop()


def test_speakers_go_on_from_a_batch(spark, tmp_path):
    """The first half in a batch, the rest in a stream of several parts: the labels and the profiles of one pass."""
    rng = random.Random(3)
    voices = [[1.0, 0.1, 0.0], [0.0, 1.0, 0.1], [0.1, 0.0, 1.0], [0.9, 0.3, 0.0]]
    rows = [(None if k % 5 == 0 else f"r{k % 2}", k, 1 + k // 8, str(k % 3), k * 3.0, k * 3.0 + rng.choice([1.0, 2.0, 2.5]), "words", [x + rng.gauss(0, 0.05) for x in rng.choice(voices)]) for k in range(60)]
    settings = speakers.Settings(seed_seconds=2.0, merge_seed_seconds=4.0, merge_similarity_threshold=0.8, merge_margin=0.02)
    data = spark.createDataFrame(rows, ROW.replace("recording_id long", "recording_id string"))
    observed = speakers.observations(data, settings).select("recording_id", "seq", "chunk_index", "local_speaker", "seconds", "vector")
    later = sorted((r for r in observed.collect() if r.seq >= 30), key=lambda r: r.seq)
    for k in range(2):
        given(tmp_path / "in", k, [r.asDict() for r in later[15 * k : 15 * k + 15]])
    source = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    memory = speakers.memory(data.where("seq < 30"), settings)
    run(stateful.speakers(source, settings, memory), "continued", tmp_path).awaitTermination(180)
    got = {r.seq: (r.recording_id, r.emitted_speaker) for r in spark.table("continued").collect()}
    whole = speakers.resolved_speakers(data, settings).collect()
    assert got == {r.seq: (r.recording_id, r.emitted_speaker) for r in whole if r.seq >= 30} and len(got) == 30
    shape = lambda df: sorted((str(r.recording_id), r.speaker_id, r.embedding_count, round(r.total_seconds, 6), [round(x, 6) for x in r.centroid or []], len(r.exemplars)) for r in df.collect())
    assert shape(stateful.profiles_of(spark, str(tmp_path / "state-continued"))) == shape(speakers.profiles(data, settings))


class Service(BaseHTTPRequestHandler):
    jobs: list = []
    said: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        part = self.path.split("/")
        if part[-1] == "events":
            after = int(self.headers.get("Last-Event-ID") or 0)
            body = "".join(f"id: {k}\nevent: status\ndata: {{\"k\":\ndata: {k}}}\n\n" for k in range(after + 1, 6)) + ": a comment\n\ndata: never ended"
            return self.answer(body.encode())
        if part[2] == "jobs":
            return self.answer(json.dumps({"job_id": part[3], "state": "completed" if part[3] == "4" else "claimed"}).encode())
        if part[-1] == "gone":
            return self.answer(b"", 404)
        self.answer(b"payload of " + self.path.rsplit("/", 1)[1].encode())

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        part = self.path.split("/")
        if self.path == "/api/jobs/claim":
            types = json.loads(body).get("types")
            job = next((j for j in self.jobs if types is None or j["type"] in types), None)
            if job is None:
                return self.answer(b"", 204)
            self.jobs.remove(job)
            return self.answer(json.dumps(job).encode())
        if part[-1] == "status" and part[-2] == "3":
            return self.answer(b"", 409)
        if part[-1] == "status" and part[-2] == "2" and b"failed" in body:
            return self.answer(b"", 500)
        self.said.append((self.path, body.decode()))
        return self.answer(json.dumps({"url": part[-2], "reader_url": f"/api/transfer/{part[-2]}"}).encode())

    def answer(self, body: bytes, status: int = 200):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def service():
    Service.jobs, Service.said = [{"job_id": str(k), "type": "asr" if k else "other", "metadata": {"k": k}} for k in range(5)], []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def work(job, payload: bytes) -> bytes:
    if job["job_id"] == "2":
        raise ValueError
    return payload.upper()


def test_jobs_over_http(spark, service, tmp_path):
    spark.dataSource.register(http.Jobs)
    jobs = spark.readStream.format("strandline_jobs").option("url", service).option("types", "asr").load()
    query = jobs.writeStream.foreachBatch(http.handled(http.Client(service), work)).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 90
        while time.time() < until and len([p for p, _ in Service.said if p.endswith("status")]) < 5:
            time.sleep(0.3)
    finally:
        query.stop()
    states = [(p.split("/")[3], json.loads(b)) for p, b in Service.said if p.endswith("status")]
    # Job 2 fails and the service doesn't take that; 3 is canceled; 4 has ended before.
    assert [(k, s["state"]) for k, s in sorted(states, key=lambda x: x[0])] == [("1", "claimed"), ("1", "running"), ("1", "completed"), ("2", "claimed"), ("2", "running")]
    assert ("/api/transfer/1", "PAYLOAD OF 1") in Service.said
    assert [j["job_id"] for j in Service.jobs] == ["0"]


def test_a_failing_job_says_so(service):
    heard = []
    row = type("Row", (), {"job_id": "1", "asDict": lambda self: {"job_id": "2"}})()
    frame = type("Frame", (), {"foreach": lambda self, f: f(row)})()
    http.handled(http.Client(service), work, on_state=lambda *x: heard.append(x))(frame, 0)
    assert [s for _, s in heard] == ["claimed", "awaiting_payload", "running", "failed"]
    assert json.loads(Service.said[-1][1])["error"] == {"code": "handler_error", "message": "ValueError"}


def test_claims_are_in_the_offset(service):
    reader = http.JobsReader({"url": service, "types": "asr", "maxwaitseconds": "0", "maxjobspertrigger": "2"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    again = http.JobsReader({"url": service})  # after a restart only the written offset is left
    assert [r[0] for r in rows] == ["1", "2"] and list(again.readBetweenOffsets({"claimed": 0}, json.loads(json.dumps(end)))) == rows
    assert [r[0] for r in reader.read(end)[0]] == ["3", "4"]


def test_events_over_http(spark, service, tmp_path):
    spark.dataSource.register(events.Events)
    source = spark.readStream.format("strandline_events").option("url", f"{service}api/jobs/1/events").option("maxEventsPerTrigger", 2).option("maxWaitSeconds", 2).load()
    query = run(source, "events", tmp_path, processingTime="1 second")
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("events").count() < 5:
            time.sleep(0.3)
    finally:
        query.stop()
    rows = spark.table("events").orderBy("seq").collect()
    assert [(r.seq, r.id, r.event) for r in rows] == [(k, str(k + 1), "status") for k in range(5)]
    parsed = spark.table("events").select("seq", readers.event_payload(F.col("data"), "k int").alias("x")).orderBy("seq").collect()
    assert [r.x.payload.k for r in parsed] == [1, 2, 3, 4, 5]


def test_event_blocks():
    lines = [b": hello\n", b"data: a\r\n", b"data:b\r\n", b"\r\n", b"\n", b"event: x\n", b"\n", b"id: 7\n", b"event: y\n", b"data\n", b"\n", b"data: lost\n"]
    assert list(events.event_blocks(lines)) == [(None, "message", "a\nb"), ("7", "y", "")]


def test_transfers(spark, service):
    client = http.Client(service)
    references = spark.createDataFrame([("abc",), ("/api/transfer/def",), ("gone",)], "reference string")
    got = {r.reference: r for r in http.downloaded(references, client).collect()}
    assert bytes(got["abc"].content) == b"payload of abc" and bytes(got["/api/transfer/def"].content) == b"payload of def"
    assert got["gone"].content is None and "404" in got["gone"].error
    http.uploaded(client)(spark.createDataFrame([("xyz", bytearray(b"content"))], "reference string, content binary"), 0)
    assert ("/api/transfer/xyz", "content") in Service.said


def test_claims_before_a_failure_are_kept(service, monkeypatch):
    reader = http.JobsReader({"url": service, "types": "asr", "maxwaitseconds": "0"})
    claim, calls = reader.client.claim, []

    def failing(*x):
        calls.append(x)
        if len(calls) >= 3:
            raise ConnectionResetError
        return claim(*x)

    monkeypatch.setattr(reader.client, "claim", failing)
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["1", "2"] and [j[0] for j in end["jobs"]] == ["1", "2"]
    with pytest.raises(ConnectionResetError):  # nothing is lost by this one
        reader.read(end)


class Answers(BaseHTTPRequestHandler):
    """Answers by the path's first part; counts posts by their idempotency key."""

    counted: dict = {}
    tries: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        part = self.path.split("/")[1]
        if part == "cut":
            body = b"id: 1\ndata: one\n\ndata: two"
            self.send_response(200)
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            self.wfile.write(b"%x\r\n" % len(body) + body + b"\r\n50\r\nand")  # the next chunk isn't whole
            self.close_connection = True
            return
        self.told(int(part))

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        key = self.headers.get("Idempotency-Key")
        Answers.tries.append(key)
        first = Answers.tries.count(key) == 1
        if self.path == "/refused":
            return self.told(403)
        if self.path == "/canceled":
            return self.told(409)
        if self.path == "/busy" and first:
            return self.told(503)
        Answers.counted.setdefault(key, (self.path, body))
        if self.path == "/lost" and first:  # taken, but the answer doesn't arrive
            self.close_connection = True
            return None
        return self.told(200)

    def told(self, status):
        self.send_response(status)
        self.send_header("Content-Length", "0")
        self.end_headers()


@pytest.fixture
def answers():
    Answers.counted, Answers.tries = {}, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_events_that_fail(answers):
    reader = lambda path: events.EventsReader({"url": f"{answers}/{path}", "maxwaitseconds": "1", "maxfailures": "3"})
    for code in (401, 404):
        with pytest.raises(OSError):
            one = reader(code)
            one.read(one.initialOffset())
    one = reader(500)
    assert [list(one.read(one.initialOffset())[0]) for _ in range(2)] == [[], []]
    with pytest.raises(OSError):
        one.read(one.initialOffset())
    one = reader("cut")
    assert list(one.read(one.initialOffset())[0]) == [(0, "1", "message", "one")]


def as_rows(rows):
    return iter([type("Row", (), {"asDict": lambda self, r=r: r})() for r in rows])


def test_each_result_is_posted_once(spark, answers, tmp_path):
    """Answers that are lost, a busy service, a task tried again and a replayed batch: one post a result."""
    spark.dataSource.register(posting.Posts)
    rows = [{"reference": f"/{kind}", "body": f"result {k}", "post_id": str(k)} for k, kind in enumerate(["plain", "lost", "busy", "canceled"] * 5)]
    given(tmp_path / "in", 0, rows[:10])
    given(tmp_path / "in", 1, rows[10:])
    source = spark.readStream.schema("reference string, body string, post_id string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = source.writeStream.format("strandline_posts").option("url", answers).option("name", "results").option("report", "/report").option("pauseSeconds", 0.01)
    stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    posted = {k: v for k, v in Answers.counted.items() if v[0] != "/report"}
    assert posted == {f"results:{r['post_id']}": (r["reference"], r["body"]) for r in rows if r["reference"] != "/canceled"}
    reports = [json.loads(v[1]) for v in Answers.counted.values() if v[0] == "/report"]
    assert sorted((r["batch"], r["state"], r["posts"], r["canceled"]) for r in reports) == [(0, "committed", 8, 2), (1, "committed", 7, 3)]
    # A task that is tried again sends its rows again; as do rows without an id.
    writer = posting.StreamPosting({"url": answers, "name": "results", "pauseseconds": "0"})
    before = len(Answers.counted)
    assert writer.write(as_rows([*rows[:10], *[{"reference": "/plain", "body": "no id"}] * 2])) == posting.Posted(10, 2)
    assert len(Answers.counted) == before + 1
    with pytest.raises(OSError):
        writer.write(as_rows([{"reference": "/refused", "body": ""}]))


def test_posts_of_a_batch(spark, answers):
    spark.dataSource.register(posting.Posts)
    spark.createDataFrame([("/plain", f"{k}") for k in range(9)], "reference string, body string").write.format("strandline_posts").mode("append").option("url", answers).save()
    assert sorted(v[1] for v in Answers.counted.values()) == sorted(str(k) for k in range(9))


def test_job_calls(service):
    """What a client creates, cancels and opens."""
    client = http.Client(service)
    client.create("asr", {"k": 1})
    client.cancel("7")
    client.channel()
    assert [(p, json.loads(b)) for p, b in Service.said] == [("/api/jobs", {"type": "asr", "metadata": {"k": 1}}), ("/api/jobs/7/cancel", {}), ("/api/transfer", {})]


def test_routing_by_event(spark):
    rows = spark.createDataFrame([(k, ["status", "result", "other"][k % 3]) for k in range(12)], "k int, event string")
    found = readers.routed(rows, {"status": lambda df: df.select("k"), "result": lambda df: df.select((F.col("k") * 10).alias("k"))})
    assert {n: sorted(r.k for r in df.collect()) for n, df in found.items()} == {"status": [0, 3, 6, 9], "result": [10, 40, 70, 100]}


def test_post_each_in_groups(spark, tmp_path):
    def post(rows):
        (tmp_path / f"{rows[0]['k']}.json").write_text(json.dumps(rows))

    writers.post_each(post, 4)(spark.range(10).selectExpr("id AS k").coalesce(1), 0)
    assert sorted(len(json.loads(f.read_text())) for f in tmp_path.glob("*.json")) == [2, 4, 4]
