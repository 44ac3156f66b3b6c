"""Streams on a few rows: what batch gives, final states, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediasift.operators import events as E
from mediasift.operators import rates
from mediasift.streaming import live, processors, stateful
from mediasift.streaming.running import drain, rocksdb, shared_folder

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


JOBS = "job_id STRING, seq BIGINT, ts TIMESTAMP, state STRING, stage STRING, segments_done BIGINT, segments_total BIGINT, bytes BIGINT, total_bytes BIGINT"


def test_nothing_follows_a_final_state(spark, tmp_path):
    row = lambda seq, state, stage, done: ("j", seq, at(seq), state, stage, done, 10, None, None)
    batches = [[row(0, "queued", None, 0), row(1, None, "video", 1)], [row(2, None, "video", 5), row(3, "failed", None, 5), row(4, None, "video", 9)], [row(5, "downloading", "video", 10)]]
    got = [(r.seq, r.event, r.detail) for r in drain(processors.stream_jobs(stream_of(spark, tmp_path, batches, JOBS)), "update").orderBy("seq", "event").collect()]
    assert got == [(0, "state", "queued"), (1, "stage", "video"), (1, "state", "downloading"), (2, "milestone", "video 50%"), (3, "state", "failed")]


def test_rate_stream_equals_batch(spark, tmp_path):
    schema = "job_id STRING, seq BIGINT, ts TIMESTAMP, bytes BIGINT, started_at TIMESTAMP"
    rows = [(f"j{i % 2}", i, at(i * 0.2), 100 * i, None) for i in range(40)]
    batch = {(r.job_id, r.seq): r.bytes_per_second for r in rates.smoothed_rate(spark.createDataFrame(rows, schema)).collect()}
    stream = drain(stateful.stream_rate(stream_of(spark, tmp_path, [rows[:17], rows[17:]], schema)), "update")
    assert {(r.job_id, r.seq): r.bytes_per_second for r in stream.collect()} == pytest.approx(batch) and len(batch) == 40


def test_a_visit_closes_once(spark, tmp_path):
    schema = "visit_id STRING, ts TIMESTAMP, candidate_key STRING"
    batches = [
        [("a", at(0), "x"), ("b", at(0), "x"), ("a", at(5), "y")],
        # out of order, a repeat that keeps nothing open, and a candidate after the quiet stretch
        [("a", at(9), "z"), ("a", at(14), "x"), ("a", at(20), "w"), *[("b", at(5 * i), f"k{i}") for i in range(1, 12)]],
        [("end", at(900), "e")], [("end", at(901), "f")],
    ]
    rows = stateful.close_quiet_visits(stream_of(spark, tmp_path, batches, schema), "10 seconds", 6, 45, 3600)
    start = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    got = {r.visit_id: (r.new_candidates, r.last_new_us // 1_000_000 - start, r.closed_us // 1_000_000 - start, r.hit_cap) for r in drain(rows).collect() if r.visit_id != "end"}
    assert got == {"a": (3, 9, 15, False), "b": (10, 45, 45, True)}


def test_late_rows_reach_what_waits(spark, tmp_path):
    schema = "visit_id STRING, ts TIMESTAMP, candidate_key STRING"
    # Lateness is over the quiet time: the row at 13 s waits behind a gap that rows at 5 and 10 s close.
    batches = [[("a", at(0), "x"), ("a", at(13), "w")], [("a", at(5), "y"), ("a", at(10), "z")], [("end", at(900), "e")], [("end", at(901), "f")]]
    rows = stateful.close_quiet_visits(stream_of(spark, tmp_path, batches, schema), "10 seconds", 6, 45, 3600)
    start = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    got = [(r.new_candidates, r.last_new_us // 1_000_000 - start, r.closed_us // 1_000_000 - start) for r in drain(rows).collect() if r.visit_id == "a"]
    assert got == [(4, 13, 19)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "elsewhere"})

    with pytest.raises(ValueError):
        shared_folder(Elsewhere)


REFRESH = "visit_id BIGINT, request_id STRING, seq BIGINT, ts TIMESTAMP, event STRING, url STRING, has_cookie BOOLEAN, cookie STRING, mime_type STRING, content_length BIGINT"


def test_parts_of_a_request_over_batches(spark, tmp_path):
    def part(i, event, url=None, cookie=None, has=None, length=None):
        return (1, "r", i, at(i), event, url, cookie is not None if has is None else has, cookie, "video/mp4" if event == "response" else None, length)

    batches = [[part(0, "request", "u0", "a=1"), part(2, "response", None, length=7)], [part(3, "extra", cookie="b=2")], [part(5, "response", "u5"), part(4, "extra", has=True)]]
    rows = processors._run(stream_of(spark, tmp_path, batches, REFRESH), ["visit_id", "request_id"], processors.Refresh(processors.DAY_MS), processors.Refresh.SCHEMA, "1 hour")
    got = sorted((r.batch_no, r.seq, r.url, r.content_length, r.cookie, r.refreshed) for r in drain(rows, "update").collect())
    assert [g[1:] for g in got] == [(2, "u0", 7, "a=1", False), (2, "u0", 7, "b=2", True), (2, "u0", 7, None, True), (5, "u5", None, None, False)]


PACKAGE = "visit_id BIGINT, family STRING, ts TIMESTAMP, seq BIGINT, event STRING, url STRING, system STRING"


def test_protection_reaches_earlier_candidates_of_its_visit_only(spark, tmp_path):
    def seen(visit, i):
        return (visit, "f", at(i), i, "candidate", f"u{i}", None)

    mark = lambda visit, i: (visit, "f", at(i), i, "protected", "m", "Widevine")
    batches = [[seen(1, 0), seen(2, 1), seen(1, 2)], [seen(1, 3), mark(1, 4), seen(1, 5)], [seen(1, 6), mark(1, 7), seen(2, 8)], [mark(3, 9)], [seen(3, 10)]]
    rows = processors.stream_protection(stream_of(spark, tmp_path, batches, PACKAGE))
    got = [(r.visit_id, r.seq, r.is_protected) for r in drain(rows, "update").orderBy("batch_no", "seq", "is_protected").collect()]
    assert got == [(1, 0, False), (2, 1, False), (1, 2, False), (1, 0, True), (1, 2, True), (1, 3, False), (1, 3, True), (1, 5, True), (1, 6, True), (2, 8, False), (3, 10, True)]


def test_a_key_is_given_up_after_its_last_row(spark, tmp_path):
    """Rows 30 minutes apart keep a key for 40 minutes each; after two hours of silence it starts anew."""
    minute = 60
    batches = [[(1, "f", at(0), 0, "protected", "m", "W")], [(1, "f", at(30 * minute), 1, "candidate", "a", None)], [(9, "g", at(65 * minute), 2, "candidate", "x", None)],
               [(1, "f", at(66 * minute), 3, "candidate", "b", None)], [(9, "g", at(200 * minute), 4, "candidate", "y", None)], [(9, "g", at(201 * minute), 5, "candidate", "z", None)],
               [(1, "f", at(202 * minute), 6, "candidate", "c", None)]]
    rows = processors.stream_protection(stream_of(spark, tmp_path, batches, PACKAGE), ttl_ms=40 * minute * 1000, late="1 minute")
    got = {(r.url, r.is_protected) for r in drain(rows, "update").collect() if r.visit_id == 1}
    assert got == {("a", True), ("b", True), ("c", False)}


def test_correlation_keeps_no_header_maps(spark, tmp_path):
    sent, more, answer = E.METHODS[:3]
    part = lambda rid, seq, method, rest: (1, seq, at(seq), method, f'{{"requestId": "{rid}", {rest}}}')
    reply = lambda rid, seq: part(rid, seq, answer, f'"type": "XHR", "response": {{"url": "https://h/{rid}", "headers": {{"Content-Range": "bytes 0-1/7", "Content-Length": "2"}}}}')
    batches = [
        [part("a", 1, sent, '"request": {"headers": {"Cookie": "own", "X": "1"}}'), part("a", 2, more, '"headers": {"COOKIE ": "extra"}'), reply("a", 3)],
        [part("b", 4, sent, '"request": {"headers": {"cookie": "own"}}'), reply("b", 5), part("b", 6, more, '"headers": {"Cookie": "", "x": "1"}'), reply("c", 7)],
        [(-1, 999, at(9999), m, '{"requestId": "end"}') for m in (sent, more, answer)],
    ]
    rows = live.stream_correlate(E.parse_net_events(stream_of(spark, tmp_path, batches, E.EVENT_SCHEMA)))
    plan, kept = rows._jdf.queryExecution().analyzed(), []

    def walk(node):
        if node.nodeName() == "Join":
            kept.extend(node.children().apply(i).schema().simpleString() for i in range(2))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len(kept) == 4 and not any("map<" in k for k in kept)
    got = {r.request_id: (r.url, r.resource_type, r.content_length, r.cookie) for r in drain(rows).filter("visit_id > 0").collect()}
    assert got == {"a": ("https://h/a", "XHR", 7, "extra"), "b": ("https://h/b", "XHR", 7, "own"), "c": ("https://h/c", "XHR", 7, None)}


def test_a_small_store_sets_nothing_aside(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    with rocksdb(spark):
        assert spark.conf.get(name) == "false"
        assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "3"
    assert spark.conf.get(name, None) is None
