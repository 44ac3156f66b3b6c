"""Lines by byte offset: pieces, growing files, bad bytes."""

import random

import pyarrow.fs as fs

from mediasift.sources import lines, readers
from mediasift.streaming import live
from mediasift.streaming.running import ROCKSDB, rocksdb


def plain(data: bytes):
    out, at = [], 0
    for part in data.split(b"\n"):
        if part or at < len(data):
            out.append((at, part.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(part) + 1
    return [o for o in out if o[0] < len(data)]


def test_every_cut_gives_the_same_lines(tmp_path):
    rng = random.Random(9)
    for n in range(60):
        data = b"".join(bytes(rng.choice(b"ab\xc3\xa9\xff \r") for _ in range(rng.randrange(12))) + b"\n" for _ in range(rng.randrange(15))) + b"end" * (n % 2)
        file = tmp_path / f"f{n}"
        file.write_bytes(data)
        for size in (1, 2, 3, 7, 1000):
            got = [(o, x) for p in lines._pieces(str(file), 0, len(data), size, False) for b in lines._read(fs.LocalFileSystem(), p, rng.randrange(1, 9)) for o, x in zip(b.column("offset").to_pylist(), b.column("line").to_pylist())]
            assert got == plain(data), (data, size)


def test_one_file_over_many_tasks(spark, tmp_path):
    text = "".join(f"10:00:00.{i % 1000:03d} {'WARN' if i % 5 == 0 else 'INFO'}  core  message {i}\r\n  more {i}\n" for i in range(4_000))
    (tmp_path / "app-2026-01-05.log").write_bytes(b"\xef\xbb\xbf" + text.encode() + b"\n  last line \xff")
    (tmp_path / "_hidden").write_text("10:00:00.000 INFO core no\n")
    read = lines.read_lines(spark, str(tmp_path), piece_bytes=10_000)
    assert read.rdd.getNumPartitions() > 20
    parsed = readers.read_app_log(spark, str(tmp_path), piece_bytes=10_000).orderBy("offset").collect()
    assert len(parsed) == 8_001 and [p.level for p in parsed[:3]] == ["WARN", "WARN", "INFO"]
    assert parsed[0].message == "message 0" and parsed[-1].is_continuation and parsed[-1].line == "  last line �" and parsed[-1].level == "INFO"
    assert str(parsed[0].log_date) == "2026-01-05" and parsed[-1].source == "core"


def test_growing_files_are_followed_by_byte(spark, tmp_path):
    folder, out, file = tmp_path / "logs", tmp_path / "out", tmp_path / "logs" / "a.log"
    folder.mkdir()

    def run():
        stream = live.stream_log(spark, str(folder), "WARN").select("line", "offset")
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).format("parquet").trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        return sorted((r.line[-1], r.offset) for r in spark.read.parquet(str(out)).collect())

    row = "10:00:00.000 WARN  x  line "
    n = len(row) + 2
    file.write_text(row + "1\n" + row + "2")
    assert run() == [("1", 0)]  # the second has no break yet
    with file.open("a") as more:
        more.write("\n" + row + "3\n")
    (folder / "b.log").write_text(row + "4\n")
    assert run() == [("1", 0), ("2", n), ("3", 2 * n), ("4", 0)]
    assert run() == [("1", 0), ("2", n), ("3", 2 * n), ("4", 0)]


def test_events_are_followed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text('{"visit_id": 1, "seq": 1, "ts": "2026-01-01T00:00:00Z", "method": "Network.requestWillBeSent", "params": "{\\"requestId\\": \\"r1\\"}"}\nnot json\n')
    query = readers.read_net_events(spark, str(tmp_path / "in"), stream=True).select("visit_id", "request_id").writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM followed").collect()] == [(1, "r1")]
    assert [tuple(r) for r in readers.read_net_events(spark, str(tmp_path / "in")).select("visit_id", "request_id").collect()] == [(1, "r1")]


def test_the_state_store_is_set_for_the_query_only(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with rocksdb(spark):
        assert spark.conf.get(name) == ROCKSDB
    assert spark.conf.get(name, None) == before
