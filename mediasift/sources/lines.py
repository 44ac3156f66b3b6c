"""Text files as lines with their byte offsets, in pieces of bytes.

``spark.read.format("lines")`` cuts a file into byte ranges, one task each: a line belongs to the range in which it
starts. ``spark.readStream.format("lines")`` follows files that grow: its offset is a byte position per file, always after
a whole line, so a batch run again reads the same bytes. Each row is ``file, offset, line``; within a file the offset
orders the lines, however they were read.

Files are opened through ``pyarrow.fs``, so a path may be local or name any store that pyarrow knows (hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file STRING, offset BIGINT, line STRING"
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())])
PIECE, BLOCK = 128 << 20, 8 << 20
BOM = b"\xef\xbb\xbf"


@dataclass
class Piece(InputPartition):
    """Lines that start at ``start`` or later and before ``end``."""

    file: str
    start: int
    end: int
    aligned: bool  # a line is known to start at ``start``
    whole: bool = False  # only lines whose break has been written


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(place, recursive=True))
        # Hidden files are others' work in progress, as Spark's own readers take them.
        found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    elif info.type == fs.FileType.File:
        found = [info]
    else:
        raise FileNotFoundError(path)
    return store, sorted(found, key=lambda f: f.path)


def _pieces(file: str, start: int, end: int, size: int, whole: bool) -> list[Piece]:
    cuts = [*range(start, end, size)]
    return [Piece(file, a, b, i == 0, whole) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], end]))]


def _read(store: fs.FileSystem, piece: Piece, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The lines of a piece, a block of bytes at a time."""
    with store.open_input_file(piece.file) as source:
        at = piece.start if piece.aligned else piece.start - 1
        source.seek(at)
        held, skipping = b"", not piece.aligned
        while True:
            data = source.read(block)
            last = len(data) < block
            buffer = held + data
            if skipping:  # up to the break that lies at or behind the byte before the piece
                found = buffer.find(b"\n")
                if found < 0:
                    if last:
                        return
                    at, held = at + len(buffer), b""
                    continue
                at, buffer, skipping = at + found + 1, buffer[found + 1 :], False
            breaks = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10)
            starts = np.concatenate([[0], breaks + 1])
            ends = breaks
            if last and not piece.whole and starts[-1] < len(buffer):
                ends = np.append(breaks, len(buffer))
            starts = starts[: len(ends)]
            inside = at + starts < piece.end
            if inside.any():
                yield _batch(piece.file, at, buffer, starts[inside], ends[inside])
            if last or not inside.all() or at + (breaks[-1] + 1 if len(breaks) else 0) >= piece.end:
                return
            done = int(breaks[-1]) + 1 if len(breaks) else 0
            at, held = at + done, buffer[done:]


def _batch(file: str, at: int, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    lines = [buffer[a:b].removesuffix(b"\r") for a, b in zip(starts.tolist(), ends.tolist())]
    if at == 0 and len(lines) and starts[0] == 0:
        lines[0] = lines[0].removeprefix(BOM)
    try:
        texts = pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 become U+FFFD
        texts = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
    return pa.record_batch([pa.array([file] * len(lines), pa.string()), pa.array(at + starts, pa.int64()), texts], schema=ARROW)


class LinesReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        return [p for f in _files(self.path)[1] for p in _pieces(f.path, 0, f.size, self.size, False)]

    def read(self, partition: Piece):
        yield from _read(_files(self.path)[0], partition)


class LinesStreamReader(DataSourceStreamReader):
    """Offsets are ``{file: position}``. A file that has become shorter is taken for a new one."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        store, files = _files(self.path)
        return {"files": json.dumps({f.path: self._last_break(store, f) for f in files})}

    @staticmethod
    def _last_break(store: fs.FileSystem, file: fs.FileInfo, block: int = 65_536) -> int:
        """The position after the last line break, read from the end."""
        with store.open_input_file(file.path) as source:
            end = file.size
            while end:
                start = max(0, end - block)
                source.seek(start)
                found = source.read(end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, position in sorted(after.items()):
            known = before.get(file, 0)
            out += _pieces(file, known if known <= position else 0, position, self.size, True)
        return out

    def read(self, partition: Piece):
        yield from _read(_files(self.path)[0], partition)

    def commit(self, end: dict) -> None:
        pass


class LinesSource(DataSource):
    """Options: ``path``; ``pieceBytes``, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def _of(self, reader):
        return reader(self.options["path"], int(self.options.get("pieceBytes", PIECE)))

    def reader(self, schema) -> DataSourceReader:
        return self._of(LinesReader)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return self._of(LinesStreamReader)


def read_lines(spark: SparkSession, path: str, stream: bool = False, piece_bytes: int = PIECE) -> DataFrame:
    """``file, offset, line`` of a file or a folder of files. Line breaks are ``\\n`` and ``\\r\\n``; a byte order mark is dropped.

    A batch read takes a last line without a break, a stream leaves it until its break is written.
    """
    spark.dataSource.register(LinesSource)
    reader = (spark.readStream if stream else spark.read).format("lines").option("pieceBytes", piece_bytes)
    return reader.load(path)
