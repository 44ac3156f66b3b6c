"""Streams on the state API of Spark 4.

Each is a ``StatefulProcessor``: state per key, or per bucket of keys where they are many, and an event-time timer that
gives a key up ``ttl_ms`` after its last row, so state is bounded and a replay gives the same result. The state store must
be RocksDB: ``running.drain`` starts streams with it, other callers set
``spark.sql.streaming.stateStore.providerClass`` before they start the query.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import headers as H
from ..functions import text as X
from ..operators import events as E

DAY_MS = 24 * 3600 * 1000
BUCKETS = 512
TERMINAL = ("completed", "failed", "canceled")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Rows of one key in this batch, by sequence number."""
    return pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)


def _plain(value):
    return None if value is None or value != value else value


class Forgetting(StatefulProcessor):
    """A processor whose keys end ``ttl_ms`` after their last row.

    A key's values are one typed row of state, read once and written once per batch, with the time the key ends. One
    timer per key is pending at a time. When it fires before its key's time, because more rows came, it is set anew.
    """

    STATE = ""  # typed columns of the value state

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"until BIGINT, {self.STATE}")

    def step(self, key: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame | None, tuple]:
        """What goes out for the rows of this batch, and the values to hold."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear state beside the values."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _in_order(rows)
        before = self.held.get()
        out, values = self.step(key, ordered, None if before is None else tuple(before)[1:])
        until = max(int(ordered["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.ttl_ms
        if before is None:
            self.handle.registerTimer(until)
        self.held.update((until if before is None else max(until, before[0]), *values))
        if out is not None and len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.held.get()[0]
        if until > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.held.clear()
            self.forget()
        return iter(())

    def close(self) -> None:
        pass


class Bucketed(StatefulProcessor):
    """A processor for keys that are many and small: a bucket of keys is one row of state, read and written once a batch.

    Each call of the state API goes over a socket, so calls per bucket are few where calls per key would be millions. The
    values of a key are a list that starts with the time the key ends, ``ttl_ms`` after its last row; a key that has ended is
    dropped by the bucket's timer, or when rows come to its bucket. ``buckets`` holds for the life of a checkpoint.
    """

    SCHEMA = ""
    KEYS: tuple[str, ...] = ()
    BLANK: tuple = ()  # values of a new key

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer BIGINT, entries STRING")

    def step(self, key: tuple, row: tuple, values: list, out: list[tuple]) -> None:
        """Fold one row into ``values`` (in place) and append what goes out to ``out``."""
        raise NotImplementedError

    def _load(self) -> tuple[int | None, dict[tuple, list]]:
        held = self.held.get()
        if held is None:
            return None, {}
        n = len(self.KEYS)
        return held[0], {tuple(e[:n]): e[n:] for e in json.loads(held[1])}

    def _keep(self, timer: int | None, entries: dict[tuple, list], now: int) -> None:
        """Hold what has not ended, and see to it that the first end is noticed."""
        live = [[*key, *values] for key, values in entries.items() if values[0] > now]
        if not live:
            self.held.clear()
            return
        first = min(e[len(self.KEYS)] for e in live)
        if timer is None or first < timer:
            self.handle.registerTimer(first)
            timer = first
        self.held.update((timer, json.dumps(live)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ordered = _in_order(rows)
        now = timerValues.getCurrentWatermarkInMs()
        ends = ((ordered["ts"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)).fillna(0).astype("int64").clip(lower=now) + self.ttl_ms
        columns = [c for c in ordered.columns if c != "ts" and not c.startswith("_")]
        values = [ordered[c].astype(object).where(ordered[c].notna(), None).tolist() for c in columns]
        places = [columns.index(k) for k in self.KEYS]
        record = namedtuple("record", columns)
        timer, entries = self._load()
        out: list[tuple] = []
        for end, row in zip(ends.tolist(), map(record._make, zip(*values, strict=True)), strict=True):
            of = tuple(int(row[i]) if isinstance(row[i], float) else row[i] for i in places)
            held = entries.get(of)
            if held is None:
                held = entries[of] = [end, *self.BLANK]
            elif end > held[0]:
                held[0] = end
            self.step(of, row, held, out)
        self._keep(timer, entries, now)
        if out:
            fields = [c.split() for c in self.SCHEMA.split(", ")]
            frame = pd.DataFrame(out, columns=[name for name, _ in fields])
            yield frame.astype({name: "Int64" for name, kind in fields if kind == "BIGINT"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, entries = self._load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if entries:
            self._keep(timer if timer is not None and timer > fired else None, entries, max(fired, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def close(self) -> None:
        pass


def _run_bucketed(df: DataFrame, processor: Bucketed, late: str, buckets: int) -> DataFrame:
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*processor.KEYS), F.lit(buckets)).cast("int")).withWatermark("ts", late)
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, processor.SCHEMA, "Update", "eventTime")


def _run(df: DataFrame, keys: list[str], processor: Forgetting, schema: str, late: str) -> DataFrame:
    return df.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "eventTime")


class Refresh(Bucketed):
    """The parts of requests; a response goes out when it comes, and again when extra headers come after it."""

    SCHEMA = "visit_id BIGINT, request_id STRING, seq BIGINT, url STRING, mime_type STRING, content_length BIGINT, cookie STRING, refreshed BOOLEAN"
    KEYS = ("visit_id", "request_id")
    # url, cookie, extra_known, extra_cookie; of the response: seq, url, mime_type, length
    BLANK = (None, None, False, None, None, None, None, None)

    def step(self, key, row, values, out):
        _, url, cookie, extra_known, extra_cookie, seq, r_url, mime, length = values
        late = False
        if row.event == "request":
            url, cookie = row.url, row.cookie
        elif row.event == "extra":
            extra_known, extra_cookie, late = bool(row.has_cookie), row.cookie, seq is not None
        else:
            seq, r_url, mime = int(row.seq), row.url or url, row.mime_type
            length = None if row.content_length is None else int(row.content_length)
        values[1:] = (url, cookie, extra_known, extra_cookie, seq, r_url, mime, length)
        if row.event == "response" or late:
            out.append((*key, seq, r_url, mime, length, extra_cookie if extra_known else cookie, late))


def stream_refresh(events: DataFrame, ttl_ms: int = DAY_MS, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """M2: emits a response when it comes, and again when its extra headers come later.

    ``events`` are parsed by ``parse_net_events``; ends of loading are not needed, as state expires.
    """
    method = F.col("method")
    event = F.when(method == E.METHODS[0], "request").when(method == E.METHODS[1], "extra").otherwise("response")
    headers = H.lower_keys(F.when(method == E.METHODS[0], F.col("p.request.headers")).when(method == E.METHODS[1], F.col("p.headers")))
    answer = H.lower_keys(F.col("p.response.headers"))
    length = X.asset_length(F.try_element_at(answer, F.lit("content-range")), F.try_element_at(answer, F.lit("content-length")))
    rows = events.filter(method.isin(*E.METHODS[:3])).select(
        "visit_id", "request_id", "seq", "ts", event.alias("event"),
        F.coalesce(F.col("p.request.url"), F.col("p.response.url")).alias("url"),
        F.coalesce(F.map_contains_key(headers, F.lit("cookie")), F.lit(False)).alias("has_cookie"),
        F.try_element_at(headers, F.lit("cookie")).alias("cookie"), F.col("p.response.mimeType").alias("mime_type"), length.alias("content_length"),
    )
    return _run_bucketed(rows, Refresh(ttl_ms), late, buckets)


class Protection(Forgetting):
    """Candidates of a package. Until protection shows they are appended to a list, which then goes out once more."""

    SCHEMA = "visit_id BIGINT, family STRING, url STRING, seq BIGINT, is_protected BOOLEAN, system STRING"

    STATE = "system STRING"

    def init(self, handle):
        super().init(handle)
        self.waiting = handle.getListState("waiting", "url STRING, seq BIGINT")

    def forget(self):
        self.waiting.clear()

    def step(self, key, rows, held):
        known = held[0] if held else None
        seen = rows[rows["event"] == "candidate"]
        marks = rows[rows["event"] != "candidate"]
        shows = None
        if known is None and len(marks):
            shows, known = marks["seq"].iloc[0], marks["system"].iloc[0]
        now = seen[["url", "seq"]]
        if known is None:
            if len(now):
                self.waiting.appendList(list(now.itertuples(index=False, name=None)))
            return self._out(key, now, None), (None,)
        if shows is None:
            return self._out(key, now, known), (known,)
        # It shows in this batch: what came before it goes out as it was, then again with all that waited.
        early = now[now["seq"] < shows]
        waited = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["url", "seq"])
        self.waiting.clear()
        parts = [self._out(key, early, None), self._out(key, pd.concat([waited, early, now[now["seq"] >= shows]]), known)]
        return pd.concat(parts, ignore_index=True), (known,)

    @staticmethod
    def _out(key, rows, system):
        return pd.DataFrame({
            "visit_id": pd.array([key[0]] * len(rows), dtype="Int64"), "family": pd.Series([key[1]] * len(rows), dtype=object),
            "url": rows["url"].astype(object).tolist(), "seq": rows["seq"].astype("int64").tolist(), "is_protected": [system is not None] * len(rows),
            "system": pd.Series([system] * len(rows), dtype=object),
        })


def stream_protection(events: DataFrame, ttl_ms: int = DAY_MS, late: str = "1 hour") -> DataFrame:
    """M6, M7: candidates with their package's protection, emitted again if it shows later.

    ``events`` come from ``live.protection_events``; candidates once each. A package is a family in a visit: what shows in
    one visit says nothing about another.
    """
    return _run(events, ["visit_id", "family"], Protection(ttl_ms), Protection.SCHEMA, late)


class Job(Bucketed):
    """State, stage and highest tenth of jobs; after a final state nothing goes out."""

    SCHEMA = "job_id STRING, seq BIGINT, event STRING, detail STRING"
    KEYS = ("job_id",)
    BLANK = (None, None, -1)  # state, stage, decile

    def step(self, key, row, values, out):
        _, state, stage, decile = values
        if state in TERMINAL:
            return
        seq = int(row.seq)
        now = row.state if row.state is not None else ("muxing" if row.stage == "finalizing" else "downloading")
        if now != state:
            out.append((*key, seq, "state", now))
        if row.stage is not None:
            tenth = -1 if row.fraction is None else int(row.fraction * 10 + 1e-12)
            if row.stage != stage:
                out.append((*key, seq, "stage", row.stage))
                stage, decile = row.stage, tenth
            elif tenth > decile:
                out.append((*key, seq, "milestone", f"{stage} {tenth * 10}%"))
                decile = tenth
        values[1:] = (now, stage, decile)


def stream_jobs(events: DataFrame, ttl_ms: int = DAY_MS, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Milestones and state changes of a job; what comes after a final state is ignored.

    ``events`` have ``job_id, seq, ts, state, stage`` and the progress columns.
    """
    fraction = X.progress_fraction(F.col("segments_done"), F.col("segments_total"), F.col("bytes"), F.col("total_bytes"))
    rows = events.select("job_id", "seq", "ts", "state", "stage", fraction.alias("fraction"))
    return _run_bucketed(rows, Job(ttl_ms), late, buckets)
