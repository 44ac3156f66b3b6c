"""Streams whose state is a fold over a key's rows.

Each is a small step function over the rows of one key, run by
``applyInPandasWithState``: Spark partitions, shuffles and stores the state.
A key whose rows end loses its state once the watermark is ``ttl_ms`` past the
last of them, so state is bounded by event time and a replay gives the same
result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 24 * 3600 * 1000


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Rows of one key in this batch, by sequence number."""
    return pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")


def _plain(value):
    return None if value is None or value is pd.NA or value is pd.NaT or value != value else value


def _keyed(
    df: DataFrame, keys: list[str], step: Callable[[tuple, pd.DataFrame, dict], list[tuple]], schema: str,
    ttl_ms: int, late: str = "1 hour",
) -> DataFrame:
    """Run ``step(key, rows, held)`` per key; ``held`` is a dictionary that lasts between batches."""
    columns = [part.split()[0] for part in schema.split(", ")]
    whole = [part.split()[0] for part in schema.split(", ") if part.endswith("BIGINT")]

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        ordered = _in_order(rows)
        out = step(key, ordered, held)
        state.update((json.dumps(held),))
        last = max(int(ordered["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in whole})

    return df.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(
        run, schema, "held STRING", "update", GroupStateTimeout.EventTimeTimeout
    )


def _meter(key: tuple, rows: pd.DataFrame, held: dict) -> list[tuple]:
    out = []
    for row in rows.itertuples(index=False):
        now, size = int(row.ts_us), int(row.bytes)
        if not held:
            started = _plain(row.started_us)
            start = now if started is None else int(started)
            held.update(start=start, opened=start, window=0, total=0, rate=0.0)
        held["window"] += size
        held["total"] += size
        elapsed = (now - held["opened"]) / 1e6
        if elapsed >= 0.5:
            sample, rate = held["window"] / elapsed, held["rate"]
            held["rate"] = sample if rate <= 0 else rate * 0.6 + sample * 0.4
            held["window"], held["opened"] = 0, now
        since = (now - held["start"]) / 1e6
        overall = held["total"] / since if since > 0.1 and held["total"] > 0 else 0.0
        out.append((key[0], int(row.seq), held["rate"] if held["rate"] > 0 else overall))
    return out


def stream_rate(samples: DataFrame, ttl_ms: int = DAY_MS, late: str = "1 hour") -> DataFrame:
    """The smoothed rate after each sample. The state of a job is five numbers.

    ``samples`` have ``job_id, seq, ts, bytes`` (of the sample) and ``started_at``.
    """
    rows = samples.select(
        "job_id", "seq", "ts", F.unix_micros("ts").alias("ts_us"), "bytes", F.unix_micros("started_at").alias("started_us")
    )
    return _keyed(rows, ["job_id"], _meter, "job_id STRING, seq BIGINT, bytes_per_second DOUBLE", ttl_ms, late)


def close_quiet_visits(rows: DataFrame, late: str, quiet_seconds: float, cap_seconds: float, hold_seconds: float) -> DataFrame:
    """The fold of ``live.stream_quiet_visits`` over ``visit_id, ts, candidate_key``.

    A visit holds the keys of its open stretch, which the cap bounds, and afterwards only that it is closed. A row is
    emitted when the watermark has passed the end, so that no late row can change it.
    """
    quiet, cap, hold = (int(s * 1_000_000) for s in (quiet_seconds, cap_seconds, hold_seconds))

    def end(held: dict) -> int:
        return min(held["last"] + quiet, held["opened"] + cap)

    def fold(held: dict) -> dict:
        """Rows that have waited, in order, up to the end of the stretch."""
        for t, key in sorted(map(tuple, held.pop("waiting", []))):
            if "opened" not in held:
                held.update(opened=t, last=t, keys=[key])
            elif t <= end(held) and key not in held["keys"]:
                held["last"] = t
                held["keys"].append(key)
        return held

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut and held.get("closed"):
            state.remove()
            return
        for batch in batches:
            if not held.get("closed"):
                # Order is settled behind the watermark only: rows wait, each key with its first time.
                first = dict((k, t) for t, k in held.get("waiting", []))
                for t, k in zip(batch["t"], batch["candidate_key"]):
                    first[k] = min(int(t), first.get(k, int(t)))
                held["waiting"] = sorted((t, k) for k, t in first.items())
        now = state.getCurrentWatermarkMs() * 1000
        if not held.get("closed") and held.get("waiting"):
            done = fold({"waiting": list(held["waiting"])})
            if end(done) < now:
                yield pd.DataFrame(
                    [(key[0], len(done["keys"]), done["opened"], done["last"], end(done), done["last"] + quiet > done["opened"] + cap)],
                    columns=["visit_id", "new_candidates", "opened_us", "last_new_us", "closed_us", "hit_cap"],
                )
                held = {"closed": end(done)}
            else:
                # Late rows can lengthen the stretch up to the cap after its opening, which they can only make earlier.
                held["waiting"] = [w for w in held["waiting"] if w[0] <= done["opened"] + cap]
                state.update((json.dumps(held),))
                state.setTimeoutTimestamp(max(end(done) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
                return
        if held.get("closed"):
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max((held["closed"] + hold) // 1000, state.getCurrentWatermarkMs() + 1))

    kind = rows.schema["visit_id"].dataType.simpleString()
    schema = f"visit_id {kind}, new_candidates BIGINT, opened_us BIGINT, last_new_us BIGINT, closed_us BIGINT, hit_cap BOOLEAN"
    keyed = rows.withColumn("t", F.unix_micros("ts")).withWatermark("ts", late)
    return keyed.groupBy("visit_id").applyInPandasWithState(run, schema, "held STRING", "append", GroupStateTimeout.EventTimeTimeout)
