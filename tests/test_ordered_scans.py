"""Ordered groups that hold most of a table: even chunks, running values and rates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediasift.operators import jobs, ordered, rates

T0 = dt.datetime(2026, 1, 1)


def folded(rows):
    """The meter as a loop over the samples of each job."""
    out, held = {}, {}
    for job, seq, ts, size, began in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        t = round((ts - T0).total_seconds() * 1e6)
        if job not in held:
            start = t if began is None else round((began - T0).total_seconds() * 1e6)
            held[job] = [start, start, 0, 0, 0.0]
        m = held[job]
        m[2] += size
        m[3] += size
        elapsed = (t - m[1]) / 1e6
        if elapsed >= 0.5:
            m[4] = m[2] / elapsed if m[4] <= 0 else m[4] * 0.6 + m[2] / elapsed * 0.4
            m[2], m[1] = 0, t
        since = (t - m[0]) / 1e6
        out.setdefault((job, seq), []).append(m[4] if m[4] > 0 else m[3] / since if since > 0.1 and m[3] > 0 else 0.0)
    return {k: sorted(v) for k, v in out.items()}


def test_rates_of_long_and_odd_jobs_equal_the_fold(spark):
    rng = random.Random(7)
    rows, now = [], 0.0
    for i in range(9_000):  # one job with most rows and sparse numbers: several chunks, more than 64 x 64 windows
        now += rng.choice([0.001, 0.3, 0.7, 3.0])
        rows.append(("hot", i * 1_000_003, T0 + dt.timedelta(seconds=now), rng.choice([0, 5, 10**9]), None))
    for j in range(12):
        for i in range(60):  # times go back and forth, stand still, or leap
            rows.append((f"j{j}", i, T0 + dt.timedelta(seconds=rng.uniform(0, 8) if j % 2 else 0.25 * i), rng.randrange(4) * j, T0 - dt.timedelta(seconds=j - 6) if j % 3 else None))
    rows += [("zero", i, T0 + dt.timedelta(seconds=i), 0 if i < 1_700 else 7, None) for i in range(1_705)]
    rows += [("stall", i, T0 + dt.timedelta(seconds=i), 0 if 3 < i < 1_700 else 7, None) for i in range(1_705)]
    rows += [("one", 1, T0, 5, None), ("twice", 1, T0, 5, None), ("twice", 1, T0, 5, None)]
    schema = "job_id STRING, seq BIGINT, ts TIMESTAMP, bytes BIGINT, started_at TIMESTAMP"
    got = {}
    for r in rates.smoothed_rate(spark.createDataFrame(rows, schema), rows_per_chunk=800).collect():
        got.setdefault((r.job_id, r.seq), []).append(r.bytes_per_second)
    want = folded(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(got[k]) == pytest.approx(want[k], rel=1e-9, abs=1e-300), k
    assert rates.smoothed_rate(spark.createDataFrame([], schema)).count() == 0


def test_large_groups_are_cut_evenly(spark):
    """A job with sparse numbers and a fleet with one busy hour are dealt over chunks; small groups are one chunk."""
    df = spark.range(20_000).selectExpr("'hot' AS k", "id * id * 997 AS seq").union(spark.range(300).selectExpr("'small' AS k", "id AS seq"))
    df = df.union(spark.range(50).selectExpr("CAST(NULL AS STRING) AS k", "CAST(NULL AS BIGINT) AS seq"))
    cut = ordered.cut_evenly(df, ["k"], "seq", "chunk", rows=500)
    sizes = {(r.k, r.chunk): r["count"] for r in cut.groupBy("k", "chunk").count().collect()}
    hot = {c: n for (k, c), n in sizes.items() if k == "hot"}
    assert len(hot) >= 38 and max(hot.values()) <= 650 and sizes[("small", 0)] == 300 and sizes[(None, 0)] == 50
    edges = cut.filter("k = 'hot'").groupBy("chunk").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("chunk").collect()
    assert all(x.b < y.a for x, y in zip(edges, edges[1:]))

    busy = spark.range(10_000).selectExpr("concat('j', id) AS job_id", "1L AS attempt", "timestamp_micros(id * 1000) AS started_at", "timestamp_micros(id * 1000 + 500500) AS ended_at")
    steps = jobs.concurrency(busy, rows_per_chunk=400)
    assert steps.agg(F.max("running")).first()[0] == 501 and steps.count() == 20_000


def test_running_values_do_not_depend_on_the_cut(spark):
    df = spark.range(3_000).selectExpr("id % 2 AS k", "id * 7919 % 3001 AS i", "id % 17 AS v")
    carries = {"s": ordered.Carry("sum", F.col("v")), "m": ordered.Carry("max", F.col("v"), inclusive=False), "l": ordered.Carry("last", F.when(F.col("v") > 9, F.col("v")))}
    want = sorted(map(tuple, ordered.running(df, ["k"], ["i"], F.lit(0), carries).collect()), key=repr)
    assert sorted(map(tuple, ordered.running(df, ["k"], ["i"], None, carries, rows_per_chunk=64).collect()), key=repr) == want
