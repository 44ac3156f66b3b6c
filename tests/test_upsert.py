"""The kept candidate table: batches that come twice, what changed, and the batch operator as the measure."""

import datetime as dt

from pyspark.sql import functions as F

from mediasift.fixtures import traffic as T
from mediasift.operators import registry as R
from mediasift.sinks.upsert import UpsertTable
from mediasift.streaming.changes import CandidateTable

SF = "/root/testdata/sf0.001"
TOLD = ["visit_id", "day", "candidate_key", "url", "candidate_id", "kind", "hit_count", "first_seen", "last_seen", "mime_type", "content_length", "page_url", "page_title", "cookie"]


def told(df):
    return sorted(map(repr, df.select(TOLD).collect()))


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    rows = T.responses(spark, SF).withColumn("visit_id", F.when(F.col("page_id") != 3, F.col("page_id")))  # one visit is NULL
    parts = [rows.filter(F.col("seq") % 3 == n) for n in (2, 0, 1)]
    table = CandidateTable(str(tmp_path / "t"), buckets=2)
    table.write(parts[0], 0)
    first = table.changes(rows, 0).select("last_change").distinct().collect()
    table.write(parts[1], 1)
    table.write(parts[1], 1)  # as after a failure behind the ledger entry
    table.write(rows.limit(0), 2)
    table.write(parts[2], 3)
    table.write(parts[2], 3)
    got = table.read(rows)
    accepted = R.filter_candidates(R.classify_observations(rows.withColumn("day", F.date_trunc("day", "ts"))))
    assert told(got) == told(R.candidates(accepted, ["visit_id", "day"]))
    assert [r[0] for r in first] == ["added"]
    want = {}
    for n, part in ((0, parts[0]), (1, parts[1]), (3, parts[2])):
        keys = {tuple(r) for r in R.observed_candidates(R.filter_candidates(R.classify_observations(part))).select("visit_id", F.to_date("ts"), "candidate_key").collect()}
        change = {(k, "updated" if k in want else "added") for k in keys}
        want.update(dict.fromkeys(keys))
        seen = {((r.visit_id, r.d, r.candidate_key), r.last_change) for r in table.changes(rows, n).withColumn("d", F.to_date("day")).collect()}
        # A batch that was followed by another keeps its own version of what it changed.
        assert seen == change


def test_readers_see_the_last_whole_batch(spark, tmp_path):
    schema = "k STRING, at TIMESTAMP, n BIGINT"
    merge = lambda df: df.groupBy("k", "at").agg(F.sum("n").alias("n"))
    table = UpsertTable(str(tmp_path / "t"), ["k", "at"], merge, "at", buckets=2)
    day = dt.datetime(2026, 1, 1)
    assert table.current(spark, schema).count() == 0
    table.apply(spark.createDataFrame([("a", day, 1), (None, day, 2), ("a", day, 3)], schema), 7)
    # A batch that fails before its ledger entry leaves rows that nobody reads.
    spark.createDataFrame([("a", day, 99, "x", 8)], "k STRING, at TIMESTAMP, n BIGINT, last_change STRING, last_batch BIGINT").withColumn("slot", F.lit("20260101-0")).write.partitionBy("slot").parquet(str(tmp_path / "t" / "rows" / "version=8"))
    assert sorted((r.k or "", r.n, r.last_batch) for r in table.current(spark, schema).collect()) == [("", 2, 7), ("a", 4, 7)]
    table.apply(spark.createDataFrame([("a", day, 5), ("b", day + dt.timedelta(days=1), 1)], schema), 8)
    assert sorted((r.k or "", r.n, r.last_change, r.last_batch) for r in table.current(spark, schema).collect()) == [("", 2, "added", 7), ("a", 9, "updated", 8), ("b", 1, "added", 8)]
