"""A table of keyed rows that streams keep up to date, with the changes of every batch (K4, M4).

Rows live in slots, a stretch of time and a hash of the key. A batch rewrites the slots it touches, as new versions; a
ledger entry, written last, names the version of every slot. A batch that is run again reads the ledger as it was before
that batch and writes the same versions, so nothing is counted twice; readers see a batch whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch BIGINT, slot STRING, version BIGINT"


class UpsertTable:
    """``merge`` folds rows with equal ``keys`` into one row of the same columns; it must not depend on their order.

    ``period`` is a timestamp column among the keys or values that does not change for a key: old periods are left alone
    by batches that do not touch them. ``buckets`` bounds the size of a slot.
    """

    def __init__(self, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], period: str, buckets: int = 16):
        self.path, self.keys, self.merge, self.period, self.buckets = path.rstrip("/"), keys, merge, period, buckets

    def _ledger(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """Slots and versions as of the last batch, or the last one ``before`` a batch."""
        try:
            entries = spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        entries = entries if before is None else entries.filter(F.col("batch") < before)
        last = entries.agg(F.max("batch")).first()[0]
        return None if last is None else entries.filter(F.col("batch") == last).select("slot", "version")

    def _rows(self, spark: SparkSession, slots: list, schema) -> DataFrame:
        paths = [f"{self.path}/rows/version={version}/slot={slot}" for slot, version in slots]
        return spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths).drop("version", "slot")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge rows into the table as batch ``number``; made for ``foreachBatch``."""
        spark = batch.sparkSession
        day = F.date_format(self.period, "yyyyMMdd")
        slot = F.concat_ws("-", day, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string"))
        new = self.merge(batch)
        touched = [r[0] for r in batch.select(slot.alias("s")).distinct().collect()]  # buckets x the batch's days
        if not touched:
            return
        ledger = self._ledger(spark, number)
        held = [] if ledger is None else [(r.slot, r.version) for r in ledger.filter(F.col("slot").isin(touched)).collect()]
        both = new.withColumn("_old", F.lit(0))
        if held:
            stored = self._rows(spark, held, self._stored_schema(new))
            marks = stored.select(*self.keys, "last_batch", "last_change")
            both = both.unionByName(stored.drop("last_batch", "last_change").withColumn("_old", F.lit(1)))
        flags = both.groupBy(*self.keys).agg(F.max("_old").alias("_known"), F.min("_old").alias("_old"))
        merged = self.merge(both.drop("_old"))
        merged = _joined(merged, flags, self.keys)
        if held:
            merged = _joined(merged, marks, self.keys)
        else:
            merged = merged.withColumns({"last_batch": F.lit(None).cast("bigint"), "last_change": F.lit(None).cast("string")})
        changed = F.col("_old") == 0
        out = merged.withColumns({
            "last_change": F.when(changed, F.when(F.col("_known") == 1, "updated").otherwise("added")).otherwise(F.col("last_change")),
            "last_batch": F.when(changed, F.lit(number).cast("bigint")).otherwise(F.col("last_batch")),
        }).drop("_old", "_known").withColumn("slot", slot)
        out.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/rows/version={number}")
        entry = spark.createDataFrame([(s, number) for s in touched], "slot STRING, version BIGINT")
        if ledger is not None:
            entry = entry.unionByName(ledger.join(entry.select("slot"), "slot", "left_anti"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={number}")

    @staticmethod
    def _stored_schema(new: DataFrame):
        return new.withColumns({"last_batch": F.lit(0).cast("bigint"), "last_change": F.lit("")}).schema

    def current(self, spark: SparkSession, schema) -> DataFrame:
        """The rows of all slots, with ``last_batch`` and ``last_change``; ``schema`` is that of the merged rows."""
        stored = self._stored_schema(spark.createDataFrame([], schema))
        ledger = self._ledger(spark)
        if ledger is None:
            return spark.createDataFrame([], stored)
        return self._rows(spark, [(r.slot, r.version) for r in ledger.collect()], stored)

    def changes(self, spark: SparkSession, schema, number: int) -> DataFrame:
        """What batch ``number`` added and updated, as the rows were after it."""
        stored = self._stored_schema(spark.createDataFrame([], schema))
        rows = spark.read.schema(stored).parquet(f"{self.path}/rows/version={number}")
        return rows.filter(F.col("last_batch") == number)


def _joined(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which any may be NULL."""
    named = more.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in more.columns if c not in keys])
    alike = F.lit(True)
    for k in keys:
        alike = alike & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return rows.join(named, alike, "left").drop(*[f"_j_{k}" for k in keys])
