"""Tables of the shared folder that a loop replaces, and the global order of rows over partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder


class Scratch:
    """One folder of written tables. A loop drops the tables that it has replaced."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame) -> DataFrame:
        """The rows, read back from Parquet: computed once, and kept when executors are lost."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete a table that :meth:`write` returned and nothing reads any more."""
        held, path = self.paths[id(table)]
        if path is not None:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            self.paths[id(table)] = (held, None)


def range_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in the order of ``keys`` over all partitions, with ``_part`` and ``_row`` (the place in the partition).

    Nulls come first and strings are compared by their UTF-8 bytes. The range bounds come from Spark's own sample of the
    keys, which reads ``df`` twice: pass a written table. ``_part`` and ``_row`` hold for one run: write the result.
    """
    ordered = df.repartitionByRange(*[F.asc(k) for k in keys]).sortWithinPartitions(*keys)
    return ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
