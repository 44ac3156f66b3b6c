"""Running a stream over what there is and reading the result as a table."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = {
    PROVIDER: ROCKSDB,
    # Every store of every partition would set 4 MB aside for its own log, and a join has four stores but for format 3, which has one.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    # What a store holds lies on disk twice, where it is used and in the checkpoint.
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``."""
    return f"{written.shared_folder(spark)}/mediasift-{uuid.uuid4().hex}"


@contextmanager
def rocksdb(spark: SparkSession):
    """A query that is started inside takes RocksDB as its state store; the session keeps its own settings."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Process all available input and return what was emitted.

    Each batch is a folder of its own that is written whole, so a batch run
    again after a failure replaces itself. ``batch_no`` tells them apart.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    columns = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_no={number}")

    with rocksdb(spark):
        started = (
            stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
    started.awaitTermination()
    schema = StructType([*columns.fields, StructField("batch_no", IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
