"""Tables that an operator writes on its way, where a plan would otherwise grow with every round of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # folders of local sessions without the setting, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without it a local one, on one machine only: a cluster cannot share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[application]


def written(df: DataFrame) -> DataFrame:
    """The rows, read back from a table in the shared folder: computed once, and kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/mediasift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
