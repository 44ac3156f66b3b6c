"""What the operators of this folder share: the shared folder, column names, labelled samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}  # folders of local sessions without the setting, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session without that setting runs on one machine (tests), where a local folder is shared by all.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        application = spark.sparkContext.applicationId
        folder = _LOCAL.setdefault(application, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _LOCAL[application] = folder
    return folder.rstrip("/")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so (in any case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def write_out(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: they outlive lost executors and are computed once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(text_or_empty(id_column).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labelled: DataFrame, per_label: int, labels: int, most_chars: int, most_text: int = 160_000_000):
    """A bounded pandas frame ``id, label, text``: at most ``per_label`` ids of each of the ``labels`` most frequent labels.

    ``docs`` has ``id, text``, ``labelled`` has ``id, label``; null ids, labels and texts take no part. A label's ids are
    those with the smallest hashes, so the sample follows the rows and not their places. A threshold on the hash, set
    from the label's approximate number of ids, leaves about twice as many as are needed before any rank is taken. An id
    under several labels counts for the least of those that it is a candidate for; of rows that repeat an id the least
    text is taken. Texts over ``most_chars`` characters are left out. Where ``labels`` present labels of that many texts
    could exceed ``most_text`` characters in all, fewer ids are taken of each.
    """
    labelled = labelled.select("id", "label").where("id IS NOT NULL AND label IS NOT NULL")
    counted = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id", 0.02).alias("ids"))
    frequent = counted.orderBy(F.desc("n"), "label").limit(labels).collect()
    schema = f"id {docs.schema['id'].dataType.simpleString()}, label {labelled.schema['label'].dataType.simpleString()}, text string"
    if not frequent:
        return docs.sparkSession.createDataFrame([], schema).toPandas()
    per_label = max(1, min(per_label, most_text // (len(frequent) * most_chars)))
    share = F.lit(None).cast("double")
    for row in frequent:
        share = F.when(F.col("label") == row["label"], (2.0 * per_label + 200) / row["ids"]).otherwise(share)
    hashed = labelled.withColumn("h", F.xxhash64("id")).where(F.col("h") / F.lit(2.0**64) + 0.5 < share)
    one = hashed.groupBy("id", "h").agg(F.min("label").alias("label"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h", "id")))
    chosen = ranked.where(F.col("rank") <= per_label).select("id", "label")
    texts = docs.select("id", "text").where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # per_label x labels ids
    return found.toPandas().sort_values(["label", "id"]).reset_index(drop=True)


def cross_entropy_score(value):
    """The logistic function of an array, without overflow."""
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(value, -60.0, 60.0)))
