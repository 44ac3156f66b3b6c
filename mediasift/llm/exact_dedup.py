"""Exact dedup: equal texts are found by a 128-bit content hash and then compared byte by byte.

Only built-in expressions. Rows are counted per hash (partial sums in every map task, so a group that holds a third
of the rows sends one row per task); texts move once, into a join with the hashes that occur twice, and the least and the
greatest text of a hash are compared, by map tasks first where a hash has very many rows. Hashes whose texts differ are
grouped again by the texts themselves.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, write_out

MOST_TOGETHER = 20_000  # rows of one hash that are compared in one task


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. For text of one-byte characters that is ``lower``, which is much faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", hashed=content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty. Of a group the ``smallest`` or ``largest`` id stays; null ids stay only where a group
    has no other. Rows that repeat both id and text share one verdict. Other columns of ``docs`` are not read, so their
    names cannot clash. An empty table gives an empty result. ``hashed`` can be replaced to test collisions.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    stays = F.min if keep == "smallest" else F.max
    text = lower_ascii(text_or_empty(F.col(text_column)))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("norm")).withColumn("h", hashed(F.col("norm")))

    prints = write_out(rows.select("doc_id", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")))
    groups = write_out(prints.groupBy("h").agg(stays("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")))
    collided = write_out(_collided(rows, groups.where("n > 1")))

    found = prints.join(groups, "h")
    if not collided.isEmpty():
        exact = (
            rows.join(collided, "h", "left_semi").groupBy("h", "norm")
            .agg(stays("doc_id").alias("keep2"), F.count(F.lit(1)).alias("n2"))
            .select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep2", "n2")
        )
        found = found.join(exact, ["h", "sha"], "left").withColumns(
            {"keep": F.when(F.col("n2").isNull(), F.col("keep")).otherwise(F.col("keep2")), "n": F.coalesce("n2", "n")}
        )
    return found.select(
        "doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _collided(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes under which not all bytes are equal: the least and the greatest text of the hash differ.

    The aggregation is dealt by the hash like the join below it, so texts move once. Hashes of more than ``MOST_TOGETHER``
    rows are few (at most one in so many rows) and take a join of their own, which Spark broadcasts by the size of their
    written table: map tasks then send two texts of such a hash and no group meets in one task.
    """

    def unequal(hashes: DataFrame) -> DataFrame:
        texts = rows.join(hashes.select("h"), "h").groupBy("h").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
        return texts.where(F.col("least") != F.col("greatest")).select("h")

    crowded = write_out(repeated.where(F.col("n") > MOST_TOGETHER))
    found = unequal(repeated.where(F.col("n") <= MOST_TOGETHER))
    return found if crowded.isEmpty() else found.unionByName(unequal(crowded))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with its own columns, without the rows whose text another row keeps.

    Rows with a null id stay (they cannot be told apart); a repeated row (same id and text) stays as often as it stood.
    """
    groups = exact_groups(docs, id_column, text_column, keep)
    dropped = groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_dropped_id"), F.unhex("text_sha256").alias("_dropped_sha")
    ).distinct()
    text = lower_ascii(text_or_empty(docs[text_column]))
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    return docs.join(dropped, (docs[id_column] == F.col("_dropped_id")) & (sha == F.col("_dropped_sha")), "left_anti")
