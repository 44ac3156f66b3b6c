"""SQL functions that return tables (§2.13): parts and segments of the manifests of a corpus.

A table function is expanded by the analyzer into the plan of the operator behind it, so ``SELECT * FROM hls_parts()`` is
what the DataFrame form is. With an argument it gives the rows of one manifest; after ``LATERAL`` it becomes a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import dash, hls


def _define(spark: SparkSession, name: str, rows: DataFrame) -> None:
    view = f"_{name}_rows"
    rows.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(wanted STRING DEFAULT NULL) RETURNS TABLE ({columns})"
        f" RETURN SELECT * FROM {view} WHERE {name}.wanted IS NULL OR {view}.manifest_id = {name}.wanted"
    )


def register_table_functions(spark: SparkSession, manifests: DataFrame) -> list[str]:
    """Create ``hls_parts``, ``hls_variants`` and ``dash_segments`` over ``manifests`` (``manifest_id, url, kind, body``).

    The session's functions and views of these names are replaced. Names are returned.
    """
    lists = hls.split_playlists(manifests.filter(F.col("kind") == K.HLS))
    media = lists.filter(F.col("playlist_role") == "media")
    masters = lists.filter(F.col("playlist_role") == "master")
    parsed = dash.parse_manifests(manifests.filter(F.col("kind") == K.DASH))
    tables = {
        "hls_parts": hls.hls_parts(media),
        "hls_variants": hls.hls_master_variants(masters),
        "dash_segments": dash.dash_segments(dash.dash_representations(parsed)),
    }
    for name, rows in tables.items():
        _define(spark, name, rows)
    return list(tables)
