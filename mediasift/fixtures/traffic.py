"""Traffic rendered from ``events``: one observed response per event.

The text runs in Spark SQL and DuckDB alike (``{events}`` is the table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import from_sql

RESPONSES_SQL = """
SELECT event_id AS request_id, event_id AS seq, ts, user_id AS page_id,
 concat('https://site', CAST(user_id % 5 AS VARCHAR(10)), '.example.com/watch/', CAST(user_id AS VARCHAR(10))) AS page_url,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('Page ', CAST(user_id AS VARCHAR(10))) END AS page_title,
 concat('https://',
   CASE WHEN event_id % 19 = 0 THEN 'pubads.g.doubleclick.net'
        ELSE concat('cdn', CAST(user_id % 4 AS VARCHAR(10)), '.example.com') END,
   '/v', CAST(user_id % 7 AS VARCHAR(10)),
   CASE event_type WHEN 'click'    THEN concat('/seg-', CAST(event_id % 50 AS VARCHAR(10)), '.ts')
                   WHEN 'view'     THEN '/master.m3u8'
                   WHEN 'signup'   THEN '/manifest.mpd'
                   WHEN 'purchase' THEN concat('/movie', CAST(event_id % 9 AS VARCHAR(10)), '.mp4')
                   ELSE '/track.mp3' END,
   '?token=t', CAST(event_id AS VARCHAR(20)), '&q=', CAST(event_id % 3 AS VARCHAR(10))) AS url,
 CASE event_type WHEN 'click' THEN 'video/mp2t' WHEN 'view' THEN 'text/plain'
                 WHEN 'signup' THEN 'application/dash+xml; charset=utf-8'
                 WHEN 'purchase' THEN 'video/mp4' ELSE NULL END AS mime_type,
 CASE WHEN event_id % 23 = 0 THEN 'Media' ELSE 'XHR' END AS resource_type,
 CAST(round(value * 1000) AS BIGINT) AS content_length,
 CASE WHEN event_id % 4 = 0 THEN concat('s=', CAST(event_id AS VARCHAR(20))) ELSE NULL END AS cookie,
 event_type
FROM {events}
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = from_sql(spark, sf_dir, RESPONSES_SQL, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))
