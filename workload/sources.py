"""Sources, sinks and small operators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mediasift.fixtures import records as D
from mediasift.fixtures import traffic as T
from mediasift.fixtures.tables import table
from mediasift.functions import classify as K
from mediasift.functions import text as X
from mediasift.functions import urls as U
from mediasift.functions.sql import register_sql_functions
from mediasift.operators import detection, inspection, ordered, variants
from mediasift.operators.written import shared_folder
from mediasift.sinks import writers
from mediasift.sources import readers

from .records import E_CTE
from .registry import query
from .traffic import R_CTE


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/mediasift-{uuid.uuid4().hex}"


@query("read_app_log", f"""WITH {E_CTE}, l AS (
SELECT seq * 2 AS line_no, level, source, 0 AS continuation,
 concat('[job', page_id, '] GET ', url, CASE WHEN seq % 5 = 0 THEN concat(' Cookie: sid=', seq) ELSE ' done' END) AS message FROM e
UNION ALL SELECT seq * 2 + 1, level, source, 1, concat('IOException: part ', seq) FROM e WHERE seq % 13 = 0)
SELECT level, source, continuation, message FROM l""")
def read_app_log(spark, sf_dir):
    """One log file per day, written whole and read in pieces of 64 KiB."""
    lines = D.log_lines(spark, sf_dir)
    files = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    folder = new_folder(spark)
    files.repartition("file").write.partitionBy("file").text(folder)
    parsed = readers.read_app_log(spark, folder, piece_bytes=65_536)
    return parsed.select("level", "source", F.col("is_continuation").cast("int").alias("continuation"), "message")


@query("tail_lines", r"""
SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> '')[-12:], lambda x: regexp_replace(x, '[ \t\n\f\r\x0B]+$', '')), chr(10)), '') AS tail FROM documents""")
def tail_lines(spark, sf_dir):
    rows = inspection.tail_lines(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", F.coalesce("tail", F.lit("")).alias("tail"))


@query("short_urls", "SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE concat(left(text, 60), '...', right(text, 25)) END AS short FROM documents")
def short_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.short_url(F.col("text")).alias("short"))


@query("first_observations", f"WITH {R_CTE} SELECT page_id AS target, url, min(seq) AS ordinal FROM r GROUP BY 1, 2")
def first_observations(spark, sf_dir):
    rows = T.responses(spark, sf_dir).select(F.col("page_id").alias("target"), "url", F.col("seq").alias("ordinal"))
    return detection.first_observations(rows)


@query("carry_forward", f"WITH {R_CTE} SELECT seq, last_value(CASE WHEN seq % 7 = 0 THEN url END IGNORE NULLS) OVER (PARTITION BY page_id % 3 ORDER BY seq) AS url FROM r")
def carry_forward(spark, sf_dir):
    rows = T.responses(spark, sf_dir).select((F.col("page_id") % 3).alias("k"), "seq", F.when(F.col("seq") % 7 == 0, F.col("url")).alias("url"))
    return ordered.carry_forward(rows, "url", ["k"], ["seq"], ordered.by_count("seq", 1000)).select("seq", "url")


@query("top_n_with_rest", """
WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, max(total) AS total, greatest(max(total) - 3, 0) AS rest,
 concat(string_agg(CASE WHEN k <= 3 THEN CAST(l_partkey AS VARCHAR) END, '; ' ORDER BY k), CASE WHEN max(total) > 3 THEN concat('; +', max(total) - 3) ELSE '' END) AS summary FROM n GROUP BY 1""")
def top_n_with_rest(spark, sf_dir):
    order = [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"]
    ranked = ordered.top_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 1_000_000, "k").withColumn("name", F.col("l_partkey").cast("string"))
    return variants.top_n_with_rest(ranked, ["l_orderkey"], "k", "name").select("l_orderkey", "total", "rest", "summary")


@query("hidden_extensions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 1 THEN '.mp4' WHEN 2 THEN '.m3u8' ELSE '' END AS extension, CAST(l_linenumber % 3 <> 0 AS INTEGER) AS fragment FROM lineitem""")
def hidden_extensions(spark, sf_dir):
    """Extensions in query values, names of fragments."""
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    q = F.when(n % 4 == 1, F.concat(F.lit("id="), part, F.lit("&file=a.b.mp4"))).when(n % 4 == 2, F.lit("u=x%2Fy%2Em3u8%3Fs%3D1")).when(n % 4 == 3, F.lit("v=1.longextension")).otherwise(F.lit(""))
    path = F.when(n % 3 == 1, F.concat(F.lit("/v/seg-"), part, F.lit(".m4s"))).when(n % 3 == 2, F.concat(F.lit("/v/"), part)).otherwise(F.concat(F.lit("/v/part"), part, F.lit(".mp4")))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", U.extension_from_query(q).alias("extension"), K.looks_like_fragment(path).cast("int").alias("fragment")
    )


@query("resume_identities", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(p_size % 5, '|u', p_partkey, '|', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('v', p_partkey) END, '||bytes=0-', p_size) END AS identity FROM part""")
def resume_identities(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    last = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("v"), key))
    identity = X.resume_identity(F.col("p_size") % 5, F.concat(F.lit("u"), key), last, F.lit(None).cast("string"), F.concat(F.lit("bytes=0-"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", identity.alias("identity"))


@query("write_table", f"WITH {R_CTE} SELECT seq, event_type, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS round FROM r")
def write_table(spark, sf_dir):
    """K4: a second write replaces the partition that it has rows of, and no other."""
    rows, folder = T.responses(spark, sf_dir).select("seq", "event_type"), new_folder(spark)
    writers.write_table(rows.withColumn("round", F.lit(1)), folder, ["event_type"])
    writers.write_table(rows.filter("event_type = 'view'").withColumn("round", F.lit(2)), folder, ["event_type"])
    return spark.read.parquet(folder).select("seq", "event_type", "round")


@query("sql_functions", f"""WITH {R_CTE}
SELECT seq, concat(CASE WHEN request_id % 19 = 0 THEN 'pubads.g.doubleclick.net' ELSE concat('cdn', page_id % 4, '.example.com') END, '/v', page_id % 7) AS family, left(sha256(url), 16) AS id FROM r""")
def sql_functions(spark, sf_dir):
    register_sql_functions(spark)
    T.responses(spark, sf_dir).createOrReplaceTempView("_responses")
    return spark.sql("SELECT seq, family_key(url) AS family, stable_id(url) AS id FROM _responses")
