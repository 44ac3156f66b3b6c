"""The smoothed transfer rate of every sample, for jobs of any length.

A meter adds up bytes until half a second has passed since its window opened; the sample that brings that about closes
the window, counts in it and opens the next one. A closed window's rate moves the smoothed one: 0.6 old + 0.4 new.
Told like that a job is a fold from its first sample to its last. Two facts make it parallel:

* The sample that closes a window depends only on when the window opened: it is the first one, in order, whose time is
  half a second later. So every sample has a fixed successor, and the windows of a job are the path of successors from
  its start. The path is found by pointer jumping: with pointers that reach 1, 2, 4, ... windows ahead, what has been
  reached doubles every round.
* What a window does to the smoothed rate is an affine map, or the window's own rate where there is none yet. Such maps
  compose into maps of the same kind, so rates come from a prefix scan: maps of 64 windows are combined into one, those
  again, and the rates go back down the same levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Carry, CHUNK_ROWS, cut_evenly, running
from .written import written

WINDOW_US = 500_000
OLD, NEW = 0.6, 0.4
FAN = 64
LEAST = 5e-324  # a positive rate stays positive, however long nothing arrives


def _successors(records: DataFrame, asked: DataFrame) -> DataFrame:
    """``job_id, at, next_at, next_n``: the first record of the job at ``at`` + half a second or later; without one no row.

    ``records`` (``job_id, at, n``) are samples later than all before them; only such a sample can close a window. A
    record half a second later lies in the next half-second cell or behind it, so cells are searched apart and one
    record per cell is carried back over the cells that have none.
    """
    cell = F.floor(F.col("x") / WINDOW_US)
    targets = records.select("job_id", F.col("at").alias("x"), F.lit(1).alias("is_record"), F.struct("at", "n").alias("record"), F.lit(None).cast("bigint").alias("from"))
    queries = asked.select("job_id", (F.col("at") + WINDOW_US).alias("x"), F.lit(0).alias("is_record"), F.lit(None).cast("struct<at:bigint,n:bigint>").alias("record"), F.col("at").alias("from"))
    both = targets.unionByName(queries).withColumn("cell", cell)
    # A cell holds at most half a million records, as times are whole microseconds.
    behind = Window.partitionBy("job_id", "cell").orderBy("x", "is_record").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("here", F.min("record").over(behind)).filter("is_record = 0")
    cells = both.groupBy("job_id", "cell").agg(F.min("record").alias("first")).withColumn("back", -F.col("cell"))
    later = running(cells, ["job_id"], ["back"], None, {"later": Carry("last", F.col("first"), inclusive=False)})
    joined = found.join(later.select("job_id", "cell", "later"), ["job_id", "cell"])
    out = joined.withColumn("next", F.coalesce("here", "later")).filter(F.col("next").isNotNull())
    return out.select("job_id", F.col("from").alias("at"), F.col("next.at").alias("next_at"), F.col("next.n").alias("next_n"))


def window_closings(records: DataFrame, starts: DataFrame) -> DataFrame:
    """``job_id, n, closed, opened``: the samples that close windows, found by pointer jumping from every job's start."""
    nodes = records.select("job_id", "at").unionByName(starts.select("job_id", F.col("start").alias("at"))).distinct()
    step = written(_successors(records, nodes))
    reached = written(starts.select("job_id", F.col("start").alias("at")))
    pointers = step.select("job_id", "at", F.col("next_at").alias("to"))
    while not pointers.isEmpty():
        further = reached.join(pointers, ["job_id", "at"]).select("job_id", F.col("to").alias("at"))
        reached = written(reached.unionByName(further))
        onward = pointers.select("job_id", F.col("at").alias("to"), F.col("to").alias("far"))
        pointers = written(pointers.join(onward, ["job_id", "to"]).select("job_id", "at", F.col("far").alias("to")))
    return reached.join(step, ["job_id", "at"]).select("job_id", F.col("next_n").alias("n"), F.col("next_at").alias("closed"), F.col("at").alias("opened"))


def _combined(maps: Column) -> Column:
    """The map that a list of maps makes one after the other. ``a, b``: rate -> a rate + b; ``c``: the rate from nothing."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    return F.aggregate(maps, start, lambda s, m: F.struct(
        (s["a"] * m["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b"), _applied(m, s["c"]).alias("c")))


def _applied(m: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.greatest(m["a"] * rate + m["b"], F.lit(LEAST))).otherwise(m["c"])


def rate_scan(maps: DataFrame) -> DataFrame:
    """``job_id, k, before``: the rate that arrives at map ``k`` of each job (0, 1, ...), for ``job_id, k, m``.

    Up: 64 neighbours become one map, until every job is one. Down: the rate that arrives at a group of 64 arrives at its
    first, and goes on from each to the next.
    """
    levels, top = [maps], maps.agg(F.max("k")).first()[0] or 0
    while top >= FAN:
        groups = levels[-1].groupBy("job_id", F.floor(F.col("k") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("list"))
        levels.append(written(groups.select("job_id", F.col("up").alias("k"), _combined(F.transform("list", lambda x: x["m"])).alias("m"))))
        top //= FAN
    before = None
    for level in reversed(levels):
        groups = level.groupBy("job_id", F.floor(F.col("k") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("list"))
        if before is None:
            groups = groups.withColumn("rate", F.lit(0.0))
        else:
            groups = groups.join(before.select("job_id", F.col("k").alias("up"), F.col("before").alias("rate")), ["job_id", "up"])
        first = F.struct(F.col("rate").alias("now"), F.array().cast("array<struct<k:bigint,before:double>>").alias("all"))
        passed = F.aggregate("list", first, lambda s, x: F.struct(
            _applied(x["m"], s["now"]).alias("now"), F.array_append(s["all"], F.struct(x["k"].alias("k"), s["now"].alias("before"))).alias("all")))
        before = groups.select("job_id", F.explode(passed["all"]).alias("r")).select("job_id", "r.k", "r.before")
    return before


def smoothed_rate(samples: DataFrame, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """``job_id, seq, bytes_per_second`` after every sample, equal to the fold of ``stream_rate``.

    ``samples`` have ``job_id, seq, ts, bytes`` (of the sample) and ``started_at``, of which the first sample's counts.
    Rows with one sequence number are ordered by time and size. Until a window has closed with bytes in it the rate is
    the overall one. A job may hold any share of the rows; nothing passes through one task but one row per chunk.
    """
    rows = samples.select("job_id", "seq", F.unix_micros("ts").alias("t"), F.col("bytes").alias("size"), F.unix_micros("started_at").alias("began"))
    order = ["seq", "t", "size"]
    cut = cut_evenly(rows, ["job_id"], "seq", "part", rows_per_chunk)
    rows = written(running(cut, ["job_id"], order, F.col("part"), {
        "n": Carry("count", F.lit(1)), "total": Carry("sum", F.col("size")), "latest": Carry("max", F.col("t"), inclusive=False),
    }))
    starts = written(rows.filter("n = 1").select("job_id", F.coalesce("began", "t").alias("start")))
    records = rows.filter("latest IS NULL OR t > latest").select("job_id", F.col("t").alias("at"), "n")
    closings = written(window_closings(records, starts))

    marked = rows.join(closings, ["job_id", "n"], "left")
    flag = F.when(F.col("closed").isNotNull(), 1).otherwise(0)
    counted = written(running(marked, ["job_id"], ["n"], F.col("part"), {
        "k": Carry("sum", flag, inclusive=False), "closed_so_far": Carry("sum", flag),
    }).withColumn("k", F.coalesce("k", F.lit(0))))
    windows = counted.groupBy("job_id", "k").agg(F.sum("size").alias("size"), F.max("closed").alias("closed"), F.max("opened").alias("opened"))
    speed = F.col("size") / ((F.col("closed") - F.col("opened")) / F.lit(1e6))
    mapped = F.struct(F.lit(OLD).alias("a"), (F.col("s") * NEW).alias("b"), F.col("s").alias("c"))
    maps = written(windows.filter("closed IS NOT NULL").withColumn("s", speed).select("job_id", "k", mapped.alias("m")))
    scanned = rate_scan(maps).join(maps, ["job_id", "k"])
    after = scanned.select("job_id", (F.col("k") + 1).alias("closed_so_far"), _applied(F.col("m"), F.col("before")).alias("rate"))

    told = counted.join(after, ["job_id", "closed_so_far"], "left").join(starts, "job_id")
    since = (F.col("t") - F.col("start")) / F.lit(1e6)
    overall = F.when((since > 0.1) & (F.col("total") > 0), F.col("total") / since).otherwise(0.0)
    return told.select("job_id", "seq", F.when(F.col("rate") > 0, F.col("rate")).otherwise(overall).alias("bytes_per_second"))
