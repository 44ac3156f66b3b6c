"""Ordered operators over groups of any size.

``Window.partitionBy(key)`` puts a whole group into one task, which is fine for
the lines of one manifest (a group is at most one text) and wrong for a log
file, a busy job or a popular file name, any of which may hold a third of the
data. The functions here cut such a group into chunks along its own order,
work inside the chunks in parallel, and carry one summary row per chunk across:

1. a window inside (group, chunk) gives the value as far as the chunk knows it;
2. a partial aggregate gives each chunk's total;
3. a window over the totals (one row per chunk) gives what came before it;
4. a join on (group, chunk) adds the two. The details already lie on that key,
   so only the totals move.

The chunk is a value computed from the row, so a task that is run again after
a lost executor makes the same chunks. Where a row has no number that is evenly
spread (sparse sequence numbers, a busy hour), :func:`cut_evenly` measures large
groups first and cuts them at quantiles of their own order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of an evenly numbered group that share a chunk.
CHUNK_ROWS = 250_000


@dataclass(frozen=True)
class Carry:
    """One running value. ``kind`` is sum, count, max or last (last value that is not NULL)."""

    kind: str
    value: Column
    inclusive: bool = True


def by_count(position: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk by an increasing number such as a sequence or line number."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(rows))


def by_time(ts: str | Column, seconds: int = 3600) -> Column:
    """Chunk by a stretch of time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def cut_evenly(df: DataFrame, keys: Sequence[str], position: str, name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the number ``name`` of each row's chunk: about ``rows`` rows of a group share one.

    Groups of up to ``rows`` rows are one chunk. A quantile sketch of ``position`` (a number or timestamp) gives a larger
    group its splitters, at most one per ``rows`` rows and 1,023 in all. So there are fewer splitters than one per
    ``rows`` rows of the table, which is what is broadcast. Rows at one position share a chunk, NULL comes first.
    """
    kind = df.schema[position].dataType.typeName()
    place = F.unix_micros(position) if kind == "timestamp" else F.col(position).cast("bigint")
    groups = df.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.lit(0).alias("_all"), place.alias("_place"))
    group = [f"_g{i}" for i in range(len(keys))] + ["_all"]
    large = groups.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    measured = groups.alias("a").join(F.broadcast(large.alias("b")), same).select("a.*", "_n").groupBy(*group).agg(
        F.min("_n").alias("_n"), F.percentile_approx("_place", [i / 1024 for i in range(1, 1024)], 20_000).alias("_q")
    )
    parts = F.least(F.lit(1024), F.ceil(F.col("_n") / rows))
    taken = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_q", F.greatest(F.lit(1), F.round(i * 1024 / parts).cast("int"))))
    # Every 32nd splitter finds the stretch of splitters that a row is compared with.
    measured = measured.select(*group, F.array_distinct(taken).alias("_cuts")).withColumn(
        "_coarse", F.filter("_cuts", lambda s, i: i % 32 == 31)
    )
    alike = F.lit(True)
    for i, k in enumerate(keys):
        alike = alike & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    passed = F.size(F.filter("_coarse", lambda s: s < place)) * 32
    chunk = passed + F.size(F.filter(F.slice("_cuts", passed + 1, 32), lambda s: s < place))
    marked = df.join(F.broadcast(measured), alike, "left")
    return marked.select(*df.columns, F.when(F.col("_cuts").isNull() | place.isNull(), 0).otherwise(chunk).alias(name))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    carries: dict[str, Carry],
    rows_per_chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running values per group. ``chunk`` must not decrease along ``order``.

    Without ``chunk`` large groups are cut evenly along the first column of ``order``.
    """
    if chunk is None:
        cut = cut_evenly(df, keys, order[0], "_even", rows_per_chunk)
        return running(cut, keys, order, F.col("_even"), carries).drop("_even")
    rows = df.select("*", chunk.alias("_chunk"))
    inputs = {f"_in_{name}": carry.value for name, carry in carries.items()}
    rows = rows.withColumns(inputs)

    group = [*keys, "_chunk"]
    ordered = Window.partitionBy(*group).orderBy(*order)
    until = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # One row per chunk: what is left of a group after aggregation.
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    position = F.struct(*order)
    local, totals, prefix = {}, [], {}
    for name, carry in carries.items():
        frame = until if carry.inclusive else before
        value = F.col(f"_in_{name}")
        if carry.kind == "last":
            local[name] = F.last(value, ignorenulls=True).over(frame)
            totals.append(
                F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_total_{name}")
            )
            prefix[f"_before_{name}"] = F.last(f"_total_{name}", ignorenulls=True).over(earlier)
        else:
            function = {"sum": F.sum, "count": F.count, "max": F.max}[carry.kind]
            local[name] = function(value).over(frame)
            totals.append(function(value).alias(f"_total_{name}"))
            merge = F.max if carry.kind == "max" else F.sum
            prefix[f"_before_{name}"] = merge(f"_total_{name}").over(earlier)

    summary = (
        rows.groupBy(*group)
        .agg(*totals)
        .withColumns(prefix)
        .select(*[F.col(c).alias(f"_k_{c}") for c in group], *prefix)
    )
    detail = rows.withColumns(local)
    same_chunk = F.lit(True)
    for column in group:
        same_chunk = same_chunk & F.col(column).eqNullSafe(F.col(f"_k_{column}"))
    joined = detail.join(summary, same_chunk, "left")

    merged = {}
    for name, carry in carries.items():
        mine, earlier_value = F.col(name), F.col(f"_before_{name}")
        if carry.kind == "last":
            merged[name] = F.coalesce(mine, earlier_value)
        elif carry.kind == "max":
            merged[name] = F.greatest(mine, earlier_value)
        else:
            both = F.coalesce(mine, F.lit(0)) + F.coalesce(earlier_value, F.lit(0))
            merged[name] = F.when(mine.isNotNull() | earlier_value.isNotNull(), both)
            if carry.kind == "count":
                merged[name] = both
    return joined.withColumns(merged).select(*df.columns, *carries)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """``row_number`` over groups of any size."""
    return running(df, keys, order, chunk, {name: Carry("count", F.lit(1))})


def carry_forward(
    df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], chunk: Column, name: str | None = None
) -> DataFrame:
    """The last value that was not NULL, in order."""
    name = name or col
    carried = running(df, by, order, chunk, {"_carried": Carry("last", F.col(col))})
    return carried.withColumn(name, F.col("_carried")).drop("_carried")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group, NULL keys being equal.

    The filter on a row number becomes a group limit ahead of the shuffle, so
    each task sends at most one row per group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group with their rank, limited ahead of the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
