"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, its target share of the corpus over its present share. A document's count is
the inverse of the Poisson distribution with that mean at a number in [0, 1) that a hash of the seed and the document
gives, so the same corpus is drawn by every run and by every attempt of a task. Copies are generated after the count is
known and dealt out by a hash of their own: the order within and between partitions has nothing to do with the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, text_or_empty, write_out

TWO_52 = float(2**52)


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of an MD5 over seed and parts."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def source_rates(docs: DataFrame, source_column: str = "source", temperature: float = 0.5, weights: dict[str, float] | None = None, length: float = 1.0) -> DataFrame:
    """``source, n, rate``: the mean number of copies of a document of each source.

    Target weights are the given ones (sources without one get 0), or the present sizes to the power ``temperature``.
    The mixed corpus has ``length`` times the documents of the present one, on average. A null source is a source of
    its own. One row per source: the counts are summed in the map tasks first, so a hot source does not weigh.
    """
    counts = docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("weight", weight)
    totals = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    rate = F.lit(float(length)) * F.col("weight") / F.col("all_weight") * F.col("all_n") / F.col("n")
    return weighted.join(F.broadcast(totals)).select("source", "n", F.when(F.col("all_weight") > 0, rate).otherwise(0.0).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a Poisson variable, up to where a double no longer tells them from 1.

    Logarithms keep large means from underflow; the list has some mean + 10 standard deviations entries and belongs to
    a source, not to a document.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps")
    )

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(state["steps"], total).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["steps"])).otherwise(F.array(F.lit(1.0)))


def replicate(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", seed: str = "mix", rates: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with its own columns and ``_copy`` (0, 1, ...) and ``_order`` (the key of the global shuffle).

    ``rates`` are those of :func:`source_rates` unless given. A document that draws 0 is absent, one that draws k comes
    k times; no draw is cut off. Null ids count as the empty id, so rows that repeat an id draw the same number. An
    empty table stays empty. Where ``docs`` has a column of an added name, the added one gets underscores
    behind it.

    The steps of all sources are one small row each. They are written out first, so Spark sees how small they are and
    texts are not dealt by source; where sources are too many to broadcast, adaptive execution splits the hot ones.
    """
    taken = docs.columns
    u, n, own_source, own_steps = (free_name(x, taken) for x in ("_u", "_n", "_source", "_steps"))
    copy, order = free_name("_copy", taken), free_name("_order", taken)
    rates = source_rates(docs, source_column, **options) if rates is None else rates
    steps = write_out(rates.select(F.col("source").alias(own_source), poisson_steps(F.col("rate")).alias(own_steps)))
    drawn = docs.withColumn(u, uniform(seed, text_or_empty(docs[id_column])))
    joined = drawn.join(steps, F.col(source_column).eqNullSafe(F.col(own_source)))
    counted = joined.withColumn(n, F.size(F.filter(own_steps, lambda s: s <= F.col(u)))).where(F.col(n) > 0)
    copies = counted.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    ordered = copies.withColumn(order, F.xxhash64(F.lit(seed), F.col(id_column), F.col(copy)))
    return ordered.repartition(order).sortWithinPartitions(order)
