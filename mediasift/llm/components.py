"""Connected components by alternating large-star and small-star steps.

A step replaces every link by one to the smallest neighbour. A node's smallest neighbour is a minimum, which map tasks
fold before rows move, and is joined back to its links, so no list of neighbours is ever built; a hub's links are split
by adaptive execution. Every round is written to the shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_out


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.where("b > a").join(_smallest(both), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    joined = links.join(_smallest(links), "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(joined.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def connected_components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has a link to another; the component is its smallest node.

    Links may repeat, point either way or to themselves; null ends are ignored. Rounds grow with the logarithm of the
    longest path; more than ``most_rounds`` raise an error rather than return an unfinished answer.
    """
    ends = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), F.col(left).alias("l"), F.col(right).alias("r"))
    stars = write_out(ends.where("l IS NOT NULL AND r IS NOT NULL AND a > b").select("a", "b").distinct())
    seen = None
    for _ in range(most_rounds):
        stars = write_out(_small_star(_large_star(stars)))
        # Stars are settled when no round changes the sum of a hash over all links.
        state = stars.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    hubs = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(hubs)
