"""Exact Lloyd clustering of integer vectors, with Shallot search for the nearest centroid.

Every vector remembers its nearest and second-nearest centroid, an upper bound on the distance to the first and a lower
bound on the distance to any other. When the centroids have moved, both bounds are widened by the moves. A vector whose
bounds still keep the two apart is left alone. For others the exact distances to both remembered centroids are taken and
the search starts at the closer one: the other centroids are met in the order of their distance from it, inside a ball
of radius (own distance to the start + distance to the second-best so far), which shrinks whenever a better second is
found; behind it no centroid can be among the two nearest. Those that survive are compared by squared distances in 64-bit
integers, ties by the smaller number, so bounds decide what is looked at and never who wins.

A round is one pass over the vectors. It writes their state anew and adds, at the end of every task, one row of sums per
cluster; only k x components sums reach the driver, which divides them exactly. Every round's table replaces the one
before, in the shared folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Scratch

MOST = 1 << 27  # with components up to this, squared distances of 64 components fit 64 bits
SLACK = 1e-9  # relative error allowed for in every bound
SUMS = "c_cluster int, sums array<long>, n long"
STATE = "id long, v array<int>, cluster int, second int, upper double, lower double"


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, components: int = 64, scale: int = 256) -> DataFrame:
    """``id, v``: floor(scale * x) of every component, taken as double.

    Rows whose vector is null, has another number of components, or holds a null, NaN or infinite one are left out. Rows
    that repeat stay apart. A value beyond 2^27 ends the query, as no long could hold its distances.
    """
    kind = rows.schema[vector_column].dataType.elementType.simpleString()
    vector = F.col(vector_column) if kind in ("float", "double") else F.col(vector_column).cast("array<double>")

    def run(batches):
        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), components), False)
            batch = batch.filter(whole)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            x = flat.reshape(-1, components)
            finite = np.isfinite(x).all(axis=1)
            scaled = np.floor(scale * x[finite])
            if (np.abs(scaled) > MOST).any():
                raise ValueError("a component is too large for exact distances")
            ends = np.arange(0, scaled.size + 1, components, dtype=np.int32)
            v = pa.ListArray.from_arrays(pa.array(ends), pa.array(scaled.astype(np.int32).ravel()))
            yield pa.record_batch([batch.column("id").filter(pa.array(finite)), v], names=["id", "v"])

    return rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("v")).mapInArrow(run, "id long, v array<int>")


def hashed_seeds(vectors: DataFrame, k: int, prefix: str = "") -> list[list[int]]:
    """The vectors with the k smallest SHA-256 (hex) of prefix + id, in that order; equal ids by their components, null ids last."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return [row[0] for row in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()]


class Centroids:
    """Centroids with what the search needs: each one's neighbours by distance, and how far they have moved."""

    def __init__(self, values: np.ndarray, before: np.ndarray | None = None):
        self.values, self.k = values, len(values)
        apart = np.sqrt(((values[:, None, :] - values[None, :, :]) ** 2).sum(axis=2).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(apart, -1.0)  # itself first
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.gaps = np.take_along_axis(apart, self.order, axis=1)
        moves = np.zeros(self.k) if before is None else np.sqrt(((values - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        self.moves = moves
        # The largest move of any centroid other than c.
        self.other_moves = np.array([np.delete(moves, c).max(initial=0.0) for c in range(self.k)])

    def squared(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = vectors - self.values[which]
        return np.einsum("ij,ij->i", apart, apart)

    def assign(self, vectors: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """Exact nearest and second-nearest centroids and bounds from those of the round before. Counts what is compared."""
        upper, lower = upper + self.moves[first], lower - self.other_moves[first]
        first, second = first.copy(), second.copy()
        if self.k == 1:
            return first, second, upper, lower, 0
        open_ = np.flatnonzero(~(lower > upper))
        d1 = self.squared(vectors[open_], first[open_])
        upper[open_] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
        still = ~(lower[open_] > upper[open_])
        open_, d1 = open_[still], d1[still]
        x = vectors[open_]
        d2 = self.squared(x, second[open_])
        a, b = first[open_], second[open_]
        swap = (d2 < d1) | ((d2 == d1) & (b < a))
        a, b, d1, d2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, from_start = a.copy(), np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
        searching, compared = np.arange(len(open_)), 2 * len(open_)
        for j in range(1, self.k):
            reach = from_start[searching] + np.sqrt(d2[searching].astype(np.float64)) * (1 + SLACK)
            searching = searching[self.gaps[start[searching], j] <= reach]
            if not len(searching):
                break
            c = self.order[start[searching], j]
            new = (c != a[searching]) & (c != b[searching])
            at, c = searching[new], c[new]
            d = self.squared(x[at], c)
            compared += len(at)
            wins = (d < d1[at]) | ((d == d1[at]) & (c < a[at]))
            seconds = ~wins & ((d < d2[at]) | ((d == d2[at]) & (c < b[at])))
            w, s = at[wins], at[seconds]
            b[w], d2[w] = a[w], d1[w]
            a[w], d1[w] = c[wins], d[wins]
            b[s], d2[s] = c[seconds], d[seconds]
        first[open_], second[open_] = a, b
        upper[open_] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
        lower[open_] = np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
        return first, second, upper, lower, compared


def _vectors(batch: pa.RecordBatch, components: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, components).astype(np.int64)


def _pass(centroids: Centroids, begun: bool):
    """One round over a partition: states, then one row of sums per cluster that has vectors here."""
    components = centroids.values.shape[1]

    def run(batches):
        sums, counts = np.zeros_like(centroids.values), np.zeros(centroids.k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _vectors(batch, components)
            if begun:
                state = [batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")]
            else:
                state = [np.zeros(n, np.int32), np.full(n, min(1, centroids.k - 1), np.int32), np.full(n, np.inf), np.full(n, -np.inf)]
            first, second, upper, lower, _ = centroids.assign(x, *state)
            member = (np.arange(centroids.k)[:, None] == first[None, :]).astype(np.float64)
            sums += np.rint(member @ x).astype(np.int64)  # exact: a batch's sums stay under 2^53
            counts += np.bincount(first, minlength=centroids.k)
            own = [batch.column("id"), batch.column("v"), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.record_batch([*own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=NAMES)
        some = np.flatnonzero(counts)
        m = len(some)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
        yield pa.record_batch([*none, pa.array(some, pa.int32()), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(counts[some], pa.int64())], names=NAMES)

    return run


NAMES = ["id", "v", "cluster", "second", "upper", "lower", "c_cluster", "sums", "n"]


def _last(centroids: Centroids, begun: bool):
    components = centroids.values.shape[1]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = _vectors(batch, components)
            state = [batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")] if begun else [
                np.zeros(n, np.int32), np.full(n, min(1, centroids.k - 1), np.int32), np.full(n, np.inf), np.full(n, -np.inf)]
            first = centroids.assign(x, *state)[0]
            yield pa.record_batch([batch.column("id"), pa.array(first, pa.int32()), pa.array(centroids.squared(x, first), pa.int64())], names=["id", "cluster", "distance"])

    return run


@dataclass
class Clusters:
    """``rows``: ``id, cluster, distance`` (squared) of every vector, written; ``centroids``: those the distances are to."""

    rows: DataFrame
    centroids: list[list[int]]

    def inertia(self) -> DataFrame:
        """``cluster, cluster_inertia, centroid_sha256``: at most one row per centroid."""
        return self.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def lloyd(vectors: DataFrame, seeds: list[list[int]], rounds: int) -> Clusters:
    """``rounds`` times: assign every vector to its nearest centroid, then move centroids to the floor of their mean.

    ``vectors`` has ``id, v`` (see :func:`integer_vectors`); nothing else is read. A centroid without vectors stays where
    it is. Vectors are assigned once more at the end. Without seeds (an empty table) there are no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    if not seeds:
        return Clusters(vectors.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    values, before, table, begun = np.array(seeds, np.int64), None, vectors, False
    for _ in range(rounds):
        state = table.select(*(STATE_COLUMNS if begun else ["id", "v"]))
        written = scratch.write(state.mapInArrow(_pass(Centroids(values, before), begun), f"{STATE}, {SUMS}"))
        if begun:
            scratch.drop(written_before)
        written_before, table, begun = written, written.where("c_cluster IS NULL"), True
        parts = written.where("c_cluster IS NOT NULL").select("c_cluster", "n", F.posexplode("sums").alias("i", "s"))
        totals = parts.groupBy("c_cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        before, values = values, values.copy()
        for row in totals:
            values[row["c_cluster"], row["i"]] = int(row["s"]) // row["n"]
    last = table.select(*(STATE_COLUMNS if begun else ["id", "v"])).mapInArrow(_last(Centroids(values, before), begun), "id long, cluster int, distance long")
    return Clusters(scratch.write(last), values.tolist())


STATE_COLUMNS = ["id", "v", "cluster", "second", "upper", "lower"]


def with_inertia(found: Clusters) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector. Sums are longs."""
    spark = found.rows.sparkSession
    digests = found.digests()
    sums = {row[0]: row[1] for row in found.inertia().collect()}  # one row per centroid at most
    known = [(c, sums.get(c, 0), sum(sums.values()), d) for c, d in enumerate(digests)]
    named = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(named), "cluster")  # as many rows as centroids


def clusters(rows: DataFrame, id_column: str, vector_column: str, k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, prefix: str = "") -> DataFrame:
    """Integer vectors of ``rows``, clustered from ``k`` hashed seeds; see :func:`with_inertia` for the columns."""
    vectors = integer_vectors(rows, id_column, vector_column, components, scale)
    return with_inertia(lloyd(vectors, hashed_seeds(vectors, k, prefix), rounds))
