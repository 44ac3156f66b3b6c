"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into four segments with an index each. A query probes ever larger balls around its segments, one segment
at a time: once segments 0..j have been searched to radius r and the others to r - 1, every code within distance
4 r + j has been seen. A query stops when its k-th verified distance lies within that bound, so nothing is missed.

Codes are reduced to distinct ones first (a vector that a third of the rows share is one code that carries its k + 1
smallest ids), queries to distinct ones too. Blocks of queries meet blocks of codes; each meeting returns k neighbours
a query, and the best of them are folded. The number of meetings is the product of both block counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_out

SEGMENTS, BITS = 4, 16
MASKS = [np.array([m for m in range(1 << BITS) if m.bit_count() == r], dtype=np.uint16) for r in range(BITS + 1)]


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is positive; null, NaN and missing components leave it clear. A null vector has no code."""
    parts = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


class SegmentIndex:
    """Per segment: the codes in the order of that segment, and where each of its values starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint16).reshape(-1, SEGMENTS) if len(codes) else np.zeros((0, SEGMENTS), np.uint16)
        self.order = [np.argsort(self.parts[:, j], kind="stable") for j in range(SEGMENTS)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, j], minlength=1 << BITS))]) for j in range(SEGMENTS)]

    def probe(self, queries: np.ndarray, j: int, r: int):
        """(query, code) places of the codes whose segment j is exactly r bits from the query's, each pair once over all (r, j)."""
        keys = (queries.view(np.uint16).reshape(-1, SEGMENTS)[:, j][:, None] ^ MASKS[r][None, :]).ravel()
        first, last = self.starts[j][keys], self.starts[j][keys.astype(np.int64) + 1]
        sizes = last - first
        who = np.repeat(np.repeat(np.arange(len(queries)), len(MASKS[r])), sizes)
        places = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        found = self.order[j][places]
        apart = np.bitwise_count(queries.view(np.uint16).reshape(-1, SEGMENTS)[who] ^ self.parts[found])
        new = np.ones(len(found), bool)
        for i in range(SEGMENTS):  # seen before by segment i: at a smaller radius, or at this one before j's turn
            if i != j:
                new &= apart[:, i] >= r + (i < j)
        return who[new], found[new], apart[new].sum(axis=1)

    def nearest(self, queries: np.ndarray, weight: np.ndarray, k: int):
        """For each query the (query, code, distance) triples of all codes up to its k-th distance; a code counts ``weight`` times."""
        found = [], [], []
        active = np.arange(len(queries))
        seen = np.zeros((len(queries), BITS * SEGMENTS + 1), np.int64)
        for r in range(BITS + 1):
            for j in range(SEGMENTS):
                if not len(active):
                    break
                who, code, distance = self.probe(queries[active], j, r)
                who = active[who]
                for into, values in zip(found, (who, code, distance), strict=True):
                    into.append(values)
                np.add.at(seen, (who, distance), weight[code])
                active = active[seen[active, : SEGMENTS * r + j + 1].sum(axis=1) < k]
        who, code, distance = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        reach = np.argmax(np.cumsum(seen, axis=1) >= k, axis=1)
        reach[seen.sum(axis=1) < k] = BITS * SEGMENTS
        near = distance <= reach[who]
        return who[near], code[near], distance[near]


def _search(k: int, chunk: int):
    def run(key, queries, index):
        codes = index["code"].to_numpy().view(np.uint64)
        ids = index["ids"].combine_chunks()
        starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        search, weight, asked = SegmentIndex(codes), np.diff(starts), queries["code"].to_numpy().view(np.uint64)
        out = [], [], []
        for at in range(0, len(asked), chunk):
            part = np.ascontiguousarray(asked[at : at + chunk])
            who, code, distance = search.nearest(part, weight, k)
            sizes = weight[code]
            which = np.repeat(np.arange(len(code)), sizes)
            places = np.repeat(starts[code] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(code) else np.zeros(0, np.int64)
            who, distance, number = who[which], distance[which], flat[places]
            order = np.lexsort((number, distance, who))
            who, distance, number = who[order], distance[order], number[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            best = rank < k
            for into, values in zip(out, (part[who[best]], distance[best], number[best]), strict=True):
                into.append(values)
        code, distance, number = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"code": code.astype(np.uint64).view(np.int64), "distance": distance.astype(np.int32), "id": number.astype(np.int64)})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 1024, index_block: int = 65_536, chunk: int = 32) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest other rows of every query, by Hamming distance, then id.

    Both inputs have ``id`` (long) and ``code`` (64-bit long). Rows with a null id or code are not searched and queries
    with one get no answer; ids that repeat with the same code are one row. Fewer than k other rows: fewer answers. An
    empty side gives an empty result. Blocks bound the memory of a task; they do not change the answer.
    """
    rows, queries = (x.select(F.col("id").cast("long"), "code").where("id IS NOT NULL AND code IS NOT NULL").distinct() for x in (rows, queries))
    # The k + 1 smallest ids of a code are enough: one of them may be the query itself.
    ranked = F.row_number().over(_by("code", "id"))
    few = rows.withColumn("_place", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.withColumn("_r", F.row_number().over(_by(["code", "_place"], "id"))).where(F.col("_r") <= k + 1)
    few = few.withColumn("_r", ranked).where(F.col("_r") <= k + 1)
    codes = write_out(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = write_out(queries.select("code").distinct())
    index_blocks = max(1, -(-codes.count() // index_block))
    query_blocks = max(1, -(-asked.count() // query_block))
    left = asked.withColumn("q", F.pmod(F.xxhash64("code"), F.lit(query_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))))
    right = codes.withColumn("i", F.pmod(F.xxhash64("code"), F.lit(index_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    met = left.groupBy("q", "i").cogroup(right.groupBy("q", "i")).applyInArrow(_search(k + 1, chunk), "code long, distance int, id long")
    best = met.withColumn("_r", F.row_number().over(_by("code", ["distance", "id"]))).where(F.col("_r") <= k + 1)
    best = best.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))
    answers = queries.withColumnRenamed("id", "query_id").join(best, "code")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("_p", "_n")).select("query_id", (F.col("_p") + 1).alias("rank"), "_n.id", "_n.distance")


def _by(keys, order):
    from pyspark.sql import Window

    keys, order = ([x] if isinstance(x, str) else x for x in (keys, order))
    return Window.partitionBy(*keys).orderBy(*order)
