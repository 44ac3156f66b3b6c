import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm.shallot_clusters import Centroids, clusters, hashed_seeds, integer_vectors, lloyd

SCHEMA = "id long, e array<float>, cluster string, v int, n int"


def nearest(vectors, centroids):
    apart = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


def plain(rows, k, rounds, prefix, parts):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == parts and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    x = np.array([v for _, v in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"{prefix}{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = x[order[:k]]
    for _ in range(rounds):
        near = nearest(x, c)[0]
        c = np.array([[int(s) // int((near == j).sum()) for s in x[near == j].sum(axis=0)] if (near == j).any() else c[j] for j in range(len(c))])
    near, d = nearest(x, c)
    return sorted([(i, int(a), int(b), int(d[near == a].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest()) for (i, _), a, b in zip(kept, near, d)], key=repr)


def made(spark, rows, k, rounds, prefix, parts):
    table = spark.createDataFrame([(i, e, "clash", 1, 2) for i, e in rows], SCHEMA).repartition(4)
    got = clusters(table, "id", "e", k=k, rounds=rounds, components=parts, prefix=prefix)
    return sorted([tuple(r) for r in got.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=repr)


def test_against_all_distances(spark):
    rng = random.Random(2)
    clumps = [[rng.uniform(-2, 2) for _ in range(6)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(clumps)]) for i in range(1500)]
    rows += [(i, [0.5] * 6) for i in range(2000, 2900)]  # one vector a third of the rows share
    rows += [(7, rows[7][1])] * 3 + [(None, [0.1] * 6), (3000, None), (3001, [0.1] * 5), (3002, [float("nan")] + [0.0] * 5), (3003, [None] + [0.0] * 5), (3004, [float("inf")] + [0.0] * 5)]
    for k, rounds in ((12, 5), (1, 2), (2, 3), (40, 1), (3, 0)):
        assert made(spark, rows, k, rounds, "2:", 6) == plain(rows, k, rounds, "2:", 6)


def test_ties_empty_centroids_and_few_rows(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(54)]  # repeated vectors: equal centroids, of which the smaller number wins
    for k in (5, 20, 54, 80):
        assert made(spark, grid, k, 4, "p", 2) == plain(grid, k, 4, "p", 2)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])]):
        assert made(spark, rows, 3, 2, "p", 2) == plain(rows, 3, 2, "p", 2)


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (2000, 16)) + rng.integers(-500, 500, 16) for _ in range(25)])
    c = x[rng.choice(len(x), 30, replace=False)].astype(np.int64)
    first, second = np.zeros(len(x), np.int32), np.ones(len(x), np.int32)
    upper, lower, before, compared = np.full(len(x), np.inf), np.full(len(x), -np.inf), None, []
    for _ in range(6):
        first, second, upper, lower, n = Centroids(c, before).assign(x, first, second, upper, lower)
        apart = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2))
        assert (first == apart.argmin(axis=1)).all()
        rows = np.arange(len(x))
        assert (apart[rows, first] <= upper + 1e-6).all()
        apart[rows, first] = np.inf
        assert (apart.min(axis=1) >= lower - 1e-6).all()
        compared.append(n)
        before, c = c, np.array([x[first == j].sum(axis=0) // max(1, (first == j).sum()) if (first == j).any() else c[j] for j in range(30)])
    assert compared[0] < len(x) * 30 and compared[-1] < compared[0] / 4, compared


def test_values_without_exact_distances_end_the_query(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0], "", 1, 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        integer_vectors(table, "id", "e", components=2).collect()


def test_seeds_follow_their_hash(spark):
    vectors = spark.createDataFrame([(i, [i, 0]) for i in range(50)], "id long, v array<int>")
    want = sorted(range(50), key=lambda i: hashlib.sha256(f"s{i}".encode()).hexdigest())[:5]
    assert hashed_seeds(vectors, 5, "s") == [[i, 0] for i in want]
    assert lloyd(vectors, [], 3).rows.count() == 0 and vectors.where(F.col("id") < 0).count() == 0
