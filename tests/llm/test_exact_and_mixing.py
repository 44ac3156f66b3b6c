import hashlib
import math
import random
import string
from collections import Counter

from pyspark.sql import functions as F

from mediasift.llm import components, exact_dedup, mixing

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, h string, norm string, keep int"


def docs(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "h", "n", 1) for i, t in rows], SCHEMA)


ROWS = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "long " * 30_000), (8, "LONG " * 30_000), (None, "ab"), (9, "x"), (9, "x"), (None, "lone"), (10, "ÀA"), (11, "Àa")]


def expected(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def test_groups_are_those_of_equal_texts(spark):
    for keep in ("smallest", "largest"):
        got = exact_dedup.exact_groups(docs(spark, ROWS), keep=keep)
        assert Counter(map(tuple, got.collect())) == expected(ROWS, keep == "largest")


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    for keep in ("smallest", "largest"):
        got = exact_dedup.exact_groups(docs(spark, ROWS), keep=keep, hashed=lambda text: F.unhex(F.substring(F.md5(F.substring(text, 1, 1).cast("binary")), 1, 1)))
        assert Counter(map(tuple, got.collect())) == expected(ROWS, keep == "largest")


def test_crowded_hashes_are_compared_by_map_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_TOGETHER", 1)
    for hashed in (exact_dedup.content_hash, lambda text: F.unhex(F.substring(F.md5(F.substring(text, 1, 1).cast("binary")), 1, 1))):
        got = exact_dedup.exact_groups(docs(spark, ROWS), hashed=hashed)
        assert Counter(map(tuple, got.collect())) == expected(ROWS, False)


def test_dropping_copies_keeps_columns_and_null_ids(spark):
    left = exact_dedup.drop_copies(docs(spark, ROWS), keep="largest")
    assert left.columns == ["doc_id", "text", "h", "norm", "keep"]
    assert sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x or 0)) == [2, 3, 4, 6, 8, 9, 9, 11, None, None]


def test_empty_table(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert mixing.replicate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def poisson_inverse(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_invert_the_poisson_distribution(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)] + [(None, "n", "big"), (7, "again", "big")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, n int, rate double")
    mixed = mixing.replicate(df, seed="s", temperature=0.3)
    assert mixed.columns == [*df.columns, "_copy", "_order"]
    sizes = Counter(r[2] for r in rows)
    weight = {s: n**0.3 for s, n in sizes.items()}
    want = Counter()
    for i, text, source in rows:
        rate = weight[source] / sum(weight.values()) * len(rows) / sizes[source]
        u = int(hashlib.md5(f"s|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i, text, source] += poisson_inverse(rate, u)
    got = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert got == +want
    assert abs(sum(got.values()) - len(rows)) < 5 * math.sqrt(len(rows))


def test_given_weights_and_large_rates(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(2000)], "doc_id long, source string")
    counts = Counter(r.source for r in mixing.replicate(df, weights={"a": 1.0}, length=10.0).collect())
    assert set(counts) == {"a"} and abs(counts["a"] - 20_000) < 1_000


def test_components_match_union_find(spark):
    rng = random.Random(5)
    for n, m in ((40, 30), (200, 150), (60, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, x) for x in range(2001, 2200)] + [(3, None)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if b is not None and a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
