import hashlib
import random
import zlib

from pyspark.sql import functions as F

from mediasift.llm import catalog
from mediasift.llm.merkle_manifest import build, fold, leaf_digest, path_digest, proofs

SCHEMA = "id long, g string, x string, tree int, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Roots and paths by a loop: ``{leaf place: siblings}`` of every group, then of the top tree."""
    def tree(leaves):
        paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(level) > 1:
            for i, a in enumerate(at):
                start = a // 8 * 8
                paths[i].append((level[start:a], level[a + 1 : start + 8]))
            level, at = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [a // 8 for a in at]
        return level[0], paths

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for i, g, x in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, h(field(i), field(g), field(x)), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in order}
    root, tops = tree([subs[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: r[:3]), subs[g][1], strict=True):
            out.append((r[3], r[2], subs[g][0], root, h(*[x for left, right in path + top for x in left + right])))
    return sorted(out, key=repr)


def made(spark, rows):
    table = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(5)
    manifest = build(table, F.col("g"), F.col("id"), leaf_digest(F.col("id"), F.col("g"), F.col("x")), {"n": F.length("x")})
    got = proofs(manifest).withColumn("folded", fold(F.col("leaf"), F.col("path"))).withColumn("proof", path_digest(F.col("path"))).collect()
    assert all(r["folded"] == manifest.root for r in got)
    return sorted([(r["order"], r["leaf"], r["subroot"], manifest.root, r["proof"]) for r in got], key=repr)


def test_trees_of_many_sizes(spark):
    rng = random.Random(5)
    rows = []
    for g, n in [(None, 1), ("", 8), ("a", 9), ("b", 64), ("c", 65), ("hot", 1500), ("é", 7), ("z", 2)]:
        rows += [(i, g, "x" * rng.randrange(4)) for i in rng.sample(range(10_000), n)]
    assert made(spark, rows) == plain(rows)


def test_few_rows_nulls_and_repeats(spark):
    for rows in ([(1, "a", "t")], [(1, None, None)], [(None, None, None), (None, None, None)], [(3, "a", "x")] * 20 + [(3, "a", "y"), (None, "a", "z"), (2, "b", "x")],
                 [(1, "a", "long " * 100_000), (2, "b", "")], [(i, str(i), "") for i in range(70)]):
        assert made(spark, rows) == plain(rows)
    empty = spark.createDataFrame([], SCHEMA)
    manifest = build(empty, F.col("g"), F.col("id"), leaf_digest(F.col("x")))
    assert manifest.root is None and proofs(manifest).count() == 0


def test_the_count_of_bytes_tells_fields_apart(spark):
    one = spark.createDataFrame([("a", "bc", "é", None), ("ab", "c", "é", None)], "a string, b string, c string, d string")
    got = [r[0] for r in one.select(leaf_digest(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [h("1:a2:bc2:é-"), h("2:ab1:c2:é-")]


def test_query_tells_tampered_rows(spark):
    got = catalog.QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001")
    wrong = got.where("NOT verified").select("doc_id").collect()
    text = {r["doc_id"]: r["text"] for r in catalog.documents(spark, "/root/testdata/sf0.001").collect()}
    assert {r[0] for r in wrong} == {i for i, t in text.items() if zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in t or "")}
