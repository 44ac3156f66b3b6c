"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets verify them.

1. Every text becomes its shingle set, a signature and band hashes, in one pass. Texts with equal sets are one class
   from here on; the set's hash names it, its smallest id (and that row's text hash, where rows repeat the id) stands for
   it, and it counts as many times as it has texts.
2. Rows are shuffled on band hashes. A bucket is never listed: it only tells its members its smallest member.
3. A member's label is the smallest member of any of its buckets, so a family of near copies shares a label and its sets
   move once and not once per band. Labels that meet in a bucket are verified against each other as well, therefore
   every pair that shares a bucket is verified, and exactly once.
4. A label's members are cut into blocks of bounded size. Blocks meet in pairs; a meeting multiplies membership matrices
   and returns one row per member (its links and one linked member), never a pair per link.
5. Linked members form connected components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_name, text_or_empty, write_out
from .shingles import mixed, shingles

MOST_LABELS, MOST_PARTNERS = 16, 4  # labels in a bucket, and labels that a label meets, before they are merged


def banding(similarity: float, recall: float, hashes: int = 320) -> tuple[int, int]:
    """(bands, rows): the most rows per band, thus the fewest false candidates, that reach ``recall`` at ``similarity``."""
    best = 1, 1
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    return best


class BandHashes:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.weight = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.place = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        narrow = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(narrow), 512):
            np.minimum(least, (narrow[at : at + 512, None] * self.factor + self.shift).min(axis=0), out=least)
        return mixed((least.reshape(self.bands, self.rows) * self.weight).sum(axis=1, dtype=np.uint64) + self.place)


def signatures(docs: DataFrame, id_column: str, text_column: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id, th, n, set, bands``: hash of the text, number of shingles, 128-bit hash of the sorted set, one 64-bit hash per band."""

    def run(batches):
        hashed = BandHashes(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, sets, keys = [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, words)
                    sizes.append(len(found))
                    sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    keys.append(hashed(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
                yield pa.record_batch(
                    [part.column("id"), part.column("th"), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "th", "n", "set", "bands"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return _texts(docs, id_column, text_column).mapInArrow(run, f"id {kind}, th long, n int, set binary, bands array<long>")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(F.col(text_column)).alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("th"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in ``left`` with every one in ``right``, by products of membership matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = np.concatenate([*left, *right])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = times[column] > 1
    renamed = np.cumsum(times > 1) - 1
    column, row = renamed[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(64, min(4096, (8 << 20) // (4 * (len(left) + len(right)))))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        member = np.zeros((len(left) + len(right), width), np.float32)
        member[row[a:b], column[a:b] - start] = 1
        out += member[: len(left)] @ member[len(left) :].T
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, one, two): whether the sets at ``one[i]`` and ``two[j]`` reach ``similarity``.

    Between two blocks ``one`` and ``two`` are the sets of side 0 and 1; within one block both are all sets, and no set
    is near itself.
    """
    size = np.array([len(s) for s in sets], np.float64)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(two)
    two = one if within else two
    common = overlaps([sets[i] for i in one], [sets[j] for j in two])
    near = np.zeros(common.shape, bool)
    for at in range(0, len(one), 256):
        rows = slice(at, at + 256)
        # A margin far under what one shingle changes, so that equality counts.
        near[rows] = common[rows].astype(np.float64) * (1 + similarity) >= similarity * (size[one[rows]][:, None] + size[two][None, :]) - 1e-6
    if within:
        np.fill_diagonal(near, False)
    return near, one, two


def smallest_linked(near: np.ndarray, one: np.ndarray, two: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` sets the first one in its component of the graph ``near``."""
    root = np.arange(count)
    while True:
        before = root.copy()
        for rows, columns, matrix in ((one, two, near), (two, one, near.T)):
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                reached = np.where(matrix[at : at + 256], root[columns][None, :], count).min(axis=1, initial=count)
                root[some] = np.minimum(root[some], reached)
        root = root[root]
        if (root == before).all():
            return root


def _verify(words: int, similarity: float):
    def run(key, rows):
        rows = rows.sort_by([(c, "ascending") for c in ("r1", "r2", "i", "j", "set")])
        name, side, copies = (rows[c].to_numpy() for c in ("set", "side", "copies"))
        names = np.stack([rows[c].to_numpy() for c in ("r1", "r2", "i", "j")])
        starts = np.concatenate([[0], np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1, [len(name)]])
        out_name, out_links, out_root = [], [], []
        for a, b in zip(starts, starts[1:]):
            # A row that the input repeats comes more than once; it is one member.
            _, first = np.unique(name[a:b], return_index=True)
            if len(first) < 2:
                continue
            first += a
            sets = [shingles(t, words) for t in rows["text"].take(pa.array(first)).to_pylist()]
            near, one, two = linked(sets, side[first], similarity)
            if not near.any():
                continue
            member, many = name[first], copies[first].astype(np.float64)
            links = np.zeros(len(first), np.int64)
            links[one] += (near @ many[two]).astype(np.int64)
            if (side[first] == 1).any():  # between two blocks each pair stands once
                links[two] += (near.T @ many[one]).astype(np.int64)
            root = smallest_linked(near, one, two, len(first))
            some = np.flatnonzero(links)
            out_name.append(member[some])
            out_links.append(links[some])
            out_root.append(member[root[some]])
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_name, out_links, out_root)]
        return pa.table({c: pa.array(x.tolist(), t) for c, x, t in zip(("set", "links", "root"), joined, (pa.binary(), pa.int64(), pa.binary()))})

    return run


def _labels(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, label`` and the ``r1 < r2`` of labels that meet in a bucket.

    A label's members move once for every label it meets. Where a bucket holds more than MOST_LABELS labels, or a label
    meets more than MOST_PARTNERS others, they are merged, until none does: what belongs to one large family gets one
    label, and every member moves a bounded number of times per block.
    """
    labels = met.groupBy("node").agg(F.min("least").alias("label"))
    while True:
        labels = write_out(labels)
        held = write_out(met.join(labels, "node").select("key", "label").distinct())
        buckets = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"))
        crowded = write_out(buckets.where((F.col("n") > MOST_LABELS)).select("key", "low"))
        if not crowded.isEmpty():
            lower = held.join(crowded, "key").select("label", "low")
        else:
            other = held.withColumnRenamed("label", "other")
            pairs = write_out(held.join(other, "key").where("label < other").select(F.col("label").alias("r1"), F.col("other").alias("r2")).distinct())
            both = pairs.unionAll(pairs.select(F.col("r2").alias("r1"), F.col("r1").alias("r2")))
            stars = both.groupBy("r1").agg(F.count(F.lit(1)).alias("n"), F.least("r1", F.min("r2")).alias("low")).where(F.col("n") > MOST_PARTNERS)
            stars = write_out(stars.select("r1", "low"))
            if stars.isEmpty():
                return labels, pairs
            lower = stars.select(F.col("r1").alias("label"), "low").unionAll(both.join(stars, "r1").select(F.col("r2").alias("label"), "low"))
        lower = lower.groupBy("label").agg(F.min("low").alias("low"))
        labels = labels.join(lower, "label", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8,
    recall: float = 0.999, block: int = 150_000,
) -> DataFrame:
    """One row per row: ``doc_id, class_id, n_links, rep_id, n_copies, n_shingles``.

    ``class_id`` is the smallest id of the component, ``n_links`` the number of other rows at ``similarity`` or more,
    ``rep_id`` the smallest id with the same shingle set and ``n_copies`` their number. Ids are long. A null text counts
    as empty; texts without words link to nothing and are their own class. Rows with a null id are not compared: they
    get a null class and no links. Rows that repeat an id are rows of their own and link to each other if they are
    near. ``recall`` is the chance that a pair at exactly ``similarity`` shares a bucket. ``block`` bounds the shingles
    of one side of a meeting. Other columns are not read. An empty table gives an empty result.
    """
    return _compared(docs, id_column, text_column, words, similarity, recall, block).drop("th", "first")


def _compared(
    docs: DataFrame, id_column: str, text_column: str, words: int = 5, similarity: float = 0.8, recall: float = 0.999, block: int = 150_000,
) -> DataFrame:
    """``near_duplicates`` with ``th``, the hash of the row's text, and ``first``, the ``rep, th`` of its class's first row."""
    bands, rows = banding(similarity, recall)
    sized = write_out(signatures(docs, id_column, text_column, words, bands, rows))
    compared = sized.where("id IS NOT NULL AND n > 0")
    row = F.struct("id", "th")
    classes = compared.groupBy("set").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min_by("bands", row).alias("bands"))
    classes = write_out(classes.select("set", F.col("row.id").alias("rep"), F.col("row.th").alias("th"), "copies", "n", "bands"))

    # Labels only bring classes together; classes whose 64-bit nodes are equal share a label and are verified like others.
    banded = classes.select(F.xxhash64("set").alias("node"), F.explode("bands").alias("key"))
    buckets = write_out(banded.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "least"))
    met = write_out(banded.join(buckets, "key").select("key", "node", "least"))
    labels, pairs = _labels(met)

    # Blocks, and the meetings of the blocks of a label with each other and with those of labels it meets in a bucket.
    members = labels.join(classes.select(F.xxhash64("set").alias("node"), "set", "rep", "th", "copies", "n"), "node")
    totals = write_out(members.groupBy("label").agg(F.ceil(F.sum(F.col("n").cast("long")) / F.lit(float(block))).cast("int").alias("blocks"), F.sum(F.col("n").cast("long")).alias("weight")))
    pairs = pairs.unionAll(totals.select(F.col("label").alias("r1"), F.col("label").alias("r2")))
    sizes = pairs.join(totals.select(F.col("label").alias("r1"), F.col("blocks").alias("b1"), F.col("weight").alias("w1")), "r1").join(
        totals.select(F.col("label").alias("r2"), F.col("blocks").alias("b2"), F.col("weight").alias("w2")), "r2")
    sizes = write_out(sizes)
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("r1") == F.col("r2"), F.col("w1")).otherwise(F.col("w1") + F.col("w2"))), F.lit(0))).first()[0]
    bundles = max(1, -(-int(total) // block))

    def side(which: int) -> DataFrame:
        """Members as side ``which`` of all meetings of their label, once per block of the other side."""
        own, theirs = ("r1", "b2") if which == 0 else ("r2", "b1")
        apart = sizes if which == 0 else sizes.where("r1 != r2")
        joined = members.join(apart, members["label"] == apart[own])
        b = F.pmod(F.xxhash64("node"), F.col("b1" if which == 0 else "b2")).cast("int")
        x = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        out = joined.withColumn("b", b).withColumn("x", x)
        same = F.col("r1") == F.col("r2")
        i = F.when(same, F.least("b", "x")).otherwise(F.col("b") if which == 0 else F.col("x"))
        j = F.when(same, F.greatest("b", "x")).otherwise(F.col("x") if which == 0 else F.col("b"))
        # Within a label the block with the larger number is the other side.
        at = F.when(same, (F.col("b") > F.col("x")).cast("int")).otherwise(F.lit(which))
        return out.select("set", "rep", "th", "copies", "r1", "r2", i.alias("i"), j.alias("j"), at.alias("side"), ((F.col("b1") > 1) | (F.col("b2") > 1)).alias("large"))

    meetings = side(0).unionAll(side(1))
    # Rows that repeat id and text are one text here, folded before they move and dealt as the join needs them.
    texts = _texts(docs, id_column, text_column).withColumnRenamed("id", "rep").dropDuplicates(["rep", "th"])
    bundle = F.when(F.col("large"), F.xxhash64("r1", "r2", "i", "j")).otherwise(F.pmod(F.xxhash64("r1", "r2"), F.lit(bundles)))
    work = meetings.join(texts, ["rep", "th"]).drop("rep", "th").withColumn("bundle", bundle).drop("large")
    found = work.groupBy("bundle").applyInArrow(_verify(words, similarity), "set binary, links long, root binary")
    found = write_out(found)

    linked_to = found.groupBy("set").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("set != root"), "set", "root").withColumnRenamed("node", "set")
    named = classes.select("set", F.struct("rep", "th").alias("row"))
    firsts = write_out(components.join(named, "set").groupBy("component").agg(F.min("row").alias("first")))
    firsts = components.join(firsts, "component").select("set", "first")
    known = classes.select("set", "rep", "copies", F.struct("rep", "th").alias("row")).join(linked_to, "set", "left").join(firsts, "set", "left")
    known = known.select("set", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "row").alias("first"))
    comparable = F.col("id").isNotNull() & (F.col("n") > 0)
    joined = sized.select("id", "th", "n", F.when(comparable, F.col("set")).alias("set")).join(known, "set", "left")
    return joined.select(
        F.col("id").alias("doc_id"), F.coalesce("first.rep", "id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("rep", "id").alias("rep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.col("n").alias("n_shingles"), "th", "first",
    )


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns; of every class the row with the smallest id stays. Rows with a null id stay.

    Where rows of a class share its smallest id, the one whose text has the smallest hash stays; rows that repeat id and
    text stay or go together.
    """
    found = _compared(docs, id_column, text_column, **options)
    later = found.where("doc_id != first.rep OR th != first.th")
    gone, hashed = free_name("_dropped", docs.columns), free_name("_text", docs.columns)
    dropped = write_out(later.select(F.col("doc_id").alias(gone), F.col("th").alias(hashed)).distinct())
    same_text = F.xxhash64(text_or_empty(docs[text_column])) == F.col(hashed)
    return docs.join(dropped, (docs[id_column] == F.col(gone)) & same_text, "left_anti")
