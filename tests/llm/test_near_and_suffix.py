import hashlib
import random
from collections import Counter

import numpy as np

from mediasift.llm import near_dedup, suffix_dedup
from mediasift.llm.shingles import shingles


def near_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(n + i, passage + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    rows += [(5000, rows[0][1]), (5001, rows[0][1].upper()), (5002, "two words"), (5003, "Two, words!"), (5004, ""), (5005, None), (5006, "?!"), (5007, ""), (None, rows[0][1]), (5008, "solo " * 30_000), (5008, "solo " * 30_001)]
    return rows


def brute(rows):
    sets = [(i, set(shingles(t).tolist())) for i, t in rows]
    links, parent = Counter(), {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y or 10 * len(x & y) < 8 * len(x | y):
                continue
            links[a] += 1
            links[b] += 1
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return Counter((i, None if i is None else find(i), links[n]) for n, (i, _) in enumerate(rows))


def test_links_and_classes_match_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, rep long, set string")
    want = brute(rows)
    for block in (300_000, 900):  # the second cuts families into several blocks
        got = near_dedup.near_duplicates(df, block=block).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep long")
    left = near_dedup.drop_near_copies(df)
    assert left.columns == df.columns
    classes = {r[1] for r in brute(rows) if r[1] is not None}
    assert {r.doc_id for r in left.collect()} == classes | {None}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_many_labels_in_a_bucket_are_merged(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_LABELS", 1)
    monkeypatch.setattr(near_dedup, "MOST_PARTNERS", 0)
    rows = near_rows()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=2000).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_texts_that_share_an_id_are_rows_of_their_own(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    changed = lambda t: " ".join([*t[:-1], "changed"])
    near, other, third = text(80), text(80), text(80)
    rows = [(3, " ".join(near)), (7, changed(near)), (7, " ".join(other)), (9, changed(other)), (8, " ".join(third)), (8, changed(third)), (7, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(3, 3, 1), (7, 3, 1), (7, 7, 2), (7, 7, 2), (9, 7, 2), (8, 8, 1), (8, 8, 1)])
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in near_dedup.near_duplicates(df).collect()) == want
    left = Counter(map(tuple, near_dedup.drop_near_copies(df).collect()))
    assert left[rows[0]] == 1 and left[rows[2]] == 2 and left[rows[4]] + left[rows[5]] == 1 and sum(left.values()) == 4


def test_banding_reaches_its_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = near_dedup.banding(similarity, 0.99)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99 and bands * rows <= 320


def test_bucket_pointers_sort_suffixes():
    rng = random.Random(1)
    stretches = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 200))) for _ in range(20)] + [b"a" * 150, b"ab" * 80]
    flat = b"".join(stretches)
    ends = np.repeat(np.cumsum([len(s) for s in stretches]), [len(s) for s in stretches])
    for depth in (8, 13, 64, 100):
        pointer = suffix_dedup.bucket_pointers(np.frombuffer(flat, np.uint8), ends, depth)
        known = {p: flat[p : p + depth] for p in range(len(flat)) if ends[p] - p >= depth}
        assert {p for p in range(len(flat)) if pointer[p] >= 0} == set(known)
        by_pointer = sorted(known, key=lambda p: pointer[p])
        assert [known[p] for p in by_pointer] == sorted(known.values())
        assert len({pointer[p] for p in known}) == len(set(known.values()))


def removed(rows, length):
    first = {}
    for k, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            at = (k is not None, k or 0, p)
            first[data[p : p + length]] = min(at, first.get(data[p : p + length], at))
    out = Counter()
    for k, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (k is not None, k or 0, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[k, len(data), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "be", "gamma delta", "x", "lorem", "é", "ipsum dolor", "zz"]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 50)))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            at = rng.randrange(0, len(p) - 50)
            text += p[at : at + rng.randrange(40, 260)] + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        rows.append((rng.choice([i, i, i, None, rng.randrange(0, 90)]), text))
    rows += [(5, None), (6, ""), (None, None), (7, "a" * 1000), (8, "ab" * 400), (7, "a" * 1000), (200, "a" * 99), (201, "a" * 100)]
    df = spark.createDataFrame([(*r, 0, b"") for r in rows], "doc_id long, text string, k int, marks binary")
    assert Counter(map(tuple, suffix_dedup.remove_repeats(df).collect())) == removed(rows, 100)
    assert Counter(map(tuple, suffix_dedup.remove_repeats(df, length=64).collect())) == removed(rows, 64)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_a_common_line_is_dealt_by_its_strings(spark):
    rng = random.Random(5)
    line, passage = "one line of forty bytes in many contexts", " ".join(str(rng.random()) for _ in range(20))
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, noise(100) + (line if i % 3 == 0 else passage if i % 3 == 1 else "") + noise(100)) for i in range(600)]
    # Some contexts come again, in other documents and further on in one.
    rows += [(1000 + i, noise(30) + rows[3 * i][1][20:210] + noise(30)) for i in range(40)] + [(7, rows[0][1]), (None, rows[3][1]), (900, (line + noise(60)) * 2 + line)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (20, 1):
        assert Counter(map(tuple, suffix_dedup.remove_repeats(df, crowd=crowd).collect())) == removed(rows, 100)
    # What goes to a bucket of anchors stays small, however many documents hold the line.
    keyed = df.selectExpr("doc_id", "text", "coalesce(doc_id, -1) AS k", "xxhash64(text) AS th")
    met = Counter()
    for r in suffix_dedup._dealt_stretches(keyed, 100, 8, 20).collect():
        if r.bucket < 8:
            met.update(suffix_dedup.unpack(r.payload)[0].tolist())
    assert not met or max(met.values()) <= 20


def test_long_texts_are_cut_into_pieces():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    pieces, owner, base = suffix_dedup._pieces([text, b"", text[:50]], 100)
    assert b"".join(p[: suffix_dedup.PIECE] for p in pieces) == text + text[:50]
    anchors = suffix_dedup.Anchors()
    h, piece, first, n = anchors([text, text[1000:3000]])
    assert n[piece == 0].sum() == 5000 - 99 and n[piece == 1].sum() == 2000 - 99
    inside = {(x, s) for x, p, s in zip(h, piece, first) if p == 0}
    assert sum((x, s + 1000) in inside for x, p, s in zip(h, piece, first) if p == 1) >= (piece == 1).sum() - 1
