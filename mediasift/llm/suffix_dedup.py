"""Repeated byte strings across documents, by bucket-pointer refinement of suffixes.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier (in a smaller document id, or further
ahead in the same document).

1. Anchors. Of the q-grams in a string of ``length`` bytes the one with the smallest hash is its anchor; equal strings
   have equal anchors at equal offsets. Neighbouring strings share an anchor, so a text has one per 35 bytes or so.
2. Anchors are dealt by hash. Where an anchor's hash occurs once in all texts, none of its strings repeats; this is
   most of a corpus, and it ends here.
3. The other stretches, with their bytes, are dealt by anchor. Equal stretches are one; the strings of different
   stretches are told apart by bucket-pointer refinement (:func:`bucket_pointers`), and all but the first are repeats.
4. Anchors with more than ``crowd`` stretches (a line that many documents hold in different contexts) have no bucket of
   their own: their single strings are dealt by a 128-bit digest of all their bytes, and equal digests are equal strings.
   So what meets in one place is bounded: ``crowd`` stretches of an anchor, or one row per batch of a string.
5. The repeated strings of a document are joined back to its text.

A mapper settles what repeats inside its own batch of texts and sends one witness of it, so a passage that a third of
the documents share sends one row per batch to its bucket and not one per document.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, write_out
from .shingles import mixed

LENGTH = 100
GRAM = 32  # bytes of an anchor
PIECE = 1 << 22  # bytes that are hashed at a time; longer texts are cut into overlapping pieces
CHUNK = 1 << 21  # bytes that are sorted at a time
BASE = 0x9E3779B97F4A7C15
CROWD = 1 << 13  # stretches of an anchor, of up to 268 bytes each, that are refined together
MOST_STRINGS = 1 << 18  # single strings that a mapper holds
NO_ID = -(1 << 63)


# ---- bucket-pointer refinement -------------------------------------------------------------------------------------


def bucket_pointers(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For every position the bucket of its suffix by its first ``depth`` bytes; -1 where fewer bytes are left.

    ``ends[i]`` is the end of the stretch that position i lies in: suffixes do not run over it. A bucket is named by the
    place of its first member in sorted order, so pointers order the suffixes. Buckets start as those of 8-byte grams
    and are refined by sorting on the pointers of the suffixes d bytes further on. What a round refines, later rounds use
    on the left as well as on the right side; a bucket of one needs no more sorting.
    """
    n = len(data)
    left = ends - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    gram = np.zeros(n, np.uint64)
    for i in range(8):
        gram = (gram << np.uint64(8)) | padded[i : i + n]
    pointer = np.full(n, -1, np.int64)
    here = np.flatnonzero(left >= 8)
    _, inverse, counts = np.unique(gram[here], return_inverse=True, return_counts=True)
    pointer[here] = (np.cumsum(counts) - counts)[inverse]
    alone = np.zeros(n, bool)
    alone[here] = counts[inverse] == 1
    known = 8
    while known < depth:
        shift = min(known, depth - known)
        open_ = np.flatnonzero((left >= known + shift) & ~alone)
        own, next_ = pointer[open_], pointer[open_ + shift]
        order = np.lexsort((next_, own))
        own, next_ = own[order], next_[order]
        new_bucket = np.ones(len(order), bool)
        new_bucket[1:] = own[1:] != own[:-1]
        new_part = new_bucket.copy()
        new_part[1:] |= next_[1:] != next_[:-1]
        places = np.arange(len(order))
        bucket_at = np.maximum.accumulate(np.where(new_bucket, places, 0))
        part_at = np.maximum.accumulate(np.where(new_part, places, 0))
        size = np.diff(np.concatenate([np.flatnonzero(new_part), [len(order)]]))
        refined = np.where(left >= known + shift, pointer, -1)
        refined[open_[order]] = own + (part_at - bucket_at)
        alone[open_[order]] = np.repeat(size == 1, size)
        pointer = refined
        known += shift
    return pointer


def repeated_strings(stretches: list[bytes], strings: np.ndarray, document: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset) of strings that occur earlier in another stretch.

    Stretch i holds ``strings[i]`` strings, at offsets 0, 1, ...; the first stands at ``start[i]`` of ``document[i]``.
    Documents are numbers in their order. Strings at the same place of equally numbered documents are not earlier.
    """
    sizes = np.array([len(s) for s in stretches], np.int64)
    data = np.frombuffer(b"".join(stretches), np.uint8)
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes, sizes)
    pointer = bucket_pointers(data, ends, length)
    which = np.repeat(np.arange(len(stretches)), strings)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
    bucket = pointer[first[which] + offset]
    doc, at = document[which], start[which] + offset
    order = np.lexsort((at, doc, bucket))
    bucket, doc, at = bucket[order], doc[order], at[order]
    head = np.ones(len(order), bool)
    head[1:] = bucket[1:] != bucket[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = (doc > doc[lead]) | ((doc == doc[lead]) & (at > at[lead]))
    return which[order[later]], offset[order[later]]


# ---- anchors ---------------------------------------------------------------------------------------------------------


class Anchors:
    """Anchors of the strings of texts; powers of the rolling hash are kept between calls."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            factors = np.full(n, BASE, np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(factors)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, piece, first string, number of strings) of every anchor's stretch, strings counted from the piece's start."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        grams = n - self.gram + 1
        if n < self.length:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        self._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        value = mixed((total[self.gram :] - total[: grams]) * self.down[:grams])
        # The smallest hash, and the leftmost of equal ones: the place sits in the low bits, which the hash gives up.
        bits = np.uint64(max(1, int(n).bit_length()))
        least = (value >> bits << bits) | np.arange(grams, dtype=np.uint64)
        window, width = self.length - self.gram + 1, 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if window > width:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) + self.length <= ends[piece]
        starts = valid.copy()
        starts[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(starts)
        stop = np.flatnonzero(valid & ~np.concatenate([valid[1:] & (anchor[1:] == anchor[:-1]), [False]])) + 1
        return value[anchor[first]], piece[first], first - (ends - sizes)[piece[first]], stop - first


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def _slices(batch, most_bytes: int = PIECE):
    """Parts of a batch with some MB of text, one row at least."""
    lengths = batch.column("text").to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, text in enumerate(lengths):
        if size and size + len(text) > most_bytes:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += len(text)
    if at < batch.num_rows:
        yield batch.slice(at)


def _pieces(texts: list[bytes], length: int):
    """(pieces, their text, their place in it); neighbours overlap by a string less one byte."""
    pieces, owner, base = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            pieces.append(text[at : at + PIECE + length - 1])
            owner.append(i)
            base.append(at)
    return pieces, np.array(owner, np.int64), np.array(base, np.int64)


def _by_bucket(buckets: np.ndarray):
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], buckets[order][1:] != buckets[order][:-1]])) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(buckets[order[a]]), order[a:b]


def _ask(length: int, buckets: int):
    """Texts to packed anchors, one row per bucket. Repeats inside the batch go on by themselves, beside a witness."""

    def run(batches):
        anchors = Anchors(length)
        for batch in batches:
            for part in _slices(batch):
                k, th = (part.column(c).to_numpy() for c in ("k", "th"))
                pieces, owner, base = _pieces([t.encode() for t in part.column("text").to_pylist()], length)
                h, piece, at, n = anchors(pieces)
                doc, lo = owner[piece], base[piece] + at
                _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                multiple = times[inverse] > 1
                witness = np.zeros(len(h), bool)
                witness[first] = True
                out = [], []
                for sent, passed in ((np.flatnonzero(witness), False), (np.flatnonzero(multiple), True)):
                    # What is known to repeat needs no bucket of its own and is dealt by document.
                    to = buckets + (mixed(th[doc[sent]].view(np.uint64)) % np.uint64(buckets)).astype(np.int64) if passed else (h[sent] % np.uint64(buckets)).astype(np.int64)
                    for bucket, some in _by_bucket(to):
                        i = sent[some]
                        out[0].append(bucket)
                        out[1].append(pack(h[i], k[doc[i]], th[doc[i]], lo[i].astype(np.uint64) << np.uint64(8) | n[i].astype(np.uint64), np.where(passed, 0, times[inverse[i]]).astype(np.uint32)))
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "payload"])

    return run


def _answer(buckets: int, crowd: int):
    """Packed anchors of a bucket to the marks (place and number of strings) of those whose hash occurs twice.

    A hash that occurs more than ``crowd`` times has one row more, without a mark.
    """

    def run(key, rows):
        parts = [unpack(p) for p in rows["payload"].to_pylist()]
        h, k, th, mark, times = (np.concatenate(x) for x in zip(*parts))
        crowded = np.zeros(0, np.uint64)
        if key[0].as_py() < buckets:
            names, inverse = np.unique(h, return_inverse=True)
            total = np.bincount(inverse, times, len(names))
            crowded = names[total > crowd]
            # A witness of several has been sent on by its mapper already.
            keep = (total > 1)[inverse] & (times == 1)
            h, k, th, mark = h[keep], k[keep], th[keep], mark[keep]
        none = pa.nulls(len(crowded), pa.int64())
        columns = {"k": k, "th": th, "mark": mark.astype(np.int64)}
        table = {c: pa.chunked_array([pa.array(v, pa.int64()), none]) for c, v in columns.items()}
        return pa.table({**table, "h": np.concatenate([h, crowded]).view(np.int64)})

    return run


def _marks(marks) -> tuple[np.ndarray, np.ndarray]:
    marks = np.unique(np.asarray(marks, np.int64))
    return marks >> 8, marks & 255


def _single_strings(stretches: list[bytes], k, th, lo, n, length: int, buckets: int):
    """Stretches in the order of their places to packed single strings, dealt by digest, and settled repeats."""

    def packed(digests, owner, place, runs):
        out = [], []
        digest = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        owner, place = np.array(owner, np.int64), np.array(place, np.int64)
        for bucket, i in _by_bucket(2 * buckets + (digest[:, 0] % np.uint64(buckets)).astype(np.int64)):
            out[0].append(bucket)
            out[1].append(pack(digest[i, 0], digest[i, 1], k[owner[i]], th[owner[i]], place[i]))
        at, start, count = np.array(runs, np.int64).reshape(-1, 3).T
        for bucket, i in _by_bucket(buckets + (mixed(th[at].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
            out[0].append(bucket)
            out[1].append(pack(np.zeros(len(i), np.uint64), k[at[i]], th[at[i]], start[i], count[i], b""))
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "payload"])

    seen: dict[bytes, tuple[int, int]] = {}
    digests, owner, place, runs = [], [], [], []
    for i, stretch in enumerate(stretches):
        document, first = int(k[i]), int(lo[i])
        for x in range(int(n[i])):
            digest = hashlib.blake2b(stretch[x : x + length], digest_size=16).digest()
            if seen.setdefault(digest, (document, first + x)) >= (document, first + x):
                digests.append(digest)
                owner.append(i)
                place.append(first + x)
            elif runs and runs[-1][0] == i and runs[-1][1] + runs[-1][2] == first + x:
                runs[-1][2] += 1
            else:
                runs.append([i, first + x, 1])
        if len(digests) + len(runs) > MOST_STRINGS:
            yield packed(digests, owner, place, runs)
            seen, digests, owner, place, runs = {}, [], [], [], []
    if digests or runs:
        yield packed(digests, owner, place, runs)


def _send(length: int, buckets: int):
    """Texts with marks to packed stretches with their bytes, one row per bucket, and settled repeats.

    The lowest bit of a mark says that its anchor is crowded; such stretches go as single strings.
    """

    def run(batches):
        anchors = Anchors(length)
        for batch in batches:
            for part in _slices(batch):
                k, th = (part.column(c).to_numpy() for c in ("k", "th"))
                texts = [t.encode() for t in part.column("text").to_pylist()]
                seen: dict[bytes, int] = {}
                bytes_, doc, lo, n, repeat, crowded = [], [], [], [], [], []
                for d in np.argsort(k, kind="stable"):
                    marks = np.unique(part.column("marks")[int(d)].values.to_numpy())
                    for start, count, many in zip(*(x.tolist() for x in (*_marks(marks >> 1), marks & 1))):
                        stretch = texts[d][start : start + count + length - 1]
                        before = seen.setdefault(stretch, len(bytes_))
                        # Documents come in their order, so an equal stretch before this one is earlier or the same place.
                        repeat.append(before < len(bytes_) and (k[doc[before]], lo[before]) < (k[d], start))
                        bytes_.append(stretch)
                        doc.append(int(d))
                        lo.append(start)
                        n.append(count)
                        crowded.append(many == 1)
                if not bytes_:
                    continue
                doc, lo, n, repeat = np.array(doc), np.array(lo, np.int64), np.array(n, np.int64), np.array(repeat, bool)
                crowded = np.array(crowded, bool) & ~repeat
                if crowded.any():
                    i = np.flatnonzero(crowded)
                    yield from _single_strings([bytes_[x] for x in i], k[doc[i]], th[doc[i]], lo[i], n[i], length, buckets)
                h = _anchor_of(anchors, bytes_)
                out = [], []
                for sent, settled in ((np.flatnonzero(~repeat & ~crowded), False), (np.flatnonzero(repeat), True)):
                    to = buckets + (mixed(th[doc[sent]].view(np.uint64)) % np.uint64(buckets)).astype(np.int64) if settled else (h[sent] % np.uint64(buckets)).astype(np.int64)
                    for bucket, some in _by_bucket(to):
                        i = sent[some]
                        out[0].append(bucket)
                        out[1].append(pack(h[i], k[doc[i]], th[doc[i]], lo[i], n[i], b"" if settled else b"".join([bytes_[x] for x in i])))
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "payload"])

    return run


def _anchor_of(anchors: Anchors, stretches: list[bytes]) -> np.ndarray:
    """The hash of the one anchor that all strings of a stretch share."""
    out = np.zeros(len(stretches), np.uint64)
    at, size = 0, 0
    for i in range(len(stretches) + 1):
        if i == len(stretches) or size + len(stretches[i]) > PIECE:
            h, piece, _, _ = anchors(stretches[at:i])
            out[at + piece[::-1]] = h[::-1]
            at, size = i, 0
        if i < len(stretches):
            size += len(stretches[i])
    return out


def _refine(length: int, buckets: int):
    """Packed stretches of a bucket to the marks of strings that start earlier elsewhere."""

    def run(key, rows):
        parts = [unpack(p) for p in rows["payload"].to_pylist()]
        if key[0].as_py() >= 2 * buckets:
            return _single_repeats(*(np.concatenate(x) for x in zip(*parts)))
        h, k, th, lo, n = (np.concatenate(x) for x in list(zip(*parts))[:5])
        if key[0].as_py() >= buckets:
            return pa.table({"k": k, "th": th, "mark": lo << 8 | n})
        flat, ends = b"".join(p[5] for p in parts), np.cumsum(n + length - 1)
        out = [], []  # stretch, mark

        def settle(i: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
            out[0].append(i)
            out[1].append(start << 8 | count)

        order = np.lexsort((lo, k, h))
        cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        waiting, weight = [], 0
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            if b - a == 1:
                continue
            first: dict[bytes, int] = {}
            for i in order[a:b].tolist():
                stretch = flat[ends[i] - n[i] - length + 1 : ends[i]]
                j = first.setdefault(stretch, i)
                if j != i and (k[j], lo[j]) < (k[i], lo[i]):
                    settle(np.array([i]), lo[i : i + 1], n[i : i + 1])
            if len(first) > 1:
                waiting.append(first)
                weight += sum(map(len, first))
            if weight > CHUNK:
                _sort(waiting, k, lo, n, length, settle)
                waiting, weight = [], 0
        _sort(waiting, k, lo, n, length, settle)
        which, mark = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"k": k[which], "th": th[which], "mark": mark.astype(np.int64)})

    return run


def _single_repeats(high, low, k, th, place) -> pa.Table:
    """The marks of strings whose digest stands earlier elsewhere."""
    order = np.lexsort((place, k, low, high))
    high, low, k, th, place = (x[order] for x in (high, low, k, th, place))
    head = np.ones(len(order), bool)
    head[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = (k > k[lead]) | (place > place[lead])
    return pa.table({"k": k[later], "th": th[later], "mark": place[later] << 8 | 1})


def _sort(groups: list[dict[bytes, int]], k, lo, n, length: int, settle) -> None:
    """Different stretches with equal anchors: which of their strings repeat. Groups have no string in common."""
    stretches = [s for g in groups for s in g]
    if not stretches:
        return
    i = np.array([x for g in groups for x in g.values()])
    _, document = np.unique(k[i], return_inverse=True)
    which, offset = repeated_strings(stretches, n[i], document, lo[i], length)
    order = np.lexsort((offset, which))
    which, offset = which[order], offset[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)
    heads = np.flatnonzero(new)
    if len(heads):
        settle(i[which[heads]], lo[i[which[heads]]] + offset[heads], np.diff(np.concatenate([heads, [len(which)]])))


def _finish(length: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                out = [], [], [], []
                for text, marks in zip(part.column("text").to_pylist(), part.column("marks")):
                    data = text.encode()
                    removed = spans = 0
                    kept = data
                    if marks.is_valid:
                        start, count = _marks(marks.values.to_numpy())
                        change = np.zeros(len(data) + 1, np.int32)
                        np.add.at(change, start, 1)
                        np.add.at(change, start + count + length - 1, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        removed = int(gone.sum())
                        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    for column, value in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest())):
                        column.append(value)
                yield pa.record_batch([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _dealt_stretches(rows: DataFrame, length: int, buckets: int, crowd: int) -> DataFrame:
    """``bucket, payload``: what may repeat of ``doc_id, text, k, th``, dealt so that equal strings meet."""
    asked = rows.select("k", "th", "text").mapInArrow(_ask(length, buckets), "bucket int, payload binary")
    marked = write_out(asked.groupBy("bucket").applyInArrow(_answer(buckets, crowd), "k long, th long, mark long, h long"))
    # One row per ``crowd`` anchors of the input at most; written, so that Spark knows how few.
    crowded = write_out(marked.where("mark IS NULL").select("h", F.lit(1).alias("many")))
    flagged = marked.where("mark IS NOT NULL").join(crowded, "h", "left")
    mark = F.shiftleft("mark", 1) + F.coalesce("many", F.lit(0))
    listed = flagged.groupBy("k", "th").agg(F.collect_list(mark).alias("marks"))
    # This join and that of the repeats take the same columns of ``rows``, so its texts are shuffled once.
    return rows.join(listed, ["k", "th"]).select("doc_id", "k", "th", "text", "marks").mapInArrow(_send(length, buckets), "bucket int, payload binary")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """One row per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null is empty, strings never cross rows. Ids are long; a null id comes before all others.
    Rows with equal ids are ordered by the place of the string alone, so rows that repeat id and text do not remove each
    other. ``crowd`` is where anchors become crowded; it changes no result. Other columns are not read. Texts shorter than ``length`` keep all bytes. An empty table gives no rows.
    """
    if not 64 <= length <= 200:
        raise ValueError("length must be from 64 to 200")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(F.col(text_column)).alias("text"))
    rows = rows.withColumns({"k": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})
    # Buckets follow the number of input partitions, so a bucket's size does not grow with the input.
    buckets = max(8, 4 * docs.rdd.getNumPartitions())
    stretches = _dealt_stretches(rows, length, buckets, crowd)
    repeats = stretches.groupBy("bucket").applyInArrow(_refine(length, buckets), "k long, th long, mark long")
    removed = repeats.groupBy("k", "th").agg(F.collect_list("mark").alias("marks"))
    joined = rows.join(removed, ["k", "th"], "left").select("doc_id", "k", "th", "text", "marks")
    return joined.mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
