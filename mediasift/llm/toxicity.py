"""Toxic spans by a linear-chain conditional random field.

Training needs labelled tokens, and documents are what is labelled. A token of a toxic document counts as toxic when
its word, or one of the word's edges, is significantly more frequent in toxic documents than in clean ones; all tokens of clean
documents are clean. The field is fitted to these sequences: one weight per such feature, and the transitions.

Scoring runs forward-backward over the whole text and takes marginals. Tokens without any feature are alike, and what
lies far away along a run of them has no influence (the messages contract by a known factor per token), so the
recursion is carried out within that reach of tokens that have a feature and its limit is used elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, labelled_sample, text_or_empty

WORD = re.compile(r"\w+")
REMEMBERED = 300_000
SEGMENT = 24  # tokens of a training sequence
SPANS = "array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[str]:
    """The word, its first 3 to 6 and its last 4 characters."""
    n = len(word)
    return [word, *[f"{word[:k]}~" for k in (3, 4, 5, 6) if k < n], *([f"~{word[-4:]}"] if n > 4 else [])]


def words_of(text: str) -> list[str]:
    lower = text.lower()
    return WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in WORD.findall(text)]


class Field:
    """Two states (clean 0, toxic 1). ``weights`` and ``bias`` score state 1; ``moves[i, j]`` scores i before j."""

    def __init__(self, weights: dict[str, float], bias: float, moves: np.ndarray, start: float):
        self.weights, self.bias, self.moves, self.start = weights, bias, moves, start
        self.remembered: dict[str, float] = {}
        self.prepare()

    def prepare(self) -> None:
        (a, b), (c, d) = np.exp(self.moves - self.moves.max())
        self.steps = float(a), float(b), float(c), float(d)
        # Birkhoff's contraction of one step; emissions scale states and do not change it.
        ratio = math.sqrt(max((a * d) / (b * c), (b * c) / (a * d)))
        contraction = (ratio - 1) / (ratio + 1)
        self.reach = 1 if contraction < 1e-9 else min(100_000, math.ceil(math.log(1e-13) / math.log(contraction)))
        neutral = math.exp(self.bias)
        forward = backward = (0.5, 0.5)
        for _ in range(self.reach):
            forward, backward = self._forward(forward, neutral), self._backward(backward, neutral)
        self.far_forward, self.far_backward = forward, backward
        p = forward[1] * backward[1]
        self.far = p / (p + forward[0] * backward[0])

    def _forward(self, m, emit):
        a, b, c, d = self.steps
        x, y = m[0] * a + m[1] * c, (m[0] * b + m[1] * d) * emit
        return x / (x + y), y / (x + y)

    def _backward(self, m, emit):
        a, b, c, d = self.steps
        y = m[1] * emit
        u, v = a * m[0] + b * y, c * m[0] + d * y
        return u / (u + v), v / (u + v)

    def emission(self, word: str) -> float:
        known = self.remembered.get(word)
        if known is None:
            known = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[word] = known
        return known

    def window(self, scores: list[float], head: bool, tail: bool) -> list[float]:
        """Marginals of state 1 along ``scores``; ``head`` and ``tail``: the window starts or ends the text."""
        emits = [math.exp(min(50.0, s + self.bias)) for s in scores]
        forward = []
        m = self.far_forward
        for i, e in enumerate(emits):
            if i == 0 and head:
                y = math.exp(self.start) * e
                m = (1 / (1 + y), y / (1 + y))
            else:
                m = self._forward(m, e)
            forward.append(m)
        out = [0.0] * len(emits)
        m = (0.5, 0.5) if tail else self.far_backward
        for i in range(len(emits) - 1, -1, -1):
            p = forward[i][1] * m[1]
            out[i] = p / (p + forward[i][0] * m[0])
            m = self._backward(m, emits[i])
        return out

    def marginals(self, words: list[str]) -> list[tuple[int, list[float]]]:
        """(first token, marginals) of the windows around tokens with a feature and around both ends of the text."""
        get, emission = self.remembered.get, self.emission
        scores = [s if (s := get(w)) is not None else emission(w) for w in words]
        n = len(scores)
        hits = [0, *[i for i, s in enumerate(scores) if s], n - 1] if n else []
        out, at = [], 0
        while at < len(hits):
            first, last = max(0, hits[at] - self.reach), hits[at] + self.reach
            while at + 1 < len(hits) and hits[at + 1] - self.reach <= last:
                at += 1
                last = hits[at] + self.reach
            last = min(n - 1, last)
            out.append((first, self.window(scores[first : last + 1], first == 0, last == n - 1)))
            at += 1
        return out

    def judge(self, text: str, at_least: float = 0.5) -> tuple[float, list[dict]]:
        """(document score: the largest marginal of any token, maximal runs of tokens at ``at_least`` as character offsets)."""
        words = words_of(text)
        if not words:
            return 0.0, []
        windows = self.marginals(words)
        score = max(self.far if len(words) > 2 * self.reach else 0.0, *[max(m) for _, m in windows])
        if score < at_least:
            return score, []
        toxic = {first + i: p for first, m in windows for i, p in enumerate(m) if p >= at_least}
        spans, before = [], None
        for i, found in enumerate(WORD.finditer(text)):
            if i in toxic:
                if before == i - 1 and spans:
                    spans[-1]["end"], spans[-1]["score"] = found.end(), max(spans[-1]["score"], toxic[i])
                else:
                    spans.append({"start": found.start(), "end": found.end(), "score": toxic[i]})
                before = i
        return score, spans


def _nothing_learned() -> Field:
    return Field({}, -8.0, np.zeros((2, 2)), 0.0)


def telling_features(toxic: list[list[str]], clean: list[list[str]], odds: float = 3.5, doubt: float = 1e-4) -> set[str]:
    """Features that are ``exp(odds)`` times likelier in toxic texts, beyond what chance does among so many features.

    A word counts once in a text, and texts that share half of their word triples with one earlier text do not count, so
    neither repetition inside a text nor copies and near copies of one text make a word telling. A word inside a set
    phrase counts in every text that holds the phrase. The chance of a feature's counts is bounded by Chernoff's
    inequality and must stay under ``doubt`` over the number of features.
    """
    numbers: dict[str, int] = {}
    uses = []
    for texts in (clean, toxic):
        found = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for words in texts for w in ("", *words, "")), np.int64)
        triples = np.stack([found[:-2], found[1:-1], found[2:]], axis=1) if len(found) > 2 else np.zeros((0, 3), np.int64)
        keys = (triples.astype(np.uint64) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)).sum(axis=1, dtype=np.uint64)
        text = np.repeat(np.arange(len(texts)), [len(words) + 2 for words in texts])[1:-1]
        _, first, same = np.unique(keys, return_index=True, return_inverse=True)
        owner = text[first[same]] if len(first) else text[:0]  # the first text that holds the triple
        meets, shared = np.unique(np.stack([text, owner], axis=1)[text != owner], axis=0, return_counts=True)
        length = np.bincount(text, minlength=len(texts))
        copies = meets[2 * shared >= length[meets[:, 0]], 0]
        counts = ~np.isin(text, copies)
        once = np.unique(np.stack([text[counts], triples[counts, 1]], axis=1), axis=0)
        uses.append(np.bincount(once[:, 1], minlength=1))
    size = len(numbers) + 1
    uses = [np.concatenate([u, np.zeros(size - len(u), np.int64)]) for u in uses]
    empty = numbers.get("", 0)
    total = [int(u.sum() - u[empty]) for u in uses]
    if not total[0] or not total[1]:
        return set()
    base = total[1] / (total[0] + total[1])
    # Toxic uses first: most features have too few of them to tell anything, and are forgotten before clean uses are counted.
    toxic_uses: dict[str, int] = {}
    for word, number in numbers.items():
        if number != empty and (n := int(uses[1][number])):
            for f in features(word):
                toxic_uses[f] = toxic_uses.get(f, 0) + n
    least = math.log(max(1, len(toxic_uses)) / doubt)
    toxic_uses = {f: n for f, n in toxic_uses.items() if n * math.log(1 / base) >= least}
    clean_uses = dict.fromkeys(toxic_uses, 0)
    for word, number in numbers.items():
        if number != empty and (n := int(uses[0][number])):
            for f in features(word):
                if f in clean_uses:
                    clean_uses[f] += n
    out = set()
    for f, n1 in toxic_uses.items():
        n0 = clean_uses[f]
        share = n1 / (n0 + n1)
        if share <= base or math.log((n1 + 0.5) / (n0 + 0.5) * (1 - base) / base) < odds:
            continue
        gain = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0)
        if (n0 + n1) * gain >= least:
            out.add(f)
    return out


def train(texts: list[str], labels: list[int], most_segments: int = 8_000, steps: int = 120, seed: int = 0) -> Field:
    one: dict[str, str] = {}  # one string for all uses of a word
    texts = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    toxic = [words for words, y in zip(texts, labels, strict=True) if y == 1]
    clean = [words for words, y in zip(texts, labels, strict=True) if y == 0]
    telling = telling_features(toxic, clean)
    if not telling:
        return _nothing_learned()
    place = {f: i + 1 for i, f in enumerate(sorted(telling))}
    found = {w: k for w in one if (k := tuple(place[f] for f in features(w) if f in place))}
    # Sequences of SEGMENT tokens: those with a telling token, and the lengths of the others, which are all alike.
    rows, marks, plain = [], [], []
    for is_toxic, group in ((True, toxic), (False, clean)):
        for words in group:
            for at in range(0, len(words), SEGMENT):
                part = [found.get(w, ()) for w in words[at : at + SEGMENT]]
                if any(part):
                    rows.append(part)
                    marks.append([bool(k) and is_toxic for k in part])
                else:
                    plain.append(len(part))
    rng = np.random.default_rng(seed)
    if len(rows) > most_segments // 2:
        chosen = rng.choice(len(rows), most_segments // 2, replace=False)
        rows, marks = [rows[i] for i in chosen], [marks[i] for i in chosen]
    if len(plain) > most_segments // 2:
        plain = rng.choice(plain, most_segments // 2, replace=False).tolist()
    rows, marks = rows + [[()] * n for n in plain], marks + [[False] * n for n in plain]
    width = max(1, max(len(k) for r in rows for k in r))
    ids = np.zeros((len(rows), SEGMENT, width), np.int64)
    truth = np.zeros((len(rows), SEGMENT), np.int64)
    there = np.zeros((len(rows), SEGMENT), bool)
    for i, (part, mark) in enumerate(zip(rows, marks, strict=True)):
        there[i, : len(part)] = True
        truth[i, : len(mark)] = mark
        for j, k in enumerate(part):
            ids[i, j, : len(k)] = k
    return _fit(ids, truth, there, place, steps)


def _fit(ids, truth, there, place, steps: int, ridge: float = 2e-5, rate: float = 0.1) -> Field:
    """Adam on the mean log likelihood of the segments; forward-backward over all of them at once."""
    n, length, _ = ids.shape
    size = len(place) + 1  # weight 0 belongs to no feature
    theta = np.zeros(size + 1 + 4)
    theta[size] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    used = there[:, :, None] & (ids > 0)
    both = there[:, 1:] & there[:, :-1]
    want = np.zeros_like(theta)
    np.add.at(want, ids[used & (truth == 1)[:, :, None]], 1)
    want[size] = (truth * there).sum()
    for a in (0, 1):
        for b in (0, 1):
            want[size + 1 + 2 * a + b] = (both & (truth[:, :-1] == a) & (truth[:, 1:] == b)).sum()
    for step in range(1, steps + 1):
        weights, bias, moves = theta[:size].copy(), theta[size], theta[size + 1 :].reshape(2, 2)
        weights[0] = 0
        emit = np.where(there, np.exp(np.clip(weights[ids].sum(axis=2) + bias, -50, 50)), 1.0)
        jump = np.exp(moves)
        forward, backward = np.ones((length, n, 2)), np.ones((length, n, 2))
        scale = np.ones((length, n, 2))
        scale[:, :, 1] = emit.T
        forward[0] = scale[0] / scale[0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            x = (forward[t - 1] @ jump) * scale[t]
            x = np.where(there[:, t, None], x, forward[t - 1])
            forward[t] = x / x.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            x = (backward[t + 1] * scale[t + 1]) @ jump.T
            x = np.where(there[:, t + 1, None], x, 1.0)
            backward[t] = x / x.sum(axis=1, keepdims=True)
        joint = forward * backward
        p = joint[:, :, 1] / joint.sum(axis=2)
        have = np.zeros_like(theta)
        q = p.T * there
        np.add.at(have, ids[used], np.broadcast_to(q[:, :, None], ids.shape)[used])
        have[size] = q.sum()
        pair = forward[:-1, :, :, None] * jump[None, None] * (scale[1:] * backward[1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        have[size + 1 :] = (pair * both.T[:, :, None, None]).sum(axis=(0, 1)).ravel()
        grad = (want - have) / n - ridge * theta
        grad[0] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in place.items()}
    return Field(weights, float(theta[size]), theta[size + 1 :].reshape(2, 2), 0.0)


def fit(docs: DataFrame, labelled: DataFrame, per_label: int = 3000, most_chars: int = 20_000, most_segments: int = 8_000) -> Field:
    """Fits on a bounded sample of ``docs`` (``id, text``) by the labels 0 and 1 of ``labelled`` (``id, label``).

    At most ``per_label`` texts of at most ``most_chars`` characters of either label. Weights are fitted on at most
    ``most_segments`` sequences of these texts, half of them with a telling token, drawn at random with a fixed seed.
    Rows with a null id, label or text are not used.
    """
    sample = labelled_sample(docs, labelled.where("label IN (0, 1)"), per_label, 2, most_chars)
    return train(sample["text"].tolist(), sample["label"].astype(int).tolist(), most_segments)


def _judged(docs: DataFrame, field: Field, text, schema: T.StructType, keep) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                yield keep(part, [field.judge(t or "") for t in part.column(part.num_columns - 1).to_pylist()])

    return docs.select(*docs.columns, text.alias(free_name("_judged_text", docs.columns))).mapInArrow(run, schema)


def score(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans`` for every row and its whole text.

    ``spans`` are character offsets (end exclusive) of toxic runs with their largest marginal. Null texts and texts
    without words score 0. Without anything learned all scores are low. Ids may be null or repeat; other columns are
    not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def keep(part, found):
        value = np.array([s for s, _ in found], np.float64)
        spans = pa.array([x for _, x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
        return pa.record_batch([part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), spans], ["doc_id", "score", "predicted", "spans"])

    texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(F.col(text_column)).alias("text"))
    return _judged(texts, field, F.col("text"), T._parse_datatype_string(f"doc_id {kind}, score double, predicted int, spans {SPANS}"), keep)


def drop_toxic(docs: DataFrame, field: Field, text_column: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the rows whose text scores 0.5 or more. Rows are judged where they are: nothing moves."""

    def keep(part, found):
        clean = pa.array([s < 0.5 for s, _ in found], pa.bool_())
        return part.select(part.schema.names[:-1]).filter(clean)

    return _judged(docs, field, text_or_empty(docs[text_column]), docs.schema, keep)
