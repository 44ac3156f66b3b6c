"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by measurements of its characters, words and repetitions and a
learned layer; gated attention (a tanh branch times a sigmoid branch) weighs the passages; the weighted sum of their
codes is scored. Only documents have labels: the attention learns from them which passages tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cross_entropy_score, labelled_sample, text_or_empty

PASSAGE = 600  # bytes, extended to the next space
CLASSES = 16
FEATURES = 2 * CLASSES + 9


def _byte_classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, space, line end, sentence end, comma, quote, !, |, brackets, markup signs, dashes, controls, lead and other bytes of longer characters."""
    table = np.full(256, 11, np.uint8)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".?", ",;:", "'\"", "!", "|", "()[]{}<>")):
        table[[ord(c) for c in chars]] = i
    table[[ord(c) for c in "-_="]] = 12
    table[[c for c in range(32) if c not in (9, 10, 13)]] = 13
    table[0x80:0xC0], table[0xC0:] = 14, 15
    return table


BYTE_CLASS = _byte_classes()


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); an empty text has one passage of zeros."""
    data = [t.encode("utf-8", "replace") + b" " for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    kind = BYTE_CLASS[flat]
    space = (kind == 3) | (kind == 4)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # A passage starts at a text's start, or after the first space behind a multiple of PASSAGE.
    gaps = np.flatnonzero(space) + 1
    wanted = np.concatenate([np.arange(s + PASSAGE, e, PASSAGE) for s, e in zip(starts, ends)]) if len(data) else np.zeros(0, np.int64)
    cuts = gaps[np.searchsorted(gaps, wanted)] if len(wanted) else wanted.astype(np.int64)
    cuts = np.unique(np.concatenate([starts, cuts[cuts < len(flat)]]))
    length = np.diff(np.concatenate([cuts, [len(flat)]]))
    passage = np.repeat(np.arange(len(cuts)), length)
    counts = np.bincount(passage * CLASSES + kind, minlength=len(cuts) * CLASSES).reshape(-1, CLASSES)
    share = counts / np.maximum(1, length)[:, None]
    # Words: bytes between spaces, known by start, length and a hash.
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    out = np.zeros((len(cuts), FEATURES), np.float32)
    out[:, :CLASSES] = share
    out[:, CLASSES : 2 * CLASSES] = np.log1p(counts) / 6
    if len(first):
        power = np.multiply.accumulate(np.concatenate([[1], np.full(len(flat), 0x9E3779B97F4A7C15 | 1, np.uint64)]).astype(np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.astype(np.uint64) * power[:-1])])
        # The sum between two places, shifted back to exponent 0, does not depend on where the word stands.
        word = (total[last] - total[first]) * power[len(flat) - first]
        word ^= word >> np.uint64(29)
        own = passage[first]
        words = np.bincount(own, minlength=len(cuts))
        order = np.lexsort((word, own))
        new = np.ones(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (own[order][1:] != own[order][:-1])
        distinct = np.bincount(own[order][new], minlength=len(cuts))
        again = np.zeros(len(first), bool)
        again[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
        tail = kind[last - 1]
        signs = (tail == 8) | (tail == 11)
        upper = (kind[first] == 1) & (kind[np.minimum(first + 1, last - 1)] == 1)
        long = last - first
        per = np.maximum(1, words)
        columns = (
            distinct / per, np.bincount(own, again, len(cuts)) / per, np.bincount(own, signs, len(cuts)) / per, np.bincount(own, upper, len(cuts)) / per,
            np.bincount(own, long, len(cuts)) / per / 10, np.bincount(own, long > 25, len(cuts)) / per, np.log1p(words) / 5, np.bincount(own, long == 1, len(cuts)) / per, np.ones(len(cuts)),
        )
        out[:, 2 * CLASSES :] = np.stack(columns, axis=1)
    return out, np.diff(np.concatenate([np.searchsorted(cuts, starts), [len(cuts)]]))


class Network:
    def __init__(self, mean, scale, width: int = 24, depth: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        shapes = {"E": (FEATURES, width), "e": (width,), "V": (width, depth), "U": (width, depth), "a": (depth,), "w": (width,), "b": (1,)}
        self.weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "EVUaw" else np.zeros(s) for k, s in shapes.items()}

    def forward(self, features: np.ndarray, sizes: np.ndarray):
        """Document values and what the backward pass needs. Attention is a softmax inside each document."""
        p = self.weights
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), cross_entropy_score(h @ p["U"])
        raw = (t * g) @ p["a"]
        at = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(sizes)), sizes)
        top = np.maximum.reduceat(raw, at)
        weight = np.exp(raw - top[own])
        weight /= np.add.reduceat(weight, at)[own]
        bag = np.add.reduceat(weight[:, None] * h, at)
        return bag @ p["w"] + p["b"], (x, h, t, g, weight, bag, own, at)

    def gradients(self, slope: np.ndarray, kept) -> dict:
        """``slope``: derivative of the loss by each document's value."""
        p, (x, h, t, g, weight, bag, own, at) = self.weights, kept
        out = {"w": bag.T @ slope, "b": np.array([slope.sum()])}
        d_bag = slope[:, None] * p["w"]
        d_h = weight[:, None] * d_bag[own]
        d_weight = (d_bag[own] * h).sum(axis=1)
        d_raw = weight * (d_weight - np.add.reduceat(weight * d_weight, at)[own])
        out["a"] = (t * g).T @ d_raw
        d_tg = d_raw[:, None] * p["a"]
        d_v, d_u = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        out["V"], out["U"] = h.T @ d_v, h.T @ d_u
        d_h = (d_h + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - h * h)
        out["E"], out["e"] = x.T @ d_h, d_h.sum(axis=0)
        return out


def train(texts: list[str], labels: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 128, decay: float = 1e-4, seed: int = 0) -> Network | None:
    """Adam on the cross entropy, classes weighted evenly. None when there is nothing to learn from."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        return None
    parts = [passage_features(texts[i : i + 64]) for i in range(0, len(texts), 64)]
    features, sizes = (np.concatenate(x) for x in zip(*parts))
    at = np.cumsum(sizes) - sizes
    net = Network(features.mean(axis=0), features.std(axis=0) + 1e-3, seed=seed)
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    m, v = ({k: np.zeros_like(w) for k, w in net.weights.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(sizes))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            rows = np.concatenate([np.arange(at[d], at[d] + sizes[d]) for d in some])
            value, kept = net.forward(features[rows], sizes[some])
            slope = (cross_entropy_score(value) - labels[some]) * share[some] / len(some)
            step += 1
            for k, grad in net.gradients(slope, kept).items():
                grad = grad + decay * net.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net.weights[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labelled: DataFrame, per_label: int = 2500, most_chars: int = 20_000, epochs: int = 60) -> Network | None:
    """Fits on a bounded sample of ``docs`` (``id, text``) by the labels 0 and 1 of ``labelled`` (``id, label``).

    At most ``per_label`` texts of at most ``most_chars`` characters of either label. Rows with a null id, label or text
    are not used.
    """
    sample = labelled_sample(docs, labelled.where("label IN (0, 1)"), per_label, 2, most_chars)
    return train(sample["text"].tolist(), sample["label"].to_numpy(np.float64), epochs)


def score(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted, passages, top_passage`` for every row and its whole text.

    ``top_passage`` is the number of the passage with the most attention. Null and empty texts are one empty passage.
    Without a model every score is 0.5. Ids may be null or repeat; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for rows in batches:
            at = 0
            while at < rows.num_rows:
                # Some MB of text at a time, however long single texts are.
                part = rows.slice(at, 128)
                while part.num_rows > 1 and part.column("text").nbytes > 4_000_000:
                    part = rows.slice(at, part.num_rows // 2)
                at += part.num_rows
                features, sizes = passage_features(part.column("text").to_pylist())
                if net is None:
                    value, best = np.full(part.num_rows, 0.5), np.zeros(part.num_rows, np.int64)
                else:
                    raw, kept = net.forward(features, sizes)
                    value, weight = cross_entropy_score(raw), kept[4]
                    start = np.cumsum(sizes) - sizes
                    best = np.array([int(np.argmax(weight[s : s + n])) for s, n in zip(start, sizes)])
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(best.astype(np.int32))],
                    ["doc_id", "score", "predicted", "passages", "top_passage"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(F.col(text_column)).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, passages int, top_passage int")
