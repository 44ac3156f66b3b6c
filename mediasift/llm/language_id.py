"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3) that both contain, over the root of the product
of how many each contains. Nyström landmarks turn it into features: kernels with a few hundred training texts, whitened
by the landmarks' own kernel matrix. One ridge regression per language (one versus rest) is solved on the features.
Scoring is two matrix products per batch of texts: presence by landmarks, kernels by languages.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import labelled_sample, text_or_empty

LETTER_BITS = 6
SPACE_LETTER, PLAIN_LETTERS = 0, 26
SIZES = tuple(1 << (LETTER_BITS * n) for n in (1, 2, 3))
OFFSETS = (0, SIZES[0], SIZES[0] + SIZES[1])
GRAMS = sum(SIZES)


def _alphabet() -> np.ndarray:
    """Code point -> one of 64 letters: a-z, other letters dealt over the rest by their number, everything else a space."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            table[code] = code - 96 if "a" <= c <= "z" else PLAIN_LETTERS + 1 + (code * 40503 >> 4) % (63 - PLAIN_LETTERS)
    return table


class Profiles:
    """The sets of n-grams of texts, with scratch space that is used again."""

    def __init__(self):
        self.alphabet = _alphabet()
        self.flags = np.zeros(GRAMS, bool)

    def grams(self, text: str) -> np.ndarray:
        """Sorted numbers of the n-grams of a text; none if it has no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letters = self.alphabet[points]
        if not letters.any():
            return np.zeros(0, np.int64)
        # One space between words and at both ends.
        word = letters != SPACE_LETTER
        kept = word.copy()
        kept[1:] |= word[:-1]
        letters = np.concatenate([[0], letters[kept], [0]]).astype(np.int32)
        two = (letters[:-1] << LETTER_BITS) | letters[1:]
        three = (two[:-1] << LETTER_BITS) | letters[2:]
        self.flags[letters] = True
        self.flags[two + OFFSETS[1]] = True
        self.flags[three + OFFSETS[2]] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


class Model:
    """``place``: n-gram -> column, or -1 where no landmark has it."""

    def __init__(self, languages, place, landmarks, weights):
        self.languages, self.place, self.landmarks, self.weights = languages, place, landmarks, weights

    def scores(self, profiles: list[np.ndarray]) -> np.ndarray:
        """Rows of languages' regression values."""
        presence = np.zeros((len(profiles), self.landmarks.shape[0]), np.float32)
        for row, grams in enumerate(profiles):
            columns = self.place[grams]
            presence[row, columns[columns >= 0]] = 1.0 / np.sqrt(max(1, len(grams)))
        return presence @ self.landmarks @ self.weights


def train(texts: list[str], languages: list[str], landmarks: int, ridge: float) -> Model:
    """Landmarks are taken evenly over the languages, the texts with the most distinct n-grams up to 4,000 first."""
    profiles = Profiles()
    grams = [profiles.grams(t) for t in texts]
    used = [i for i, g in enumerate(grams) if len(g)]
    names = sorted({languages[i] for i in used})
    place = np.full(GRAMS, -1, np.int32)
    if not names:
        return Model([], place, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    chosen = []
    for name in names:
        own = [i for i in used if languages[i] == name]
        own.sort(key=lambda i: (-len(grams[i]) if len(grams[i]) <= 4000 else 0, i))
        chosen += own[: max(1, landmarks // len(names))]
    known = np.unique(np.concatenate([grams[i] for i in chosen]))
    place[known] = np.arange(len(known), dtype=np.int32)
    matrix = np.zeros((len(known), len(chosen)), np.float32)
    for column, i in enumerate(chosen):
        matrix[place[grams[i]], column] = 1.0 / np.sqrt(len(grams[i]))
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    kernels = Model(names, place, matrix, np.eye(len(chosen), dtype=np.float32)).scores([grams[i] for i in used]).astype(np.float64)
    features = np.column_stack([kernels @ whiten, np.ones(len(used))])
    target = np.array([[1.0 if languages[i] == name else -1.0 for name in names] for i in used])
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    # The constant goes with the text's own norm left out, so it is kept beside the product.
    model = Model(names, place, matrix, (whiten @ solved[:-1]).astype(np.float32))
    model.constant = solved[-1]
    return model


def fit(docs: DataFrame, labelled: DataFrame, per_language: int = 400, most_languages: int = 200, most_chars: int = 20_000, landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Fits on a bounded sample of ``docs`` (``id, text``) by the labels of ``labelled`` (``id, label``).

    At most ``per_language`` texts of at most ``most_chars`` characters for each of the ``most_languages`` most frequent
    labels (fewer of each where all languages together could exceed 160 million characters). Rows with a null id, label or text are not used.
    """
    sample = labelled_sample(docs, labelled, per_language, most_languages, most_chars)
    return train(sample["text"].tolist(), sample["label"].tolist(), landmarks, ridge)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", batch: int = 64) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row and its whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing was learned. Equal
    scores go to the language that sorts first. Ids may be null or repeat; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        profiles, model = Profiles(), sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                grams = [profiles.grams(t) for t in part.column("text").to_pylist()]
                names, scores = ["und"] * len(grams), np.zeros(len(grams))
                if model.languages:
                    values = model.scores(grams) + model.constant
                    chance = np.exp(3.0 * (values - values.max(axis=1, keepdims=True)))
                    chance /= chance.sum(axis=1, keepdims=True)
                    for i, g in enumerate(grams):
                        if len(g):
                            best = int(np.argmax(values[i]))
                            names[i], scores[i] = model.languages[best], chance[i, best]
                yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(F.col(text_column)).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
