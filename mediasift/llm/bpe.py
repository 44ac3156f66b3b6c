"""BPE encoding and decoding as streaming transducers.

Encoding. A merge list has a sufficient lookahead: a token that ends at least so many bytes before the end of what has
been read can no longer change. :class:`Merges` computes it from the list, and :class:`Encoder` reads bytes in blocks,
emits the tokens that are stable and keeps the rest, so a word of any length takes constant memory. A boundary that
no merge crossed separates two independent halves, therefore the next block starts at the last emitted token.

Decoding is a byte-to-text machine fed with one token at a time; a character that is cut across tokens waits in its state.

Words repeat. What the transducers make of a word is remembered in a table of bounded size: both start and end a word
in their initial state, so the remembered answer is what they would give again.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_or_empty

NEVER = 1 << 60
BLOCK = 4096  # bytes read between two looks for stable tokens
PORTION = 4096  # runs of a text that are held at once
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64

# The pre-tokenizer's pattern and white space are fixed values of the tokenizer.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def characters(category: str) -> str:
    """The characters of a general category, as ranges of a character class."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] == category:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return ranged(ranges)


# Code points of Unicode 16 that the tokenizer's library knows and the tables of Python 3.13 do not, as
# ranges of letters, of numbers, and of capitals (first, last, distance to the small letter; two are of Unicode 17).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def ranged(ranges) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


SMALL = {code: code + away for first, last, away in NEW_CAPITALS for code in range(first, last + 1)}
CAPITAL = re.compile(f"[{ranged((a, b) for a, b, _ in NEW_CAPITALS)}]")

# Characters that Python takes for white space and the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file, with its sufficient lookahead in bytes."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        model = data["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.spelling = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.byte = [vocab[c] for c in letters]
        self.last_byte = [vocab[c + self.suffix] for c in letters]
        self.value = {c: b for b, c in enumerate(letters)}
        self.place: dict[tuple[int, int], int] = {}
        self.pairs, self.merged = [], []
        for place, (left, right) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            pair = vocab[left], vocab[right]
            self.place[pair] = place
            self.pairs.append(pair)
            self.merged.append(vocab[left + right])
        self.lookahead = self._sufficient_lookahead()
        self.spelled_bytes = {i: s.encode() for i, s in self.spelling.items()}
        self.plain_bytes = {i: self._plain(s) for i, s in self.spelling.items()}

    def _plain(self, spelling: str) -> bytes:
        if spelling in self.special:
            return spelling.encode()
        word_end = bool(self.suffix) and spelling.endswith(self.suffix)
        return bytes(self.value[c] for c in (spelling.removesuffix(self.suffix) if word_end else spelling)) + b" " * word_end

    def length(self, token: int) -> int:
        return len(self.spelling[token].removesuffix(self.suffix)) if self.suffix else len(self.spelling[token])

    def _sufficient_lookahead(self) -> int:
        """How far to the right the fate of a merge can depend on text.

        Merge ``(l, r)`` looks at ``r``, and fails where an earlier merge takes ``r`` itself, or a token on ``r``'s
        right edge, together with what follows. That merge depends on text in turn, on still earlier merges only, so the
        longest chain is found in one pass over the list.
        """
        made = {}
        for place, merged in enumerate(self.merged):
            made.setdefault(merged, place)
        starts_with: dict[int, list[tuple[int, int]]] = {}  # left token -> (place, farthest reach so far)
        longest = 0
        for place, (left, right) in enumerate(self.pairs):
            beyond, edge, taken_at = 0, right, place
            while True:
                for other, reach in reversed(starts_with.get(edge, ())):
                    if other < taken_at:
                        beyond = max(beyond, reach)
                        break
                if edge not in made:
                    break
                taken_at = made[edge]
                edge = self.pairs[taken_at][1]
            reach = self.length(right) + beyond
            longest = max(longest, reach)
            known = starts_with.setdefault(left, [])
            known.append((place, max(reach, known[-1][1] if known else 0)))
        return longest + max(map(self.length, self.spelling))

    def merge(self, tokens: list[int]) -> list[int]:
        """The tokens after all merges, earliest in the list first, leftmost first."""
        return self._merge_short(tokens) if len(tokens) < 40 else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        place_of = self.place.get
        places = [place_of(pair, NEVER) for pair in zip(tokens, tokens[1:])]
        while places and (best := min(places)) != NEVER:
            i = places.index(best)
            tokens[i : i + 2] = (self.merged[best],)
            del places[i]
            if i:
                places[i - 1] = place_of((tokens[i - 1], tokens[i]), NEVER)
            if i < len(places):
                places[i] = place_of((tokens[i], tokens[i + 1]), NEVER)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        tokens, n = list(tokens), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def consider(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (place := self.place.get((tokens[i], tokens[j]))) is not None:
                heapq.heappush(heap, (place, i))

        for i in range(n):
            consider(i)
        while heap:
            place, i = heapq.heappop(heap)
            if (j := after[i]) >= n or (tokens[i], tokens[j]) != self.pairs[place]:
                continue
            tokens[i], tokens[j], after[i] = self.merged[place], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            consider(before[i])
            consider(i)
        return [t for t in tokens if t >= 0]


class Encoder:
    """Bytes of one word in, stable tokens out."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, b""

    def feed(self, data: bytes):
        """The tokens that have become stable; while less than a block is held there are none."""
        if len(self.held) + len(data) < self.block:
            self.held += data
            return ()
        return self._fed(data)

    def _fed(self, data: bytes):
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            if len(self.held) >= self.block + self.merges.lookahead:
                yield from self._stable()

    def _stable(self):
        merged = self.merges.merge([self.merges.byte[b] for b in self.held])
        done, end = 0, len(self.held) - self.merges.lookahead
        for token in merged:
            if done + self.merges.length(token) > end:
                break
            done += self.merges.length(token)
            yield token
        self.held = self.held[done:]

    def finish(self) -> list[int]:
        """The tokens of what is held, which ends the word; the encoder is as new."""
        held, self.held = self.held, b""
        if not held:
            return []
        tokens = [self.merges.byte[b] for b in held]
        tokens[-1] = self.merges.last_byte[held[-1]]
        return self.merges.merge(tokens)


class Decoder:
    """Tokens in, text out. ``spelled`` gives the library's text for a tokenizer without decoder: spellings between spaces.

    Otherwise tokens are turned back into the bytes they stand for, word ends into spaces; bytes that are no UTF-8
    become U+FFFD.
    """

    def __init__(self, merges: Merges, spelled: bool = False):
        self.data = merges.spelled_bytes if spelled else merges.plain_bytes
        self.separator, self.first = b" " if spelled else b"", True
        self.decode = codecs.getincrementaldecoder("utf-8")("replace").decode

    def feed(self, token: int) -> str:
        """What is certain once ``token`` is known; a character cut across tokens waits."""
        return self.feed_bytes(self.data[token])

    def feed_bytes(self, data: bytes) -> str:
        """The bytes of one token, or of several with the separator between them."""
        data = data if self.first else self.separator + data
        self.first = False
        return self.decode(data)

    def finish(self) -> str:
        return self.decode(b"", True)


class _Remembered(dict):
    """Run without white space -> (its ids as text, the bytes of its tokens for the decoder, number of tokens)."""

    def __init__(self, tokenizer: "Tokenizer"):
        self.tokenizer, self.merges = tokenizer, tokenizer.merges
        self.encoder = Encoder(tokenizer.merges)
        self.words: dict[str, tuple[str, bytes, int]] = {}

    def __missing__(self, run: str):
        words = self.tokenizer.words.findall(run)
        if len(words) == 1:
            entry = self.word(words[0])
        else:
            entries = [self.words.get(w) or self.word(w) for w in words]
            entry = " ".join([e[0] for e in entries]), b" ".join([e[1] for e in entries]), sum([e[2] for e in entries])
        if len(run) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = entry
        return entry

    def word(self, word: str) -> tuple[str, bytes, int]:
        tokens = [*self.encoder.feed(word.encode()), *self.encoder.finish()]
        entry = " ".join(map(str, tokens)), b" ".join(map(self.merges.spelled_bytes.__getitem__, tokens)), len(tokens)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = entry
        return entry


class Tokenizer:
    """Normalises, splits into words and encodes them, as the tokenizer file says."""

    def __init__(self, definition: str):
        self.merges = Merges(definition)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        letters, numbers = characters("L") + ranged(NEW_LETTERS), characters("N") + ranged(NEW_NUMBERS)
        self.words = re.compile(f"[{letters}]+|[{numbers}]|{CONTRACTIONS}|[^{SPACE}{letters}{numbers}]+")
        self.runs = re.compile(f"[^{SPACE}]+")
        self.remembered = _Remembered(self)

    def pieces(self, text: str):
        """(text, special token) in order; special tokens are recognised before normalisation."""
        at = 0
        if self.special and "<|" in text:
            for m in self.special.finditer(text):
                yield text[at : m.start()], m[0]
                at = m.end()
        yield text[at:] if at else text, None

    def split(self, text: str) -> list[str]:
        """Runs without white space, normalised. White space parts words and is dropped, so a run's words are its own."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if CAPITAL.search(text):
                text = text.translate(SMALL)
            text = text.replace("Σ", "σ")  # characters are lower-cased one at a time: a closing sigma like any other
        text = text.lower()
        return text.split() if text.isprintable() or not SEPARATORS.search(text) else self.runs.findall(text)

    def entries(self, text: str):
        """What the encoder says, run by run: (ids as text, the bytes of the tokens, number of tokens)."""
        for part, special in self.pieces(text):
            yield from map(self.remembered.__getitem__, self.split(part))
            if special is not None:
                yield str(self.merges.special[special]), special.encode(), 1

    def digests(self, text: str, keep_ids: bool = False):
        """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded text, ids or None), entry by entry.

        Ids and decoded text are hashed as they come; the decoder's state goes on from one portion of tokens to the next.
        """
        count, ids, texts, kept = 0, hashlib.sha256(), hashlib.sha256(), []
        decoder, entries, gap = Decoder(self.merges, spelled=True), self.entries(text), ""
        while portion := list(itertools.islice(entries, PORTION)):
            spelled = " ".join([e[0] for e in portion])
            ids.update((gap + spelled).encode())
            texts.update(decoder.feed_bytes(b" ".join([e[1] for e in portion])).encode())
            count += sum([e[2] for e in portion])
            if keep_ids:
                kept.append(np.fromstring(spelled, np.int32, sep=" "))
            gap = " "
        texts.update(decoder.finish().encode())
        return count, ids.hexdigest(), texts.hexdigest(), np.concatenate(kept or [np.zeros(0, np.int32)]) if keep_ids else None

    def encode(self, text: str) -> list[int]:
        return [int(i) for entry in self.entries(text) for i in entry[0].split(" ")]

    def decode(self, tokens: list[int], spelled: bool = False) -> str:
        decoder = Decoder(self.merges, spelled)
        return "".join(map(decoder.feed, tokens)) + decoder.finish()


_known: dict[str, Tokenizer] = {}


def tokenizer(definition: str) -> Tokenizer:
    """One per process and file: tables and remembered words serve all tasks of a Python worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _known:
        _known.clear()
        _known[key] = Tokenizer(definition)
    return _known[key]


def _definition(spark: SparkSession, path: str):
    """The file's text, sent to every executor once (a tokenizer file has a fixed size of some MB)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _each(docs: DataFrame, columns: dict, schema: str, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield make(batch.slice(at, 256))

    return docs.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: one row per row. Null and empty texts have no tokens; special tokens' strings become their ids.

    Ids may be null or repeat; other columns are not read; an empty table stays empty.
    """
    sent = _definition(docs.sparkSession, path)

    def make(batch):
        t = tokenizer(sent.value)
        ids = [t.encode(x) for x in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _each(docs, {"doc_id": F.col(id_column), "text": text_or_empty(F.col(text_column))}, f"doc_id {kind}, ids array<int>", make)


def decode(rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids", spelled: bool = False) -> DataFrame:
    """``doc_id, text``: one row per row; a null list of ids gives the empty text. ``spelled``: see :class:`Decoder`."""
    sent = _definition(rows.sparkSession, path)

    def make(batch):
        t = tokenizer(sent.value)
        texts = [t.decode(x or [], spelled) for x in batch.column("ids").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_column].dataType.simpleString()
    return _each(rows, {"doc_id": F.col(id_column), "ids": F.col(ids_column)}, f"doc_id {kind}, text string", make)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): what encoding, and decoding again, gives for every row.

    The same answers as :func:`encode` and :func:`decode`, hashed where they are made so that tokens need not move.
    """
    sent = _definition(docs.sparkSession, path)

    def make(batch):
        t = tokenizer(sent.value)
        counts, spelled, ids, texts = [], [], [], []
        for text in batch.column("text").to_pylist():
            n, id_digest, text_digest, numbers = t.digests(text, with_ids)
            counts.append(n)
            ids.append(id_digest)
            texts.append(text_digest)
            spelled.append(numbers)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns, names = [*columns, pa.array(spelled, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.record_batch(columns, names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _each(docs, {"doc_id": F.col(id_column), "text": text_or_empty(F.col(text_column))}, schema, make)
