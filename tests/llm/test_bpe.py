import hashlib
import random

import pytest
from tokenizers import Tokenizer

from mediasift.llm import bpe, catalog


@pytest.fixture(scope="module")
def both():
    path = catalog.tokenizer_file()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    with open(path, encoding="utf-8") as file:
        return library, bpe.Tokenizer(file.read())


TEXTS = [
    "", " ", "Hello, World's 42nd!", "ΑΣ ΟΔΟΣ", "é é İI ß", "a\x1cb\x1fc\x85d\xa0e f​g", "<|endoftext|>x<|startoftext|> <|EndOfText|><|end", "don't WE'LL 'tis ''s !'s",
    "日本語テキスト 123 ①②½ Ⅷ", "👩‍👩‍👧 \U0001F600!!", "\n\t\r\v\f", "a_b-c.d/e", "x" * 5000, "ab" * 3000 + " " + "!" * 2000, "﻿bom \u0000nul �",
]


def test_same_as_the_library(both):
    library, own = both
    rng = random.Random(4)
    letters = "abcdefghij é ß 12 ,.!' \n ñ Ж 字 <|>_"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(200)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids, spelled=True) == library.decode(ids, skip_special_tokens=False)
        decoded = library.decode(ids, skip_special_tokens=False)
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert own.digests(text)[:3] == (len(ids), *want) and own.digests(text, keep_ids=True)[3].tolist() == ids


def test_streaming_in_small_blocks_gives_the_same_tokens(both):
    library, own = both
    rng = random.Random(6)
    parts = ["the", "ing", "an", "er", "tion", "a", "o", "un", "l", "ll", "x", "s", "t", "ist", "'"[:0]]
    for n in range(150):
        word = "".join(rng.choice(parts) for _ in range(rng.randrange(100, 600))) if n % 2 else "".join(rng.choice("abcdethsrin") for _ in range(rng.randrange(200, 1200)))
        for block in (1, 16, 200):
            encoder = bpe.Encoder(own.merges, block)
            tokens, most = [], 0
            for at in range(0, len(word), 50):
                tokens += encoder.feed(word[at : at + 50].encode())
                most = max(most, len(encoder.held))
            tokens += encoder.finish()
            assert tokens == library.encode(word, add_special_tokens=False).ids
            assert most <= 2 * (block + own.merges.lookahead + 50)


def test_bytes_come_back(both):
    own = both[1]
    for text in ("hello world 42", "naïve 日本 😀"):
        assert own.decode(own.encode(text)).replace(" ", "") == text.replace(" ", "")
    broken = own.merges.byte[0xF0]
    assert own.decode([broken]) == "�"


def test_operators(spark, both):
    library, own = both
    path = catalog.tokenizer_file()
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "null id", 0), (3, None, 0), (3, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = sorted((-1 if i is None else i, own.encode(t or "")) for i, t, _ in rows)
    encoded = bpe.encode(df, path)
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in encoded.collect()) == want
    decoded = bpe.decode(encoded, path, spelled=True)
    assert sorted(r.text for r in decoded.collect()) == sorted(library.decode(ids, skip_special_tokens=False) for _, ids in want)
    for r in bpe.round_trip(df, path, with_ids=True).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), path).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first().text == ""


def test_every_code_point_alone_and_between_letters(both):
    """All but private ones and halves of surrogate pairs; most scripts by a sample, what Unicode 16 added whole."""
    library, own = both
    added = [c for a, b in bpe.NEW_LETTERS + bpe.NEW_NUMBERS + tuple((a, b) for a, b, _ in bpe.NEW_CAPITALS) for c in range(a, b + 1)]
    codes = sorted({*range(0x3000), *range(0xA000, 0xD800, 3), *range(0xE000 + 6400, 0x20000, 7), *added})
    for form in ("{}", "a{}b", "{0}{0} 1{0}"):
        texts = [form.format(chr(c)) for c in codes]
        for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text) == found.ids, ascii(text)
