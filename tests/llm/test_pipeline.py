import hashlib
import string
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from mediasift.llm import catalog
from mediasift.llm.shared import write_out
from mediasift.llm.shingles import shingles

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = write_out(stage(spark, docs, SF))
        rows = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
            after = {r.doc_id: r.text for r in rows}
            assert all(before[i] == t for i, t in after.items())
        if name == "toxicity":
            field = catalog.toxicity_field(docs, SF)
            assert set(after) == {i for i, t in before.items() if field.judge(t)[0] < 0.5}
        elif name == "exact dedup":
            keep = {}
            for i, t in before.items():
                t = t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
                keep[t] = max(i, keep.get(t, i))
            assert set(after) == set(keep.values())
        elif name == "near dedup":
            sets = {i: set(shingles(t).tolist()) for i, t in before.items()}
            root = {i: i for i in sets}
            holders = {}
            for i in sorted(sets):
                for x in sets[i]:
                    holders.setdefault(x, []).append(i)
            common = Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1 :])

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for (a, b), n in common.items():
                if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
                    a, b = find(a), find(b)
                    root[max(a, b)] = min(a, b)
            assert set(after) == {i for i in sets if find(i) == i}
        elif name == "source mixing":
            assert abs(len(rows) - len(before)) < 5 * len(before) ** 0.5
        else:
            library = Tokenizer.from_file(catalog.tokenizer_file())
            drawn = Counter(r.doc_id for r in docs.collect())
            assert Counter(r.doc_id for r in rows) == drawn
            for r in rows:
                ids = library.encode(before[r.doc_id], add_special_tokens=False).ids
                assert list(r.ids) == ids and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        if name != "bpe":
            docs, before = out, after


def test_odd_documents_pass_through_every_stage(spark):
    text = "some words that are long enough to make shingles of them all"
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, text, "en", "s", 60), (3, text, "en", "s", 60), (None, text, "xx", "t", 60), (4, "y " * 50_000, "en", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for odd in (docs, docs.limit(0)):
        left = odd
        for name, stage in corpus_pipeline.STAGES:
            before, left = left, write_out(stage(spark, left, SF))
            assert name == "bpe" or left.columns == before.columns
        assert left.count() == 0 or odd.count() > 0
