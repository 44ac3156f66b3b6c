import random
import zlib

import numpy as np

from mediasift.llm import catalog, language_id, quality, toxicity
from mediasift.llm.shared import labelled_sample

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "123 !?"), (None, "the of and"), (3, "x"), (4, "word " * 60_000), (5, "\U0001F600 日本語 İ")]


def odd_rows(spark):
    return spark.createDataFrame([(*r, "a", 1.0) for r in ODD], "doc_id long, text string, label string, score double")


def no_labels(spark, kind="int"):
    return spark.createDataFrame([], f"id long, label {kind}")


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in catalog.op4_language_id(spark, SF).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if truth[r.doc_id]]) > 0.97


def test_language_of_odd_rows(spark):
    texts = [f"{a} {b}" for a in ("the", "of", "und", "der") for b in ("house", "haus", "tree", "baum")]
    model = language_id.train(texts, ["en" if t.startswith(("the", "of")) else "de" for t in texts], 8, 1e-3)
    found = [(r.doc_id, r.lang_pred) for r in language_id.predict(odd_rows(spark), model).collect()]
    assert found[:3] == [(1, "und"), (2, "und"), (3, "und")] and found[3] == (None, "en") and len(found) == len(ODD)
    assert language_id.predict(odd_rows(spark).limit(0), model).count() == 0
    nothing = language_id.fit(odd_rows(spark).selectExpr("doc_id id", "text"), no_labels(spark, "string"))
    assert {r.lang_pred for r in language_id.predict(odd_rows(spark), nothing).collect()} == {"und"}


def test_scores_are_the_kernel_regression():
    profiles = language_id.Profiles()
    texts, names = ["abc abd", "abe", "xyz", "xyy zz"], ["a", "a", "b", "b"]
    model = language_id.train(texts, names, 4, 0.5)
    grams = [set(profiles.grams(t).tolist()) for t in texts]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in grams] for x in grams])
    unit = language_id.Model(names, model.place, model.landmarks, np.eye(4, dtype=np.float32))
    assert np.allclose(np.sort(unit.scores([profiles.grams(t) for t in texts]), axis=1), np.sort(kernel, axis=1), atol=1e-6)


def test_quality_on_held_out_texts(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in catalog.op8_quality_attention(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.97


def test_quality_of_odd_rows(spark):
    net = quality.train(["good words here and there"] * 8 + ["BAD!! BAD!! BAD!!"] * 8, np.array([1.0] * 8 + [0.0] * 8), 20)
    found = quality.score(odd_rows(spark), net).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.score for r in quality.score(odd_rows(spark), quality.fit(odd_rows(spark).selectExpr("doc_id id", "text"), no_labels(spark))).collect()} == {0.5}
    assert quality.score(odd_rows(spark).limit(0), net).count() == 0


def test_attention_gradients_are_those_of_the_loss():
    features, sizes = quality.passage_features(["some words " * 90, "OTHER!! words | here " * 70, ""])
    net = quality.Network(features.mean(axis=0), features.std(axis=0) + 1, width=5, depth=4)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        value, _ = net.forward(features, sizes)
        return float(np.sum(np.logaddexp(0, value) - y * value))

    value, kept = net.forward(features, sizes)
    grads = net.gradients(quality.cross_entropy_score(value) - y, kept)
    for name, weight in net.weights.items():
        place = tuple(0 for _ in weight.shape)
        weight[place] += 1e-5
        up = loss()
        weight[place] -= 2e-5
        assert np.isclose((up - loss()) / 2e-5, grads[name][place], atol=1e-4)
        weight[place] += 1e-5


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "bcdfgk" for b in ("an", "ol", "ir", "est", "um")]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zonker", "qruft" + rng.choice(plain)])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_field_learns_words_and_word_edges():
    field = toxicity.train(*toxic_corpus(600, 1))
    texts, labels = toxic_corpus(200, 2)
    found = [field.judge(t) for t in texts]
    assert [int(s >= 0.5) for s, _ in found] == labels
    for (_, spans), text, label in zip(found, texts, labels):
        assert all(text[x["start"] : x["end"]].startswith(("zonker", "qruft")) for x in spans) and bool(spans) == bool(label)


def test_marginals_are_exact():
    field = toxicity.Field({"bad": 3.0, "so~": 1.0}, -2.0, np.array([[0.3, -0.4], [-0.2, 0.9]]), 0.1)
    rng = random.Random(0)
    for n in (1, 2, 7, 400):
        words = [rng.choice(["a"] * 60 + ["bad", "sofar"]) for _ in range(n)]
        emit = [np.array([1.0, np.exp(field.emission(w) + field.bias)]) for w in words]
        jump = np.exp(field.moves)
        forward, backward = [np.array([1.0, np.exp(field.start)]) * emit[0]], [np.ones(2)]
        for e in emit[1:]:
            forward.append((f := (forward[-1] @ jump) * e) / f.sum())
        for e in reversed(emit[1:]):
            backward.append((b := jump @ (backward[-1] * e)) / b.sum())
        joint = np.array(forward) * np.array(backward[::-1])
        want = joint[:, 1] / joint.sum(axis=1)
        got = np.full(n, field.far)
        for first, values in field.marginals(words):
            got[first : first + len(values)] = values
        assert np.allclose(got, want, atol=1e-9)


def test_toxicity_on_held_out_texts(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in catalog.op2_toxicity_crf(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.93


def test_toxicity_of_odd_rows(spark):
    field = toxicity.train(*toxic_corpus(300, 1))
    rows = odd_rows(spark).union(spark.createDataFrame([(9, "ban zonker col", "a", 1.0)], odd_rows(spark).schema))
    found = {(r.doc_id, r.predicted) for r in toxicity.score(rows, field).collect()}
    assert (9, 1) in found and {(1, 0), (2, 0), (None, 0)} <= found
    left = toxicity.drop_toxic(rows, field)
    assert left.columns == rows.columns and left.count() == len(ODD)
    assert toxicity.score(rows.limit(0), field).count() == 0
    nothing = toxicity.fit(rows.selectExpr("doc_id id", "text"), no_labels(spark))
    assert {r.predicted for r in toxicity.score(rows, nothing).collect()} == {0}


def test_a_sample_keeps_every_label_and_defines_its_choice(spark):
    """One id in most rows, contradicting labels, several texts under an id."""
    docs = spark.createDataFrame([(1, f"b{i}") for i in range(50)] + [(i, f"t{i}") for i in range(2, 40)], "id long, text string")
    labelled = spark.createDataFrame([(1, 1)] * 50 + [(1, 0)] + [(i, i % 2) for i in range(2, 40)] + [(None, 1), (5, None)], "id long, label int")
    got = labelled_sample(docs, labelled, 3, 2, 100)
    assert sorted(got["label"]) == [0, 0, 0, 1, 1, 1] and got["id"].is_unique
    everything = labelled_sample(docs, labelled, 100, 2, 100)
    assert len(everything) == 39 and dict(zip(everything["id"], everything["label"]))[1] == 0 and dict(zip(everything["id"], everything["text"]))[1] == "b0"
    assert len(labelled_sample(docs, labelled, 100, 2, 100, most_text=1000)) == 10
    assert labelled_sample(docs, labelled.limit(0), 3, 2, 100).empty


def test_letters_of_all_planes(spark):
    texts = ["\U0001fa70 \U0001f600!", "\U0001e900\U0001e901", "\U00010000", "\U00020000", "12 ...", "", None, "\u24b6"]
    profiles = language_id.Profiles()
    assert [len(profiles.grams(t or "")) > 0 for t in texts] == [any(c.isalpha() for c in t or "") for t in texts]


def test_a_word_of_a_set_phrase_becomes_telling_and_copies_do_not():
    rng = random.Random(1)
    word = lambda: "w" + str(rng.randrange(3000))
    clean = [[word() for _ in range(40)] for _ in range(800)]
    toxic = [[word() for _ in range(20)] + ["you", "vile", "thing"] + [word() for _ in range(20)] for _ in range(60)]
    copied = [word() for _ in range(30)] + ["harmless"] + [word() for _ in range(30)]
    told = toxicity.telling_features(toxic + [list(copied) for _ in range(60)], clean + [["you"], ["thing"]] * 30)
    assert any("vile" in f for f in told) and not any("harmless" in f for f in told)
