"""Learned operators: language ID (3) and toxicity (8)."""

import random

import numpy as np
import pytest

from riskflow.llm import common, langid, minhash, toxicity

SF = "/root/testdata/sf0.01"


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=5)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    ids, mask, label = rng.integers(0, 256, (7, 6)).astype(np.uint8), np.ones((7, 6), np.float32), rng.integers(0, 3, 6)
    mask[5:, 2] = 0
    _, grads = net.gradients(ids, mask, label)
    for name, w in net.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, step = w[at], 1e-3
        w[at] = old + step
        up = net.gradients(ids, mask, label)[0]
        w[at] = old - step
        down = net.gradients(ids, mask, label)[0]
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], rel=0.05, abs=1e-4), name


def test_pooling_covers_whole_texts_and_batches():
    net = langid.Network(["a", "b"], hidden=4)
    texts = ["x" * n for n in (1, 63, 64, 65, 200_000)] + ["é" * 50, "zz" * 3000]
    together = net.predict(texts, max_bytes=1000)
    for other in (net.predict(texts), [net.predict([t])[0] for t in texts]):      # up to single-precision rounding
        assert [p for p, _ in other] == [p for p, _ in together]
        assert [s for _, s in other] == pytest.approx([s for _, s in together], abs=1e-5)
    data = texts[3].encode()
    probabilities = np.concatenate([net.positions(np.frombuffer(data[a:a + 64], np.uint8)[:, None])[:, :, 0] for a in (0, 64)], axis=1)
    assert together[3][1] == pytest.approx(probabilities.mean(axis=1).max(), abs=1e-5)
    assert len(net.label_positions(texts[3])) == 65


def test_language_held_out_accuracy(spark):
    got = langid.op3_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both["held_out"]]
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95


def test_language_of_messy_texts(spark, messy, nothing):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(40)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == ["de", "en"]
    got = {r.text: r.p for r in messy.select("text", langid.predict_column(net)("text").alias("p")).collect()}
    for t in (None, "", " \n\t "):
        assert (got[t].lang_pred, got[t].score) == ("und", 0.0)
    assert got["one two"].lang_pred in ("de", "en")
    assert langid.train(messy).languages == langid.train(nothing).languages == []      # no language to learn
    assert langid.Network([]).predict(["abc"]) == [("und", 0.0)]


def _corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts, labels, places = [], [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(rng.randint(3, 20))]
        toxic, at = i % 4 == 0, None
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vileword", "nastier", "nastiest"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(toxic))
        places.append(at)
    return texts, labels, places


def test_noisy_or_learns_sentences_from_document_labels():
    texts, labels, _ = _corpus(400, 1)
    model = toxicity.fit(texts, labels)
    texts, labels, places = _corpus(200, 2)
    for text, label, at in zip(texts, labels, places):
        score, offending = model.score(text)
        assert (score >= 0.5) == bool(label)
        if label:
            spans = toxicity.sentences(text)
            assert [spans.index((a, b)) for a, b, _ in offending] == [at]


def test_toxicity_held_out(spark):
    got = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    both = got.merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert got["score"].between(0, 1).all() and len(got) == 10_000
    assert held.loc[held["toxic"] == 1, "predicted"].mean() > 0.75
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.02


def test_toxicity_of_messy_texts(spark, messy, nothing):
    labels = spark.createDataFrame([(5, 1), (9, 0), (7, 0), (None, 1), (30, None), (12345, 1)], "doc_id long, toxic int")
    from riskflow.llm import common
    docs = common.id_and_text(messy)
    model = toxicity.train(docs, labels)
    got = docs.select("text", toxicity.score_column(model)("text").alias("s")).collect()
    assert len(got) == messy.count() and all(0 <= r.s.score <= 1 for r in got)
    assert next(r.s.score for r in got if r.text == "") == 0.0
    assert toxicity.train(common.id_and_text(nothing), labels).score("anything")[0] == 0.0
    assert toxicity.train(docs, labels.limit(0)).score("anything")[0] == 0.0


def test_a_worker_keeps_the_words_of_one_model_and_one_operator():
    texts, labels, _ = _corpus(60, 3)
    models = [toxicity.fit(texts, labels, steps=n) for n in (5, 6, 7)]
    for model in models:
        model.score(texts[0])
    assert list(toxicity._MEMO) == [models[-1].key]
    minhash.shingles("a b c d e f")
    common.forget(but=minhash.__name__)
    assert not toxicity._MEMO and minhash._WORDS
    common.forget()
    assert not minhash._WORDS
