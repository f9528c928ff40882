from __future__ import annotations

import random
import zlib

import numpy as np
from prismlake.llm import classifier

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_tables_hold_what_was_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    truth = 3 * (x[:, 0] > 0.5) + 4 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 3.5
    y = (rng.random(6000) < 1 / (1 + np.exp(-truth))).astype(float)
    model = classifier.fit(x[:4000], y[:4000])
    assert (1, 2) in model.pairs or (2, 1) in model.pairs
    scores = model.scores(x[4000:])
    clear = abs(truth[4000:]) > 1
    assert ((scores > 0.5) == (truth[4000:] > 0))[clear].mean() > 0.97
    by_hand = [model.intercept + sum(t[b[f]] for f, t in enumerate(model.single)) + sum(t[b[f], b[g]] for (f, g), t in model.pairs.items()) for b in model.bins(x[4000:4050])]
    assert np.allclose(scores[:50], 1 / (1 + np.exp(-np.array(by_hand))))


def test_degenerate_samples_and_texts_have_scores():
    one = classifier.fit(np.ones((5, 3)), np.ones(5))
    assert 0.5 < one.scores(np.zeros((1, 3)))[0] < 1
    none = classifier.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.scores(np.zeros((2, 3))).tolist() == [0.5, 0.5] and none.scores(np.zeros((0, 3))).tolist() == []
    for text in ["", None, " \n", "\0", "x", "é" * 100_000, "a b " * 200_000]:
        assert len(classifier.features(text)) == len(classifier.FEATURES) and np.isfinite(classifier.features(text)).all()


def test_held_out_accuracy_of_the_query(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 200)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", 0))
        labels.append((i, int(good), 0))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5001, "", "en", "s", 0), (None, "some words", None, None, None)]
    labels += [(None, 1, 0), (1, None, 0), (7777, 1, 0), (2, labels[2][1], 0)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = classifier.op1_quality_classifier(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    truth = {i: q for i, q, _ in labels[:900]}
    test = [r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    assert sum(test) / len(test) > 0.95
    assert sorted(map(str, found)) == sorted(map(str, classifier.op1_quality_classifier(spark, str(tmp_path)).collect()))


def test_the_sample_bounds_the_rows_that_are_fitted(spark, monkeypatch):
    rows = [(5, f"text {i} " * 3, "en", "s", 0) for i in range(6000)] + [(i, "some words", "en", "s", 0) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [5, *range(100, 160)]], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda x, y: seen.append((x.shape, len(y))))
    classifier.train(docs, labels, sample=20)
    classifier.train(docs, labels)
    classifier.train(docs.where("false"), labels)
    assert seen[0] == ((20, len(classifier.FEATURES)), 20) and seen[1][1] <= 61 and seen[2][1] == 0
