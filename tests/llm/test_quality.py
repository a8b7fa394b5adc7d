import random
import zlib

import numpy as np
import pytest

from keyloom.llm import quality
from keyloom.llm.quality import CLASS, SIZE, Model, N, class_prior, features, held_out, prior_cuts, score_documents, train

SCHEMA = "doc_id bigint, text string, score string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def good(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))) + "."


def junk(rng):
    return " ".join(w + rng.choice(["%%%", "***"]) for w in good(rng).split()) if rng.random() < 0.5 else "Spam " * rng.randint(20, 60)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        rows.append((i, junk(rng) if bad else good(rng), "x", "en"))
        if rng.random() < 0.4:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_features_count_every_byte():
    at, values = features(b"ab%% ab")
    dense = np.zeros(SIZE)
    dense[at] = values
    sign = CLASS[ord("%")]
    assert dense[sign] == pytest.approx(np.sqrt(2 / 7)) and dense[N + sign * N + sign] == pytest.approx(np.sqrt(1 / 7))
    assert [int(i) for i in features(b"")[0]] == [N + N * N]


def test_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(0)
    dense = lambda x: np.c_[x, np.ones(len(x)), np.zeros((len(x), SIZE - 2))]
    p, u = dense(rng.normal(1, 1, 3000)), dense(np.r_[rng.normal(1, 1, 2100), rng.normal(-4, 1, 900)])
    w, cuts, above_p = prior_cuts(p[::2], u[::2], p[1::2])
    scores = u[1::2] @ w
    assert abs(class_prior(np.array([(scores >= c).mean() for c in cuts]), above_p) - 0.7) < 0.06


def test_scores_are_those_of_the_weights(spark):
    rng = np.random.default_rng(2)
    model = Model(rng.normal(size=SIZE), 0.5)
    texts = ["", "a b", "One line.\nTwo lines!", "x" * 300, None]
    got = score_documents(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        at, values = features((t or "").encode())
        want = 1 / (1 + np.exp(-float(sum(model.weights[i] * v for i, v in zip(at, values, strict=True)))))
        assert r.score == pytest.approx(want) and r.predicted == int(want >= 0.7)


def test_samples_are_bounded_also_where_rows_repeat(spark, corpus, monkeypatch):
    rows, labels = corpus
    docs = spark.createDataFrame(rows + [rows[labels[0][0]]] * 500 + [(labels[0][0], f"other text {k}", "x", "en") for k in range(300)], SCHEMA)
    seen = []
    matrix = quality._matrix
    monkeypatch.setattr(quality, "_matrix", lambda rows: seen.append(len(rows)) or matrix(rows))
    model = train(docs, spark.createDataFrame(labels, LABELS), sample=100)
    assert seen == [100, 100] and model.learnt
    every = train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS))
    assert every.learnt and every.prior > 0.8  # labels for every document leave no row without one


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = train(docs, known)
    got = {r.doc_id: r for r in score_documents(docs, model).withColumn("held", held_out(docs.doc_id)).collect()}
    assert len(got) == len(rows) and abs(model.prior - 0.8) < 0.1
    assert all(r.held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [(got[i].predicted, y) for i, y, _ in labels if got[i].held]
    assert np.mean([a == b for a, b in test]) > 0.97
    flipped = [(i, 1 - y if got[i].held else y, t) for i, y, t in labels]  # labels held out are not read
    assert np.array_equal(train(docs, spark.createDataFrame(flipped, LABELS)).weights, model.weights)


def test_edge_cases(spark, corpus):
    rows, labels = corpus
    docs, known = spark.createDataFrame(rows[:200], SCHEMA), spark.createDataFrame([*labels, (None, None, None), (1, None, 0)], LABELS)
    model = train(docs, known)
    odd = spark.createDataFrame([(1, None, None, None), (1, "", None, None), (None, "w " * 200_000, None, None), (2, "same text", "a", "b"), (2, "same text", "a", "b")], SCHEMA)
    got = score_documents(odd, model)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted"]
    scores = [r.score for r in got.collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[3] == scores[4]
    assert score_documents(docs.limit(0), model).count() == 0
    none = train(docs.limit(0), known.limit(0))
    assert not none.learnt and [r.score for r in score_documents(odd, none).collect()] == [0.5] * 5
