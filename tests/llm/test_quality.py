"""The quality classifier: gradients, the softmax over long texts, held-out labels."""

import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import quality


def weights():
    draw = np.random.default_rng(4)
    return quality.Weights.of(quality.Weights.start(0.2).flat() + draw.normal(0, 0.2, len(quality.Weights.start(0.2).flat())))


def plain(own, x):
    """Score of one text from its passages' features, straight from the definition."""
    h = np.tanh(x @ own.a + own.a0)
    e = (np.tanh(h @ own.v) / (1 + np.exp(-(h @ own.u)))) @ own.w
    share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return 1 / (1 + np.exp(-(share @ h @ own.c + own.c0[0])))


def of_text(text):
    body = np.frombuffer((text or "").encode(), np.uint8)
    parts = [body[k : k + quality.PASSAGE] for k in range(0, max(len(body), 1), quality.PASSAGE)]
    return np.concatenate([quality.features(p, np.array([len(p)])) for p in parts])


def test_gradient_equals_differences():
    own, draw = weights(), np.random.default_rng(1)
    flat, x = own.flat(), draw.random((11, quality.FEATURES))
    starts, label = np.array([0, 1, 6]), np.array([1.0, 0.0, 1.0])
    found = quality.gradient(own, x, starts, label)

    def loss(flat):
        p = np.array([plain(quality.Weights.of(flat), part) for part in np.split(x, starts[1:])])
        return -np.mean(np.log(np.where(label == 1, p, 1 - p)))

    for k in [*draw.integers(0, len(flat), 40), *range(len(flat) - 30, len(flat))]:
        moved = np.zeros_like(flat)
        moved[k] = 1e-5
        assert abs((loss(flat + moved) - loss(flat - moved)) / 2e-5 - found[k]) < 1e-6


def test_scores_of_any_length(monkeypatch):
    pick, own = random.Random(3), weights()
    texts = ["".join(pick.choice("abc ÄÖ.\n&") for _ in range(n)) for n in (0, 1, 2, 511, 512, 513, 9000, 40, 3)] + [None, "x" * 70_000, "last one"]
    want = [plain(own, of_text(t)) for t in texts]
    for stretch in (1, 3, 2048):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        assert np.allclose(quality.scores(pa.array(texts, pa.string()), own), want)
        assert np.allclose(quality.scores(pa.array(["front", *texts], pa.string()).slice(1), own), want)
    assert len(quality.scores(pa.array([], pa.string()), own)) == 0


def test_held_out_labels_are_told(spark):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("aeinrst") for _ in range(pick.randint(2, 8)))
    clean = lambda n: " ".join(word() for _ in range(n))
    poor = lambda n: " ".join(word() + pick.choice(["###", "!!", "$$"]) for _ in range(n))
    rows = []
    for i in range(360):
        good, long = i % 3 > 0, i % 10 == 0
        text = clean(pick.randint(5, 200)) if good else poor(pick.randint(20, 150)) + (" " + clean(100) if long else "")
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (None, "no id", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(None, 1), (1000, None), (4, 7)], "doc_id long, quality int")
    own = quality.train(docs, labels)
    assert np.array_equal(own.flat(), quality.train(docs.repartition(3), labels.repartition(2)).flat())  # however the tables are dealt
    found = {r.doc_id: r.score for r in quality.score(docs, own).collect()}
    held = [(q, found[i]) for i, _, q in rows if i % 2 == 0]
    assert np.mean([(s >= 0.5) == q for q, s in held]) > 0.95 and 0 <= found[1000] <= 1
    one = quality.train(docs, labels.where("quality = 1"))
    assert all(abs(r.score - 121 / 122) < 1e-6 for r in quality.score(docs, one).select("score").distinct().collect())
    assert quality.score(docs.limit(0), own).count() == 0
