"""Training of the classifiers against loops and numeric gradients, and its bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import langid, quality, text, toxicity


def test_ftrl_against_loops():
    """FTRL-proximal, feature by feature, over the same batches."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint32) * np.uint32(2654435761) for _ in range(90)]
    labels = np.array([float(d.size > 0 and d[0] % 3 == 0) for d in docs])
    p = toxicity.ToxicityParams(bits=10, l1=0.5, epochs=3, batch=8)
    got = toxicity.train(docs, labels, p)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= p.l1 else (math.copysign(p.l1, zi) - zi) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    def features(d):
        b, _ = toxicity.features(d, np.array([0, len(d)]), p.bits)
        return [*b.tolist(), "bias"]

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        rows = order.permutation(len(docs))
        for at in range(0, len(rows), p.batch):
            grad = {}
            for r in rows[at : at + p.batch]:
                x = features(docs[r])
                g = 1 / (1 + math.exp(-sum(weight(i) for i in x))) - labels[r]
                for i in x:
                    grad[i] = grad.get(i, 0.0) + g
            for i, g in grad.items():
                w, before = weight(i), n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / p.alpha * w
                n[i] = before + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(got.buckets.tolist(), got.weights)) == pytest.approx(want) and got.bias == pytest.approx(weight("bias"))
    assert 0 < len(want) < len(z)  # L1 leaves some out


def test_skip_grams():
    words = np.array([1, 2, 3], np.uint32)
    b, doc = toxicity.features(np.concatenate((words, words)), np.array([0, 3, 6]), 20)
    assert sorted(b[doc == 0]) == sorted(b[doc == 1]) and (doc == 0).sum() == 3 + 2 + 1  # words, neighbours, one word between


def test_first_step_of_the_factorisation_machine():
    """One batch, one epoch: AdaGrad on the gradient of the log loss, which is taken numerically."""
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (5, 0, 3, 8)]
    stats, labels = rng.random((4, len(quality.STATS))), np.array([1.0, 0, 1, 1])
    p = quality.QualityParams(bits=6, bins=3, rank=2, epochs=1, batch=4, l2=0.0)
    got = quality.train(words, stats, labels, p)
    size = (1 << p.bits) + len(quality.STATS) * p.bins
    seed = np.random.default_rng(11)
    w, v = np.zeros(size), seed.normal(0, 0.02, (size, p.rank))
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    shift = np.uint64(64 - p.bits)
    flat, off = np.concatenate([(x >> shift).astype(np.int64) for x in words]), np.concatenate(([0], np.cumsum([len(x) for x in words])))
    extra = quality._binned(stats, got.edges, p.bits)

    def loss(bias, w, v):
        total = 0.0
        for d in range(4):
            # a word that stands twice counts as two features
            parts = [(i, 1 / (off[d + 1] - off[d])) for i in flat[off[d] : off[d + 1]]] + [(i, 1.0) for i in extra[d]]
            s = bias + sum(w[i] * a for i, a in parts) + sum(float(v[i] @ v[j]) * a * b for k, (i, a) in enumerate(parts) for j, b in parts[k + 1 :])
            total += math.log1p(math.exp(-s)) if labels[d] else math.log1p(math.exp(s))
        return total / 4

    eps = 1e-5
    touched = sorted({*flat.tolist(), *extra.ravel().tolist()})
    for i in touched[:12]:
        e = np.zeros(size)
        e[i] = eps
        g = (loss(bias, w + e, v) - loss(bias, w - e, v)) / (2 * eps)
        assert np.isclose(got.w[i], -p.rate * g / math.sqrt(1e-6 + g * g), atol=2e-4)
        for f in range(p.rank):
            e = np.zeros((size, p.rank))
            e[i, f] = eps
            g = (loss(bias, w, v + e) - loss(bias, w, v - e)) / (2 * eps)
            assert np.isclose(got.v[i, f], v[i, f] - p.rate * g / math.sqrt(1e-6 + g * g), atol=5e-3)
    assert all(got.w[i] == 0 for i in set(range(size)) - set(touched))


def test_samples_are_bounded_in_bytes(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * r.randint(0, 100)) for i in range(300)] + [(400, "y" * 100_000), (5, "z" * 90), (None, "w"), (6, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in [*range(0, 300, 2), 400]], "doc_id long, y int")
    assert sorted(map(tuple, text.bounded_sample(docs, sample, 1 << 30).collect())) == sorted(map(tuple, sample.collect()))
    few = text.bounded_sample(docs, sample, 2000)
    kept = docs.join(few, "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"))
    assert few.count() > 10 and kept.agg(F.sum("n")).first()[0] <= 2000
    assert few.exceptAll(sample).count() == 0 and text.bounded_sample(docs, sample, 0).count() <= 5
    labels = sample.select("doc_id", F.col("y").alias("toxic"), F.col("y").alias("quality"))
    assert toxicity.toxicity(docs, labels, toxicity.ToxicityParams(max_bytes=500)).count() == docs.count()
    assert quality.quality(docs, labels, quality.QualityParams(max_bytes=500)).count() == docs.count()


def test_languages_learn_whole_texts_within_bounds(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abc ") for _ in range(r.randint(1, 200))), f"l{i % 3}") for i in range(400)] + [(500, "z" * 5000, "long"), (501, None, "none"), (502, "", "none"), (2, "q", "l2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "build", lambda texts, p: seen.update(texts))
    texts = {(t or "") for _, t, _ in rows}
    for p in (langid.LangParams(chars_per_lang=700), langid.LangParams(total_chars=2000), langid.LangParams(total_docs=8)):
        seen.clear()
        langid.fit(d, p)
        assert set(seen) <= {"l0", "l1", "l2", "long", "none"} and {"l0", "l1", "l2"} <= set(seen)
        assert all(t in texts for v in seen.values() for t in v)  # whole ones
        for lang, v in seen.items():
            assert len(v) == 1 or sum(map(len, v)) <= min(p.chars_per_lang, p.total_chars // len(seen))
        assert sum(map(len, seen.values())) <= max(p.total_docs, len(seen)) or p.total_docs > 1000
