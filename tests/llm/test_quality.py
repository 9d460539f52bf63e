"""The quality classifier on rows kept from it, and its edges."""

import random

import numpy as np
from pyspark.sql import functions as F

from prosegauge.llm import quality


def text(r, good):
    words = ["".join(r.choices(["ba", "lo", "ri", "te", "su", "no"], k=r.randint(1, 4))) for _ in range(r.randint(4, 120))]
    if good:
        return " ".join(w.capitalize() + "." if r.random() < 0.1 else w for w in words)
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(w + r.choice(["***", "$$$", "&&&"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join([words[0]] * len(words))


def rows(n=600):
    r = random.Random(4)
    return [(i, text(r, i % 4 != 0), int(i % 4 != 0)) for i in range(n)]


def test_held_out_accuracy_and_calibration(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 400] + [(9999, 1), (None, 0), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == 600 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in data if i >= 400]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.95
    assert 0.25 <= model.network.temperature <= 8


def test_edges(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", None), (2, "", None), (3, " \n ", 1.0), (4, "x " * 100_000, 2.0), (None, "ba lo", 3.0)], "doc_id long, text string, score double")
    got = quality.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got[:4]}) == 1
    assert quality.score(odd.limit(0), model).count() == 0


def test_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, one)).collect()} == {0.75}


def test_gradient():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 5)), (r.random(60) > 0.5).astype(float)
    net = quality.Network(x, y, epochs=1)
    got, eps = net.gradient(x, y), 1e-6

    def loss():
        w, b, u, c = net.layers
        z = np.tanh(x @ w + b) @ u + c
        return np.logaddexp(0, -(2 * y - 1) * z).mean() + 0.5e-4 * ((w**2).sum() + (u**2).sum())

    for p, g in zip(net.layers, got, strict=True):
        at = tuple(0 for _ in p.shape)
        p[at] += eps
        up = loss()
        p[at] -= 2 * eps
        down = loss()
        p[at] += eps
        assert np.isclose(g[at], (up - down) / (2 * eps), atol=1e-6)


def test_a_text_without_room_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 4000)
    first = spark.range(60).orderBy(F.xxhash64("id"), "id").first()["id"]
    rows = [(i, "word " * 1000 if i == first else f"text number {i} of a few words", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert quality.train(docs.drop("quality"), docs.drop("text")).network is not None


def test_scores_against_a_plain_version():
    """Index vectors, contexts, pooling, the two layers and the temperature, one number after the other."""
    r = random.Random(3)
    good = [" ".join(r.choices(["the", "river", "Stone", "walks", "7", "slowly."], k=r.randint(5, 40))) for _ in range(60)]
    bad = [" ".join(r.choices(["BUY", "now!!!", "click", "$$$", "the", "now!!!"], k=r.randint(5, 40))) for _ in range(60)]
    texts, labels = good + bad, [1] * 60 + [0] * 60
    model = quality.Quality(texts, labels)

    def pairs(text):
        out, before = [], None
        for w in text.split():
            a, b = quality.terms(w)
            out.append((a, quality.AGAIN if w == before else b))
            before = w
        return out

    seen = {}
    for t in texts:
        for a, b in pairs(t):
            for x in (a, b):
                seen[x] = seen.get(x, 0) + 1
    known = {x for x, n in seen.items() if n >= quality.LEAST and x}
    index = {x: quality.index_vector(x).astype(float) for x in known}
    rare = quality.index_vector(quality.RARE).astype(float)
    context = {x: np.zeros(quality.DIMENSIONS) for x in [*known, None]}
    name = lambda x: x if x in known else None
    vector = lambda x: index.get(x, rare)
    for t in texts:
        line = pairs(t)
        for i, pair in enumerate(line):
            around = sum((vector(a) + vector(b) for j, (a, b) in enumerate(line) if j != i and abs(i - j) <= quality.WINDOW), np.zeros(quality.DIMENSIONS))
            for x in pair:
                context[name(x)] += around
    unit = {x: v / max(np.linalg.norm(v), 1e-9) for x, v in context.items()}
    final = lambda x: vector(x) / quality.ENTRIES**0.5 + unit[name(x)]
    asked = [texts[0], texts[-1], "river now!!! unheard-of words", "", "the the the"]
    net, want = model.network, []
    for t in asked:
        line = pairs(t)
        pooled = np.concatenate([np.mean([final(p[k]) for p in line], axis=0) if line else np.zeros(quality.DIMENSIONS) for k in (0, 1)])
        z = (pooled - net.mean) / net.scale
        w, b, u, c = net.layers
        hidden = [np.tanh(sum(z[i] * w[i, j] for i in range(len(z))) + b[j]) for j in range(len(b))]
        logit = sum(h * v for h, v in zip(hidden, u, strict=True)) + c[0]
        want.append(1 / (1 + np.exp(-logit / net.temperature)))
    assert np.allclose(model.score(asked), want, atol=1e-4)


def test_a_long_labelled_text_does_not_empty_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 5_000)
    rows = [(k, "x " * 10_000 if k % 10 == 0 else ("calm words in a row" if k % 2 else "BUY BUY now!!!")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.network is not None
    a, b = model.score(["calm words in a row", "BUY BUY now!!!"])
    assert a > 0.5 > b
