"""The language model against plain Python: counts, the base, and exact likelihoods."""

import math
import re
import zlib

import numpy as np
import pytest

from prosegauge.llm import hmm

TEXTS = [
    "The cat sat on the mat. The cat ran.",
    "the dog sat on THE log",
    None,
    "",
    " \n\t ",
    "der hund und die katze und der hund",
    "die katze sitzt auf der matte",
    "x" * 3000,
    "unseen-words only-here ünïcode",
    "the cat sat on the mat " * 300,
    "der hund " * 900,
]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def plain(rows):
    seen = {}
    for _, t, held in rows:
        for w in tokens(t) if not held else ():
            seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, t, held in rows:
        ws = tokens(t)
        out.append((i, held, len(ws), sum(w in seen for w in ws), n, sum(math.log10((seen.get(w, 0) + 1) / (n + v + 1)) for w in ws)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,shared,long", [(100, 1, 50), (2000, 3, 1000), (hmm.BLOCK_CHARS, hmm.SHARED, hmm.LONG_CHARS)])
def test_counts_and_base(spark, monkeypatch, block, shared, long):
    monkeypatch.setattr(hmm, "BLOCK_CHARS", block)
    monkeypatch.setattr(hmm, "SHARED", shared)
    monkeypatch.setattr(hmm, "LONG_CHARS", long)
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(TEXTS * 3)] + [(None, "the null key", False), (1, TEXTS[1], False)]
    got = hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held boolean")).collect()
    want = plain(rows)
    assert [tuple(r)[:5] for r in sorted(got, key=lambda r: str(tuple(r)[:5]))] == [w[:5] for w in sorted(want, key=lambda w: str(w[:5]))]
    by = {(w[0], w[2]): w[5] for w in want}
    assert all(math.isclose(r["base_score"], by[r["doc_id"], r["n_tokens"]], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_a_very_long_text(spark, monkeypatch):
    rows = [(1, "one two three four " * 30_000, False), (2, "one two three", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in hmm.language_model(docs).collect()}
    assert got[1]["n_tokens"] == 120_001 == got[1]["train_tokens"] and got[2]["n_known"] == 4
    assert got[1]["base_score"] < got[1]["score"] <= 0


def test_nothing_to_learn_from(spark):
    rows = [(1, "a b", True), (2, None, True)]
    got = hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string, held boolean")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert all(abs(r["score"]) < 1e-9 for r in got)
    assert hmm.language_model(spark.createDataFrame([], "doc_id long, text string, held boolean")).count() == 0


def small_model(rng):
    counts = hmm.Counts(100, 50, np.arange(hmm.OWN, dtype=np.uint64), rng.integers(1, 9, hmm.ENDINGS).astype(float), rng.random(hmm.ENDINGS))
    return hmm.Model.random(counts, 4)


def test_likelihood_is_exact():
    rng = np.random.default_rng(0)
    model, n = small_model(rng), np.array([1, 7, 40, 3, 25])
    classes = rng.integers(0, hmm.UNKNOWN + 1, n.sum())
    want, at = [], 0
    for m in n:
        state, total = model.start.copy(), 0.0
        for t, c in enumerate(classes[at : at + m]):
            state = (state @ model.move if t else state) * model.emit[c]
            total += math.log(state.sum())
            state /= state.sum()
        want.append(total)
        at += m
    for chunk in (1, 4, 10, 2048):
        assert np.allclose(model.likelihood(classes, n, chunk), want, rtol=1e-10)


def test_expected_counts_by_enumeration():
    rng = np.random.default_rng(1)
    model, n = small_model(rng), np.array([4, 1, 3])
    classes = rng.integers(0, hmm.UNKNOWN, n.sum())
    k = len(model.start)
    start, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, hmm.UNKNOWN))
    at = 0
    for m in n:
        line = classes[at : at + m]
        paths = np.array(np.meshgrid(*[np.arange(k)] * m, indexing="ij")).reshape(m, -1)
        p = model.start[paths[0]] * model.emit[line[0], paths[0]]
        for t in range(1, m):
            p = p * model.move[paths[t - 1], paths[t]] * model.emit[line[t], paths[t]]
        p /= p.sum()
        np.add.at(start, paths[0], p)
        for t in range(m):
            np.add.at(emit, (paths[t], line[t]), p)
            if t:
                np.add.at(moves, (paths[t - 1], paths[t]), p)
        at += m
    for chunk in (1, 2, 3, 100):
        got = model.expected(classes, n, chunk)
        for a, b in zip(got, (start, moves, emit), strict=True):
            assert np.allclose(a, b)


def test_a_cut_changes_no_count():
    rng = np.random.default_rng(5)
    model, n = small_model(rng), np.array([1, 300, 17, 64, 2, 128])
    classes = rng.integers(0, hmm.UNKNOWN, n.sum())
    whole = model.expected(classes, n)
    for chunk in (1, 7, 64):
        for a, b in zip(model.expected(classes, n, chunk), whole, strict=True):
            assert np.allclose(a, b)


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(6)
    model, n = small_model(rng), np.full(50, 40)
    counts = hmm.Counts(100, 50, np.arange(hmm.OWN, dtype=np.uint64), rng.integers(1, 9, hmm.ENDINGS).astype(float), rng.random(hmm.ENDINGS))
    classes = np.tile(np.repeat(np.arange(8), 5), 50) * 11
    likely = []
    for _ in range(6):
        likely.append(model.likelihood(classes, n).sum())
        model = hmm.Model.estimated(*model.expected(classes, n), counts)
    assert likely == sorted(likely) and likely[-1] > likely[0] + 100


def test_model_is_a_distribution():
    model = small_model(np.random.default_rng(2))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
