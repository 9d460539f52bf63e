"""Delta rollups: sums in any order, batches once, counts by the tokenizer."""

import re

import pytest

from prosegauge.llm import rollups, tokens

CHANGE = "kind string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"


def totals(store):
    return {tuple(r)[:3]: (r["docs"], r["tokens"]) for r in store.totals().collect()}


def test_signed_changes_and_idempotent_commits(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    assert totals(store) == {}
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", 3, None), ("insert", "b", "de", "v1", None, None)], CHANGE)
    assert store.commit("b1", first) and not store.commit("b1", first)
    want = {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 3), ("b", "de", "v1"): (1, 0)}
    assert totals(store) == want
    second = spark.createDataFrame([("revise", "a", "en", "v1", 7, 10), ("delete", "b", "de", "v1", 0, None), ("delete", None, None, "v1", 3, None)], CHANGE)
    assert store.commit("b2", second) and not store.commit("b2", second)
    assert totals(store) == {("a", "en", "v1"): (2, 12)}
    other = rollups.Rollup(spark, str(tmp_path / "other"))
    other.commit("b2", second)
    other.commit("b1", first)
    assert totals(other) == totals(store)


def test_a_lost_commit_leaves_nothing(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    bad = spark.createDataFrame([("insert", "a", "en", "v", 1, None), ("merge", "a", "en", "v", 1, None)], CHANGE)
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("x", bad)
    assert not store.committed("x") and totals(store) == {}
    assert store.commit("x", bad.where("kind = 'insert'")) and totals(store) == {("a", "en", "v"): (1, 1)}
    for name in ("", "a/b", "_x", "a b"):
        with pytest.raises(ValueError):
            store.commit(name, bad)


def test_two_who_commit_at_once(spark, tmp_path, monkeypatch):
    """Both find no marker when they look; one creates it."""
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("insert", "a", "en", "v", 4, None)], CHANGE)
    monkeypatch.setattr(rollups.Rollup, "committed", lambda self, batch: False)
    assert [store.commit("b", rows) for _ in range(3)] == [True, False, False]
    assert totals(store) == {("a", "en", "v"): (1, 4)}
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("_rows")]) == 1


def test_a_marker_that_names_nothing_is_told(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b.committed").touch()
    with pytest.raises(RuntimeError, match="broke off"):
        store.totals()


def test_maintained_totals(spark, tmp_path):
    texts = ["The cat, it sat.", None, "", " \t\n\x0b ", "ünï 日本", "a  b\r\nc", "x" * 9000, "The cat, it sat.", "some words, " * 30_000]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", "t", "s", None][i % 4], i) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")
    encode, want = tokens.encoder(tokens.default_path()).ids, {}
    for _, t, lang, source, _ in rows:
        for version, n in ((rollups.WORDS, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), (rollups.BPE, len(encode(t)))):
            d, s = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, s + n)
    got = rollups.maintain(docs, str(tmp_path / "m"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want
    assert rollups.maintain(docs.limit(0), str(tmp_path / "empty")).count() == 0
