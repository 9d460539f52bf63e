"""Hyperdimensional profiles: exact bundles, held-out accuracy, and edges."""

import random

import numpy as np

from prosegauge.llm import langid

SYLLABLES = {"en": "th he ing and ou er tion wh re st".split(), "de": "sch ei ung ch ver ge ö ß keit pf".split(), "fr": "eau oi é ç que ai eux tre la è".split()}


def text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_bundle_is_the_sum_of_bound_trigrams():
    slots, one, d = langid.letter_slots(), langid.letter_vectors(256), 256
    for t in ("A b", "héllo  wörld!", "", "...", "x", "  ab1cd  ", "日本語 text"):
        line = [0]
        for c in t:
            s = int(slots[ord(c)])
            if s or line[-1]:
                line.append(s)
        if line[-1]:
            line.append(0)
        want = np.zeros(d)
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            want += np.roll(one[a], 2).astype(int) * np.roll(one[b], 1) * one[c]
        both = langid.bundles(["zz top", t, None], d)
        assert np.array_equal(both[1], want), t
        assert not both[2].any()


def test_case_is_ignored_and_order_counts():
    a, b, c = langid.bundles(["Abc", "aBC", "cba"], 1024)
    assert np.array_equal(a, b) and not np.array_equal(a, c)


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(0)
    rows = [(i, text(r, lang, r.randint(3, 40)), lang) for i, lang in enumerate(random.Random(1).choices(list(SYLLABLES), k=300))]
    train = spark.createDataFrame(rows[:200] + [(900, None, "en"), (901, "no label", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model.languages == ["de", "en", "fr"]
    odd = [(500, None, "x"), (501, "", "x"), (502, " 12 !? ", "x"), (503, text(r, "en", 20_000), "x"), (200, rows[200][1], "x")]
    held = spark.createDataFrame(rows[200:] + odd, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang lang_pred", "'clash' score")
    got = langid.identify(held, model).collect()
    assert len(got) == 105
    by = {x["doc_id"]: x for x in got}
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang in rows[200:]]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got)
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503]["lang_pred"] == "en"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty)
    some = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in langid.identify(some, model).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_texts_in_many_scripts_are_counted_in_parts(monkeypatch):
    r = random.Random(8)
    letters = [chr(c) for c in range(0x400, 0x3000) if chr(c).isalpha()]
    texts = ["".join(r.choices(letters, k=400)) for _ in range(40)] + [None, "", "a short one"]
    whole = langid.bundles(texts, 256)
    monkeypatch.setattr(langid, "CELLS", 3000)
    monkeypatch.setattr(langid, "VECTORS", 50)
    assert np.array_equal(langid.bundles(texts, 256), whole)
    assert max(len(part) * len(known) for part, known, _ in langid.counted(texts) if len(part) > 1) <= 3000
