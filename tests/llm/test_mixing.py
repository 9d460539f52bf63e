"""The Pfair schedule: deviations, deadlines, and every row once."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegauge.llm import mixing

WEIGHTS = st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 40), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(WEIGHTS)
def test_period_deviates_by_less_than_a_block(weights):
    ticks, line = sum(weights.values()), mixing.period(weights)
    assert len(line) == ticks
    seen = dict.fromkeys(weights, 0)
    for t, s in enumerate(line, 1):
        i = seen[s]
        assert i * ticks // weights[s] <= t - 1 and t <= -(-(i + 1) * ticks // weights[s])  # after release, by the deadline
        seen[s] += 1
        assert all(abs(seen[x] * ticks - weights[x] * t) < ticks for x in weights)
    assert seen == weights


@settings(max_examples=80, deadline=None)
@given(WEIGHTS, st.data())
def test_plan_gives_each_block_one_slot(weights, data):
    blocks = {s: data.draw(st.integers(0, 60)) for s in weights}
    slots, phase_of = {}, {}
    for r in mixing.plan(blocks, weights):
        for b in range(r.first, r.last):
            q, k = divmod(b - r.first, r.weight)
            at = r.base + q * r.ticks + r.places[k]
            assert at not in slots
            slots[at], phase_of[at] = (r.source, b), r.phase
    assert sorted(slots) == list(range(sum(blocks.values())))
    assert sorted(slots.values()) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    done = dict.fromkeys(blocks, 0)
    start, before, phase = 0, dict(done), 0
    for at in range(len(slots)):
        if phase_of[at] != phase:
            start, before, phase = at, dict(done), phase_of[at]
        source, b = slots[at]
        assert b == done[source]  # a source's blocks go out in order
        live = {s: weights[s] for s in blocks if before[s] < blocks[s]}
        done[source] += 1
        for s, w in live.items():
            assert abs((done[s] - before[s]) * sum(live.values()) - w * (at + 1 - start)) < sum(live.values())


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    rows = [(i, f"s{min(i % 7, 3)}", "t") for i in range(200)] + [(7, "s0", "again"), (7, "s0", "again"), (None, "s1", "x"), (500, None, "n"), (501, "", "e"), (502, "solo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 mix_slot")
    got = mixing.mixed(docs, block=4).collect()
    assert sorted((str(r[:3]) for r in got)) == sorted(str(r) for r in rows)
    places = [(r["mix_slot"], r["mix_place"]) for r in got]
    assert len(set(places)) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["source"] or "", r["mix_block"]), set()).add(r["mix_slot"])
    assert all(len(s) == 1 for s in by.values())
    assert sorted(next(iter(s)) for s in by.values()) == list(range(len(by)))
    ordered = mixing.in_order(docs.select("doc_id", "source", "text"), block=4)
    assert ordered.columns == ["doc_id", "source", "text"] and ordered.count() == len(rows)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_order_follows_the_slots(spark):
    docs = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(80)], "doc_id long, source string")
    got = [r["source"] for r in mixing.in_order(docs, weights={"a": 3, "b": 1}, block=2).collect()]
    assert got == [s for s in mixing.period({"a": 3, "b": 1}) * 10 for _ in range(2)]


def test_weights_are_needed_for_every_source(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mixed(docs, weights={"a": 5})


def test_tempered_weights_sum_to_the_ticks():
    got = mixing.tempered({"a": 10_000, "b": 100, "c": 1})
    assert sum(got.values()) == mixing.TICKS and got["a"] > got["b"] > got["c"] >= 1
