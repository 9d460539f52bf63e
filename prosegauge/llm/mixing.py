"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weight w (of 1) its block i may not start
before slot floor(i / w) and must be done by slot ceil((i + 1) / w). In each slot
the released block with the earliest deadline goes out (ties by the source's
name). As the weights sum to 1, every deadline is met, so that after any number of
slots each source is less than one block away from its share.

Weights are whole numbers of ticks, so the schedule repeats after as many slots as
there are ticks. One period is simulated (its length depends on the weights, not
on the data), and a block's slot follows from its number: whole periods, and its
place in the period. When a source runs out the weights of those left apply from
the next slot on, a new phase with a period of its own. Documents are numbered
within their source on the cluster: a source is split by a hash into as many parts
as a part has documents, the parts are numbered alone and shifted by the counts before them.
"""

from __future__ import annotations

import heapq
from math import isqrt
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32
TICKS = 1000
POWER = 0.5
#: Numbers that are broadcast at most.
BROADCAST = 4_000_000
#: The plan has up to half the square of this many rows.
MOST_SOURCES = 2000


def tempered(sizes: dict[str, int], power: float = POWER, ticks: int = TICKS) -> dict[str, int]:
    """Target weights in ticks, in proportion to a power of the sources' sizes, one tick at least."""
    ticks = max(ticks, 10 * len(sizes))
    shares = {s: n**power for s, n in sizes.items()}
    total = sum(shares.values())
    exact = {s: max(1.0, ticks * x / total) for s, x in shares.items()}
    whole = {s: int(x) for s, x in exact.items()}
    left = ticks - sum(whole.values())
    for s in sorted(exact, key=lambda s: (whole[s] - exact[s], s))[: max(0, left)]:
        whole[s] += 1
    return whole


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline first."""
    ticks = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # by release
    ready: list[tuple[int, str, int]] = []  # by deadline
    out = []
    for t in range(ticks):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * ticks // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * ticks // weights[s], s, i + 1))
    return out


class Run(NamedTuple):
    """Blocks ``first`` to ``last`` (excluded) of a source: block ``first + q * weight + r`` gets slot ``base + q * ticks + places[r]``."""

    source: str
    phase: int
    first: int
    last: int
    base: int
    ticks: int
    weight: int
    places: list[int]


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[Run]:
    """All sources' runs, phase by phase."""
    if missing := sorted(s for s, n in blocks.items() if n and weights.get(s, 0) < 1):
        raise ValueError(f"sources without a weight of at least one tick: {missing[:5]}")
    left, done, base, runs = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    phase = 0
    while left:
        now = {s: weights[s] for s in left}
        ticks, line = sum(now.values()), period(now)
        places: dict[str, list[int]] = {s: [] for s in now}
        for t, s in enumerate(line):
            places[s].append(t)
        ends = {s: (n - 1) // now[s] * ticks + places[s][(n - 1) % now[s]] + 1 for s, n in left.items()}
        end = min(ends.values())
        for s in sorted(left):
            took = end // ticks * now[s] + sum(t < end % ticks for t in places[s])
            if took:
                runs.append(Run(s, phase, done[s], done[s] + took, base, ticks, now[s], places[s]))
            done[s] += took
            left[s] -= took
        left = {s: n for s, n in left.items() if n}
        base, phase = base + end, phase + 1
    return runs


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``mix_phase``, ``mix_block`` (of its source), ``mix_slot`` and ``mix_place`` (in the block).

    Every row gets one place; a source's last block may be short. Rows with a null
    source are a source of their own (named "" in ``weights``, after which empty
    names count as null). Repeated rows get places of their own. An empty table
    stays so. Columns of these names are replaced. ``weights`` are whole ticks by
    source; by default the square roots of the sources' sizes (``tempered``).
    """
    spark = docs.sparkSession
    added = ("mix_phase", "mix_block", "mix_slot", "mix_place")
    kept = docs.select([c for c in docs.columns if c not in added])
    named = kept.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    sizes = {r["_source"]: r["n"] for r in named.groupBy("_source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; mix groups of them instead")
    runs = plan({s: -(-n // block) for s, n in sizes.items()}, weights or tempered(sizes))
    parts = spark.createDataFrame([(s, isqrt(n) + 1) for s, n in sizes.items()], "_source string, _parts long")
    rows = named.join(F.broadcast(parts), "_source").withColumn("_part", F.pmod(F.xxhash64(key, "_source"), "_parts"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_source", "_part").agg(F.count("*").alias("n"))
    shifts = counts.select("_source", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    tie = F.xxhash64(*[c for c, kind in kept.dtypes if not kind.startswith("map")])
    within = Window.partitionBy("_source", "_part").orderBy(key, tie)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(shifts, ["_source", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_shift")).withColumn("mix_block", F.floor(F.col("_rank") / block).cast("long"))
    where = spark.createDataFrame([(r.source, *r[1:]) for r in runs], "_of string, mix_phase int, _first long, _last long, _base long, _ticks long, _weight long, _places array<int>")
    i = F.col("mix_block") - F.col("_first")
    slot = F.col("_base") + F.floor(i / F.col("_weight")) * F.col("_ticks") + F.get("_places", (i % F.col("_weight")).cast("int"))
    hit = (F.col("_source") == F.col("_of")) & (F.col("mix_block") >= F.col("_first")) & (F.col("mix_block") < F.col("_last"))
    # a plan's size follows from the sources and weights, not from the documents; beyond the bound the join shuffles
    small = sum(8 + len(r.places) for r in runs) <= BROADCAST
    return ranked.join(F.broadcast(where) if small else where, hit).select(*kept.columns, "mix_phase", "mix_block", slot.cast("long").alias("mix_slot"), (F.col("_rank") % block).cast("int").alias("mix_place"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, none added or lost, in the order of the mix: files and the rows in them follow the schedule."""
    order = ("mix_slot", "mix_place")
    return mixed(docs, **options).repartitionByRange(*order).sortWithinPartitions(*order).select(docs.columns)
