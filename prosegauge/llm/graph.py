"""Connected components of a graph whose edges do not fit one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prosegauge.llm.common import columns, materialize, release

#: Edges that one task contracts.
PART = 100_000


def contracted(edges: DataFrame, part: int = PART) -> DataFrame:
    """``edges(src, dst)`` -> as few or fewer edges that connect the same nodes.

    Each task joins what its own edges connect and sends one edge from each node
    to the smallest, so that chains become stars. A task holds ``part`` edges or so.
    Nodes are of any one type that has an order.
    """
    n, rows = edges.count(), edges.select("src", "dst")
    kind = to_arrow_type(rows.schema["src"].dataType)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in it:
            for a, b in zip(*columns(batch, "src", "dst"), strict=True):
                if a is not None and b is not None:
                    a, b = find(a), find(b)
                    root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        if pairs:
            src, dst = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(src, kind), pa.array(dst, kind)], names=["src", "dst"])

    return rows.coalesce(max(1, -(-n // part))).mapInArrow(run, rows.schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, root)``: the smallest node reachable from each node.

    Every round takes the smallest label among a node's neighbours and then
    follows labels once more (pointer jumping), so the number of rounds grows
    with the logarithm of a component's width. Each round is a table in the
    shared folder. Joins are on plain exchanges, which adaptive execution splits
    where one node has most of the edges. Nodes without an edge are not listed.
    Loops and repeated edges do no harm; nulls are left out.
    """
    pairs = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = materialize(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("root")), "cc-labels")
    for _ in range(max_rounds):
        known = labels.select(F.col("node").alias("dst"), F.col("root").alias("near"))
        near = both.join(known, "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        lower = materialize(labels.join(near, "node", "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), "cc-lower")
        after = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialize(lower.join(after, "root").select("node", F.least("root", "next").alias("root"), "was"), "cc-labels")
        moved = jumped.where(F.col("root") != F.col("was")).limit(1).count()
        release(labels, lower)
        labels = jumped
        if not moved:
            release(both)
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
