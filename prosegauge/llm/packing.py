"""Best-fit packing of documents' token sequences into rows of fixed capacity.

Bulk-synchronous best-fit decreasing. The state is a table, range-sorted by size,
of what waits (documents, or pieces of longer ones) and of the gaps that open
sequences have left. A superstep takes the documents of one band of lengths, the
longest first, and all gaps that could hold them. The band is cut into ranges of
size; in each, a task sweeps its documents downward, and each takes its successor,
the smallest gap of the range that is large enough. What found no gap in its
range is swept once more against the gaps left over from all ranges, and opens
new sequences where there is none. Which of the documents that want a gap gets it
is settled by rank. Gaps are updated in the table and the next superstep follows,
for the next band, half as long, down to one token.

Documents of one length, and sequences of one gap that were opened or filled
together, move as one row of the table (a first one and a count), so that the
table has a few rows for each length whatever the number of documents; ranks tell
the documents of a length apart. Rows are ranked by the cluster (a
length that many share is split by a hash, each part ranked alone and shifted by the
counts before it) and find their sequence by their rank.

The result is best-fit decreasing but for gaps in another range of the same band,
which a document sees after those of its own range.

Where the documents' order counts (``pack_in_order``), windows of it are packed each by
one sweep, as lengths alone would deal the documents of all windows together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm import tokens
from prosegauge.llm.common import batches, columns, materialize, row_order, small_batches

CAPACITY = 1024
END_ID = 2
#: Ranges of size that a band of lengths is cut into.
RANGES = 4
#: Documents that are packed together where their order counts.
WINDOW = 2048
#: More than a document has pieces.
PIECES = 1 << 22
#: Kinds of rows of the table that a superstep reads and writes.
WAITS, GAP, PLACED = 0, 1, 2
STATE = "kind int, size long, first long, count long, sequence long, each long, offset long"


class Run(NamedTuple):
    """A row of the table.

    Waiting documents of length ``size`` with ranks from ``first`` on; sequences
    from ``sequence`` on with a gap of ``size``; or documents that have a place,
    ``each`` to a sequence from ``sequence`` on, the first of a sequence at ``offset``.
    """

    kind: int
    size: int
    first: int
    count: int
    sequence: int = 0
    each: int = 0
    offset: int = 0


def sweep(runs: list[Run], capacity: int, open_from: int | None = None) -> list[Run]:
    """Documents from the longest down take the smallest gap that is large enough.

    What finds none opens sequences with numbers from ``open_from`` on, or waits
    where that is None. Equal documents and equal gaps are dealt with as runs.
    """
    held: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    gaps: list[int] = []
    out = [r for r in runs if r.kind == PLACED]

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in held:
                held[gap] = []
                insort(gaps, gap)
            held[gap].append((first, n))

    for r in sorted(r for r in runs if r.kind == GAP):
        put(r.size, r.sequence, r.count)
    for r in sorted((r for r in runs if r.kind == WAITS), key=lambda r: (-r.size, r.first)):
        length, rank, left = r.size, r.first, r.count
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a capacity of {capacity}")
        while left:
            at = bisect_left(gaps, length)  # the successor
            if at < len(gaps):
                gap = gaps[at]
                first, n = held[gap].pop()
                if not held[gap]:
                    del held[gap], gaps[at]
            elif open_from is None:
                out.append(Run(WAITS, length, rank, left))
                break
            else:
                gap, first, n = capacity, open_from, -(-left // (capacity // length))
                open_from += n
            each = gap // length
            full, over = min(n, left // each), 0
            if full:
                out.append(Run(PLACED, length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left < each:
                over = left
                out.append(Run(PLACED, length, rank, over, first + full, over, capacity - gap))
                put(gap - over * length, first + full, 1)
                left = 0
            put(gap, first + full + bool(over), n - full - bool(over))
    return out + [Run(GAP, gap, 0, n, first) for gap in gaps for first, n in held[gap]]


def bands(capacity: int) -> list[tuple[int, int]]:
    """Bands of lengths, above the first number up to the second, the longest first."""
    out, top = [], capacity
    while top:
        out.append((top // 2, top))
        top //= 2
    return out


def superstep(state: DataFrame, low: int, high: int, step: int, capacity: int, ranges: int = RANGES) -> DataFrame:
    """Places all documents longer than ``low``, of which none is longer than ``high``."""
    width = -(-(high - low) // ranges)
    takes_part = (F.col("size") > low) & (F.col("kind") != PLACED)
    # larger gaps are a range of their own, without documents; the rest of the table only passes through
    at = F.when(takes_part, F.least(F.floor((F.col("size") - low - 1) / width), F.lit(ranges))).otherwise(-1 - F.col("size") % ranges)

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(*map(int, r)) for r in rows.drop(columns="range").itertuples(index=False)]
        if int(rows["range"].iloc[0]) >= 0:
            runs = sweep(runs, capacity)
        return pd.DataFrame(runs, columns=Run._fields)

    def across(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = [Run(*map(int, r)) for rows in it for r in rows.itertuples(index=False)]
        some = [r for r in runs if r.kind != PLACED and r.size > low]
        others = [r for r in runs if r.kind == PLACED or r.size <= low]
        yield pd.DataFrame(others + sweep(some, capacity, step << 48), columns=Run._fields)

    swept = state.withColumn("range", at.cast("int")).groupBy("range").applyInPandas(local, STATE)
    return swept.repartition(1).mapInPandas(across, STATE)  # a few rows for each length, so bounded by the capacity


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all of ``capacity`` but for a shorter first."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, order: tuple[Column, Column] | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for each piece of each row's ids and one end id.

    With ``order`` its two columns follow, as ``part`` and ``row``.
    """
    small_batches(docs.sparkSession)
    path = path or tokens.default_path()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    beside = ["part", "row"] if order else []
    schema = pa.schema(fields + [("part", pa.string()), ("row", pa.int64())][: len(beside)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).ids

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for i, t, *at_row in zip(*columns(batch, "doc_id", "text", *beside), strict=True):
                ids = np.append(encode(t), np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    yield i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), *at_row

        for batch in it:
            yield from batches(rows(batch), schema)

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *(c.alias(n) for c, n in zip(order or (), beside, strict=True)))
    return read.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", part string, row long" * bool(order))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with a ``length`` column -> the same rows with ``sequence_id`` and ``offset``.

    ``pieces`` is read more than once and should be a table. Rows alike in every
    column are told apart by nothing, and take places of their own all the same.
    """
    small_batches(pieces.sparkSession)
    counts = materialize(pieces.groupBy("length").agg(F.count("*").alias("n")), "pack-counts")
    zero = F.lit(0).cast("long")
    state = counts.select(F.lit(WAITS).alias("kind"), F.col("length").alias("size"), zero.alias("first"), F.col("n").alias("count"), zero.alias("sequence"), zero.alias("each"), zero.alias("offset"))
    for step, (low, high) in enumerate(bands(capacity)):
        state = superstep(state, low, high, step, capacity)
    plan = materialize(state.where(F.col("kind") == PLACED).select(F.col("size").alias("length"), "first", "count", "sequence", "each", F.col("offset").alias("base")), "pack-plan")
    # as many parts of a length as a part has rows, so that neither grows with the rows themselves
    parts = counts.select("length", F.ceil(F.sqrt("n")).cast("int").alias("parts"))
    rows = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(*pieces.columns), F.col("parts")).cast("int")).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "part").orderBy(*pieces.columns)
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(shift, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("shift"))
    # as many rows as the sweeps made runs: a few for each length
    at = F.col("rank") - F.col("first")
    out = ranked.join(F.broadcast(plan), "length").where((at >= 0) & (at < F.col("count"))).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece, the end id alone. Equal rows are packed as
    often as they occur, a null doc_id is kept, an empty table gives no rows.
    Other columns of ``docs`` are neither read nor returned.
    """
    return place(materialize(token_pieces(docs, key, text, path, capacity), "pieces"), capacity)


def share(lengths: np.ndarray, numbers: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing in one sweep: each piece's sequence, named by the number of the piece that opened it, and offset.

    Of pieces of one length those with smaller numbers come first.
    """
    line = np.lexsort((numbers, lengths))
    sizes, starts, counts = (x.tolist() for x in np.unique(lengths[line], return_index=True, return_counts=True))
    start = dict(zip(sizes, starts, strict=True))
    sequence, offset = np.empty(len(line), np.int64), np.empty(len(line), np.int64)
    for r in sweep([Run(WAITS, n, 0, k) for n, k in zip(sizes, counts, strict=True)], capacity, 0):
        if r.kind == PLACED:
            at, k = start[r.size] + r.first, np.arange(r.count)
            rows = line[at : at + r.count]
            sequence[rows] = r.sequence + k // r.each
            offset[rows] = r.offset + k % r.each * r.size
    opens = np.flatnonzero(offset == 0)
    names = np.empty(len(opens), np.int64)
    names[sequence[opens]] = numbers[opens]
    return names[sequence], offset


def pack_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """As ``pack``, in the order of the rows of ``docs`` (``row_order``); sequences are in rising order of ``sequence_id``.

    Documents share sequences with others of their window, ``window`` rows that follow
    one another, and no sequence comes before one of an earlier window. Within a
    window sequences follow the documents that open them. Every window may leave
    sequences short, so there are a few more of them than ``pack`` makes.
    """
    pieces = materialize(token_pieces(docs, key, text, path, capacity, order=row_order(docs)), "pieces")
    spark = docs.sparkSession
    ends = sorted((r["part"], r["n"]) for r in pieces.groupBy("part").agg((F.max("row") + 1).alias("n")).collect())  # a row for each file
    firsts = zip((part for part, _ in ends), accumulate((n for _, n in ends), initial=0), strict=False)
    place = F.col("first") + F.col("row")
    made = [c for c in pieces.columns if c not in ("part", "row")]
    numbered = pieces.join(F.broadcast(spark.createDataFrame(list(firsts), "part string, first long")), "part").select(
        *made, F.floor(place / window).cast("long").alias("window"), (place * PIECES + F.col("piece")).alias("number")
    )

    def one(rows: pa.Table) -> pa.Table:
        found = share(rows["length"].to_numpy(), rows["number"].to_numpy(), capacity)
        return rows.select(made).append_column("sequence_id", pa.array(found[0])).append_column("offset", pa.array(found[1]))

    # a document has one piece that isn't full, so a group has as many rows as a window
    shared = numbered.where(F.col("length") < capacity).groupBy("window").applyInArrow(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = numbered.where(F.col("length") == capacity).select(*made, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(shared).repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset")
