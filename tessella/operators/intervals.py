"""Continuous periods and gaps of the day intervals of each entity.

The aggregate is a sorted list of disjoint intervals with the number of members in each. Two lists
merge in linear time (``merged``), and partial lists combine in a reduction tree: within each Arrow
batch before any shuffle, then per (entity, slice), then per entity. A list never holds more
intervals than there are separate days in use, so the last step is bounded by the calendar, not by
the rows of the hottest entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The end of an open interval.
OPEN = 2**31 - 1
#: Sorted disjoint intervals: (start, stop, members) each.
Intervals = list[tuple[int, int, int]]
_LISTS = "entity string, slice int, starts array<int>, stops array<int>, members array<bigint>"
_SPANS = "entity string, kind string, start int, stop int, members bigint"


def merged(a: Intervals, b: Intervals) -> Intervals:
    """Two sorted lists of disjoint intervals as one, in one pass; intervals that share a day or follow on the next day join."""
    if not a or not b:
        return a or b
    out: Intervals = []
    i = j = 0
    start, stop, members = 0, -(2**62), 0
    while i < len(a) or j < len(b):
        if j == len(b) or (i < len(a) and a[i][0] <= b[j][0]):
            at, i = a[i], i + 1
        else:
            at, j = b[j], j + 1
        if at[0] <= stop + 1:
            stop, members = max(stop, at[1]), members + at[2]
        else:
            if members:
                out.append((start, stop, members))
            start, stop, members = at
    out.append((start, stop, members))
    return out


class Tree:
    """Lists of one entity, combined pairwise as they come: each is merged about log(lists) times."""

    def __init__(self) -> None:
        self.levels: list[Intervals | None] = []

    def add(self, intervals: Intervals) -> None:
        for level, held in enumerate(self.levels):
            if held is None:
                self.levels[level] = intervals
                return
            intervals, self.levels[level] = merged(held, intervals), None
        self.levels.append(intervals)

    def whole(self) -> Intervals:
        out: Intervals = []
        for held in self.levels:
            out = merged(held or [], out)
        return out


def _lists(rows: list[tuple[tuple[str, int], Intervals]]) -> pa.RecordBatch:
    """Rows of lists, one per (entity, slice)."""
    sizes = np.cumsum([0, *(len(x) for _, x in rows)]).astype(np.int32)
    flat = np.array([v for _, x in rows for v in x], np.int64).reshape(-1, 3)
    column = lambda i, kind: pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat[:, i], kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), column(0, pa.int32()), column(1, pa.int32()), column(2, pa.int64())],
        ["entity", "slice", "starts", "stops", "members"],
    )


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals of each batch as one list per (entity, slice)."""
    for batch in batches:
        trees: dict[tuple[str, int], Tree] = {}
        for entity, part, start, stop in zip(*(batch.column(c).to_pylist() for c in range(4))):
            trees.setdefault((entity, part), Tree()).add([(start, stop, 1)])
        if trees:
            yield _lists([(k, t.whole()) for k, t in trees.items()])


def _reduced(key: Callable[[str, int], tuple], emit: Callable[[list], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the lists of each ``key`` (rows of a partition sorted by it) and ``emit`` them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, done = None, Tree(), []
        for batch in batches:
            for entity, part, starts, stops, members in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if held != key(entity, part):
                    if held is not None:
                        done.append((held, tree.whole()))
                    held, tree = key(entity, part), Tree()
                tree.add(list(zip(starts, stops, members)))
            if len(done) >= 10_000:
                yield emit(done)
                done = []
        if held is not None:
            yield emit([*done, (held, tree.whole())])

    return run


def _periods_and_gaps(lists: list[tuple[tuple[str], Intervals]]) -> pa.RecordBatch:
    """Each list and its complement between the first and the last interval."""
    rows = [(entity, "period", *span) for (entity,), spans in lists for span in spans]
    rows += [(entity, "gap", a[1] + 1, b[0] - 1, 0) for (entity,), spans in lists for a, b in zip(spans, spans[1:])]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["entity", "kind", "start", "stop", "members"])


def continuous_periods(intervals: DataFrame, slices: int = 16) -> DataFrame:
    """(entity, kind, start, stop, members) of intervals (entity string, start date, stop date).

    Both days belong to an interval; a null ``stop`` or one in the year 9999 is open. Rows with a
    null entity or start, or with a stop before the start, are left out. Intervals of an entity
    that share a day or follow on the next day join. ``kind`` is ``period`` (``members``: the
    intervals joined in it, 1 if single) or ``gap`` (members 0). ``start`` and ``stop`` are days
    since 1970, an open stop is ``OPEN``. Repeated rows count as members each. Other columns of
    the input do not matter. An empty input gives an empty result.
    """
    stop = F.when(F.col("stop").isNull() | (F.year("stop") >= 9999), F.lit(OPEN)).otherwise(F.unix_date("stop"))
    rows = (
        intervals.select(F.col("entity").cast("string").alias("entity"), F.unix_date("start").alias("start"), stop.alias("stop"))
        .filter("entity IS NOT NULL AND start IS NOT NULL AND stop >= start")
        .select("entity", F.pmod(F.xxhash64("start", "stop"), F.lit(slices)).cast("int").alias("slice"), "start", "stop")
    )
    partial = rows.mapInArrow(_within_batches, _LISTS)
    sliced = partial.repartition("entity", "slice").sortWithinPartitions("entity", "slice").mapInArrow(_reduced(lambda e, p: (e, p), _lists), _LISTS)
    return sliced.repartition("entity").sortWithinPartitions("entity").mapInArrow(_reduced(lambda e, _: (e,), _periods_and_gaps), _SPANS)


def day_text(day: str) -> Column:
    """``yyyy-MM-dd`` of a day number, ``open`` of an open end."""
    return F.when(F.col(day) == OPEN, F.lit("open")).otherwise(F.date_format(F.date_from_unix_date(F.when(F.col(day) != OPEN, F.col(day))), "yyyy-MM-dd"))
