"""Cutting oversized texts at natural boundaries, with overlap.

Candidate cuts are paragraph, line and word ends (fixed steps inside runs that have none); a
dynamic programme over them minimises cut penalties plus size imbalance under the length limit.
Where a piece starts follows from where the one before ends, so one cost per cut suffices.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalty of a cut inside a run of non-blanks, at a word, line and paragraph end.
PENALTIES = {"run": 4.0, "word": 1.0, "line": 0.25, "paragraph": 0.0}
LEVELS = ("paragraph", "line", "word", "run")
_BLANK = " \t\r\n"
_PARAGRAPHS, _LINES, _RUNS = re.compile(r"\n[ \t]*\n[ \t\n]*"), re.compile(r"\n"), re.compile(r"[^ \t\r\n]+")


def _spans(text: str, breaks: re.Pattern[str], start: int, stop: int) -> list[tuple[int, int]]:
    """Trimmed (start, end) of the stretches of text[start:stop] between ``breaks``, empty ones left out."""
    edges = [start]
    for m in breaks.finditer(text, start, stop):
        edges += [m.start(), m.end()]
    edges.append(stop)
    out = []
    for a, b in zip(edges[::2], edges[1::2]):
        while a < b and text[a] in _BLANK:
            a += 1
        while a < b and text[b - 1] in _BLANK:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def boundaries(text: str, limit: int, overlap: int) -> tuple[str, dict[int, str]]:
    """(cut level, {position: kind}): the places where a piece of ``text`` may end.

    The cut level is the coarsest kind of stretch that fits the limit everywhere. Finer ends are
    offered only inside stretches too long to be one step: over ``limit - overlap`` from the end
    before them, blanks between included.
    """
    level, ends, room, last = 0, {}, limit - overlap, 0
    for a, b in _spans(text, _PARAGRAPHS, 0, len(text)):
        ends[b] = "paragraph"
        level = max(level, int(b - a > limit))
        if b - last > room:
            for c, d in _spans(text, _LINES, a, b):
                ends.setdefault(d, "line")
                if d - c > limit:
                    level = max(level, 2)
                if d - last > room:
                    for run in _RUNS.finditer(text, c, d):
                        e, f = run.span()
                        ends.setdefault(f, "word")
                        if f - e > limit:
                            level = 3
                        if f - e > room:
                            for g in range(e + room // 2, f, max(room // 2, 1)):
                                ends.setdefault(g, "run")
                last = d
        last = b
    return LEVELS[level], ends


def _next_start(text: str, end: int, overlap: int) -> int:
    """Where the piece after a cut at ``end`` starts: about ``overlap`` before it, at a line or word start if near."""
    if not overlap:
        start = end
        while start < len(text) and text[start] in _BLANK:
            start += 1
        return start
    aim = max(end - overlap, 0)
    if aim == 0:
        return 0
    near = text[aim - 1 : min(aim + overlap // 2, end - 1)]
    at = near.find("\n")
    if at < 0:
        at = next((i for i, c in enumerate(near) if c in _BLANK), -1)
    if at < 0:
        return aim
    start = aim + at
    while start < end - 1 and text[start] in _BLANK:
        start += 1
    return start


def _cheapest(starts: list[int], ends: list[int], penalties: list[float], limit: int, target: float) -> list[int]:
    """For each cut, numbered from 1, the cut before it on the cheapest way there from the start of the text, 0."""
    n = len(ends)
    cost, back = [0.0, *[float("inf")] * n], [0] * (n + 1)
    for i in range(n):
        start, so_far = starts[i], cost[i] + 1.0
        for j in range(i, n):
            size = ends[j] - start
            if size > limit:
                break
            off = (size - target) / limit
            value = so_far + penalties[j] + off * off
            if value < cost[j + 1]:
                cost[j + 1], back[j + 1] = value, i
    return back


def _cheapest_vectorised(starts: list[int], ends: list[int], penalties: list[float], limit: int, target: float) -> list[int]:
    """As ``_cheapest``, relaxing all cuts within reach of one cut at a time."""
    n = len(ends)
    at, fees = np.array(ends, np.float64), np.array(penalties)
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    cost[0] = 0.0
    for i in range(n):
        reach = bisect_right(ends, starts[i] + limit)
        value = (cost[i] + 1.0) + fees[i:reach] + ((at[i:reach] - starts[i] - target) / limit) ** 2
        better = value < cost[i + 1 : reach + 1]
        cost[i + 1 : reach + 1][better] = value[better]
        back[i + 1 : reach + 1][better] = i
    return back.tolist()


def cut(text: str, limit: int, overlap: int) -> tuple[str, list[int], list[int]]:
    """(cut level, starts, ends) of the pieces of a trimmed text longer than ``limit``."""
    level, kinds = boundaries(text, limit, overlap)
    ends = sorted(kinds)
    n = len(ends)
    starts = [0]  # of the piece after cut i - 1
    for end, following in zip(ends, [*ends[1:], len(text)]):
        start = _next_start(text, end, overlap)
        starts.append(start if following - start <= limit else _next_start(text, end, 0))  # no room for the overlap
    pieces = -(-max(len(text) - overlap, 1) // (limit - overlap))
    target = min(limit, (len(text) - overlap) / pieces + overlap)
    penalties = [*(PENALTIES[kinds[e]] for e in ends[:-1]), 0.0]
    back = (_cheapest_vectorised if n >= 64 else _cheapest)(starts, ends, penalties, limit, target)
    at, found = n, []
    while at:
        found.append((starts[back[at]], ends[at - 1]))
        at = back[at]
    found.reverse()
    if any(b - a > limit for a, b in found):
        raise ValueError("no cuts keep the pieces within the limit")
    return level, [a for a, _ in found], [b for _, b in found]


def normal_text(content: Column) -> Column:
    """CRLF and lone CR as LF, blanks trimmed at both ends."""
    return F.trim(F.regexp_replace(content, "\r\n?", "\n"), F.lit(_BLANK))


def oversized(documents: DataFrame, limit: int = 1500, overlap: int = 200) -> DataFrame:
    """(id, text, cut_level, starts, ends) of each document longer than ``limit``.

    ``documents``: id, content. Contents that are null, blank or within the limit give no row.
    Positions count code points of ``text``, the content as ``normal_text`` gives it.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")

    @F.pandas_udf("cut_level string, starts array<int>, ends array<int>")
    def cuts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, limit, overlap) for t in texts], columns=["cut_level", "starts", "ends"])

    long = documents.select("id", normal_text(F.col("content")).alias("text")).filter(F.length("text") > limit)
    return long.withColumn("_cut", cuts("text")).select("id", "text", "_cut.cut_level", "_cut.starts", "_cut.ends")


def pieces(documents: DataFrame, limit: int = 1500, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, start, stop, text): the consecutive pieces of each oversized document.

    A piece is text[start:stop]; indexes run from 0. Each piece after the first repeats about
    ``overlap`` characters of the one before, starting at a line or word start where one is near;
    none where the blanks between or the next stretch leave no room for them.
    Every piece is at most ``limit`` long and together they cover all but blanks between pieces.
    """
    cut_at = F.posexplode(F.arrays_zip("starts", "ends")).alias("chunk_index", "_at")
    rows = oversized(documents, limit, overlap).select("id", "text", cut_at)
    start, stop = F.col("_at.starts"), F.col("_at.ends")
    return rows.select("id", "chunk_index", start.alias("start"), stop.alias("stop"), F.substr("text", start + 1, stop - start).alias("text"))
