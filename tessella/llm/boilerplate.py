"""Lines and blocks of lines repeated across the documents of one source.

A source's documents are dealt at random into shards of bounded size. In each shard the line
identifiers of its documents are concatenated and a suffix array over them gives, through common
prefixes of neighbouring suffixes, every repeated block. A block that spans a share of a source's
documents spans at least that share in one of its shards, so blocks below the share in a shard can
be dropped there: what is left is a small set of candidates, counted exactly over all shards.

Candidates are single lines and blocks that no line could lengthen on either side in their shard;
there are at most two per line of a shard, each a hash with the place of one occurrence. Hashes of
all blocks of a length come from prefix sums, so a shard is read once per length in use.

A hot source only has more shards; documents cross the network once, as line identifiers.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import BLANKS, latest_rows

#: Lines aimed at per shard.
SHARD_LINES = 200_000
#: Documents aimed at per shard at least, so that a share of them is more than one.
SHARD_DOCUMENTS = 64
_PRIME = 0x9E3779B97F4A7C15  # odd multiplier of the block hash
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BLOCKS = "source string, hash bigint, length int, documents bigint, id string, at int"


def line_texts(content: Column) -> Column:
    """The lines of a text, ended by CRLF, CR or LF."""
    return F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n", -1)


def line_key(line: Column) -> Column:
    """A line as it is compared: whitespace collapsed and trimmed, lower case, digit runs as one 0."""
    collapsed = F.trim(F.regexp_replace(line, f"[{BLANKS}]+", " "), F.lit(BLANKS))
    return F.regexp_replace(F.lower(collapsed), "[0-9]+", "0")


def line_identifier(line: Column) -> Column:
    """64-bit identifier of a line's key."""
    return F.xxhash64(line_key(line))


def block_texts(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """``blocks`` (id, at, length and others) with ``lines``: the keys of their lines; ``contents``: id, content."""
    keys = F.filter(F.transform(line_texts(F.col("content")), lambda line: F.when(line.rlike(r"\p{L}"), line_key(line))), lambda k: k.isNotNull())
    cut = F.slice(keys, F.col("at") + 1, F.col("length"))
    return blocks.join(contents.select("id", "content"), "id").withColumn("lines", F.array_join(cut, "\n")).drop("content")


def identified_lines(content: Column) -> Column:
    """array<struct<line_no, id>> of the lines with a letter, numbered from 1 over all lines."""
    numbered = F.transform(line_texts(content), lambda line, i: F.when(line.rlike(r"\p{L}"), F.struct((i + 1).alias("line_no"), line_identifier(line).alias("id"))))
    return F.coalesce(F.filter(numbered, lambda x: x.isNotNull()), F.array().cast("array<struct<line_no:int,id:bigint>>"))


def _joined(docs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenated identifiers, the document of each, and the lines left in its document from each on."""
    sizes = docs["ids"].map(len).to_numpy()
    ids = np.concatenate(docs["ids"].to_numpy()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    return ids, doc, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))


def suffix_array(ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it), suffixes ending with their document.

    Prefix doubling: ranks by the first 2**j lines, from pairs of ranks by the first 2**(j-1).
    """
    n = len(ids)
    position = np.arange(n)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while n and (left > width).any():
        second = np.where(left > width, ranks[-1][np.minimum(position + width, n - 1)] + 1, 0)
        merged = np.unique(ranks[-1] * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        if merged.max() == ranks[-1].max():
            break
        ranks.append(merged)
        width *= 2
    order = np.lexsort((left, ranks[-1]))
    a, b = order[:-1].copy(), order[1:].copy()
    room = np.minimum(left[a], left[b]) if n else np.zeros(0, np.int64)
    common = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        while True:  # the top level may match several times over
            fits = room - common >= step
            same = fits.copy()
            same[fits] = ranks[level][(a + common)[fits]] == ranks[level][(b + common)[fits]]
            common[same] += step
            if level < len(ranks) - 1 or not same.any():
                break
    return order, np.r_[0, common][:n]


def repeated_blocks(ids: np.ndarray, doc: np.ndarray, left: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """{(start, length): documents} of one occurrence of each repeated block in at least ``least`` documents.

    Blocks are the intervals of the common prefixes, that is those that some line follows in one
    place and not in another, if likewise not all stand after the same line; and every single line.
    Documents are counted on the way: of two suffixes of one document next to each other in order,
    the second counts in no interval that holds both.
    """
    order, common = suffix_array(ids, left)
    out: dict[tuple[int, int], int] = {}
    n = len(ids)
    place = doc[order] if n else doc
    by_doc = np.argsort(place, kind="stable")
    before = np.full(n, -1, np.int64)  # the suffix before of the same document
    if n:
        same = place[by_doc[1:]] == place[by_doc[:-1]]
        before[by_doc[1:][same]] = by_doc[:-1][same]
    starts = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)
    ahead = np.where(starts[order], -1, np.unique(ids, return_inverse=True)[1][order - 1]) if n else order  # the line before a suffix, -1: none
    order_, common_, before_, ahead_ = order.tolist(), common.tolist(), before.tolist(), ahead.tolist()

    def note(first: int, stop: int, length: int, twice: int) -> None:
        if (documents := stop - first - twice) >= least:
            out[order_[first], length] = documents

    bounds = np.flatnonzero(np.r_[True, common[1:] == 0, True]) if n else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # suffixes with the same first line
        if b - a < max(least, 1):
            continue
        # open intervals: first suffix, common prefix, suffixes counted twice, line before (-1: several)
        firsts, lengths, twice, lines = [a], [1], [0], [ahead_[a]]
        for i in range(a + 1, b + 1):
            prefix, first, again, line = (common_[i] if i < b else 0), i - 1, 0, ahead_[i - 1]
            while lengths and lengths[-1] > prefix:
                first, length, again, line = firsts.pop(), lengths.pop(), twice.pop(), lines.pop()
                if length > 1 and line < 0:
                    note(first, i, length, again)
                elif length == 1:
                    note(first, i, 1, again)
                if lengths:
                    if lengths[-1] >= prefix:
                        twice[-1] += again
                        lines[-1] = line if lines[-1] == line else -1
                        again = 0
            if i == b:
                break
            if lengths[-1] < prefix:
                parent = lines[-1]
                lines[-1] = line if parent == line else -1
                firsts.append(first)
                lengths.append(prefix)
                twice.append(again)
                lines.append(line)
            lines[-1] = ahead_[i] if lines[-1] == ahead_[i] else -1
            if before_[i] >= a:
                twice[bisect_right(firsts, before_[i]) - 1] += 1
    if least <= 1:  # a block of one document repeats nowhere else: its lines stand for it
        out.update({(int(i), 1): 1 for i in np.unique(ids, return_index=True)[1] if (int(i), 1) not in out})
    return out


class BlockHashes:
    """64-bit hashes of blocks of line identifiers, from prefix sums: one line hashes to itself."""

    def __init__(self, ids: np.ndarray) -> None:
        power = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(len(ids), base, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(ids.astype(np.uint64) * power(_PRIME)[:-1])]
        self.back = power(_INVERSE)

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return ((self.sums[start + length] - self.sums[start]) * self.back[start]).astype(np.int64)


def _blocks(source: list, hashes: list, lengths: list, documents: list, ids: list, at: list) -> pd.DataFrame:
    """A frame of blocks whose columns have their types even if it is empty."""
    return pd.DataFrame({
        "source": pd.Series(source, dtype=object), "hash": pd.Series(hashes, dtype="int64"), "length": pd.Series(lengths, dtype="int32"),
        "documents": pd.Series(documents, dtype="int64"), "id": pd.Series(ids, dtype=object), "at": pd.Series(at, dtype="int32"),
    })


def _occurrences(docs: pd.DataFrame, blocks: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """(start, block, length) of each occurrence of ``blocks`` (block: its row); and the document of all lines."""
    ids, doc, left = _joined(docs)
    hashes, found = BlockHashes(ids), []
    wanted, rows = blocks["hash"].to_numpy(), np.arange(len(blocks))
    for length in np.unique(blocks["length"]):
        mine = rows[blocks["length"].to_numpy() == length]
        mine = mine[np.argsort(wanted[mine])]
        start = np.flatnonzero(left >= length)
        here = hashes.at(start, int(length))
        at = np.minimum(np.searchsorted(wanted[mine], here), len(mine) - 1)
        hit = wanted[mine][at] == here
        found.append(pd.DataFrame({"start": start[hit], "block": mine[at[hit]], "length": np.int64(length)}))
    return pd.concat(found, ignore_index=True), doc


def shards(documents: DataFrame, shard_lines: int = SHARD_LINES) -> DataFrame:
    """(source, shard, id, numbers, ids, share): documents as line numbers and identifiers, dealt into shards.

    ``documents``: id, source and lines as ``identified_lines`` gives them, one row per id.
    """
    rows = documents.filter("id IS NOT NULL AND source IS NOT NULL")
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("lines")).alias("n_lines"))
    number = F.greatest(F.lit(1), F.least(F.ceil(F.col("n_lines") / shard_lines), F.floor(F.col("documents") / SHARD_DOCUMENTS)))
    shard = F.pmod(F.xxhash64("id"), number).cast("int")
    return rows.join(totals, "source").select("source", shard.alias("shard"), "id", F.col("lines.line_no").alias("numbers"), F.col("lines.id").alias("ids"), "documents")


def frequent_blocks(dealt: DataFrame, share: float, least: int) -> DataFrame:
    """(source, hash, length, documents, id, at): blocks in at least ``share`` of the source's documents and in ``least`` of them.

    ``documents`` is the exact number over all shards. Single lines come all; longer blocks are
    those that nothing could lengthen on either side in some shard. One occurrence of the block
    begins with line ``at`` (from 0, of those with a letter) of document ``id``.
    """

    def candidates(docs: pd.DataFrame) -> pd.DataFrame:
        total = int(docs["documents"].iloc[0])
        local = max(1, int(np.ceil(max(least, share * total) / total * len(docs) - 1e-9)))
        ids, doc, left = _joined(docs)
        found = repeated_blocks(ids, doc, left, local)
        if not found:
            return _blocks([], [], [], [], [], [])
        start, length = np.array([*found]).T
        first = np.searchsorted(doc, doc[start])
        return _blocks([docs["source"].iloc[0]] * len(found), BlockHashes(ids).at(start, length), length, list(found.values()), docs["id"].to_numpy()[doc[start]], start - first)

    def count(docs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or blocks.empty:
            return _blocks([], [], [], [], [], [])
        at, doc = _occurrences(docs, blocks)
        seen = np.unique(at["block"].to_numpy() * (len(docs) + 1) + doc[at["start"].to_numpy()]) // (len(docs) + 1)
        rows, documents = np.unique(seen, return_counts=True)
        mine = blocks.iloc[rows]
        return _blocks([docs["source"].iloc[0]] * len(rows), mine["hash"].to_numpy(), mine["length"].to_numpy(), documents, mine["id"].to_numpy(), mine["at"].to_numpy())

    where = F.min(F.struct("id", "at")).alias("_where")
    named = dealt.groupBy("source", "shard").applyInPandas(candidates, _BLOCKS).groupBy("source", "hash", "length").agg(where).select("source", "hash", "length", "_where.*")
    counted = _each_shard(dealt, named, count, _BLOCKS)
    totals = dealt.groupBy("source").agg(F.first("documents").alias("_total"))
    exact = counted.groupBy("source", "hash", "length").agg(F.sum("documents").alias("documents"), where)
    kept = exact.join(totals, "source").filter((F.col("documents") >= least) & (F.col("documents") >= F.lit(share) * F.col("_total") - 1e-9))
    return kept.select("source", "hash", "length", "documents", "_where.*")


def _each_shard(dealt: DataFrame, blocks: DataFrame, step, schema: str) -> DataFrame:  # noqa: ANN001
    """``step(documents, blocks of their source)`` for each shard."""
    every = dealt.groupBy(F.col("source").alias("to_source"), F.col("shard").alias("to_shard")).agg(F.count(F.lit(1)).alias("_n"))
    copies = blocks.join(every, F.col("source") == F.col("to_source")).select("to_source", "to_shard", "hash", "length", "id", "at")
    return dealt.groupBy("source", "shard").cogroup(copies.groupBy("to_source", "to_shard")).applyInPandas(step, schema)


def repeated_lines(documents: DataFrame, share: float = 0.1, least: int = 4, shard_lines: int = SHARD_LINES) -> DataFrame:
    """(source, id, line_no): the lines covered by a block that spans ``share`` of the source's documents and ``least`` of them.

    ``documents``: id, source and lines (``identified_lines``), one row per id. Rows with a null
    id or source are left out; documents without lines count among their source's documents. Lines
    without a letter belong to no block and do not part one. Other columns do not matter. Empty
    inputs give an empty result.
    """
    dealt = shards(documents, shard_lines)

    def covered(docs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or blocks.empty:
            return pd.DataFrame({"source": pd.Series(dtype=object), "id": pd.Series(dtype=object), "line_no": pd.Series(dtype="int64")})
        at, doc = _occurrences(docs, blocks)
        change = np.zeros(len(doc) + 1, np.int64)
        np.add.at(change, at["start"].to_numpy(np.int64), 1)
        np.add.at(change, (at["start"] + at["length"]).to_numpy(np.int64), -1)
        hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        numbers = np.concatenate(docs["numbers"].to_numpy()) if len(doc) else np.zeros(0, np.int32)
        return pd.DataFrame({"source": docs["source"].iloc[0], "id": docs["id"].to_numpy()[doc[hit]], "line_no": numbers[hit]})

    return _each_shard(dealt, frequent_blocks(dealt, share, least), covered, "source string, id string, line_no bigint")


def counting_documents(rows: DataFrame) -> DataFrame:
    """id, source, lines of canonical documents: counting rows, types trimmed and upper-cased, blank ones left out."""
    kind = F.upper(F.trim("document_type", F.lit(BLANKS)))
    lined = rows.select("document_id", "ingested_at", kind.alias("source"), identified_lines(F.col("content")).alias("lines"))
    return latest_rows(lined, "document_id", "ingested_at", ["source", "lines"]).filter("source <> ''").select(F.col("document_id").alias("id"), "source", "lines")


def without_lines(contents: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, content) with the lines of ``removed`` (id, line_no) taken out; a null content stays null.

    The rest keeps its order; line ends become LF in texts that lose a line, others stay as they are.
    """
    gone = removed.groupBy("id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(line_texts(F.col("content")), lambda line, i: ~F.array_contains("_gone", (i + 1).cast("bigint")))
    return contents.join(gone, "id", "left").select("id", F.when(F.col("_gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"))
