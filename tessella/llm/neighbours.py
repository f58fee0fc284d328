"""The k most similar vectors of every vector, by shifted Hilbert orderings.

Vectors are projected on random rotations of their leading principal axes, shifted, and numbered
along a Hilbert curve, once per ordering. Spark range-partitions the keys by (ordering, key) and
numbers them through each ordering; each window of numbers is compared with itself and the windows
before and after it, and the best of every row are kept. Windows travel in groups that also hold
the window before and after, so the result does not depend on the number of partitions. The lists
of all orderings merge per row.

A window holds a falling share of a growing collection, so the merged lists are then refined: in
each round the neighbours of a vector, and those that have it for a neighbour, are compared with
each other. Rounds go on until one of them renews less than a set share of the results.

Work grows linearly: ``orderings * 3 * window`` inner products per vector and about ``kept ** 2``
more a round. Nothing is compared across a whole group: copies of one vector share a key, are
ordered by a tie-break, and meet the copies in their windows only, which are as similar as any
others. A vector in the lists of very many is compared with them in chunks.

Disk holds a part of the work at a time: orderings are compared a few after another, a round goes
through its groups in slices, what was found is merged into the lists in between, and shuffle files
and tables that were read for the last time are removed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.orphan_refs import BUCKET_KEYS, dictionary
from tessella.session import ensure_checkpoint_dir, remove, spread
from tessella.sources.sinks import scratch


@dataclass(frozen=True)
class Curves:
    """Parameters: orderings, projected dimensions, bits each, rows per window, principal axes used.

    ``kept``: length of the lists while they are refined; ``settled``: the share of renewed results
    below which a round is the last; ``most_rounds``: an error if they do not settle by then.
    """

    orderings: int = 8
    axes: int = 8
    bits: int = 6
    window: int = 1024
    principal: int = 20
    seed: int = 20
    kept: int = 24
    settled: float = 0.04
    most_rounds: int = 24


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (rows, axes), each below ``2 ** bits``.

    Gray-code form: undo the rotations and reflections from the highest bit down, Gray-encode,
    interleave the bits. ``axes * bits`` must stay below 64.
    """
    x = cells.astype(np.int64).T.copy()
    high = 1 << bits - 1
    level = high
    while level > 1:
        below = level - 1
        for i in range(len(x)):
            flipped = (x[i] & level) != 0
            swap = np.where(flipped, 0, (x[0] ^ x[i]) & below)
            x[0] ^= swap | np.where(flipped, below, 0)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    level = high
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> bit & 1
    return key


def _unit(embeddings: pa.ListArray, dim: int) -> np.ndarray:
    flat = embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose embedding has exactly ``dim`` finite numbers that are not all zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(e.isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda v: v != 0))


def _moments(coded: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of all stored vectors; dim * (dim + 1) numbers reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _decoded(batch.column(1), batch.column(0).to_numpy(), dim).astype(np.float64)
            n, total, gram = n + len(unit), total + unit.sum(0), gram + unit.T @ unit
        if n:
            values = np.r_[n, total, gram.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    sums = coded.select("scale", "stored").mapInArrow(partial, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return 0, np.zeros(dim), np.eye(dim)
    values = np.zeros(1 + dim + dim * dim)
    for row in sums:
        values[row["i"]] = row["v"]
    n, mean = int(values[0]), values[1 : dim + 1] / values[0]
    return n, mean, values[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)


def _projections(mean: np.ndarray, covariance: np.ndarray, curves: Curves) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, offset) per ordering: unit vectors to the unit cube, mean near its middle, shifted."""
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, : max(curves.axes, min(curves.principal, len(mean)))]
    random = np.random.default_rng(curves.seed)
    out = []
    for _ in range(curves.orderings):
        turn = np.linalg.qr(random.normal(size=(axes.shape[1], axes.shape[1])))[0][:, : curves.axes]
        matrix = axes @ turn
        spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", matrix, covariance, matrix), 1e-12))
        matrix = matrix / spread / 5
        out.append((matrix, 0.5 - mean @ matrix + (random.random(matrix.shape[1]) - 0.5) / 4))
    return out


#: Windows that travel together, at most and at least; one more at either end comes along to be compared with.
_GROUP, _LEAST_GROUP = 32, 4

#: Vectors, times orderings, that are compared before their lists are merged: bounds the disk.
_TOGETHER = 400_000

#: A round goes through its groups in a slice for so many vectors, at most ``_SLICES``; lists are merged after ``_PENDING`` slices.
_SLICED, _SLICES, _PENDING = 40_000, 12, 4

#: Vectors that have one neighbour in common and are compared with its neighbours at once.
_CHUNK = 128

#: Pairs gathered before they are packed: bounds the memory of a task.
_PAIRS = 1 << 20

#: Rows compared at once: keeps the inner products in the processor's cache.
_SLICE = 256


def _best(left: np.ndarray, right: np.ndarray, codes: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``left``: codes and similarities of the k best of ``right``, best first; row i is ``right[own + i]``."""
    take = min(k, len(right) - 1)
    near, best = np.zeros((len(left), take), np.int64), np.zeros((len(left), take), np.float32)
    for i in range(0, len(left) if take else 0, _SLICE):
        sims = left[i : i + _SLICE] @ right.T
        rows = np.arange(len(sims))
        sims[rows, own + i + rows] = -2
        at = np.argpartition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take :]
        near[i : i + _SLICE], best[i : i + _SLICE] = codes[at], np.take_along_axis(sims, at, 1)
    return near, best


def _packed(code: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int, fields: dict[str, np.ndarray] | None = None, counted: int | None = None) -> pa.RecordBatch:
    """One row per code: its distinct ``near``, best first, at most ``k``; ``fields`` are summed up over the first ``counted`` of those kept."""
    span = int(near.max()) + 1 if len(near) else 1
    order = np.argsort(code * span + near) if len(code) and int(code.max()) < 2**63 // span - 1 else np.lexsort((near, code))
    code, near, sims = code[order], near[order], sims[order].astype(np.float32)
    extra = {n: v[order] for n, v in (fields or {}).items()}
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (near[1:] != near[:-1])][: len(code)])
    if len(first):
        sims, extra = np.maximum.reduceat(sims, first), {n: np.minimum.reduceat(v, first) for n, v in extra.items()}
    code, near = code[first], near[first]
    run = np.cumsum(np.r_[False, code[1:] != code[:-1]][: len(code)])
    bits = sims.view(np.int32)
    rising = (bits ^ (bits >> 31 & 0x7FFFFFFF)).astype(np.int64)  # in the order of the floats
    order = np.argsort((run << 32) + (2**31 - rising), kind="stable")
    code, near, sims = code[order], near[order], sims[order]
    rank = np.arange(len(code)) - np.searchsorted(code, code)
    kept = rank < k
    code, near, sims, rank = code[kept], near[kept], sims[kept], rank[kept]
    starts = np.flatnonzero(rank == 0)
    offsets = pa.array(np.r_[starts, len(code)].astype(np.int32))
    columns = [pa.array(code[starts]), pa.ListArray.from_arrays(offsets, pa.array(near)), pa.ListArray.from_arrays(offsets, pa.array(sims))]
    for v in extra.values():
        first_ones = np.where(rank < (k if counted is None else counted), v[order][kept], 0)
        columns.append(pa.array(np.add.reduceat(first_ones, starts).astype(np.int32) if len(starts) else np.zeros(0, np.int32)))
    return pa.RecordBatch.from_arrays(columns, ["code", "near", "sims", *extra])


def _whole(batches: Iterator[pa.RecordBatch], by: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by the columns ``by``, recut so that no group of theirs is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        if held:
            change[0] = any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != k[0] for c, k in zip(by, keys))
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(change)
        if len(at):
            if held or at[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))]).combine_chunks().to_batches()[0]
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _decoded(packed: pa.Array, scale: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of 16-bit fractions."""
    first = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])  # all are of one length
    raw = np.frombuffer(packed.buffers()[2], "<i2", len(packed) * dim, first).reshape(-1, dim)
    return raw.astype(np.float32) * (scale / 32767).astype(np.float32)[:, None]


def _met(start: np.ndarray, lefts: np.ndarray, sizes: np.ndarray, member: np.ndarray, least: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, near, similarity) of pairs within blocks of rows that are better than ``least`` of the code.

    A block's first ``lefts`` rows are compared with all its rows. Blocks of like size go together.
    """
    order = np.argsort(sizes, kind="stable")
    for i in range(0, len(order), 64):
        some = order[i : i + 64]
        wide, high = int(sizes[some].max()), int(lefts[some].max())
        if not high:
            continue
        columns = np.arange(wide)
        right = start[some, None] + np.minimum(columns, sizes[some, None] - 1)
        left = right[:, :high]
        sims = np.matmul(unit[left], unit[right].transpose(0, 2, 1))
        valid = (columns[:high] < lefts[some, None])[:, :, None] & (columns < sizes[some, None])[:, None, :] & (member[left][:, :, None] != member[right][:, None, :])
        b, l, r = np.nonzero(valid & (sims > least[left][:, :, None]))
        yield member[left[b, l]], member[right[b, r]], sims[b, l, r]
        b, l, r = np.nonzero(valid & (sims > least[right][:, None, :]) & (columns >= lefts[some, None])[:, None, :])
        yield member[right[b, r]], member[left[b, l]], sims[b, l, r]


def _hot(lists: DataFrame) -> DataFrame:
    """(_hot, _chunks): the codes in the lists of more than ``_CHUNK`` others."""
    asked = lists.select(F.explode("near").alias("near")).groupBy("near").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _CHUNK)
    return asked.select(F.col("near").alias("_hot"), F.ceil(F.col("_n") / _CHUNK).cast("int").alias("_chunks"))


def _refined(lists: DataFrame, hot: DataFrame, vectors: DataFrame, parts: int, kept: int, dim: int, part: int, slices: int) -> DataFrame:
    """(code, near, sims): what the members of each group in slice ``part`` of ``slices`` find in it.

    A vector's group holds its neighbours (left) and those that have it for a neighbour. Groups of
    more than ``_CHUNK`` of the latter are dealt into chunks that each get all of the former, and
    vectors that travel to very many groups are salted alike: no task gets an unbounded group.
    """
    chunks = F.coalesce("_chunks", F.lit(1))
    dealt = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")

    def within(group: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("slice"), F.col(group)), F.lit(slices)) == part

    def pairs(ends: DataFrame) -> DataFrame:
        own = ends.join(hot, F.col("code") == F.col("_hot"), "left").select("code", chunks.alias("_own"), "near")
        return own.join(hot, F.col("near") == F.col("_hot"), "left").select("code", "near", "_own", chunks.alias("_their"))

    ends = lambda rows: rows.select("code", F.explode("near").alias("near"))
    left = pairs(ends(lists.filter(within("code")))).select(F.col("near").alias("member"), dealt("code", "_their").alias("salt"), F.col("code").alias("group"), F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("chunk"), F.lit(1).alias("left"))
    right = pairs(ends(lists).filter(within("near"))).select(F.col("code").alias("member"), dealt("near", "_own").alias("salt"), F.col("near").alias("group"), dealt("code", "_their").alias("chunk"), F.lit(0).alias("left"))
    members = left.unionByName(right).repartition(parts, "member", "salt").groupBy("member", "salt", "group", "chunk").agg(F.max("left").alias("left"))
    least = lists.select(F.col("code").alias("_code"), F.when(F.size("sims") >= kept, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    known = vectors.select("code", "scale", "stored").join(least, F.col("code") == F.col("_code")).join(hot, F.col("code") == F.col("_hot"), "left")
    sent = known.select(F.col("code").alias("member"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("salt"), "scale", "least", "stored")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        n = 0
        for batch in _whole(batches, [0, 1]):
            group, chunk, left, member, scale, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])])
            sizes = np.diff(np.r_[start, len(group)])
            lefts = np.add.reduceat(left.astype(np.int64), start)
            for part in _met(start, lefts, sizes, member, least, _decoded(batch.column(6), scale, dim)):
                found.append(part)
                n += len(part[0])
                if n >= _PAIRS:
                    yield _packed(*map(np.concatenate, zip(*found)), kept)
                    found, n = [], 0
        if n:
            yield _packed(*map(np.concatenate, zip(*found)), kept)

    grouped = members.join(sent, ["member", "salt"]).select("group", "chunk", "left", "member", "scale", "least", "stored")
    return grouped.repartition(parts, "group", "chunk").sortWithinPartitions("group", "chunk", F.desc("left")).mapInArrow(meet, _LISTS)


_LISTS = "code bigint, near array<bigint>, sims array<float>"


def _merged(lists: DataFrame | None, met: list[DataFrame], parts: int, kept: int, k: int) -> DataFrame:
    """(code, near, sims, fresh): ``lists`` and those ``met`` (code, near, sims) as one of each code; ``fresh`` of its first ``k`` were in the latter only."""
    rows = reduce(DataFrame.unionByName, [x.select("code", "near", "sims", F.lit(new).alias("new")) for new, x in [*([(False, lists)] if lists is not None else []), *((True, x) for x in met)]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, [0]):
            near, sims = batch.column(1), batch.column(2)
            sizes = np.diff(near.offsets.to_numpy())
            code = np.repeat(batch.column(0).to_numpy(), sizes)
            new = np.repeat(batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32), sizes)
            yield _packed(code, near.flatten().to_numpy(), sims.flatten().to_numpy(), kept, {"fresh": new}, k)

    return rows.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(merge, _LISTS + ", fresh int")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the action that wrote them, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Tables:
    """Tables of one call in the scratch folder, by name; writing one anew or dropping it removes its files."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.places = spark, {}

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows``, which may read the table of that name as it was, written and read again."""
        place = scratch(self.spark, f"neighbours-{name}")
        try:
            rows.write.option("compression", "zstd").parquet(place)
        except BaseException:
            remove(self.spark, place)
            raise
        self.drop(name)
        self.places[name] = place
        return self.spark.read.schema(rows.schema).parquet(place)

    def drop(self, *names: str) -> None:
        for name in names:
            if place := self.places.pop(name, None):
                remove(self.spark, place)


def _edges(keyed: DataFrame, orderings: int, group: int, window: int, parts: int, tables: _Tables) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By ordering, the (ranks, keys, codes) where a group begins, its first window ends or its last begins.

    Three of ``group * window`` vectors reach the driver for each ordering.
    """
    keys = keyed.select("code", F.posexplode("keys").alias("ordering", "key"))
    ranged = keys.repartitionByRange(parts, "ordering", "key", "code").sortWithinPartitions("ordering", "key", "code")
    ranged = tables.keep("ranged", ranged.select("ordering", "key", "code", F.monotonically_increasing_id().alias("at")))  # the number of the partition, then 33 bits for the place in it
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy("ordering", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("ordering", "part").collect()
    starts, ordering, total = [], None, 0
    for row in sizes:
        total = total if row["ordering"] == ordering else 0
        ordering = row["ordering"]
        starts.append((ordering, row["part"], total - row["first"]))
        total += row["n"]
    shifts = ranged.sparkSession.createDataFrame(starts, "ordering int, part bigint, shift bigint")
    ranks = ranged.withColumn("part", part).join(shifts, ["ordering", "part"]).withColumn("rank", F.col("at") + F.col("shift"))
    rows = ranks.filter((F.col("rank") % (group * window)).isin(0, window, (group - 1) * window)).select("ordering", "rank", "key", "code").orderBy("ordering", "rank").collect()
    tables.drop("ranged")
    return {i: tuple(np.array([r[c] for r in rows if r["ordering"] == i], np.int64) for c in ("rank", "key", "code")) for i in range(orderings)}


def _segments(key: np.ndarray, code: np.ndarray, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The last of the sorted (keys, codes) that is not above each (key, code)."""
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    at = low.copy()
    level = np.flatnonzero(high > low)
    for i in np.unique(low[level]):
        rows = level[low[level] == i]
        at[rows] += np.searchsorted(codes[i : high[rows[0]]], code[rows], "right")
    return at - 1


def similar_vectors(vectors: DataFrame, k: int = 10, dim: int = 64, curves: Curves = Curves()) -> DataFrame:
    """(id, neighbour, similarity, rank) with the k most similar other vectors of each vector.

    ``vectors``: id (string, unique) and embedding (list of numbers); other columns do not matter.
    Rows with a null id or an unusable embedding (null, wrong length, a null, NaN or infinite
    element, all zero) take no part. Similarity is the cosine of vectors stored as 16-bit fractions
    of their largest component (error below 0.0001). Ties are settled by an internal code that is
    the same on every run. Fewer than k + 1 vectors give shorter lists, an empty input none. Coded
    vectors, keys and lists are kept in the scratch folder until they are read for the last time;
    names and the final lists are checkpointed. Raises if the lists do not settle within
    ``most_rounds``.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    tables = _Tables(spark)
    try:
        with _shuffles_removed(spark):
            names, best = _lists(vectors, k, dim, curves, tables)
    finally:
        tables.drop(*list(tables.places))
    pairs = best.select("code", F.posexplode("best").alias("_at", "_p")).select("code", F.col("_p.near").alias("neighbour"), F.col("_p.sims").cast("double").alias("similarity"), (F.col("_at") + 1).alias("rank"))
    return pairs.join(names, "code").drop("code").join(names.select(F.col("id").alias("_name"), F.col("code").alias("neighbour")), "neighbour").select("id", F.col("_name").alias("neighbour"), "similarity", "rank")


def _lists(vectors: DataFrame, k: int, dim: int, curves: Curves, tables: _Tables) -> tuple[DataFrame, DataFrame]:
    """(id, code) of all vectors, and (code, best) with the ``k`` best (near, sims) of each."""
    named = vectors.filter(F.col("id").isNotNull())
    rows = usable(named.select("id", "embedding"), dim)
    ids = named.select(F.lit("").alias("space"), F.col("id").alias("key"))
    names = dictionary(ids, max(64, ids.count() // BUCKET_KEYS)).select(F.col("key").alias("id"), "code").checkpoint()
    kept = max(k, curves.kept)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(1), dim)
            scale = np.abs(unit).max(1)
            fractions = np.rint(unit / scale[:, None] * 32767).astype("<i2")
            packed = pa.Array.from_buffers(pa.binary(dim * 2), len(fractions), [None, pa.py_buffer(fractions.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scale.astype(np.float32)), packed], ["code", "scale", "stored"])

    coded = tables.keep("coded", rows.join(names, "id").select("code", "embedding").mapInArrow(stored, "code bigint, scale float, stored binary"))
    count, mean, covariance = _moments(coded, dim)
    projections = _projections(mean, covariance, curves)
    cores = names.sparkSession.sparkContext.defaultParallelism
    windowed = min(_GROUP, max(_LEAST_GROUP, -(-count // (curves.window * 2 * cores))))  # does not change what meets

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _decoded(batch.column(2), batch.column(1).to_numpy(), dim)
            keys = np.empty((len(unit), len(projections)), np.int64)
            for i, (matrix, offset) in enumerate(projections):
                cells = np.clip((unit @ matrix + offset) * (1 << curves.bits), 0, (1 << curves.bits) - 1)
                keys[:, i] = hilbert_keys(cells, curves.bits)
            offsets = np.arange(0, keys.size + 1, len(projections), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["code", "scale", "stored", "keys"])

    coded = tables.keep("coded", spread(coded).mapInArrow(keyed, "code bigint, scale float, stored binary, keys array<bigint>"))
    parts = max(cores, -(-count * curves.orderings // 65536))
    edges = _edges(coded, curves.orderings, windowed, curves.window, parts, tables)

    def grouped(batches: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).to_numpy()
            keys = batch.column(3).flatten().to_numpy().reshape(len(code), -1)
            for i in some:
                ranks, *bounds = edges[i]
                rank = ranks[_segments(keys[:, i], code, *bounds)]
                group, inside = rank // (windowed * curves.window), rank // curves.window % windowed
                for shift, chosen in ((0, None), (-1, (inside == 0) & (group > 0)), (1, (inside == windowed - 1) & (group < ranks[-1] // (windowed * curves.window)))):
                    at = np.arange(len(code)) if chosen is None else np.flatnonzero(chosen)
                    if len(at):
                        own = batch if chosen is None else batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(group[at] + shift), pa.array(keys[at, i]), *(own.column(c) for c in range(3))], ["ordering", "group", "key", "code", "scale", "stored"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(previous, here, following):  # noqa: ANN001, ANN202
            parts = [p for p in (previous, here, following) if p is not None]
            right, codes = np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts])
            near, sims = _best(here[1], right, codes, 0 if previous is None else len(previous[0]), kept)
            offsets = np.arange(0, near.size + 1, max(near.shape[1], 1), dtype=np.int32) if near.shape[1] else np.zeros(len(near) + 1, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(here[0]), pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), pa.ListArray.from_arrays(offsets, pa.array(sims.ravel().astype(np.float32)))],
                ["code", "near", "sims"],
            )

        def blocks():  # noqa: ANN202 - (ordering and group, number of the window, codes, vectors) of each whole window
            held: tuple | None = None
            at, last = 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                order, group, codes, scale = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3, 4))
                unit = _decoded(batch.column(5), scale, dim)
                block = np.empty(len(order), np.int64)
                edges = [0, *(np.flatnonzero((np.diff(order) != 0) | (np.diff(group) != 0)) + 1), len(order)]
                for a, b in zip(edges, edges[1:]):
                    if last != (order[a], group[a]):  # all but the first have a whole window before their own
                        last, at = (order[a], group[a]), max(0, int(group[a]) * windowed - 1) * curves.window
                    block[a:b] = np.arange(at, at + b - a) // curves.window
                    at += b - a
                edges = [0, *(np.flatnonzero((np.diff(order) != 0) | (np.diff(group) != 0) | (np.diff(block) != 0)) + 1), len(order)]
                for a, b in zip(edges, edges[1:]):
                    place = ((int(order[a]), int(group[a])), int(block[a]))
                    if held is not None and held[:2] == place:
                        held = (*place, np.r_[held[2], codes[a:b]], np.r_[held[3], unit[a:b]])
                    else:
                        if held is not None:
                            yield held
                        held = (*place, codes[a:b], unit[a:b])
            if held is not None:
                yield held

        def own(place, block) -> bool:  # noqa: ANN001 - else it came along
            return block // windowed == place[1]

        previous = here = None
        at = None  # of ``here``
        for place, number, *block in blocks():
            if here is not None and at[0] == place:
                if own(*at):
                    yield lists(previous, here, block)
                previous = here
            else:
                if here is not None and own(*at):
                    yield lists(previous, here, None)
                previous = None
            here, at = block, (place, number)
        if here is not None and own(*at):
            yield lists(previous, here, None)

    groups = -(-count // (windowed * curves.window))
    merged_parts = max(cores, -(-count * 2 // 65536))
    together = max(1, min(curves.orderings, _TOGETHER // max(count, 1)))
    lists = None
    for begin in range(0, curves.orderings, together):
        some = range(begin, min(begin + together, curves.orderings))
        dealt = spread(coded).mapInArrow(lambda batches, some=some: grouped(batches, some), "ordering int, group bigint, key bigint, code bigint, scale float, stored binary")
        by_group = dealt.repartitionById(max(1, len(some) * groups), ((F.col("ordering") - begin) * groups + F.col("group")).cast("int"))
        met = by_group.sortWithinPartitions("ordering", "group", "key", "code").mapInArrow(windows, _LISTS)
        lists = tables.keep("lists", _merged(lists, [met], merged_parts, kept, k))
    coded = tables.keep("coded", coded.drop("keys"))
    slices = min(_SLICES, max(1, -(-count // _SLICED)))
    sliced_parts = max(cores, -(-count * 64 // (slices << 18)))
    for _ in range(curves.most_rounds):
        hot, fresh = tables.keep("hot", _hot(lists)), 0
        for begin in range(0, slices, _PENDING):
            some = range(begin, min(begin + _PENDING, slices))
            met = [_refined(lists, hot, coded, sliced_parts, kept, dim, i, slices) for i in some]
            if len(some) > 1:
                met = [tables.keep(f"met{i}", rows) for i, rows in zip(some, met)]
            lists = tables.keep("lists", _merged(lists, met, merged_parts, kept, k))
            tables.drop(*(f"met{i}" for i in some))
            fresh += lists.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
        if fresh <= curves.settled * k * count:
            break
    else:
        raise RuntimeError("the lists of similar vectors did not settle")
    return names, lists.select("code", F.slice(F.arrays_zip("near", "sims"), 1, k).alias("best")).checkpoint()
