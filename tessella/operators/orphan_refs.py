"""References to records that do not exist at the time of the reference.

Keys are dictionary-encoded as dense integers; references, births and deaths of keys become
compressed bitmaps per key range (32,768 codes) and period; per range, ``references AND NOT
present`` leaves the bits of orphans, which are decoded through the dictionary. A month in which a
key is born or dies cannot be settled by one bit: those survivors, and only those, are compared by
exact time.

A bitmap is stored in the smallest of three forms: sorted positions, runs, or plain bits; it never
takes more than 4 KB and takes two bytes a reference where they are few. Bitmaps are built in the
tasks that read the coded references and united per range.

Skew: references collapse to distinct (key, period) in the map-side aggregate, so a key named by
a third of all rows arrives once per task; what remains per range is bounded by the bitmap size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import ensure_checkpoint_dir

#: Codes per bitmap, as a power of two: positions fit 16 bits.
RANGE_BITS = 15
#: Keys aimed at per bucket of the dictionary.
BUCKET_KEYS = 65_536
_BITMAPS = "range bigint, period int, kind string, bits binary"
SURVIVORS = "code bigint, period int, unsettled boolean"


def month_number(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def lifespans(rows: DataFrame, space: str, key: Column, born: str, died: str) -> DataFrame:
    """(space, key, born_at, died_at) of each non-null key.

    A key is born with the earliest ``born`` of its rows and dies with the ``died`` of the row
    loaded last (null: never). Of rows loaded at the same time the largest ``died`` counts.
    """
    return (
        rows.select(key.alias("key"), F.col(born).alias("born"), F.col(died).alias("died"))
        .filter("key IS NOT NULL AND born IS NOT NULL")
        .groupBy("key")
        .agg(F.min("born").alias("born_at"), F.max(F.struct("born", "died")).alias("_last"))
        .select(F.lit(space).alias("space"), "key", "born_at", F.col("_last.died").alias("died_at"))
    )


def dictionary(keys: DataFrame, buckets: int = 1024) -> DataFrame:
    """(space, key, code): dense codes from 0, the same on every run.

    Keys are numbered within hash buckets and shifted by the sizes of the buckets before; the
    running sum of the sizes is over ``buckets`` rows, one per 65,536 keys where callers count them.
    """
    placed = keys.select("space", "key").distinct().withColumn("bucket", F.pmod(F.xxhash64("space", "key"), F.lit(buckets)).cast("int"))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("space", "key")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return ranked.join(offsets, "bucket").select("space", "key", (F.col("offset") + F.col("nth") - 1).alias("code"))


def pack_bits(positions: np.ndarray) -> bytes:
    """A compressed bitmap of sorted distinct positions below 32,768: a letter for its form, then its bytes."""
    starts = positions[np.r_[True, np.diff(positions) > 1]] if len(positions) else positions
    if len(positions) * 2 <= min(len(starts) * 4, 1 << RANGE_BITS - 3):
        return b"p" + positions.astype("<u2").tobytes()
    if len(starts) * 4 <= 1 << RANGE_BITS - 3:
        stops = positions[np.r_[np.diff(positions) > 1, True]]
        return b"r" + np.stack([starts, stops]).astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE_BITS, np.uint8)
    bits[positions] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    """The plain bits of a compressed bitmap, 4 KB."""
    form, data = packed[:1], packed[1:]
    if form == b"b":
        return np.frombuffer(data, np.uint8)
    bits = np.zeros((1 << RANGE_BITS) + 1, np.int8)
    values = np.frombuffer(data, "<u2").astype(np.int64)
    if form == b"p":
        bits[values] = 1
        return np.packbits(bits[:-1].view(np.uint8), bitorder="little")
    starts, stops = values.reshape(2, -1)
    bits[starts] += 1
    bits[stops + 1] -= 1
    return np.packbits(np.cumsum(bits[:-1], dtype=np.int8).view(np.uint8), bitorder="little")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, period, kind, bits) of (code, period, kind) rows: a bitmap per group and task, in batches of a million rows."""

    def packed(rows: pa.Table) -> pa.RecordBatch:
        code, period = rows["code"].to_numpy(), rows["period"].to_numpy()
        kind = rows["kind"].to_numpy()
        order = np.lexsort((code, kind, period, code >> RANGE_BITS))
        code, period, kind = code[order], period[order], kind[order]
        place = code >> RANGE_BITS
        new = np.r_[True, (place[1:] != place[:-1]) | (period[1:] != period[:-1]) | (kind[1:] != kind[:-1])]
        starts = np.flatnonzero(new)
        low = code & (1 << RANGE_BITS) - 1
        bits = [pack_bits(np.unique(x)) for x in np.split(low, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(place[starts]), pa.array(period[starts]), pa.array(kind[starts]), pa.array(bits, pa.binary())], ["range", "period", "kind", "bits"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= 1_000_000:
            yield packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield packed(pa.Table.from_batches(held))


def _surviving_bits(bitmaps: pd.DataFrame) -> pd.DataFrame:
    """References AND NOT present, of one range, period after period."""
    by: dict[tuple[str, int], np.ndarray] = {}
    for kind, period, packed in zip(bitmaps["kind"], bitmaps["period"], bitmaps["bits"]):
        bits = unpack_bits(packed)
        by[kind, period] = by[kind, period] | bits if (kind, period) in by else bits
    none = np.zeros(1 << RANGE_BITS - 3, np.uint8)
    born, dead = none.copy(), none.copy()  # before the period at hand
    base = int(bitmaps["range"].iloc[0]) << RANGE_BITS
    out = []
    for period in sorted(set(bitmaps["period"])):
        births, deaths = by.get(("birth", period), none), by.get(("death", period), none)
        if (refs := by.get(("ref", period))) is not None:
            missing = refs & ~(born & ~dead & ~deaths)
            moving = (births | deaths) & ~dead
            for bits, unsettled in ((missing & ~moving, False), (missing & moving, True)):
                codes = np.flatnonzero(np.unpackbits(bits, bitorder="little")) + base
                out.append(pd.DataFrame({"code": codes, "period": np.int32(period), "unsettled": unsettled}))
        born, dead = born | births, dead | deaths
    return pd.concat(out) if out else pd.DataFrame({"code": pd.Series(dtype="int64"), "period": pd.Series(dtype="int32"), "unsettled": pd.Series(dtype="bool")})


def orphan_references(refs: DataFrame, parents: DataFrame, carry: list[str], buckets: int | None = None) -> DataFrame:
    """The references whose key does not exist at their time.

    ``refs``: space, key, at and the ``carry`` columns; rows with a null among the three are no
    references. ``parents``: as ``lifespans`` gives it. Result: ``carry``, space, key, period
    (``yyyy-MM``), distinct. Empty inputs give an empty result; with empty ``parents`` every
    reference is an orphan. The distinct (key, period) pairs and their codes are checkpointed, so
    the references are read twice: to name the keys and to report the orphans. The dictionary has
    a bucket per ``BUCKET_KEYS`` pairs unless ``buckets`` says otherwise.
    """
    refs = refs.filter("space IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").select(*carry, "space", "key", "at", month_number(F.col("at")).alias("period"))
    ensure_checkpoint_dir(refs.sparkSession)
    named = refs.select("space", "key", "period").distinct().checkpoint()
    codes = dictionary(named, buckets or max(64, named.count() // BUCKET_KEYS)).checkpoint()
    known = parents.join(codes, ["space", "key"]).select("code", "born_at", "died_at").checkpoint()
    births = known.select("code", month_number(F.col("born_at")).alias("period"), F.lit("birth").alias("kind"))
    deaths = known.filter("died_at IS NOT NULL").select("code", month_number(F.greatest("born_at", "died_at")).alias("period"), F.lit("death").alias("kind"))
    coded = named.join(codes, ["space", "key"]).select("code", "period", F.lit("ref").alias("kind"))
    bitmaps = coded.unionByName(births).unionByName(deaths).mapInArrow(_bitmaps, _BITMAPS)
    survivors = bitmaps.groupBy("range").applyInPandas(_surviving_bits, SURVIVORS)
    decoded = survivors.join(known, "code", "left").join(codes, "code").drop("code")
    alive = F.col("unsettled") & (F.col("at") >= F.col("born_at")) & (F.col("died_at").isNull() | (F.col("at") < F.col("died_at")))
    return (
        refs.join(decoded, ["space", "key", "period"])
        .filter(~F.coalesce(alive, F.lit(False)))
        .select(*carry, "space", "key", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_counts(refs: DataFrame, orphans: DataFrame, table: str, at: str) -> DataFrame:
    """Per table and month: distinct references, orphans among them and their share."""
    every = refs.groupBy(table, F.date_format(at, "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = orphans.groupBy(table, "period").agg(F.count(F.lit(1)).alias("n_orphans"))
    n = F.coalesce("n_orphans", F.lit(0))
    return every.join(bad, [table, "period"], "left").select(table, "period", "n_refs", n.alias("n_orphans"), F.round(n / F.col("n_refs"), 6).alias("share"))
