"""Orphan references and intervals, against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

import numpy as np

from tessella.operators.intervals import OPEN, Tree, continuous_periods, merged
from tessella.operators.orphan_refs import dictionary, lifespans, orphan_counts, orphan_references, pack_bits, unpack_bits

DAY0 = dt.date(1970, 1, 1)


def naive_periods(rows):
    by = {}
    for e, a, b in rows:
        if e is None or a is None:
            continue
        stop = OPEN if b is None or b.year >= 9999 else (b - DAY0).days
        if stop >= (a - DAY0).days:
            by.setdefault(e, []).append(((a - DAY0).days, stop))
    out = set()
    for e, spans in by.items():
        joined = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
                joined[-1][2] += 1
            else:
                joined.append([a, b, 1])
        out |= {(e, "period", a, b, n) for a, b, n in joined}
        out |= {(e, "gap", x[1] + 1, y[0] - 1, 0) for x, y in zip(joined, joined[1:])}
    return out


def periods(spark, rows, **more):
    frame = spark.createDataFrame(rows, "entity string, start date, stop date").withColumn("kind", F.lit("clash")).withColumn("members", F.lit("clash"))
    return {tuple(r) for r in continuous_periods(frame, **more).collect()}


def test_periods_against_merging(spark):
    rng = random.Random(1)
    day = lambda n: DAY0 + dt.timedelta(days=n)
    rows = []
    for _ in range(3000):
        a = rng.randint(15000, 15400)
        stop = None if rng.random() < 0.005 else dt.date(9999, 12, 31) if rng.random() < 0.005 else day(a + rng.randint(-2, 6))
        rows.append((rng.choice(["hot"] * 3 + [f"e{rng.randint(0, 150)}"] * 3 + [None]), None if rng.random() < 0.02 else day(a), stop))
    rows += rows[:50]
    assert periods(spark, rows) == naive_periods(rows)
    assert periods(spark, rows, slices=3) == naive_periods(rows)


def test_periods_of_nothing(spark):
    assert periods(spark, []) == set()
    assert periods(spark, [(None, None, None)]) == set()
    assert periods(spark, [("a", dt.date(2024, 2, 28), None)]) == {("a", "period", 19781, OPEN, 1)}


def stamp(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_orphans_against_a_loop(spark):
    rng = random.Random(2)
    loads = [(rng.choice([None, *range(60)]), stamp(rng.randint(0, 5000)), rng.choice([None, None, stamp(rng.randint(0, 5000))])) for _ in range(150)]
    refs = [(f"r{i}", rng.choice([None, "P", "P", "Q"]), rng.choice([None, "7", "7", "7", *map(str, range(80))]), rng.choice([None, *[stamp(rng.randint(0, 5000)) for _ in range(20)]])) for i in range(1500)]
    refs += refs[:30]
    rows = spark.createDataFrame(loads, "id int, loaded timestamp_ntz, deleted timestamp_ntz").withColumn("code", F.lit("clash")).withColumn("key", F.lit("clash"))
    spans = lifespans(rows, "P", F.col("id").cast("string"), "loaded", "deleted")
    frame = spark.createDataFrame(refs, "rec string, space string, key string, at timestamp_ntz").withColumn("range", F.lit("clash"))
    born, last = {}, {}
    for k, a, d in loads:
        if k is not None:
            born[str(k)] = min(born.get(str(k), a), a)
            if str(k) not in last or (a, d or dt.datetime.min) > (last[str(k)][0], last[str(k)][1] or dt.datetime.min):
                last[str(k)] = (a, d)
    want = {
        (r, s, k, t.strftime("%Y-%m")) for r, s, k, t in refs if None not in (s, k, t)
        and not (s == "P" and k in born and t >= born[k] and (last[k][1] is None or t < last[k][1]))
    }
    for buckets in (1, 64):
        found = orphan_references(frame, spans, ["rec"], buckets)
        got = [tuple(r) for r in found.select("rec", "space", "key", "period").collect()]
        assert set(got) == want and len(got) == len(want)
    counts = orphan_counts(frame.filter("space IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL"), orphan_references(frame, spans, ["rec"]), "space", "at").collect()
    assert sum(r["n_orphans"] for r in counts) == len(want)


def test_orphans_of_nothing(spark):
    spans = lifespans(spark.createDataFrame([], "id int, a timestamp_ntz, b timestamp_ntz"), "P", F.col("id").cast("string"), "a", "b")
    refs = spark.createDataFrame([("x", "P", "1", stamp(0))], "rec string, space string, key string, at timestamp_ntz")
    assert orphan_references(refs, spans, ["rec"]).count() == 1
    assert orphan_references(refs.limit(0), spans, ["rec"]).count() == 0


def test_dictionary_is_dense(spark):
    keys = spark.range(5000).select(F.lit("s").alias("space"), F.col("id").cast("string").alias("key"))
    codes = sorted(r["code"] for r in dictionary(keys.union(keys), 37).collect())
    assert codes == list(range(5000))


def test_compressed_bitmaps_keep_their_bits():
    rng = np.random.default_rng(3)
    some = lambda n: np.unique(rng.integers(0, 1 << 15, n))
    for positions, form, most in ((some(0), b"p", 1), (some(5), b"p", 11), (some(30000), b"b", 4097), (np.arange(100, 32768), b"r", 5), (np.arange(32768), b"r", 5), (np.array([0, 32767]), b"p", 5)):
        packed = pack_bits(positions)
        assert packed[:1] == form and len(packed) <= most
        assert (np.flatnonzero(np.unpackbits(unpack_bits(packed), bitorder="little")) == positions).all()


def test_lists_merge_in_any_order():
    rng = random.Random(4)
    for _ in range(200):
        spans = [(a, a + rng.randint(0, 5)) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 20)))]
        tree, fold = Tree(), []
        for a, b in spans:
            tree.add([(a, b, 1)])
            fold = merged([(a, b, 1)], fold)
        assert tree.whole() == fold
        assert sum(n for *_, n in fold) == len(spans)
        assert {d for a, b in spans for d in range(a, b + 1)} == {d for a, b, _ in fold for d in range(a, b + 1)}
        assert all(x[1] + 1 < y[0] for x, y in zip(fold, fold[1:]))
