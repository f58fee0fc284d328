import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import neighbours
from tessella.llm.neighbours import Curves, hilbert_keys, similar_vectors
from tessella.session import shared_folder

SMALL = Curves(orderings=4, axes=4, bits=5, window=64)


def test_hilbert_keys_visit_every_cell_in_steps_of_one():
    for bits, axes in ((3, 2), (2, 3), (2, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def frame(spark, vectors, extra=""):
    return spark.createDataFrame([(f"v{i:04d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, embedding array<float>").withColumn("rank", F.lit(extra))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 20, axis=0) + 0.3 * rng.normal(size=(1200, 16))
    got = similar_vectors(frame(spark, x), 10, 16, Curves(orderings=6, axes=4, bits=6, window=128)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-sims[i])[:10]}
    found = {(r["id"], r["neighbour"]) for r in got}
    assert len(found) == len(got) == 12000
    assert len(found & want) >= 0.9 * len(want)
    for r in got[:200]:
        assert abs(r["similarity"] - sims[int(r["id"][1:]), int(r["neighbour"][1:])]) < 1e-4


def test_copies_and_unusable_vectors(spark):
    x = [[1, 0, 0]] * 40 + [[0, 1, 0], None, [0, 0, 0], [float("nan"), 1, 0], [1, 2]]
    got = similar_vectors(frame(spark, x), 3, 3, SMALL).collect()
    assert {r["id"] for r in got} == {f"v{i:04d}" for i in range(41)}
    assert all(r["id"] != r["neighbour"] for r in got)
    assert all(r["similarity"] > 0.999 for r in got if r["id"] != "v0040")


def test_few_and_no_vectors(spark):
    assert similar_vectors(frame(spark, [[1, 0], [0.9, 0.1]]), 10, 2, SMALL).count() == 2
    assert similar_vectors(frame(spark, [[1, 0]]), 10, 2, SMALL).count() == 0
    assert similar_vectors(frame(spark, []), 10, 2, SMALL).count() == 0


def test_windows_meet_across_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    curves = Curves(orderings=2, axes=4, bits=5, window=8)  # groups of 256 rows
    def result():
        return sorted((r["id"], r["rank"], r["neighbour"]) for r in similar_vectors(frame(spark, x).repartition(3), 5, 8, curves).collect())
    want = result()
    assert len(want) == 900 * 5
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.sparkContext), "defaultParallelism", 40)
        assert result() == want


def test_one_window_holds_all_where_it_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(60) for j in np.argsort(-sims[i])[:5]}
    got = {(r["id"], r["neighbour"]) for r in similar_vectors(frame(spark, x), 5, 8, Curves(orderings=1, axes=4, bits=5, window=64)).collect()}
    assert len(got & want) >= 298  # all but near ties in 16 bits


def test_single_orderings_and_slices_find_all_and_leave_no_files(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(40, 16)), 20, axis=0) + 0.3 * rng.normal(size=(800, 16))
    monkeypatch.setattr(neighbours, "_TOGETHER", 1)  # an ordering at a time
    monkeypatch.setattr(neighbours, "_SLICED", 160)  # five slices a round, merged after four
    local = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p for d in local for p in d.rglob("shuffle_*.data")}
    rows, before = frame(spark, x), shuffled()
    result = similar_vectors(rows, 10, 16, Curves(orderings=6, axes=4, bits=6, window=64))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert not list(Path(shared_folder(spark).removeprefix("file://")).glob("tessella-scratch-*/neighbours-*"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-sims[i])[:10]}
    got = {(r["id"], r["neighbour"]) for r in result.collect()}
    assert len(got) == 8000
    assert len(got & want) >= 0.95 * len(want)
