import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import boilerplate as B


def naive_blocks(docs, least):
    seen = defaultdict(set)
    for d, ids in enumerate(docs):
        for i in range(len(ids)):
            for j in range(i + 1, len(ids) + 1):
                seen[tuple(ids[i:j])].add(d)
    return {b for b, ds in seen.items() if len(ds) >= least}


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for _ in range(30):
        docs = [[rng.randint(1, 4) for _ in range(rng.randint(0, 12))] for _ in range(6)]
        ids = np.array([x for d in docs for x in d], np.int64)
        left = np.array([len(d) - i for d in docs for i in range(len(d))], np.int64)
        order, common = B.suffix_array(ids, left)
        suffixes = [tuple(ids[i : i + left[i]]) for i in range(len(ids))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        for k in range(1, len(order)):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert common[k] == n


def test_blocks_against_enumeration():
    rng = random.Random(5)
    for least in (2, 3):
        docs = [[rng.randint(1, 3) for _ in range(rng.randint(0, 9))] for _ in range(7)]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        left = np.array([len(d) - i for d in docs for i in range(len(d))], np.int64)
        got = {tuple(ids[i : i + n]): v for (i, n), v in B.repeated_blocks(ids, doc, left, least).items()}
        want = naive_blocks(docs, least)
        assert set(got) <= want
        assert {b[:1] for b in want} <= {b for b in got if len(b) == 1}
        for b in want:  # each frequent block lies within a found one that as many documents hold
            assert any(g[: len(b)] == b for g in got)


def documents(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, content string").select("id", "source", "content", B.identified_lines(F.col("content")).alias("lines"))


def test_lines_against_counting(spark):
    rng = random.Random(6)
    common = ["Share this page!", "Call 100 now", "© Orvanta", "  share THIS   page! "]
    rows = []
    for i in range(300):
        body = [f"text {rng.random()} of {i}" if rng.random() < 0.7 else rng.choice(common) for _ in range(rng.randint(0, 8))]
        rows.append((f"d{i}", rng.choice("AAAB"), rng.choice(["\n", "\r\n", "\r"]).join(body)))
    rows += [("n", "A", None), ("e", "A", ""), ("x", None, "Share this page!"), ("p", "A", "12345\n---\n")]
    docs = documents(spark, rows)
    import re
    key = lambda line: re.sub("[0-9]+", "0", re.sub("[ \t\r\n]+", " ", line).strip().lower())
    spread, totals, at = defaultdict(set), defaultdict(int), []
    for i, s, c in rows:
        if s is None:
            continue
        totals[s] += 1
        for n, line in enumerate(re.split("\r\n|\r|\n", c or ""), 1):
            if re.search(r"[^\W\d_]", line):
                spread[s, key(line)].add(i)
                at.append((i, n, s, key(line)))
    want = {(i, n) for i, n, s, k in at if len(spread[s, k]) >= max(4, 0.1 * totals[s])}
    for lines in (200_000, 150):  # one shard a source; many
        got = {(r["id"], r["line_no"]) for r in B.repeated_lines(docs, 0.1, 4, lines).collect()}
        assert got == want


def test_cleaning_and_empty(spark):
    rows = [(f"d{i}", "S", f"Intro {chr(97 + i)}{chr(98 + i)} word\nFooter line\r\nlast {chr(97 + i)} one") for i in range(5)] + [("n", "S", None)]
    docs = documents(spark, rows)
    gone = B.repeated_lines(docs)
    assert {r["line_no"] for r in gone.collect()} == {2}
    clean = {r["id"]: r["content"] for r in B.without_lines(docs.select("id", "content"), gone).collect()}
    assert clean["d0"] == "Intro ab word\nlast a one" and clean["n"] is None
    assert B.repeated_lines(docs.limit(0)).count() == 0


def test_sources_without_repeats(spark):
    docs = documents(spark, [("a", "S", "one"), ("b", "S", "two"), ("c", "T", None), ("d", "U", "x\ny"), ("e", "U", "x\nz")])
    assert B.repeated_lines(docs).count() == 0
    assert B.frequent_blocks(B.shards(docs), 0.1, 4).count() == 0
    assert {(r["id"], r["line_no"]) for r in B.repeated_lines(docs, 0.1, 2).collect()} == {("d", 1), ("e", 1)}


def brute_blocks(docs, least):
    """{block: documents} of single lines and of blocks that no line could lengthen on either side."""
    at = defaultdict(list)
    for d, ids in enumerate(docs):
        for i in range(len(ids)):
            for j in range(i + 1, len(ids) + 1):
                at[tuple(ids[i:j])].append((d, ids[i - 1] if i else None, ids[j] if j < len(ids) else None))
    out = {}
    for block, places in at.items():
        open_ = all(None in side or len(set(side)) > 1 for side in ([p[1] for p in places], [p[2] for p in places]))
        if (len(block) == 1 or open_) and len({p[0] for p in places}) >= least:
            out[block] = len({p[0] for p in places})
    return out


def test_maximal_blocks_and_their_documents_against_enumeration():
    rng = random.Random(8)
    for trial in range(120):
        docs = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 10))] for _ in range(rng.randint(1, 7))]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        left = np.array([len(d) - i for d in docs for i in range(len(d))], np.int64)
        for least in (2, 3):
            got = {tuple(ids[i : i + n].tolist()): v for (i, n), v in B.repeated_blocks(ids, doc, left, least).items()}
            assert got == brute_blocks(docs, least), docs
        hashes = B.BlockHashes(ids)
        by = defaultdict(set)
        for i in range(len(ids)):
            for n in range(1, left[i] + 1):
                by[int(hashes.at(np.array([i]), n)[0]), n].add(tuple(ids[i : i + n].tolist()))
        assert all(len(v) == 1 for v in by.values())


def test_growing_documents_and_one_line_over_and_over():
    """Versions of one growing document give few candidates; a line repeated within a document counts once."""
    ids = np.concatenate([np.arange(1, 50 * v) for v in range(1, 41)]).astype(np.int64)
    sizes = [50 * v - 1 for v in range(1, 41)]
    doc = np.repeat(np.arange(40), sizes)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
    found = B.repeated_blocks(ids, doc, left, 4)
    assert sum(n > 1 for _, n in found) <= 40
    same = np.ones(60000, np.int64)
    found = B.repeated_blocks(same, np.repeat(np.arange(3), 20000), np.tile(np.arange(20000, 0, -1), 3), 3)
    assert len(found) == 20000 and set(found.values()) == {3}
