import os
import random

import pytest

from tessella.llm import packing, tokens

PATH = os.path.join(tokens.VOCABULARIES, tokens.BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
TEXTS = ["Hello world", "", None, "naïve 👩‍💻 test 日本語", "<|endoftext|> is text", " \n\t", "a" * 5000, "ना मस्ते"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id bigint, text string, ids string")


def test_ids_match_the_other_library(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["id"]: r["ids"] for r in tokens.encode(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == (other.encode_ordinary(t) if t else [])


def test_round_trip_and_split_characters(spark):
    back = {r["id"]: r["text"] for r in tokens.decode(tokens.encode(frame(spark, TEXTS))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    ids = tokens.encode_texts(["日本 👩‍💻"], PATH)[0]
    for k in range(len(ids) + 1):
        assert "".join(tokens.decode_pieces([ids[:k], ids[k:]], PATH)) == "日本 👩‍💻"


def test_offsets(spark):
    for r in tokens.encode_with_offsets(frame(spark, TEXTS)).collect():
        text = TEXTS[r["id"]] or ""
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        if r["ids"]:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
        assert all(a < b for a, b in zip(r["starts"], r["ends"]))
        assert all(s2 in (e1, e1 - 1) for e1, s2 in zip(r["ends"], r["starts"][1:]))


def test_empty_table(spark):
    assert tokens.encode(frame(spark, TEXTS).limit(0)).count() == 0


def naive_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        if i == len(room):
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return out


def test_first_fit_decreasing_against_scanning():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 100):
        sizes = sorted((rng.randint(0, 50) for _ in range(n)), reverse=True)
        assert packing.first_fit_decreasing(sizes, 50) == naive_first_fit(sizes, 50)


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 3, 10, 37, 64, 65, 200])) for i in range(500)] + [(500, None), (501, 1000)]
    items = spark.createDataFrame(rows, "id bigint, tokens int")
    capacities = spark.createDataFrame([(1, 64), (2, 512), (3, None), (1, 64)], "capacity_id int, capacity int")
    got = packing.pack(items, capacities, group_items=100).collect()
    room = {}
    for r in got:
        room.setdefault((r["capacity_id"], r["group"], r["bin"]), []).append(r["tokens"])
    size = {1: 64, 2: 512}
    assert all(sum(v) <= size[k[0]] for k, v in room.items())
    for c in (1, 2):
        mine = [r for r in got if r["capacity_id"] == c]
        for i, t in rows:
            parts = sorted((r["start"], r["tokens"]) for r in mine if r["id"] == i)
            assert sum(n for _, n in parts) == (t or 0) and len(parts) == max(1, -(-(t or 0) // size[c]))
            assert all(s == k * size[c] for k, (s, _) in enumerate(parts))
    used = [sum(v) for k, v in room.items() if k[0] == 1]
    assert sum(used) / (64 * len(used)) > 0.9
    assert packing.pack(items.limit(0), capacities).count() == 0
    assert packing.pack(items, capacities.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, capacities, largest_capacities=1)


def test_null_and_repeated_ids_spread_over_groups(spark):
    rows = [(None, 5)] * 400 + [(7, 5)] * 400 + [(7, None)] * 10
    items = spark.createDataFrame(rows, "id bigint, tokens int")
    got = packing.pack(items, spark.createDataFrame([(1, 64)], "capacity_id int, capacity int"), group_items=100).collect()
    assert len(got) == 810 and sum(r["tokens"] for r in got) == 4000
    sizes = {}
    for r in got:
        sizes[r["group"]] = sizes.get(r["group"], 0) + 1
    assert len(sizes) >= 8 and max(sizes.values()) < 250


def test_pieces_that_cut_characters(spark):
    encoded = tokens.encode(frame(spark, TEXTS))
    for n in (1, 2, 5):
        got = {r["id"]: r["pieces"] for r in tokens.decode_in_pieces(encoded, n).collect()}
        assert {i: "".join(p) for i, p in got.items()} == {i: t or "" for i, t in enumerate(TEXTS)}
    nulls = encoded.selectExpr("id", "CAST(NULL AS array<int>) AS ids")
    assert all(r["pieces"] is None for r in tokens.decode_in_pieces(nulls, 2).collect())
