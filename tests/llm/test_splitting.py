import random

import pytest

from tessella.llm.splitting import _cheapest, _cheapest_vectorised, cut, oversized, pieces


def check(text, limit, overlap):
    level, starts, ends = cut(text, limit, overlap)
    assert starts[0] == 0 and ends[-1] == len(text)
    assert all(0 < b - a <= limit for a, b in zip(starts, ends))
    assert all(x < y for x, y in zip(ends, ends[1:]))
    assert all(not text[e:s].strip() for e, s in zip(ends, starts[1:]))  # nothing but blanks is lost
    return level, starts, ends


def test_levels_and_cover():
    rng = random.Random(1)
    word = lambda: "x" * rng.randint(1, 9)
    line = lambda n: " ".join(word() for _ in range(n))
    paragraphs = "\n\n".join(line(30) for _ in range(40))
    lines = "\n".join(line(30) for _ in range(40))
    assert check(paragraphs, 1500, 200)[0] == "paragraph"
    assert check(lines, 1500, 200)[0] == "line"
    assert check(line(2000), 1500, 200)[0] == "word"
    assert check("y" * 5000, 1500, 200)[0] == "run"
    assert check("a b " * 300 + "z" * 4000 + "\n\nend", 1500, 200)[0] == "run"


def test_cuts_at_paragraph_ends_and_repeats():
    text = "\n\n".join("word " * 60 + "end" for _ in range(12))
    _, starts, ends = check(text, 1500, 200)
    assert all(text[e : e + 2] == "\n\n" for e in ends[:-1])
    assert all(100 <= e - s <= 200 for e, s in zip(ends, starts[1:]))


def test_vectorised_way_costs_the_same():
    rng = random.Random(2)
    for _ in range(20):
        ends = sorted(rng.sample(range(1, 9000), 300))
        starts = [0, *(max(e - 150, 0) for e in ends)]
        fees = [rng.choice([0.0, 0.25, 1.0]) for _ in ends]
        def cost(back):
            at, total = len(ends), 0.0
            while at:
                size = ends[at - 1] - starts[back[at]]
                total += 1 + fees[at - 1] + ((size - 900) / 1000) ** 2
                at = back[at]
            return total
        assert abs(cost(_cheapest(starts, ends, fees, 1000, 900)) - cost(_cheapest_vectorised(starts, ends, fees, 1000, 900))) < 1e-9


def test_frames(spark):
    long = "Первая строка. " * 200
    rows = [("a", None), ("b", ""), ("c", "  \r\n "), ("d", "x" * 1500), ("e", "\r\n" + long), ("e2", "😀" * 1600)]
    docs = spark.createDataFrame([(i, c, "clash") for i, c in rows], "id string, content string, text string")
    assert {r["id"] for r in oversized(docs).collect()} == {"e", "e2"}
    out = pieces(docs).collect()
    for key in ("e", "e2"):
        got = sorted((r for r in out if r["id"] == key), key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in got] == list(range(len(got)))
        assert all(len(r["text"]) == r["stop"] - r["start"] <= 1500 for r in got)
    assert oversized(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        oversized(docs, 300, 200)


@pytest.mark.parametrize("gap", [" " * 400, "\n" + " " * 400 + "\n", "\n\n", " ", "\n" * 900, "\t" * 3000])
@pytest.mark.parametrize("stretch", [2, 700, 1000, 1299, 1300, 1301, 1500, 1501])
def test_wide_gaps_and_stretches_near_the_limit(gap, stretch):
    for body in ("x" * stretch, ("word " * 400)[: stretch - 1] + "x"):
        check(gap.join([body] * 4), 1500, 200)
        check("start " * 100 + gap.join([body] * 80), 1500, 200)


def test_no_piece_over_the_limit_whatever_the_text():
    rng = random.Random(12)
    for _ in range(3000):
        limit = rng.choice([40, 100, 300])
        overlap = rng.randint(0, limit // 2 - 1)
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append("".join(rng.choice("ab  \n\t") if rng.random() < 0.2 else "x" for _ in range(rng.randint(1, 2 * limit))))
            parts.append(rng.choice([" ", "\n", "\n\n", " " * rng.randint(0, 3 * limit), "\n" * rng.randint(0, limit), "\n \t\n"]))
        text = "".join(parts).strip(" \t\r\n")
        if len(text) > limit:
            _, starts, ends = check(text, limit, overlap)
            for end, start in zip(ends, starts[1:]):
                assert end - start <= overlap
