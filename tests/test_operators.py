"""Golden cases and edge cases of the operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.typing import loosely_equal, normalise
from tessella.operators import graph, metrics, ranking, rules
from tessella.operators import relational as R
from tessella.operators import retrieval as V
from tessella.operators.chunking import word_chunks
from tessella.operators.validation import chunk_violations, vector_violations


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def ranking_of(spark, **lists):
    rows = [("q", name, d, i, w) for name, (docs, w) in lists.items() for i, d in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "query_id string, list_name string, document_id string, rank int, weight double")


@pytest.mark.parametrize("weight,order", [(0.5, "ACBD"), (0.0, "ABC")])
def test_fusion_golden(spark, weight, order):
    got = V.reciprocal_rank_fusion(ranking_of(spark, vector=("ABC", 1.0), graph=("CDA", weight))).orderBy("rank").collect()
    assert "".join(r["document_id"] for r in got) == order
    if weight:
        score = {r["document_id"]: r["score"] for r in got}
        assert math.isclose(score["A"], 1 / 61 + 0.5 / 63, abs_tol=1e-8) and math.isclose(score["D"], 0.5 / 62, abs_tol=1e-8)


def test_fusion_counts_a_document_once_per_list(spark):
    got = V.reciprocal_rank_fusion(ranking_of(spark, vector=(["X", "Y", "X"], 1.0), graph=(["Z", "X"], 0.5))).collect()
    assert {r["document_id"]: r["score"] for r in got}["X"] == round(1 / 61 + 0.5 / 62, 8)


@pytest.mark.parametrize("mode,weight,top", [("override", 1.0, "FED"), ("rrf_blend", 1.0, "FAE"), ("rrf_blend", 0.5, "A"), ("protect_graph", 1.0, "FD")])
def test_rerank_golden(spark, mode, weight, top):
    rows = [("q", d, i, ["graph"] if d == "D" else ["vector"], float(i)) for i, d in enumerate("ABCDEF", 1)]
    pool = spark.createDataFrame(rows, "query_id string, document_id string, rank int, sources array<string>, stub double")
    got = V.controlled_rerank(pool, "stub", mode, top_k=len(top), weight=weight).orderBy("final_rank").collect()
    assert "".join(r["document_id"] for r in got) == top
    failed = V.controlled_rerank(pool.withColumn("stub", F.when(F.col("rank") > 2, F.col("stub"))), "stub", mode, top_k=3).orderBy("final_rank").collect()
    assert [r["document_id"] for r in failed] == ["A", "B", "C"] and {r["rerank_status"] for r in failed} == {"fallback"}


def test_expansion_against_a_loop(spark):
    rng = random.Random(3)
    mentions = {(f"d{rng.randint(0, 30)}", rng.choice("LM"), rng.randint(0, 5)) for _ in range(150)}
    seeds = [("q", f"d{i}", i) for i in range(1, 6)]
    want = {}
    for _, s, r in seeds:
        for d, l, c in mentions:
            if d != s and (s, l, c) in mentions:
                total, shared = want.setdefault(d, [0.0, set()])
                want[d][0] += 1 / (1 + r)
                shared.add((l, c))
    got = V.shared_hub_expansion(spark.createDataFrame(seeds, "query_id string, document_id string, rank int"), spark.createDataFrame(list(mentions), "document_id string, label string, concept int"), 100).collect()
    assert {r["document_id"]: (round(r["score"], 5), r["n_shared"]) for r in got} == {d: (round(t, 5), len(s)) for d, (t, s) in want.items()}


def test_nearest_in_blocks(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(900, None)]
    v = spark.createDataFrame(vectors, "id bigint, embedding array<double>")
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    for block in (16, 4096):
        got = V.nearest(q, v, 4, block).collect()
        for r in got:
            mine = dict(vectors)[r["query_id"]]
            order = sorted((-sum(a * b for a, b in zip(mine, e)), i) for i, e in vectors if e)
            assert order[r["rank"] - 1][1] == r["id"]
        assert len(got) == 24
    assert V.nearest(q.limit(0), v, 4).count() == 0
    named = v.filter("id < 5").select(F.concat(F.lit("v"), F.col("id")).alias("id"), "embedding")
    asked = named.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    assert V.nearest(asked, named, 2, 1).count() == 10  # more blocks than rows hit: some are empty


def test_chunk_golden(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (1, 250, 251, 460, 461)] + [(0, " \n "), (-1, None)], "id int, text string").withColumn("chunk_id", F.lit("clash"))
    rows = word_chunks(docs.drop("chunk_id"), "id", "text").collect()
    count = {n: sorted((r["chunk_index"], r["n_words"]) for r in rows if r["id"] == n) for n in (-1, 0, 1, 250, 251, 460, 461)}
    assert count[-1] == count[0] == [] and count[250] == [(0, 250)]
    assert count[251] == [(0, 250), (1, 41)] and len(count[460]) == 2 and len(count[461]) == 3


@pytest.mark.parametrize("term,yes,no", [
    ("plan", ["plans", "Plan!", "planed"], ["planet", "explan"]), ("recharge", ["recharging", "RECHARGED"], ["precharge"]), ("expiry", ["expiries", "expiry"], ["expiring"]),
    ("top-up", ["topup", "top up", "top-ups"], ["stop-up"]), ("data usage", ["data-usage", "data  usages"], ["datausage"]), ("expir*", ["expiration"], ["inexpirable"]), ("bill", ["bills"], ["billion"]),
])
def test_terms(spark, term, yes, no):
    for word in yes + no:
        assert one(spark, X.any_term(F.col("t"), [term]), t=f"the {word} is") == (word in yes), word
    assert one(spark, X.any_term(F.lit(None).cast("string"), [term])) is False


def test_text_functions(spark):
    assert one(spark, X.clean(F.col("t")), t="  a \r\n\r\n\r\n• b\t\r c ") == "a\n\n- b\nc"
    assert one(spark, X.nfkc("t"), t="ﬁ５") == "fi5"
    assert one(spark, X.numeric_tokens(F.col("t")), t="On 2024-01-05 at 10:30 paid 1,250.50 and 007, 3.10") == ["1250.5", "3.1", "7", "date:2024-01-05", "time:10:30"]
    assert one(spark, X.identifier(F.col("t"), "DOC_"), t="a b--c.d ") == "DOC_A_B_C_D"
    assert one(spark, X.document_key(F.col("t")), t="KB_1_chunk_012") == "KB_1"
    assert one(spark, X.cut_at_word(F.col("t"), 7), t="one two three") == "one two"
    assert one(spark, X.mask_number(F.col("t")), t="5500123456") == "****3456"
    assert one(spark, X.without_script_lines(F.col("t")), t="abc\nकखग\n\nabc क") == "abc\n\nabc क"
    assert one(spark, X.overlap_share(X.terms(F.col("a")), X.terms(F.col("b"))), a="one two", b="TWO three") == 0.5
    assert one(spark, loosely_equal(F.col("a"), F.col("b")), a="1.0", b="1") is True


def test_typing(spark):
    raw = spark.createDataFrame([("7", "x", "YES", "2024-01-05", ""), ("q", "y", "maybe", "05/01/2024", "2024-01-05 10:00:00"), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    rows = normalise(raw, {"a": "i", "b": "t", "c": "b", "d": "d", "e": "dt"}).collect()
    assert [r["a"] for r in rows] == [7, None, None] and [r["_bad_a"] for r in rows] == [None, "q", None]
    assert [r["c"] for r in rows] == [True, False, None] and rows[0]["d"] == dt.date(2024, 1, 5) and rows[1]["_bad_d"] == "05/01/2024"
    assert rows[1]["e"] == dt.datetime(2024, 1, 5, 10) and rows[0]["_bad_e"] is None


def test_asof_against_a_loop(spark):
    rng = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 400))
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, at(), at(), at()])) for i in range(200)]
    right = [(rng.choice(["a", "a", "b", "c", None]), at(), rng.choice([None, rng.randint(0, 99)])) for _ in range(150)]
    got = {r["id"]: r["v"] for r in R.asof_join(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, s timestamp_ntz, v int"), "k", "t", "s", "v").collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        past = [(s, v) for rk, s, v in right if rk == k and k is not None and t is not None and v is not None and s <= t]
        assert got[i] == (max(past)[1] if past else None)
    clash = R.asof_join(spark.createDataFrame(left, "id int, k string, v timestamp_ntz"), spark.createDataFrame(right, "k string, s timestamp_ntz, v int"), "k", "v", "s", "v")
    assert clash.columns == ["id", "k", "v", "asof_v"]


def test_range_join(spark):
    points, ranges = spark.createDataFrame([(float(i), "p") for i in range(50)], "x double, name string"), spark.createDataFrame([(3.0, 7.5, "a"), (0.0, 50.0, "b"), (9.0, 2.0, "c")], "lo double, hi double, name string")
    got = R.range_join(points, ranges, "x", "lo", "hi", 4.0).groupBy("range_name").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 5, "b": 50}


def test_upsert_and_difference(spark):
    old, new = spark.createDataFrame([(1, 1, "o"), (2, 5, "o"), (None, 1, "o")], "k int, v int, s string"), spark.createDataFrame([(1, 1, "n"), (2, 4, "n"), (3, 1, "n")], "k int, v int, s string")
    assert {r["k"]: r["s"] for r in R.upsert(old, new, "k", "v").collect()} == {1: "n", 2: "o", 3: "n"}
    assert {r["k"] for r in R.key_difference(new, old, "k").collect()} == {3}


def test_components_and_hops(spark):
    rng = random.Random(6)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{rng.randint(0, 30)}", f"m{rng.randint(0, 30)}") for _ in range(25)] + [("s", f"t{i}") for i in range(50)]
    names = {x for e in edges for x in e} | {"alone"}
    parent = {n: n for n in names}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes, frame = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(a, b, "t") for a, b in edges], "src string, dst string, type string")
    assert {r["id"]: r["component"] for r in graph.components(nodes, frame).collect()} == {n: find(n) for n in names}
    assert graph.components(nodes.limit(0), frame.limit(0)).count() == 0
    far = {r["id"]: r["hops"] for r in graph.hops(frame, spark.createDataFrame([("n3",)], "id string"), 5).collect()}
    assert far == {f"n{i}": abs(i - 3) for i in range(9)}


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "query_id string, document_id string, rank int")
    relevant = spark.createDataFrame([("a", "y"), ("a", "w"), ("b", "q"), ("c", "x")], "query_id string, document_id string")
    rows = {r["query_id"]: r for r in metrics.query_scores(metrics.judged(ranked, relevant), (1, 3)).collect()}
    assert rows["a"]["hit_1"] == 0 and rows["a"]["hit_3"] == 1 and rows["a"]["recall_3"] == 0.5 and rows["a"]["reciprocal_rank"] == 0.5
    assert rows["a"]["precision_3"] == pytest.approx(1 / 3) and rows["a"]["precision_found_3"] == 0.5
    assert rows["c"]["hit_3"] == 0 and rows["c"]["precision_found_1"] == 0
    assert metrics.mean_scores(metrics.query_scores(metrics.judged(ranked, relevant.limit(0)), (1,))).first()["n_queries"] == 0


def test_min_max_and_sample(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 5.0), (None, 6.0)], "p string, s double")
    got = sorted((r["p"] or "", r["s"], r["n"]) for r in ranking.min_max(rows, "p", "s", 0.5, "n").collect())
    assert got == [("", 5.0, 0.0), ("", 6.0, 1.0), ("a", 1.0, 0.0), ("a", 3.0, 1.0), ("b", 2.0, 0.5)]
    many = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "mid").otherwise(None).alias("s"))
    for bucket in (None, F.floor(F.col("id") / 64)):
        picked = ranking.stratified_sample(many, "s", "id", 20, bucket).collect()
        assert len(picked) == 20 and {r["s"] for r in picked} == {"big", "mid", None}
    assert ranking.stratified_sample(many.limit(0), "s", "id", 5).count() == 0


def test_rules(spark):
    tables, statuses = {"invoices": ["invoice"], "kyc": ["kyc"], "recharges": ["recharge"]}, {"invoices": ("payment_status", ["Overdue"]), "kyc": ("status", ["Pending"]), "recharges": ("status", ["PENDING"])}
    asked = ["List all overdue invoices", "pending kyc records", "any pending recharge", "how many invoices", "hello", "invoice of customer 12345", "invoices"]
    rows = rules.parse_question(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string"), "t", tables, statuses, ["invoices"]).orderBy("i").collect()
    assert [(r["table"], r["method"], r["filter_value"]) for r in rows] == [
        ("invoices", "exact_filter", "Overdue"), ("kyc", "exact_filter", "Pending"), ("recharges", "exact_filter", "PENDING"), ("invoices", "aggregate_count", None),
        (None, "none", None), ("invoices", "exact_filter", "12345"), ("invoices", "unresolved", None)]
    clauses = rules.clause_kinds(spark.createDataFrame([(1, "If it fails, what then? Please wait, can I go."), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("sentence_no", "clause_no").collect()
    assert [(r["clause"], r["kind"]) for r in clauses] == [("If it fails", "HYPOTHETICAL"), ("what then", "HYPOTHETICAL"), ("Please wait", "PROCEDURE"), ("can I go", "PERMISSION")]


def test_groundedness_mutants(spark):
    answers = {"Paid 250 on 2024-01-05 [F1].": [], "Paid 250.": ["R1"], "Paid 250 [F9].": ["R2:F9", "R3:250"], "Paid 99 [F1].": ["R3:99"], "Call 9876543210 [F1].": ["R4", "R3:9876543210"], "Nothing here.": [], None: []}
    rows = spark.createDataFrame([(a, {"F1": "amount=250.00, date=2024-01-05"}) for a in answers], "a string, s map<string,string>")
    assert {r["a"]: r["problems"] for r in rules.groundedness(rows, "a", "s").collect()} == answers


def test_validators(spark):
    chunks = spark.createDataFrame([("d_0", "d", 0, "x"), ("d_0", "d", 2, " "), (None, None, -1, None)], "chunk_id string, document_id string, chunk_index int, text string")
    assert {r["rule"]: r["n_rows"] for r in chunk_violations(chunks, ["chunk_id"]).collect()} == {"missing_chunk_id": 1, "empty_text": 2, "negative_index": 1, "repeated_id": 1, "broken_sequence": 1}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0])], "i int, e array<double>")
    assert {r["rule"]: r["n_rows"] for r in vector_violations(vectors, "i", "e", 2).collect()}["not_unit"] >= 1


def test_candidates_need_a_score(spark):
    rows = spark.createDataFrame([(1, None, 0.5, "c", "t")], "id int, hybrid double, score double, category string, text string")
    assert R.candidate_result(rows, "d", "m", ["hybrid", "score"], ["id"]).first()["score"] == 0.5
    with pytest.raises(Exception, match="candidate lacks"):
        R.candidate_result(rows.withColumn("score", F.lit(None).cast("double")), "d", "m", ["hybrid", "score"], ["id"]).collect()


def test_fk_report(spark):
    child, parent = spark.createDataFrame([("1",), ("2",), ("",), (None,), ("9",)], "p string"), spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert tuple(R.foreign_key_report(child, "p", parent, "k", "c.p").first()) == ("c.p", 5, 2, 2, 1, 0.666667)
    assert R.foreign_key_report(child.limit(0), "p", parent, "k", "c.p").first()["rate"] == 1.0


def test_quotable_against_a_plain_version(spark):
    """The chain of column expressions against the same rules written with Python's patterns."""
    import re

    def plain(text, index):
        out = re.sub("|".join(X.HEADER_FIELDS), " ", text or "", flags=re.S)
        out = re.sub(r"^\s*Question\s*:.*?\?\s*Answer\s*:\s*", "", out, flags=re.S | re.I)
        out = re.sub(r"^\s*(?:Question|Answer)\s*:\s*", "", out, flags=re.I)
        out = re.sub(rf"#{{2,}}\s*(?:{X.SECTIONS})\b", " ", out, flags=re.I)
        out = re.sub(r"\|(?:(?:(?!###)[^|]){0,160}\|)+", " ", re.sub("#+", " ", out.replace("**", " ")))
        out = re.sub(r"\s+", " ", re.sub(r"-{3,}", " ", out.replace("|", " "))).strip()
        if index and out[:1].islower() and (m := re.search(r"[.!?]\s+(?=[A-Z0-9\"'(\[])", out)):
            out = out[m.end() :]
        return out

    cases = [
        ("Question: How do I pay? Answer: ### Short Answer Visit the desk. ### Key Details | Detail | Value | |---|---| | Fee | 3 |", 0, "Visit the desk."),
        ("Renewal Document ID: SOP_C17_KYC Category: C17 - KYC and identity Department: Care Team Customer Scope: All Version: 1.2 Last Updated: 2026-08-08 Source Authority: Internal Knowledge Base Channel: App **Purpose** Read this.", 0, None),
        ("rest of a sentence. Then a whole one. And more", 2, "Then a whole one. And more"),
        ("rest without an end", 1, "rest without an end"), ("Answer: yes", None, "yes"), (None, 0, ""), ("", 3, ""), ("---- | --- |", 0, ""), ("Department: " + "x" * 60 + " Version: 2", 0, None),
    ]
    frame = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], "i int, t string, k int")
    got = {r["i"]: r["q"] for r in frame.select("i", X.quotable(F.col("t"), F.col("k")).alias("q")).collect()}
    for i, (text, index, want) in enumerate(cases):
        assert got[i] == plain(text, index), text
        assert want is None or got[i] == want


def test_flattened_json(spark):
    cases = {'{"a": 1, "b": {"c": [1, {"d": null}], "e": true}}': "a=1 b=c=1 d= e=True", "[]": "", "no json": "no json", "": "", '"x"': "x"}
    frame = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r["t"]: r["f"] for r in frame.select("t", X.flattened("t").alias("f")).collect()} == cases | {None: None}


def test_expansion_in_blocks_against_a_loop(spark):
    """Blocks of any size give the rows of a plain loop; nulls and empty sides take no part."""
    rng = random.Random(5)
    seeds = [(f"q{q}", rng.choice([f"d{rng.randint(0, 40)}", None]), r) for q in range(12) for r in range(1, 5)]
    seeds = list({(q, d): (q, d, r) for q, d, r in seeds}.values())
    mentions = [(rng.choice([f"d{rng.randint(0, 40)}", None]), rng.choice(["A", "B", None]), rng.choice([1, 1, 1, 2, 3, None])) for _ in range(200)]
    held = {}
    for d, a, c in mentions:
        if None not in (d, a, c):
            held.setdefault(d, set()).add((a, c))
    want = set()
    for q in {s[0] for s in seeds}:
        scores = {}
        for _, d, r in (s for s in seeds if s[0] == q and s[1] in held):
            for other, hubs in held.items():
                for hub in (hubs & held[d]) if other != d else ():
                    scores.setdefault(other, {}).setdefault(hub, []).append(1 / (1 + r))
        rows = sorted(((-round(sum(map(sum, h.values())), 6), -len(h), d) for d, h in scores.items()))[:7]
        want |= {(q, d, -s, -n, i) for i, (s, n, d) in enumerate(rows, 1)}
    s = spark.createDataFrame(seeds, "query_id string, document_id string, rank int")
    m = spark.createDataFrame(mentions, "document_id string, label string, concept int")
    for block in (2048, 8):
        got = {(r["query_id"], r["document_id"], r["score"], r["n_shared"], r["rank"]) for r in V.shared_hub_expansion(s, m, 7, block=block).collect()}
        assert {(q, d, round(x, 6), n, i) for q, d, x, n, i in got} == {(q, d, round(x, 6), n, i) for q, d, x, n, i in want}
    assert V.shared_hub_expansion(s.limit(0), m, 7).count() == V.shared_hub_expansion(s, m.limit(0), 7).count() == 0
