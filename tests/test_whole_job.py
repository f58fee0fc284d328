"""Registered queries do the whole job: no customer, hop or mention is left out."""

from tessella.operators import rules
from tessella.plans import further, graphs, reading

TICKETS, SUBSCRIPTIONS = "customer_id bigint, ticket_id bigint, category string", "customer_id bigint, subscription_id bigint"


def given(monkeypatch, module, **frames):
    monkeypatch.setattr(module, "table", lambda spark, base, name: frames[name])


def test_tickets_of_every_customer(spark, monkeypatch):
    rows = [(100, 1, "a"), (7, 2, "a"), (7, 2, "a"), (7, 3, None), (None, 4, "a"), (7, None, "a")]
    given(monkeypatch, further, tickets=spark.createDataFrame(rows, TICKETS))
    got = {tuple(r) for r in further.graph_g14_tickets_of(spark, "").collect()}
    assert got == {(100, 1, "a"), (7, 2, "a"), (7, 3, None)}


def test_facts_of_every_customer_are_numbered_across_slices(spark, monkeypatch):
    tickets = [(c, t, None) for c in (7, 100) for t in [*range(1, 40), *range(99990, 100030), *range(123456, 123470)]] * 2
    given(monkeypatch, reading, tickets=spark.createDataFrame([*tickets, (None, 1, None), (7, None, None)], TICKETS), subscriptions=spark.createDataFrame([(7, 12345), (7, 12), (8, 1)], SUBSCRIPTIONS))
    want = set()
    for c in (7, 8, 100):
        facts = {("ticket", str(t)) for k, t, _ in tickets if k == c} | {("subscription", str(i)) for k, i in ((7, 12345), (7, 12), (8, 1)) if k == c}
        want |= {(c, f"F{n}", *f) for n, f in enumerate(sorted(facts), 1)}
    got = [tuple(r) for r in reading.rule_q14_facts(spark, "").collect()]
    assert len(got) == len(want) and set(got) == want


def test_hops_reach_eight(spark, monkeypatch):
    nodes = spark.createDataFrame([("Plan::0", "Plan"), *[(f"Ticket::{i}", "Ticket") for i in range(1, 11)]], "id string, label string")
    chain = ["Plan::0", *[f"Ticket::{i}" for i in range(1, 11)]]
    edges = spark.createDataFrame([(b, a, "T") for a, b in zip(chain, chain[1:])], "src string, dst string, type string")
    monkeypatch.setattr(graphs, "_nodes", lambda *_: nodes)
    monkeypatch.setattr(graphs, "_edges", lambda *_: edges)
    assert {tuple(r) for r in graphs.graph_g07_hops(spark, "").collect()} == {(h, 1) for h in range(9)}


def test_every_mention_is_tested(spark, monkeypatch):
    far = "x " * 40
    texts = {
        "No refund. " + far + "A refund is due.": False,
        "A refund is due. " + far + "No refund.": False,
        "No refund. " + far + "Never a refund.": True,
        "## Refund\n" + far + "no refund": True,
        "## Refund": False,
        "not " + "refund" * 9: True,
        "not " + "refund" * 12: False,
    }
    given(monkeypatch, further, documents=spark.createDataFrame([*texts.items(), ("none", True)], "text string, want boolean").selectExpr("text AS doc_id", "text"))
    assert {r["doc_id"]: r["negated"] for r in further.fn_f26_negated(spark, "").collect()} == texts


def test_absence_status_and_outcome(spark):
    rows = [
        ("It is Open.", None, [], {}, ["R1"]),
        ("It costs €.", None, [], {}, ["R1"]),
        ("Reopened or openly.", None, [], {}, []),
        ("The passages do not state refunds.", None, ["A refund is due."], {}, ["R6:mentioned:refunds"]),
        ("The passages do not state refunds.", None, ["A fee is due."], {}, []),
        ("I could not find it.", None, ["x"], {}, ["R6:passages"]),
        ("We found no tickets.", None, [], {"tickets": 0}, []),
        ("We found no tickets.", None, [], {"tickets": 2}, ["R6:found:tickets"]),
        ("We found no tickets.", None, [], {"kyc": 0}, ["R6:not looked up:tickets"]),
        ("We found no tickets.", None, [], None, ["R6:not identified"]),
        ("There are none.", None, [], {"kyc": 1}, ["R6:no empty lookup"]),
        ("See [F1].", "needs_identity", [], {}, ["R5:fact"]),
        ("See [D1].", "refuse_other_customer", [], {}, ["R5:cites", "R2:D1"]),
    ]
    frame = spark.createDataFrame([(str(i), *r[:4], {"F1": "x"}, ["Open"]) for i, r in enumerate(rows)], "id string, a string, o string, p array<string>, n map<string,int>, s map<string,string>, st array<string>")
    got = {r["id"]: r["problems"] for r in rules.groundedness(frame, "a", "s", "st", "o", "p", "n").collect()}
    assert got == {str(i): r[4] for i, r in enumerate(rows)}
