"""Registered queries: rule-based reading of texts and checking of generated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import rules
from tessella.plans.register import register
from tessella.sources.tables import table

QUERIES, query = register()
#: Table -> words that name it, in order of precedence.
TABLES = {"invoices": ["invoice", "bill", "charge"], "recharges": ["recharge", "top-up"], "subscriptions": ["plan", "subscription"], "tickets": ["ticket", "complaint"]}
STATUSES = {"invoices": ("payment_status", ["Paid", "Overdue", "Pending"]), "tickets": ("status", ["Open", "Closed"])}
INTENTS = {"billing": "invoice|refund|charge", "roaming": "roaming|abroad", "device": "esim|sim|handset", "porting": "port"}


def _questions(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tickets").filter("description IS NOT NULL").select("ticket_id", "description").distinct()


_TABLE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(description), '{w}')" for w in ws)} THEN '{t}'" for t, ws in TABLES.items()) + " END"
_VALUE_SQL = "CASE " + " ".join(f"WHEN tbl = '{t}' AND contains(lower(description), '{v.lower()}') THEN '{v}'" for t, (_, vs) in STATUSES.items() for v in vs) + " END"
_CUE_SQL = "regexp_matches(description, '(?i)(how many|count|number of|total)')"


_PARSED_SQL = f"WITH q AS (SELECT DISTINCT ticket_id, description FROM tickets WHERE description IS NOT NULL), t AS (SELECT *, {_TABLE_SQL} tbl FROM q), v AS (SELECT *, {_VALUE_SQL} value FROM t)"


@query(_PARSED_SQL + f"""
    SELECT ticket_id, tbl AS table_name, CASE WHEN tbl IS NULL THEN 'none' WHEN {_CUE_SQL} THEN 'aggregate_count' WHEN value IS NOT NULL THEN 'exact_filter' ELSE 'unresolved' END AS method, value AS filter_value FROM v""")
def rule_q05_parse(spark: SparkSession, base: str) -> DataFrame:
    """Table, method and filter read from each distinct ticket text."""
    read = rules.parse_question(_questions(spark, base), "description", TABLES, STATUSES, [])
    return read.select("ticket_id", F.col("table").alias("table_name"), "method", "filter_value")


@query("SELECT DISTINCT ticket_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(description, '(?i){p}') THEN '{k}' END" for k, p in INTENTS.items()) + "], lambda x: x IS NOT NULL), ',') intents FROM tickets WHERE description IS NOT NULL")
def rule_q10_intents(spark: SparkSession, base: str) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col("description").rlike(f"(?i){p}"), F.lit(k)) for k, p in INTENTS.items()]))
    return _questions(spark, base).select("ticket_id", F.array_join(found, ",").alias("intents")).distinct()


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, '(?i){p}') THEN '{k}'" for k, p in rules.CLAUSE_CUES.items()) + " ELSE 'OTHER' END"
_CLAUSES_SQL = f"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.?!;])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) parts FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, unnest(parts) sentence, generate_subscripts(parts, 1) - 1 sentence_no FROM s),
    c AS (SELECT doc_id, sentence_no, list_filter(list_transform(string_split(regexp_replace(sentence, '[ \\t\\r\\n][-–—][ \\t\\r\\n]', ',', 'g'), ','),
      lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '[.?!; \\t\\r\\n]+$', '')), lambda x: x <> '') cs FROM n),
    k AS (SELECT doc_id, sentence_no, cs, list_transform(cs, lambda c: {_KIND_SQL}) ks FROM c),
    e AS (SELECT doc_id, sentence_no, unnest(cs) clause, unnest(ks) kind, generate_subscripts(cs, 1) - 1 clause_no, list_position(ks, 'HYPOTHETICAL') first FROM k),
    clauses AS (SELECT doc_id, sentence_no, clause_no, clause, CASE WHEN first > 0 AND clause_no + 1 >= first THEN 'HYPOTHETICAL' ELSE kind END kind FROM e)"""


@query(_CLAUSES_SQL + " SELECT doc_id, sentence_no, clause_no, md5(clause) clause, kind FROM clauses")
def rule_q07_clauses(spark: SparkSession, base: str) -> DataFrame:
    """Every clause of every text with its kind."""
    rows = table(spark, base, "documents").select("doc_id", "text")
    return rules.clause_kinds(rows, "doc_id", "text").select("doc_id", "sentence_no", "clause_no", F.md5("clause").alias("clause"), "kind")


@query(_CLAUSES_SQL + " SELECT doc_id, count(*) n_clauses, bool_or(kind = 'HYPOTHETICAL') hypothetical, bool_or(kind IN ('HYPOTHETICAL', 'PERMISSION', 'PROCEDURE')) has_policy FROM clauses GROUP BY 1")
def rule_q07_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Clauses by kind and what they say of a document: hypothetical or asking for a procedure."""
    kinds = rules.clause_kinds(table(spark, base, "documents").select("doc_id", "text"), "doc_id", "text")
    return kinds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max(F.col("kind") == "HYPOTHETICAL").alias("hypothetical"), F.max(F.col("kind").isin("HYPOTHETICAL", "PERMISSION", "PROCEDURE")).alias("has_policy"))


@query("""WITH k AS (SELECT DISTINCT ticket_id, description FROM tickets WHERE description IS NOT NULL)
    SELECT ticket_id, CASE WHEN regexp_matches(description, '(?i)\\b(my|mine|i)\\b') THEN 0.0 WHEN regexp_matches(description, '(?i)\\b(related|same|between|via)\\b') THEN 0.5 ELSE 0.15 END::DOUBLE weight FROM k""")
def rule_q09_gate(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("description")
    weight = rules.gate_weight(t.rlike(r"(?i)\b(my|mine|i)\b"), t.rlike(r"(?i)\b(related|same|between|via)\b"))
    return _questions(spark, base).select("ticket_id", weight.alias("weight"))


@query("""SELECT DISTINCT ticket_id, CASE ticket_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'R1' WHEN 2 THEN 'R2:F9,R3:' || ticket_id WHEN 3 THEN 'R3:' || (ticket_id + 1) ELSE 'R4,R3:9876543210' END problems
    FROM tickets WHERE ticket_id IS NOT NULL""")
def rule_q17_groundedness(spark: SparkSession, base: str) -> DataFrame:
    """An answer per ticket, four of five damaged in a known way: the check must name each damage."""
    number = F.col("ticket_id").cast("string")
    kind = F.col("ticket_id") % 5
    body = lambda n, tail: F.concat(F.lit("Ticket "), n, F.lit(" is on file"), tail)
    cite = F.lit(" [F1].")
    answer = (
        F.when(kind == 0, body(number, cite)).when(kind == 1, body(number, F.lit("."))).when(kind == 2, body(number, F.lit(" [F9].")))
        .when(kind == 3, body((F.col("ticket_id") + 1).cast("string"), cite)).otherwise(body(F.lit("9876543210"), cite))
    )
    rows = table(spark, base, "tickets").filter("ticket_id IS NOT NULL").select("ticket_id").distinct()
    rows = rows.select("ticket_id", answer.alias("answer"), F.create_map(F.lit("F1"), F.concat(F.lit("ticket_id="), number)).alias("support"))
    return rules.groundedness(rows, "answer", "support").select("ticket_id", F.array_join("problems", ",").alias("problems"))


@query("""WITH f AS (SELECT customer_id, 'ticket' kind, CAST(ticket_id AS VARCHAR) record_id FROM tickets UNION SELECT customer_id, 'subscription', CAST(subscription_id AS VARCHAR) FROM subscriptions)
    SELECT customer_id, 'F' || row_number() OVER (PARTITION BY customer_id ORDER BY kind, record_id) fact, kind, record_id FROM f WHERE customer_id IS NOT NULL AND record_id IS NOT NULL""")
def rule_q14_facts(spark: SparkSession, base: str) -> DataFrame:
    """Numbered facts of every customer.

    Facts are numbered within slices of a customer, by kind and the first characters of the id, and
    moved on by the sizes of the slices before: no customer's facts are sorted in one task.
    """
    from pyspark.sql import Window

    rows = table(spark, base, "tickets").select("customer_id", F.lit("ticket").alias("kind"), F.col("ticket_id").cast("string").alias("record_id")).unionByName(table(spark, base, "subscriptions").select("customer_id", F.lit("subscription").alias("kind"), F.col("subscription_id").cast("string").alias("record_id")))
    facts = rows.filter("customer_id IS NOT NULL AND record_id IS NOT NULL").distinct().withColumn("_slice", F.substring("record_id", 1, 4))
    keys = ["customer_id", "kind", "_slice"]
    sizes = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("customer_id").orderBy("kind", "_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    numbered = facts.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("record_id")))
    return numbered.join(sizes.select(*keys, before.alias("_before")), keys).select("customer_id", F.concat(F.lit("F"), F.col("_before") + F.col("_at")).alias("fact"), "kind", "record_id")
