"""Queries of the telecom knowledge base that need no text model: orphan references and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.intervals import continuous_periods, day_text
from tessella.operators.orphan_refs import lifespans, orphan_counts, orphan_references
from tessella.sources.tables import BLANKS, latest_rows, table

#: Label of an edge end, parent table, key column.
PARENTS = [("Customer", "customer_master", "customer_id"), ("Plan", "plan_master", "plan_id"), ("Subscription", "subscriptions", "subscription_id"), ("Ticket", "tickets", "ticket_id")]
#: Name space of document ids and of edge ends that name none of the four tables.
DOCUMENT, UNKNOWN = "Document", ""
_END = r"(?i)^(customer|plan|subscription|ticket)[ \t\r\n]*:[ \t\r\n]*([0-9]+)$"


def _bare(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def _edge_refs(spark: SparkSession, base: str) -> DataFrame:
    """Both ends of each edge. An end that names none of the four tables keeps its text as key."""
    edges = table(spark, base, "structured_edges").select("edge_id", "source", "target", F.col("extracted_at").alias("at"))
    ends = edges.select(
        F.lit("structured_edges").alias("rec_table"), F.col("edge_id").cast("string").alias("rec_id"), "at",
        F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), _bare(F.col(c)).alias("end")) for c in ("source", "target")])).alias("_end"),
    )
    ends = ends.select("rec_table", "rec_id", "at", F.col("_end.ref_field").alias("ref_field"), F.col("_end.end").alias("end")).filter("end <> ''")
    known = F.col("end").rlike(_END)
    number = F.regexp_replace(F.regexp_extract("end", _END, 2), "^0+(?=[0-9])", "")
    return ends.select("rec_table", "rec_id", "ref_field", F.when(known, F.initcap(F.regexp_extract("end", _END, 1))).otherwise(F.lit(UNKNOWN)).alias("space"), F.when(known, number).otherwise(F.col("end")).alias("key"), "at")


def _document_refs(spark: SparkSession, base: str) -> DataFrame:
    current = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["related_ids"])
    refs = current.select(F.col("document_id").alias("rec_id"), F.explode("related_ids").alias("id"), F.col("ingested_at").alias("at"))
    key = F.upper(_bare(F.col("id")))
    return refs.select(F.lit("canonical_documents").alias("rec_table"), "rec_id", F.lit("related_ids").alias("ref_field"), F.lit(DOCUMENT).alias("space"), key.alias("key"), "at").filter("key <> ''")


def _refs(spark: SparkSession, base: str) -> DataFrame:
    return _edge_refs(spark, base).unionByName(_document_refs(spark, base))


def _parents(spark: SparkSession, base: str) -> DataFrame:
    spans = lifespans(table(spark, base, "canonical_documents"), DOCUMENT, F.upper(_bare(F.col("document_id"))), "ingested_at", "withdrawn_at")
    for label, name, key in PARENTS:
        spans = spans.unionByName(lifespans(table(spark, base, name), label, F.col(key).cast("string"), "loaded_at", "deleted_at"))
    return spans


_CARRY = ["rec_table", "rec_id", "ref_field"]


def _named(orphans: DataFrame) -> DataFrame:
    label = F.when(F.col("space").isin(DOCUMENT, UNKNOWN), F.col("key")).otherwise(F.concat_ws(":", "space", "key"))
    return orphans.select(*_CARRY, label.alias("ref_key"), "period")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """(rec_table, rec_id, ref_field, ref_key, period) of each orphan reference."""
    return _named(orphan_references(_refs(spark, base), _parents(spark, base), _CARRY))


def p3_counts(spark: SparkSession, base: str) -> DataFrame:
    """(rec_table, period, n_refs, n_orphans, share): orphan references per table and month."""
    refs = _refs(spark, base)
    found = orphan_references(refs, _parents(spark, base), _CARRY)
    return orphan_counts(refs.select(*_CARRY, "space", "key", "at").distinct(), found, "rec_table", "at")


def _subscription_days(spark: SparkSession, base: str) -> DataFrame:
    current = latest_rows(table(spark, base, "subscriptions"), "subscription_id", "loaded_at", ["msisdn", "activation_date", "expiry_date"])
    digits = F.regexp_replace("msisdn", "[^0-9]", "")
    return current.filter(F.length(digits) >= 10).select(F.right(digits, F.lit(10)).alias("entity"), F.col("activation_date").alias("start"), F.col("expiry_date").alias("stop"))


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return continuous_periods(_subscription_days(spark, base)).select(F.col("entity").alias("msisdn"), "kind", day_text("start").alias("start_day"), day_text("stop").alias("end_day"), "members")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """(msisdn, kind, start_day, end_day): joined periods of two or more subscriptions, and gaps."""
    return _spans(spark, base).filter("kind = 'gap' OR members > 1").drop("members")


def p4_periods(spark: SparkSession, base: str) -> DataFrame:
    """Every continuous period of each line, single subscriptions included, with its members."""
    return _spans(spark, base).filter("kind = 'period'").select("msisdn", "start_day", "end_day", "members")


_ORPHANS_SQL = r"""
WITH ends AS (
  SELECT 'structured_edges' rec_table, CAST(edge_id AS VARCHAR) rec_id, 'source' ref_field, trim(source, E' \t\r\n') e, extracted_at seen_at FROM structured_edges
  UNION ALL SELECT 'structured_edges', CAST(edge_id AS VARCHAR), 'target', trim(target, E' \t\r\n'), extracted_at FROM structured_edges
), edge_refs AS (
  SELECT rec_table, rec_id, ref_field, seen_at,
    CASE WHEN regexp_matches(e, '(?i)^(customer|plan|subscription|ticket)[ \t\r\n]*:[ \t\r\n]*[0-9]+$')
      THEN upper(e[1]) || lower(regexp_extract(e, '^.([A-Za-z]+)', 1)) || ':' || CAST(CAST(regexp_extract(e, '([0-9]+)$', 1) AS HUGEINT) AS VARCHAR) ELSE e END ref_key
  FROM ends WHERE e <> ''
), counting AS (
  SELECT document_id, max(ingested_at) seen_at, max_by(related_ids, ingested_at) related_ids FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1
), doc_refs AS (
  SELECT 'canonical_documents' rec_table, document_id rec_id, 'related_ids' ref_field, seen_at, upper(trim(u, E' \t\r\n')) ref_key
  FROM (SELECT document_id, seen_at, unnest(related_ids) u FROM counting) WHERE trim(u, E' \t\r\n') <> ''
), refs AS (SELECT rec_table, rec_id, ref_field, ref_key, seen_at FROM edge_refs UNION ALL SELECT rec_table, rec_id, ref_field, ref_key, seen_at FROM doc_refs),
key_rows AS (
  SELECT 'Customer:' || customer_id k, loaded_at b, deleted_at d FROM customer_master
  UNION ALL SELECT 'Plan:' || plan_id, loaded_at, deleted_at FROM plan_master
  UNION ALL SELECT 'Subscription:' || subscription_id, loaded_at, deleted_at FROM subscriptions
  UNION ALL SELECT 'Ticket:' || ticket_id, loaded_at, deleted_at FROM tickets
  UNION ALL SELECT upper(trim(document_id, E' \t\r\n')), ingested_at, withdrawn_at FROM canonical_documents
), spans AS (
  SELECT k, min(b) born, max(b) last_at FROM key_rows WHERE k IS NOT NULL AND b IS NOT NULL GROUP BY 1
), keys AS (
  SELECT s.k, s.born, max(r.d) died FROM spans s JOIN key_rows r ON r.k = s.k AND r.b = s.last_at GROUP BY 1, 2
), found AS (
  SELECT DISTINCT rec_table, rec_id, ref_field, ref_key, strftime(seen_at, '%Y-%m') period
  FROM refs LEFT JOIN keys ON k = ref_key WHERE k IS NULL OR seen_at < born OR seen_at >= died
)
"""

_SPANS_SQL = r"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY loaded_at DESC) n FROM subscriptions
), days AS (
  SELECT right(regexp_replace(msisdn, '[^0-9]', '', 'g'), 10) msisdn, activation_date s,
    CASE WHEN expiry_date IS NULL OR year(expiry_date) >= 9999 THEN DATE '9999-12-31' ELSE expiry_date END e
  FROM ranked WHERE n = 1 AND length(regexp_replace(msisdn, '[^0-9]', '', 'g')) >= 10 AND activation_date IS NOT NULL
), valid AS (SELECT * FROM days WHERE e >= s),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY msisdn ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM valid
), numbered AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR (reach < DATE '9999-12-30' AND s > reach + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY msisdn ORDER BY s, e ROWS UNBOUNDED PRECEDING) island FROM marked
), periods AS (
  SELECT msisdn, island, min(s) s, max(e) e, count(*) members FROM numbered GROUP BY 1, 2
), texts AS (
  SELECT msisdn, s, e, members, strftime(s, '%Y-%m-%d') start_day, CASE WHEN year(e) = 9999 THEN 'open' ELSE strftime(e, '%Y-%m-%d') END end_day,
    lead(s) OVER (PARTITION BY msisdn ORDER BY s) next_s FROM periods
)
"""

#: name -> (query, its SQL twin or None)
QUERIES = {
    "p3_found": (p3_found, _ORPHANS_SQL + "SELECT * FROM found"),
    "p3_counts": (
        p3_counts,
        _ORPHANS_SQL
        + """, n AS (SELECT rec_table, strftime(seen_at, '%Y-%m') period, count(*) n_refs FROM (SELECT DISTINCT * FROM refs) GROUP BY 1, 2),
        o AS (SELECT rec_table, period, count(*) n_orphans FROM found GROUP BY 1, 2)
        SELECT n.rec_table, n.period, n_refs, coalesce(n_orphans, 0) n_orphans, round(coalesce(n_orphans, 0) / n_refs, 6) "share" FROM n LEFT JOIN o USING (rec_table, period)""",
    ),
    "p4_found": (
        p4_found,
        _SPANS_SQL
        + """SELECT msisdn, 'period' kind, start_day, end_day FROM texts WHERE members > 1
        UNION ALL SELECT msisdn, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(next_s - 1, '%Y-%m-%d') FROM texts WHERE next_s IS NOT NULL""",
    ),
    "p4_periods": (p4_periods, _SPANS_SQL + "SELECT msisdn, start_day, end_day, members FROM texts"),
}
