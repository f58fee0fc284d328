"""Registered queries: scans, projections, joins, aggregates, ranks, sorts and sets over tables.

Each entry is a query and the SQL that gives the same rows. Orders stand for invoices, line items
for payments (flag N: successful), suppliers for sites and their line items for alarms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import mask_number
from tessella.functions.typing import normalise
from tessella.operators import metrics, ranking
from tessella.operators import relational as R
from tessella.plans.register import register
from tessella.schemas import TABLES
from tessella.sources.tables import latest_rows, table

MONEY = "decimal(18,2)"
QUERIES, query = register()


def _n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- scans ----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def scan_s02_table(spark: SparkSession, base: str) -> DataFrame:
    """Whole tables, only the columns asked for."""
    places = table(spark, base, "nation").join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, base, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT customer_id, name, circle, account_type FROM customer_master WHERE CAST(customer_id AS VARCHAR) = '7' ORDER BY loaded_at LIMIT 1")
def scan_s03_lookup(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "customer_master").filter(F.col("customer_id").cast("string") == "7").orderBy("loaded_at").limit(1).select("customer_id", "name", "circle", "account_type")


@query("SELECT ticket_id, category, status FROM tickets")
def scan_s05_columns(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tickets").select("ticket_id", "category", "status")


@query("""SELECT 'customer_master' table_name, count(*) n_rows FROM customer_master UNION ALL SELECT 'plan_master', count(*) FROM plan_master
    UNION ALL SELECT 'subscriptions', count(*) FROM subscriptions UNION ALL SELECT 'tickets', count(*) FROM tickets""")
def agg_a01_row_counts(spark: SparkSession, base: str) -> DataFrame:
    """Rows of each declared table that the folder has."""
    counts = [table(spark, base, t).agg(_n("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in ("customer_master", "plan_master", "subscriptions", "tickets")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# --- projections and filters ----------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")
def proj_p01_exact_filter(spark: SparkSession, base: str) -> DataFrame:
    return R.exact_filter(table(spark, base, "orders"), "o_orderstatus", "F", "o_orderkey", 10).select("o_orderkey", "o_custkey", "o_totalprice")


_TICKET_COLUMNS = ["ticket_id", "customer_id", "category", "status", "assigned_to"]


@query("""SELECT DISTINCT 'structured' source, CAST(ticket_id AS VARCHAR) record_id, 'tickets' dataset, 'support' category, 1.0::DOUBLE score, 'exact_filter' retrieval_method,
    'tickets record: ' || concat_ws(', ', 'ticket_id=' || ticket_id, 'customer_id=' || customer_id, 'category=' || category, 'status=' || status, 'assigned_to=' || assigned_to) content FROM tickets""")
def proj_p04_common_result(spark: SparkSession, base: str) -> DataFrame:
    return R.common_result(table(spark, base, "tickets"), "tickets", "ticket_id", "support", "exact_filter", _TICKET_COLUMNS).drop("metadata").distinct()


@query("""WITH raw AS (SELECT unnest([{'c': 'customer_id', 'v': CAST(customer_id AS VARCHAR), 'k': 'i'}, {'c': 'msisdn', 'v': msisdn, 'k': 'i'},
      {'c': 'activation_date', 'v': CAST(activation_date AS VARCHAR), 'k': 'd'}, {'c': 'kyc_status', 'v': kyc_status, 'k': 'b'}]) x FROM customer_master)
    SELECT x.c column_name, count(*) n_rows, count(*) FILTER (x.v IS NULL OR x.v = '') n_null,
      count(*) FILTER (x.v <> '' AND CASE x.k WHEN 'i' THEN try_cast(x.v AS BIGINT) IS NULL WHEN 'd' THEN try_strptime(x.v, '%Y-%m-%d') IS NULL ELSE false END) n_bad FROM raw GROUP BY 1""")
def proj_p06_normalise(spark: SparkSession, base: str) -> DataFrame:
    """Typing of raw texts; what fails goes to a side column, counted here."""
    kinds = {"customer_id": "i", "msisdn": "i", "activation_date": "d", "kyc_status": "b"}
    raw = table(spark, base, "customer_master").select(*[F.col(c).cast("string").alias(c) for c in kinds])
    typed = normalise(raw.select("*", *[F.col(c).alias(f"raw_{c}") for c in kinds]), kinds)
    null = lambda c: F.col(f"raw_{c}").isNull() | (F.col(f"raw_{c}") == "")
    parts = [F.struct(F.lit(c).alias("column_name"), F.count_if(null(c)).alias("n_null"), F.count(F.col(f"_bad_{c}")).alias("n_bad")) for c in kinds]
    counts = typed.agg(_n("n_rows"), F.array(*parts).alias("_c"))
    return counts.select("n_rows", F.explode("_c").alias("_c")).select("_c.column_name", "n_rows", "_c.n_null", "_c.n_bad")


@query("SELECT subscription_id, status, renewal_type, strftime(activation_date, '%Y-%m-%d') activation_date, strftime(expiry_date, '%Y-%m-%d') expiry_date FROM subscriptions WHERE customer_id IS NOT NULL AND status IS NOT NULL")
def proj_p08_allow_list(spark: SparkSession, base: str) -> DataFrame:
    """Only declared columns that name no person."""
    allowed = [c for c in TABLES["subscriptions"].kinds if c not in (*TABLES["subscriptions"].foreign, "msisdn")]
    order = ["subscription_id", "status", "renewal_type", "activation_date", "expiry_date"]
    return table(spark, base, "subscriptions").filter("customer_id IS NOT NULL AND status IS NOT NULL").select(*[_day(c).alias(c) if TABLES["subscriptions"].kinds[c] == "d" else F.col(c) for c in order if c in allowed])


@query("SELECT subscription_id, '****' || right(msisdn, 4) masked FROM subscriptions WHERE msisdn IS NOT NULL")
def proj_p14_mask(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "subscriptions").filter("msisdn IS NOT NULL").select("subscription_id", mask_number(F.col("msisdn")).alias("masked"))


_DIGITS = "right(regexp_replace(msisdn, '[^0-9]', '', 'g'), 10)"


def _digits(c: str = "msisdn") -> Column:
    return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))


@query(f"""WITH c AS (SELECT DISTINCT customer_id, {_DIGITS} line FROM customer_master WHERE msisdn IS NOT NULL), s AS (SELECT subscription_id, customer_id, {_DIGITS} line FROM subscriptions WHERE msisdn IS NOT NULL)
    SELECT DISTINCT s.customer_id, s.subscription_id FROM s JOIN c ON s.customer_id = c.customer_id AND s.line = c.line""")
def proj_p15_own_rows(spark: SparkSession, base: str) -> DataFrame:
    """Subscriptions of a customer's own number only: the number comes from the customer's own row."""
    own = table(spark, base, "customer_master").filter("msisdn IS NOT NULL").select("customer_id", _digits().alias("line")).distinct()
    subs = table(spark, base, "subscriptions").filter("msisdn IS NOT NULL").select("subscription_id", "customer_id", _digits().alias("line"))
    return subs.join(own, ["customer_id", "line"]).select("customer_id", "subscription_id").distinct()


# --- joins ----------------------------------------------------------------------------------


@query("SELECT subscription_id, plan_id, plan_name, price FROM subscriptions LEFT JOIN plan_master USING (plan_id)")
def join_j01_plan_enrich(spark: SparkSession, base: str) -> DataFrame:
    plans = table(spark, base, "plan_master").select("plan_id", "plan_name", "price")
    return table(spark, base, "subscriptions").select("subscription_id", "plan_id").join(plans, "plan_id", "left")


@query(f"""WITH c AS (SELECT customer_id, {_DIGITS} line FROM customer_master), s AS (SELECT customer_id, {_DIGITS} line FROM subscriptions)
    SELECT c.customer_id owner_id, s.customer_id, count(*) n_rows FROM c JOIN s USING (line) WHERE length(line) = 10 GROUP BY 1, 2""")
def join_j02_by_number(spark: SparkSession, base: str) -> DataFrame:
    """An undeclared key: the number as written differently on both sides. Both sides collapse before they meet."""
    c = table(spark, base, "customer_master").groupBy(F.col("customer_id").alias("owner_id"), _digits().alias("line")).agg(_n("a"))
    s = table(spark, base, "subscriptions").groupBy("customer_id", _digits().alias("line")).agg(_n("b"))
    return c.filter("length(line) = 10").join(s, "line").groupBy("owner_id", "customer_id").agg(F.sum(F.col("a") * F.col("b")).alias("n_rows"))


def _payments(spark: SparkSession, base: str) -> DataFrame:
    """Per invoice: attempts, paid and the attempts as one sorted text."""
    lines = table(spark, base, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("amount"))
    by_flag = lines.groupBy("l_orderkey", "l_returnflag").agg(_n("n"), F.sum("amount").alias("amount"))
    paid = F.coalesce(F.sum(F.when(F.col("l_returnflag") == "N", F.col("amount"))), F.lit(0)).cast(MONEY)
    return by_flag.groupBy("l_orderkey").agg(F.sum("n").alias("attempts"), paid.alias("paid"), R.histogram_text("l_returnflag", "n").alias("by_flag"))


@query("""WITH p AS (SELECT l_orderkey, count(*) attempts, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N'), 0) paid FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CAST(coalesce(attempts, 0) AS BIGINT) attempts, CAST(coalesce(paid, 0) AS DOUBLE) paid,
      o_orderstatus = 'O' AND coalesce(paid, 0) >= CAST(o_totalprice AS DECIMAL(18,2)) mismatch FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def join_j03_invoice_payments(spark: SparkSession, base: str) -> DataFrame:
    """Per invoice what a loop over invoices would fetch, as one join; and whether paid invoices are still open."""
    joined = table(spark, base, "orders").join(_payments(spark, base), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    paid = F.coalesce("paid", F.lit(0).cast(MONEY))
    return joined.select("o_orderkey", F.coalesce("attempts", F.lit(0)).alias("attempts"), paid.cast("double").alias("paid"), ((F.col("o_orderstatus") == "O") & (paid >= F.col("o_totalprice").cast(MONEY))).alias("mismatch"))


_FOREIGN = [("subscriptions", "customer_id", "customer_master"), ("subscriptions", "plan_id", "plan_master"), ("tickets", "customer_id", "customer_master")]


@query(" UNION ALL ".join(
    f"""SELECT '{c}.{k}' reference, count(*) n_rows, count(*) FILTER ({k} IS NULL) n_null, count(*) FILTER ({k} IN (SELECT {k} FROM {p})) n_resolved,
    count(*) FILTER ({k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)) n_dangling,
    round(coalesce(count(*) FILTER ({k} IN (SELECT {k} FROM {p})) / nullif(count({k}), 0), 1.0), 6) rate FROM {c}""" for c, k, p in _FOREIGN))  # fmt: skip
def join_j05_fk_integrity(spark: SparkSession, base: str) -> DataFrame:
    reports = [R.foreign_key_report(table(spark, base, c), k, table(spark, base, p), k, f"{c}.{k}") for c, k, p in _FOREIGN]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    WHERE l_returnflag = 'R' ORDER BY CAST(l_orderkey AS VARCHAR), l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def join_j08_chain(spark: SparkSession, base: str) -> DataFrame:
    """Escalation to ticket to customer: two joins, ordered by the key as text."""
    items = table(spark, base, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    chain = items.join(table(spark, base, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = chain.join(table(spark, base, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return named.orderBy(F.col("l_orderkey").cast("string"), "l_linenumber", "l_partkey", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "c_name")


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, count(*) n FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) billed, coalesce(string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag), '') by_flag FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def join_j09_histogram(spark: SparkSession, base: str) -> DataFrame:
    joined = table(spark, base, "orders").join(_payments(spark, base), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.col("o_totalprice").alias("billed"), F.coalesce("by_flag", F.lit("")).alias("by_flag"))


@query("SELECT o_orderstatus, l_linestatus, count(*) n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> l_linestatus GROUP BY 1, 2")
def join_j13_residual(spark: SparkSession, base: str) -> DataFrame:
    joined = table(spark, base, "orders").join(table(spark, base, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.filter("o_orderstatus <> l_linestatus").groupBy("o_orderstatus", "l_linestatus").agg(_n("n"))


@query("""SELECT category, count(*) n_tickets, count(*) FILTER (status = 'Open') n_open, round(count(*) / (SELECT count(*) FROM tickets), 6) "share" FROM tickets GROUP BY 1""")
def join_j14_with_totals(spark: SparkSession, base: str) -> DataFrame:
    """Groups beside a one-row total."""
    tickets = table(spark, base, "tickets")
    total = tickets.agg(_n("_all"))
    groups = tickets.groupBy("category").agg(_n("n_tickets"), F.count_if(F.col("status") == "Open").alias("n_open"))
    return groups.join(F.broadcast(total)).select("category", "n_tickets", "n_open", F.round(F.col("n_tickets") / F.col("_all"), 6).alias("share"))


@query("""WITH s AS (SELECT customer_id, count(*) n_subscriptions FROM subscriptions GROUP BY 1), t AS (SELECT customer_id, count(*) n_tickets FROM tickets GROUP BY 1)
    SELECT coalesce(s.customer_id, t.customer_id) customer_id, coalesce(n_subscriptions, 0) n_subscriptions, coalesce(n_tickets, 0) n_tickets FROM s FULL JOIN t ON s.customer_id = t.customer_id WHERE coalesce(s.customer_id, t.customer_id) IS NOT NULL""")
def join_j22_full_outer(spark: SparkSession, base: str) -> DataFrame:
    """Two sides counted before they meet, so neither fans the other out."""
    s = table(spark, base, "subscriptions").groupBy("customer_id").agg(_n("n_subscriptions"))
    t = table(spark, base, "tickets").groupBy("customer_id").agg(_n("n_tickets"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(t, "customer_id", "full").filter("customer_id IS NOT NULL").select("customer_id", zero("n_subscriptions"), zero("n_tickets"))


@query("""SELECT DISTINCT p.plan_id FROM plan_master p WHERE EXISTS (SELECT 1 FROM subscriptions s WHERE s.plan_id = p.plan_id AND s.status = 'Active')
    AND EXISTS (SELECT 1 FROM subscriptions s WHERE s.plan_id = p.plan_id AND s.renewal_type = 'Manual')""")
def join_j20_exists_both(spark: SparkSession, base: str) -> DataFrame:
    subs = table(spark, base, "subscriptions")
    active, manual = (subs.filter(c).select("plan_id") for c in ("status = 'Active'", "renewal_type = 'Manual'"))
    return table(spark, base, "plan_master").select("plan_id").distinct().join(active, "plan_id", "left_semi").join(manual, "plan_id", "left_semi")


@query("""WITH d AS (SELECT DISTINCT document_id FROM canonical_documents), c AS (SELECT document_id, count(DISTINCT chunk_id) n FROM document_chunks GROUP BY 1)
    SELECT d.document_id FROM d LEFT JOIN c USING (document_id) WHERE n IS NULL""")
def join_j18_without_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Documents that no chunk belongs to."""
    return table(spark, base, "canonical_documents").select("document_id").distinct().join(table(spark, base, "document_chunks").select("document_id"), "document_id", "left_anti")


@query("""SELECT e.event_id, e.user_id, CAST(e.value AS DOUBLE) value, p.value asof_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_j22_asof(spark: SparkSession, base: str) -> DataFrame:
    """Each purchase with the value of its user's latest click."""
    events = table(spark, base, "events").select("event_id", "user_id", "ts", "value", "event_type")
    bought = events.filter("event_type = 'purchase'").drop("event_type")
    return R.asof_join(bought, events.filter("event_type = 'click'"), "user_id", "ts", "ts", "value").drop("ts")


@query("""WITH b AS (SELECT p_size, min(p_retailprice) low, max(p_retailprice) high FROM part GROUP BY 1)
    SELECT p_size, count(*) n FROM lineitem JOIN b ON l_extendedprice >= low AND l_extendedprice < high GROUP BY 1""")
def join_j22_range(spark: SparkSession, base: str) -> DataFrame:
    """Line items whose price lies in the price range of each part size, by buckets."""
    ranges = table(spark, base, "part").groupBy("p_size").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return R.range_join(table(spark, base, "lineitem").select("l_extendedprice"), ranges, "l_extendedprice", "low", "high", 500.0).groupBy("p_size").agg(_n("n"))


# --- aggregates -----------------------------------------------------------------------------


@query("SELECT count(*) n FROM orders WHERE o_orderstatus = 'P'")
def agg_a02_filtered_count(spark: SparkSession, base: str) -> DataFrame:
    return R.filtered_count(table(spark, base, "orders"), "o_orderstatus", "P")


@query("SELECT string_agg(DISTINCT upper(trim(status)), ',' ORDER BY upper(trim(status))) statuses FROM tickets")
def agg_a03_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tickets").agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("status")))), ",").alias("statuses"))


_RECONCILED_SQL = """WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N') paid FROM lineitem GROUP BY 1),
    i AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) billed, coalesce(paid, 0) paid FROM orders LEFT JOIN p ON o_orderkey = l_orderkey),
    r AS (SELECT o_custkey customer_id, count(*) invoices, CAST(sum(billed) AS DOUBLE) billed, CAST(sum(paid) AS DOUBLE) paid, CAST(sum(billed - paid) AS DOUBLE) balance FROM i GROUP BY 1)"""


def _reconciled(spark: SparkSession, base: str) -> DataFrame:
    invoices = table(spark, base, "orders").join(_payments(spark, base).select("l_orderkey", "paid"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = invoices.select(F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast(MONEY).alias("billed"), F.coalesce("paid", F.lit(0).cast(MONEY)).alias("paid"))
    total = lambda c, n: F.sum(c).cast("double").alias(n)
    return rows.groupBy("customer_id").agg(_n("invoices"), total("billed", "billed"), total("paid", "paid"), total(F.col("billed") - F.col("paid"), "balance"))


@query(_RECONCILED_SQL + " SELECT * FROM r")
def agg_a05_reconciliation(spark: SparkSession, base: str) -> DataFrame:
    return _reconciled(spark, base)


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, count(*) n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, CAST(sum(n) AS BIGINT) alarms, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) by_severity FROM a GROUP BY 1)
    SELECT s_suppkey, s_name, alarms, by_severity FROM supplier JOIN s ON s_suppkey = l_suppkey ORDER BY alarms DESC, CAST(s_suppkey AS VARCHAR) LIMIT 10""")
def agg_a06_top_sites(spark: SparkSession, base: str) -> DataFrame:
    by = table(spark, base, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(_n("n")).groupBy("l_suppkey").agg(F.sum("n").alias("alarms"), R.histogram_text("l_returnflag", "n").alias("by_severity"))
    joined = table(spark, base, "supplier").join(by, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.orderBy(F.col("alarms").desc(), F.col("s_suppkey").cast("string")).limit(10).select("s_suppkey", "s_name", "alarms", "by_severity")


_HUBS_SQL = """WITH e AS (SELECT o_custkey c, 'order' t FROM orders UNION ALL SELECT o_custkey, 'item' FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT user_id, 'event' FROM events),
    h AS (SELECT c customer_id, count(*) degree, count(DISTINCT t) n_types FROM e GROUP BY 1)"""


def _hubs(spark: SparkSession, base: str) -> DataFrame:
    orders = table(spark, base, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, base, "lineitem").groupBy("l_orderkey").agg(_n("n")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer_id"), F.lit("item").alias("kind"), "n")
    own = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(_n("n")).select("customer_id", F.lit("order").alias("kind"), "n")
    events = table(spark, base, "events").groupBy(F.col("user_id").alias("customer_id")).agg(_n("n")).select("customer_id", F.lit("event").alias("kind"), "n")
    return own.unionByName(items).unionByName(events).groupBy("customer_id").agg(F.sum("n").alias("degree"), F.count_distinct("kind").alias("n_types"))


@query(_HUBS_SQL + " SELECT * FROM h ORDER BY degree DESC, customer_id LIMIT 10")
def agg_a07_hubs(spark: SparkSession, base: str) -> DataFrame:
    return _hubs(spark, base).orderBy(F.col("degree").desc(), "customer_id").limit(10)


@query(_HUBS_SQL + " SELECT * FROM h ORDER BY n_types DESC, degree DESC, customer_id LIMIT 1")
def agg_a08_widest(spark: SparkSession, base: str) -> DataFrame:
    return _hubs(spark, base).orderBy(F.col("n_types").desc(), F.col("degree").desc(), "customer_id").limit(1)


@query("""WITH a AS (SELECT l_partkey k, count(*) n FROM lineitem GROUP BY 1), b AS (SELECT user_id k, count(*) n FROM events GROUP BY 1)
    SELECT p_partkey, coalesce(a.n, 0) n_items, coalesce(b.n, 0) n_events, coalesce(a.n, 0) + coalesce(b.n, 0) total FROM part LEFT JOIN a ON p_partkey = a.k LEFT JOIN b ON p_partkey = b.k""")
def agg_a09_adoption(spark: SparkSession, base: str) -> DataFrame:
    """Two child relations per parent, each counted before the join."""
    a = table(spark, base, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(_n("a"))
    b = table(spark, base, "events").groupBy(F.col("user_id").alias("p_partkey")).agg(_n("b"))
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return table(spark, base, "part").select("p_partkey").join(a, "p_partkey", "left").join(b, "p_partkey", "left").select("p_partkey", x.alias("n_items"), y.alias("n_events"), (x + y).alias("total"))


@query("""WITH r AS (SELECT customer_id, 'Subscription' entity, subscription_id id FROM subscriptions UNION SELECT customer_id, 'Ticket', ticket_id FROM tickets)
    SELECT customer_id, entity, count(*) n, min(id) first_id, max(id) last_id FROM r WHERE customer_id IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2""")
def agg_a10_customer_360(spark: SparkSession, base: str) -> DataFrame:
    """Related records of each customer by entity: counts and ends, no lists, which a hot customer would make endless."""
    rows = [table(spark, base, t).select("customer_id", F.lit(e).alias("entity"), F.col(k).alias("id")) for t, e, k in (("subscriptions", "Subscription", "subscription_id"), ("tickets", "Ticket", "ticket_id"))]
    both = rows[0].unionByName(rows[1]).filter("customer_id IS NOT NULL AND id IS NOT NULL").distinct()
    return both.groupBy("customer_id", "entity").agg(_n("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""SELECT p.plan_id, count(s.subscription_id) n_rows, CAST(sum(CASE WHEN s.status = 'Active' THEN 1 ELSE 0 END) AS BIGINT) n_active, coalesce(string_agg(DISTINCT s.renewal_type, ',' ORDER BY s.renewal_type), '') kinds
    FROM plan_master p LEFT JOIN subscriptions s ON p.plan_id = s.plan_id GROUP BY 1""")
def agg_a12_conditional(spark: SparkSession, base: str) -> DataFrame:
    by = table(spark, base, "subscriptions").groupBy("plan_id").agg(F.count("subscription_id").alias("n"), F.count_if(F.col("status") == "Active").alias("a"), F.array_join(F.array_sort(F.collect_set("renewal_type")), ",").alias("k"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return table(spark, base, "plan_master").select("plan_id").join(by, "plan_id", "left").select("plan_id", zero("n", "n_rows"), zero("a", "n_active"), F.coalesce("k", F.lit("")).alias("kinds"))


@query("SELECT coalesce(source, '(all)') source, coalesce(doc_kind, '(all)') doc_kind, count(*) n FROM documents WHERE source IS NOT NULL AND doc_kind IS NOT NULL GROUP BY ROLLUP (source, doc_kind)")
def agg_a29_rollup(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").filter("source IS NOT NULL AND doc_kind IS NOT NULL").rollup("source", "doc_kind").agg(_n("n"))
    return rows.select(*[F.coalesce(c, F.lit("(all)")).alias(c) for c in ("source", "doc_kind")], "n")


@query("SELECT coalesce(l_returnflag, '*') l_returnflag, coalesce(l_linestatus, '*') l_linestatus, count(*) n, round(sum(CAST(l_quantity AS DECIMAL(18,2))), 2)::DOUBLE quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_a29_cube(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "lineitem").cube("l_returnflag", "l_linestatus").agg(_n("n"), F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("quantity"))
    return rows.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("l_returnflag", "l_linestatus")], "n", "quantity")


@query("SELECT o_orderstatus expected, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def agg_a26_confusion(spark: SparkSession, base: str) -> DataFrame:
    joined = table(spark, base, "orders").join(table(spark, base, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return metrics.confusion(joined.select(F.col("o_orderstatus").alias("expected"), "l_linestatus"), "expected", "l_linestatus", ["F", "O"])


@query("""WITH c AS (SELECT count(*) FILTER (l_linestatus = 'F' AND o_orderstatus = 'F') tp, count(*) FILTER (l_linestatus = 'F' AND o_orderstatus <> 'F') fp, count(*) FILTER (l_linestatus <> 'F' AND o_orderstatus = 'F') fn FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1 FROM c""")
def agg_a27_precision_recall(spark: SparkSession, base: str) -> DataFrame:
    joined = table(spark, base, "orders").join(table(spark, base, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return metrics.precision_recall(joined, F.col("l_linestatus") == "F", F.col("o_orderstatus") == "F")


@query("SELECT event_type, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) accuracy FROM events GROUP BY 1")
def agg_a25_accuracy(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") >= 50).cast("int")), 6).alias("accuracy"))


# --- ranks, sorts, sets ---------------------------------------------------------------------


@query("""SELECT customer_id, ticket_id, CAST("rank" AS INTEGER) "rank" FROM (SELECT customer_id, ticket_id, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, ticket_id DESC) "rank"
    FROM (SELECT ticket_id, any_value(customer_id) customer_id, max(created_at) created_at FROM tickets WHERE created_at IS NOT NULL AND ticket_id IS NOT NULL GROUP BY ticket_id HAVING count(DISTINCT customer_id) = 1)) WHERE "rank" <= 3""")
def rank_w01_latest(spark: SparkSession, base: str) -> DataFrame:
    """The three latest tickets of each customer, of ticket ids with one customer."""
    rows = table(spark, base, "tickets").filter("created_at IS NOT NULL AND ticket_id IS NOT NULL").groupBy("ticket_id").agg(F.count_distinct("customer_id").alias("_c"), F.any_value("customer_id", ignoreNulls=True).alias("customer_id"), F.max("created_at").alias("created_at"))
    return ranking.top_n(rows.filter("_c = 1"), ["customer_id"], [F.col("created_at").desc(), F.col("ticket_id").desc()], 3).select("customer_id", "ticket_id", "rank")


def _min_max_sql(constant: str) -> str:
    return f"""WITH b AS (SELECT o_custkey k, min(o_totalprice) low, max(o_totalprice) high FROM orders GROUP BY 1)
    SELECT o_orderkey, round(CASE WHEN high = low THEN {constant} ELSE (o_totalprice - low) / (high - low) END, 6) scaled FROM orders JOIN b ON o_custkey = k"""


@query(_min_max_sql("0.5"))
def rank_w04_min_max(spark: SparkSession, base: str) -> DataFrame:
    return ranking.min_max(table(spark, base, "orders"), "o_custkey", "o_totalprice", 0.5, "scaled").select("o_orderkey", F.round("scaled", 6).alias("scaled"))


@query(_min_max_sql("1.0"))
def rank_w05_min_max(spark: SparkSession, base: str) -> DataFrame:
    return ranking.min_max(table(spark, base, "orders"), "o_custkey", "o_totalprice", 1.0, "scaled").select("o_orderkey", F.round("scaled", 6).alias("scaled"))


@query("""SELECT user_id, event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) after_error FROM events""")
def rank_w07_inherited(spark: SparkSession, base: str) -> DataFrame:
    """Once a user's event is an error, so count all after it."""
    return table(spark, base, "events").select("user_id", "event_id", "event_type").transform(ranking.carried_flag, "user_id", "event_id", F.col("event_type") == "error", "after_error").drop("event_type")


@query("""WITH c AS (SELECT doc_kind s, count(*) n FROM documents GROUP BY 1), t AS (SELECT s, n, n * 40 / (SELECT count(*) FROM documents) x FROM c), f AS (SELECT *, greatest(floor(x), 1) fl FROM t),
    g AS (SELECT *, row_number() OVER (ORDER BY x - fl DESC, s NULLS FIRST) p, 40 - sum(fl) OVER () spare FROM f), a AS (SELECT s, n, CAST(least(n, fl + CASE WHEN p <= spare THEN 1 ELSE 0 END) AS BIGINT) k FROM g),
    d AS (SELECT doc_id, doc_kind, row_number() OVER (PARTITION BY doc_kind ORDER BY doc_id) - 1 i FROM documents)
    SELECT doc_id, doc_kind FROM d JOIN a ON doc_kind IS NOT DISTINCT FROM s WHERE ceil(i * k / n) < k AND floor(ceil(i * k / n) * n / k) = i""")
def rank_w08_stratified(spark: SparkSession, base: str) -> DataFrame:
    """40 documents over the kinds: a sampling operator."""
    return ranking.stratified_sample(table(spark, base, "documents").select("doc_id", "doc_kind"), "doc_kind", "doc_id", 40, F.floor(F.col("doc_id") / 4096))


@query("""SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) previous, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) moving FROM events""")
def rank_w10_frames(spark: SparkSession, base: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, base, "events").select("event_id", F.lag("value").over(w).alias("previous"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"))


@query("SELECT doc_id, length(text) n FROM documents WHERE text IS NOT NULL ORDER BY n DESC, doc_id LIMIT 10")
def sort_l06_longest(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(10)


@query("SELECT customer_id FROM subscriptions WHERE customer_id IS NOT NULL INTERSECT SELECT customer_id FROM tickets")
def set_u03_intersection(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "subscriptions").filter("customer_id IS NOT NULL").select("customer_id").intersect(table(spark, base, "tickets").select("customer_id"))


@query("SELECT customer_id FROM customer_master EXCEPT SELECT customer_id FROM subscriptions")
def set_u04_difference(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "customer_master").select("customer_id").subtract(table(spark, base, "subscriptions").select("customer_id"))


@query("""WITH e AS (SELECT document_id, unnest(list_concat(coalesce(tags, []), coalesce(related_ids, []))) x FROM (SELECT document_id, max_by(tags, ingested_at) tags, max_by(related_ids, ingested_at) related_ids FROM canonical_documents GROUP BY 1))
    SELECT document_id, count(DISTINCT x) n FROM e WHERE x IS NOT NULL GROUP BY 1""")
def set_u06_ordered_union(spark: SparkSession, base: str) -> DataFrame:
    """Two lists of a document as one without repeats, first occurrences kept."""
    empty = F.array().cast("array<string>")
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["tags", "related_ids"])
    merged = F.array_compact(F.array_distinct(F.concat(F.coalesce("tags", empty), F.coalesce("related_ids", empty))))
    return rows.select("document_id", F.size(merged).cast("bigint").alias("n")).filter("n > 0")


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY loaded_at DESC) n FROM tickets WHERE ticket_id IS NOT NULL) SELECT ticket_id, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') loaded FROM u WHERE n = 1""")
def sink_k09_upsert(spark: SparkSession, base: str) -> DataFrame:
    """Early rows with later ones merged in by key."""
    rows = table(spark, base, "tickets")
    old, new = rows.filter("loaded_at < TIMESTAMP_NTZ'2025-07-01'"), rows.filter("loaded_at >= TIMESTAMP_NTZ'2025-07-01'")
    return R.upsert(old, new, "ticket_id", "loaded_at").select("ticket_id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@query("SELECT DISTINCT chunk_id FROM document_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE chunk_id IS NOT NULL)")
def sink_k11_resume(spark: SparkSession, base: str) -> DataFrame:
    """Chunks that still lack a vector: what a resumed embedding job has to do."""
    return R.key_difference(table(spark, base, "document_chunks").select("chunk_id"), table(spark, base, "chunk_vectors"), "chunk_id").distinct()
