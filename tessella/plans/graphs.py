"""Registered queries: the relational graph, the document graph and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators.retrieval import shared_hub_expansion
from tessella.plans.register import register
from tessella.sources.tables import BLANKS, latest_rows, table

QUERIES, query = register()
#: Entity, table, key.
ENTITIES = [("Customer", "customer_master", "customer_id"), ("Plan", "plan_master", "plan_id"), ("Subscription", "subscriptions", "subscription_id"), ("Ticket", "tickets", "ticket_id")]
#: Child entity, its foreign key, parent entity, edge type.
REFERENCES = [("Subscription", "customer_id", "Customer", "OF_CUSTOMER"), ("Subscription", "plan_id", "Plan", "ON_PLAN"), ("Ticket", "customer_id", "Customer", "OF_CUSTOMER")]
_TABLE = {e: (t, k) for e, t, k in ENTITIES}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _nodes(spark: SparkSession, base: str) -> DataFrame:
    return _union([G.row_nodes(table(spark, base, t), e, k) for e, t, k in ENTITIES])


def _edges(spark: SparkSession, base: str) -> DataFrame:
    return _union([G.reference_edges(table(spark, base, _TABLE[child][0]), child, _TABLE[child][1], column, parent, kind) for child, column, parent, kind in REFERENCES])


_NODES_SQL = "nodes AS (" + " UNION ".join(f"SELECT '{e}::' || {k} id, '{e}' AS label FROM {t} WHERE {k} IS NOT NULL" for e, t, k in ENTITIES) + ")"
_EDGES_SQL = "edges AS (" + " UNION ".join(f"SELECT '{c}::' || {_TABLE[c][1]} src, '{p}::' || {col} dst, '{kind}' AS type FROM {_TABLE[c][0]} WHERE {col} IS NOT NULL" for c, col, p, kind in REFERENCES) + ")"
_GRAPH_SQL = f"WITH RECURSIVE {_NODES_SQL}, {_EDGES_SQL}"


@query(f"{_GRAPH_SQL} SELECT 'node ' || label AS kind, count(*) n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges GROUP BY 1")
def graph_g05_counts(spark: SparkSession, base: str) -> DataFrame:
    nodes = _nodes(spark, base).groupBy(F.concat(F.lit("node "), "label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(_edges(spark, base).groupBy(F.concat(F.lit("edge "), "type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query(f"{_GRAPH_SQL} SELECT type AS edge_type, count(*) n FROM edges WHERE dst NOT IN (SELECT id FROM nodes) GROUP BY 1")
def graph_j19_dangling(spark: SparkSession, base: str) -> DataFrame:
    """Edges with an unknown end: none may enter a finished graph."""
    return G.dangling(_edges(spark, base), _nodes(spark, base)).filter("missing = 'dst'").groupBy(F.col("type").alias("edge_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) n_nodes, (SELECT count(*) FROM edges) n_edges, round(2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 4)::DOUBLE average_degree")
def graph_a15_stats(spark: SparkSession, base: str) -> DataFrame:
    n, e = _nodes(spark, base).agg(F.count(F.lit(1)).alias("n_nodes")), _edges(spark, base).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(F.broadcast(e)).select("n_nodes", "n_edges", F.round(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes")), 4).alias("average_degree"))


@query(f"{_GRAPH_SQL}, ends AS (SELECT src id, type FROM edges UNION ALL SELECT dst, type FROM edges) SELECT id, count(*) degree, count(DISTINCT type) n_types FROM ends WHERE id NOT LIKE 'Plan%' GROUP BY 1 ORDER BY degree DESC, id LIMIT 15")
def graph_l08_top_hubs(spark: SparkSession, base: str) -> DataFrame:
    """The nodes with most edges, plans excluded."""
    return G.degrees(_edges(spark, base)).filter("NOT startswith(id, 'Plan')").orderBy(F.col("degree").desc(), "id").limit(15)


@query(f"{_GRAPH_SQL} SELECT dst, type, count(DISTINCT src) n_children FROM edges GROUP BY 1, 2")
def graph_j06_children(spark: SparkSession, base: str) -> DataFrame:
    return G.children_counts(_edges(spark, base))


@query(f"{_GRAPH_SQL} SELECT e.src, e.dst, n.label AS parent_label, n.id IS NOT NULL known FROM edges e LEFT JOIN nodes n ON e.dst = n.id WHERE e.type = 'ON_PLAN'")
def graph_j07_parents(spark: SparkSession, base: str) -> DataFrame:
    """Forward hop of one edge type."""
    nodes = _nodes(spark, base).select(F.col("id").alias("dst"), F.col("label").alias("parent_label"))
    return _edges(spark, base).filter("type = 'ON_PLAN'").join(nodes, "dst", "left").select("src", "dst", "parent_label", F.col("parent_label").isNotNull().alias("known"))


@query(f"{_GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE label IN ('Subscription', 'Plan')) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def graph_u07_subgraph(spark: SparkSession, base: str) -> DataFrame:
    return G.subgraph(_edges(spark, base), _nodes(spark, base).filter("label IN ('Subscription', 'Plan')").select("id")).select("src", "dst", "type")


@query(f"""{_GRAPH_SQL}, links AS (SELECT src a, dst b FROM edges WHERE type = 'OF_CUSTOMER' UNION SELECT dst, src FROM edges WHERE type = 'OF_CUSTOMER'),
    walk(id, reached) AS (SELECT id, id FROM nodes UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.reached)
    SELECT id, min(reached) component FROM walk GROUP BY 1""")
def graph_g08_components(spark: SparkSession, base: str) -> DataFrame:
    """Everything that hangs together through customers."""
    return G.components(_nodes(spark, base), _edges(spark, base).filter("type = 'OF_CUSTOMER'"))


@query(f"""{_GRAPH_SQL}, links AS (SELECT src a, dst b FROM edges UNION SELECT dst, src FROM edges),
    walk(id, hops) AS (SELECT id, 0 FROM nodes WHERE label = 'Plan' UNION SELECT l.b, w.hops + 1 FROM walk w JOIN links l ON l.a = w.id WHERE w.hops < 8),
    least AS (SELECT id, min(hops) hops FROM walk GROUP BY 1) SELECT hops, count(*) n FROM least GROUP BY 1""")
def graph_g07_hops(spark: SparkSession, base: str) -> DataFrame:
    """Nodes by fewest edges from any plan, up to eight."""
    return G.hops(_edges(spark, base), _nodes(spark, base).filter("label = 'Plan'"), 8).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_GRAPH_SQL}, e2 AS (SELECT * FROM edges WHERE type <> 'ON_PLAN'), links AS (SELECT src a, dst b FROM e2 UNION SELECT dst, src FROM e2),
    walk(id, hops) AS (SELECT id, 0 FROM nodes WHERE label = 'Plan' UNION SELECT l.b, w.hops + 1 FROM walk w JOIN links l ON l.a = w.id WHERE w.hops < 4) SELECT count(DISTINCT id) n_reached FROM walk""")
def graph_e19_without_bridge(spark: SparkSession, base: str) -> DataFrame:
    """The same walk without the edges that bridge plans to the rest."""
    return G.hops(_edges(spark, base).filter("type <> 'ON_PLAN'"), _nodes(spark, base).filter("label = 'Plan'"), 4).agg(F.count(F.lit(1)).alias("n_reached"))


_DOCS_SQL = """d AS (SELECT document_id, max_by(category, ingested_at) category, max_by(department, ingested_at) department, max_by(related_ids, ingested_at) related_ids, max_by(tags, ingested_at) tags FROM canonical_documents GROUP BY 1)"""
_TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["category", "department", "related_ids", "tags"])


@query(f"""WITH {_DOCS_SQL}, r AS (SELECT DISTINCT document_id src, upper(trim(u, {_TRIM})) dst FROM (SELECT document_id, unnest(related_ids) u FROM d)), k AS (SELECT DISTINCT upper(trim(document_id, {_TRIM})) dst FROM d)
    SELECT src, r.dst, k.dst IS NOT NULL resolved FROM r LEFT JOIN k ON r.dst = k.dst WHERE r.dst <> ''""")
def graph_g02_related(spark: SparkSession, base: str) -> DataFrame:
    """RELATED_TO edges; those to unknown documents stay, marked."""
    bare = lambda c: F.upper(F.trim(c, F.lit(BLANKS)))
    docs = _docs(spark, base)
    refs = docs.select(F.col("document_id").alias("src"), F.explode("related_ids").alias("_u")).select("src", bare(F.col("_u")).alias("dst")).filter("dst <> ''").distinct()
    known = docs.select(bare(F.col("document_id")).alias("dst")).distinct().withColumn("_k", F.lit(True))
    return refs.join(known, "dst", "left").select("src", "dst", F.coalesce("_k", F.lit(False)).alias("resolved"))


@query(f"""WITH {_DOCS_SQL}, r AS (SELECT DISTINCT upper(trim(u, {_TRIM})) id FROM (SELECT unnest(related_ids) u FROM d)) SELECT id, 'stub' AS kind FROM r WHERE id <> '' AND id NOT IN (SELECT upper(trim(document_id, {_TRIM})) FROM d)""")
def graph_g01_stubs(spark: SparkSession, base: str) -> DataFrame:
    """Stub nodes of documents that are only named."""
    return graph_g02_related(spark, base).filter("NOT resolved").select(F.col("dst").alias("id"), F.lit("stub").alias("kind")).distinct()


@query(f"""WITH {_DOCS_SQL} SELECT category, department, count(*) n, min(document_id) first_id FROM d WHERE category IS NOT NULL GROUP BY 1, 2""")
def graph_g10_by_category(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).filter("category IS NOT NULL").groupBy("category", "department").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first_id"))


_HUBS_SQL = f"""{_DOCS_SQL}, h AS (SELECT document_id, 'Category' l, category c FROM d WHERE category IS NOT NULL UNION SELECT document_id, 'Department', department FROM d WHERE department IS NOT NULL UNION SELECT document_id, 'Tag', t FROM (SELECT document_id, unnest(tags) t FROM d) WHERE t IS NOT NULL)"""


@query(f"""WITH {_HUBS_SQL}, q AS (SELECT document_id FROM d WHERE try_cast(regexp_extract(document_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
    p AS (SELECT q.document_id query_id, m2.document_id, count(*) n_shared FROM q JOIN h m1 ON q.document_id = m1.document_id JOIN h m2 ON m1.l = m2.l AND m1.c = m2.c AND m2.document_id <> q.document_id GROUP BY 1, 2)
    SELECT query_id, document_id, n_shared, CAST(r AS INTEGER) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_shared DESC, document_id) r FROM p) WHERE r <= 10""")
def graph_j10_related(spark: SparkSession, base: str) -> DataFrame:
    """For documents whose number is divisible by 100: the ten that share most hubs with them."""
    docs = _docs(spark, base)
    hubs = [docs.select("document_id", F.lit(n).alias("label"), F.col(c).alias("concept")) for n, c in (("Category", "category"), ("Department", "department"))]
    tags = docs.select("document_id", F.lit("Tag").alias("label"), F.explode("tags").alias("concept"))
    asked = docs.filter(F.regexp_extract("document_id", "([0-9]+)$", 1).try_cast("bigint") % 100 == 0).select(F.col("document_id").alias("query_id"), "document_id", F.lit(0).alias("rank"))
    return shared_hub_expansion(asked, _union([*hubs, tags]), 10).select("query_id", "document_id", "n_shared", "rank")


@query(f"""WITH {_HUBS_SQL} SELECT l AS hub_label, c concept, count(*) n FROM h GROUP BY 1, 2""")
def graph_g20_hub_index(spark: SparkSession, base: str) -> DataFrame:
    docs = _docs(spark, base)
    hubs = [docs.select("document_id", F.lit(n).alias("hub_label"), F.col(c).alias("concept")) for n, c in (("Category", "category"), ("Department", "department"))]
    tags = docs.select("document_id", F.lit("Tag").alias("hub_label"), F.explode("tags").alias("concept"))
    return _union([*hubs, tags]).filter("concept IS NOT NULL").distinct().groupBy("hub_label", "concept").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT plan_id, count(DISTINCT subscription_id) n_subscriptions, count(DISTINCT customer_id) n_customers FROM subscriptions GROUP BY 1),
    t AS (SELECT s.plan_id, count(DISTINCT t.ticket_id) n_tickets FROM (SELECT DISTINCT plan_id, customer_id FROM subscriptions) s JOIN tickets t USING (customer_id) GROUP BY 1)
    SELECT p.plan_id, coalesce(n_subscriptions, 0) n_subscriptions, coalesce(n_customers, 0) n_customers, coalesce(n_tickets, 0) n_tickets FROM plan_master p LEFT JOIN s USING (plan_id) LEFT JOIN t USING (plan_id)""")
def graph_j15_bridge(spark: SparkSession, base: str) -> DataFrame:
    """Coverage of a concept from two optional sides, each counted before the join."""
    subs = table(spark, base, "subscriptions")
    s = subs.groupBy("plan_id").agg(F.count_distinct("subscription_id").alias("_s"), F.count_distinct("customer_id").alias("_c"))
    t = subs.select("plan_id", "customer_id").distinct().join(table(spark, base, "tickets").select("customer_id", "ticket_id"), "customer_id").groupBy("plan_id").agg(F.count_distinct("ticket_id").alias("_t"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return table(spark, base, "plan_master").select("plan_id").join(s, "plan_id", "left").join(t, "plan_id", "left").select("plan_id", zero("_s", "n_subscriptions"), zero("_c", "n_customers"), zero("_t", "n_tickets"))
