"""Registered queries: the remaining operators of each family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.typing import loose_double, loosely_equal
from tessella.operators import metrics, ranking
from tessella.operators import retrieval as V
from tessella.operators import rules
from tessella.plans import retrieval as RQ
from tessella.plans.graphs import _EDGES_SQL, _GRAPH_SQL, _edges, _nodes
from tessella.plans.register import register
from tessella.plans.texts import _MENTIONS_SQL, _mentions
from tessella.schemas import TABLES
from tessella.sources.tables import latest_rows, table

QUERIES, query = register()


_KEPT = [c for c in TABLES["customer_master"].kinds if c in ("customer_id", "circle", "account_type", "kyc_status", "status")]


@query("SELECT DISTINCT customer_id, circle, account_type, kyc_status, status FROM customer_master")
def proj_p07_allowed_columns(spark: SparkSession, base: str) -> DataFrame:
    """Key and preferred columns in declared order; the status is kept, which a cap on their number would lose."""
    return table(spark, base, "customer_master").select(*_KEPT).distinct()


@query(RQ._knn_sql(10).replace("FROM q JOIN v ON id <> query_id", "FROM q JOIN v ON id <> query_id AND label < 5") + ' SELECT query_id, id, CAST(r AS INTEGER) "rank" FROM near')
def proj_p10_corpus_filter(spark: SparkSession, base: str) -> DataFrame:
    """The corpus filter goes before the search, so no over-fetch is needed."""
    vectors = RQ._vectors(spark, base)
    near = V.nearest(RQ._asked(vectors), vectors.filter("label < 5"), 11).filter("query_id <> id").drop("rank")
    return ranking.top_n(near, ["query_id"], [F.col("score").desc(), F.col("id").asc()], 10).select("query_id", "id", "rank")


@query("SELECT o_custkey query_id, count(*) n_relevant FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def proj_p11_valid_queries(spark: SparkSession, base: str) -> DataFrame:
    """Queries with a relevant document in the index, and how many."""
    indexed = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, base, "orders").select("o_custkey", "o_orderkey").join(indexed, "o_orderkey", "left_semi").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count(F.lit(1)).alias("n_relevant"))


@query("""WITH d AS (SELECT document_id, max_by(tags, ingested_at) tags FROM canonical_documents GROUP BY 1), m AS (SELECT document_id, unnest(tags) tag FROM d)
    SELECT tag, min(document_id) first_document, count(*) n_mentions, count(*) - 1 n_collapsed FROM m WHERE tag IS NOT NULL GROUP BY 1""")
def agg_a14_first_mention(spark: SparkSession, base: str) -> DataFrame:
    """One node per tag: the first document that names it wins, the others collapse into it."""
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["tags"]).select("document_id", F.explode("tags").alias("tag")).filter("tag IS NOT NULL")
    return rows.groupBy("tag").agg(F.min("document_id").alias("first_document"), F.count(F.lit(1)).alias("n_mentions"), (F.count(F.lit(1)) - 1).alias("n_collapsed"))


@query(RQ._knn_sql(20) + """ SELECT query_id, CAST(id // 5 AS BIGINT) document_id, id, round(score, 6) score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id // 5 ORDER BY score DESC, id) i FROM near) WHERE i = 1""")
def rank_a24_best_row(spark: SparkSession, base: str) -> DataFrame:
    """The best vector of each document found for a query, the first on ties."""
    rows = RQ._ranked(spark, base, 20).withColumn("document_id", F.expr("id div 5"))
    best = ranking.best_per_document(rows, "query_id", "document_id", "score", [F.col("score").desc(), F.col("id").asc()])
    return best.select("query_id", "document_id", "id", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT document_id, max_by(category, ingested_at) category, max_by(tags, ingested_at) tags FROM canonical_documents GROUP BY 1)
    SELECT category, count(DISTINCT t) n_tags FROM (SELECT category, unnest(tags) t FROM d) WHERE category IS NOT NULL AND t IS NOT NULL GROUP BY 1""")
def set_u01_union(spark: SparkSession, base: str) -> DataFrame:
    """The union of the tag sets of each category, as its size."""
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["category", "tags"])
    return rows.select("category", F.explode("tags").alias("t")).filter("category IS NOT NULL AND t IS NOT NULL").groupBy("category").agg(F.count_distinct("t").alias("n_tags"))


@query(f"WITH {_EDGES_SQL} SELECT type AS edge_type, count(*) n, count(*) - count(DISTINCT src || '>' || dst) n_collapsed FROM edges GROUP BY 1")
def set_u02_union_all(spark: SparkSession, base: str) -> DataFrame:
    """Edges of all sources in one frame; identical (src, dst, type) must not collapse."""
    return _edges(spark, base).groupBy(F.col("type").alias("edge_type")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("src", "dst")).alias("n_collapsed"))


_FOLDERS = {"faq": "FAQ", "kb": "KNOWLEDGE_BASE", "sop": "PROCEDURE", "policy": "POLICY"}


@query("WITH p AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '([^/]+)/[^/]*$', 1)) f FROM canonical_documents WHERE file_path IS NOT NULL) SELECT file_path, CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FOLDERS.items()) + " ELSE 'PUBLIC_DOCUMENT' END document_kind FROM p")
def fn_f10_folder_type(spark: SparkSession, base: str) -> DataFrame:
    folder = F.lower(F.regexp_extract("file_path", "([^/]+)/[^/]*$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in _FOLDERS.items() for x in pair])
    return table(spark, base, "canonical_documents").filter("file_path IS NOT NULL").select("file_path", F.coalesce(kinds[folder], F.lit("PUBLIC_DOCUMENT")).alias("document_kind")).distinct()


@query("SELECT CASE WHEN document_id LIKE 'FAQ%' THEN 'faq' WHEN document_id LIKE 'KB%' THEN 'kb' ELSE 'other' END dataset, count(DISTINCT document_id) n FROM canonical_documents GROUP BY 1")
def fn_f13_dataset(spark: SparkSession, base: str) -> DataFrame:
    dataset = F.when(F.col("document_id").startswith("FAQ"), "faq").when(F.col("document_id").startswith("KB"), "kb").otherwise("other")
    return table(spark, base, "canonical_documents").groupBy(dataset.alias("dataset")).agg(F.count_distinct("document_id").alias("n"))


@query("""SELECT DISTINCT ticket_id, CASE WHEN length(description) <= 40 THEN description WHEN regexp_extract(left(description, 41), '(?s)^(.*)[ \\t\\r\\n]', 1) <> '' THEN regexp_replace(regexp_extract(left(description, 41), '(?s)^(.*)[ \\t\\r\\n]', 1), '[ \\t\\r\\n]+$', '') ELSE left(description, 40) END snippet
    FROM tickets WHERE description IS NOT NULL""")
def fn_f17_cut_at_word(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tickets").filter("description IS NOT NULL").select("ticket_id", X.cut_at_word(F.col("description"), 40).alias("snippet")).distinct()


_NEGATION = "\\b(no|not|never|without|neither)\\b"


@query(f"""WITH p AS (SELECT doc_id, string_split(lower(text), 'refund') p FROM documents WHERE contains(lower(text), 'refund')),
    i AS (SELECT doc_id, p, unnest(range(1, len(p))) i FROM p),
    m AS (SELECT doc_id, array_to_string(p[1:i], 'refund') before, p[i + 1] after, i + 1 = len(p) final FROM i),
    t AS (SELECT doc_id, regexp_matches(right(before, 60), '{_NEGATION}') negated, regexp_matches(before, '(?:\\A|\\n)#{{1,6}}[ \\t]*\\z') AND (regexp_matches(after, '\\A[ \\t\\r]*\\n') OR final AND regexp_matches(after, '\\A[ \\t\\r]*\\z')) heading FROM m)
    SELECT doc_id, coalesce(bool_and(negated) FILTER (NOT heading), FALSE) negated FROM t GROUP BY 1""")
def fn_f26_negated(spark: SparkSession, base: str) -> DataFrame:
    """Whether a negation stands within 60 characters before every mention; the whole of a heading is no mention."""
    rows = table(spark, base, "documents").select("doc_id", F.split(F.lower("text"), "refund", -1).alias("_p")).filter("size(_p) > 1")

    def mention(part: Column, i: Column) -> Column:
        first = F.greatest(i - 9, F.lit(1))  # ten parts and the terms between are 60 characters at least
        before = F.array_join(F.slice("_p", first, i + 2 - first), "refund")
        after = F.get("_p", i + 1)
        ends_line = after.rlike(r"^[ \t\r]*\n") | (after.rlike(r"^[ \t\r]*\z") & (i + 2 == F.size("_p")))
        heading = before.rlike(r"(?:\A|\n)#{1,6}[ \t]*\z") & ends_line
        return F.struct(heading.alias("heading"), F.right(before, F.lit(60)).rlike(_NEGATION).alias("negated"))

    mentions = F.filter(F.transform(F.slice("_p", F.lit(1), F.size("_p") - 1), mention), lambda m: ~m["heading"])
    return rows.select("doc_id", mentions.alias("_m")).select("doc_id", ((F.size("_m") > 0) & F.forall("_m", lambda m: m["negated"])).alias("negated"))


@query("SELECT customer_id, coalesce(try_cast(msisdn AS DOUBLE), 0) number, count(*) n FROM customer_master GROUP BY 1, 2")
def fn_f29_loose_number(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "customer_master").groupBy("customer_id", loose_double(F.col("msisdn")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.subscription_id, bool_or(CASE WHEN try_cast(s.msisdn AS DOUBLE) IS NOT NULL AND try_cast(c.msisdn AS DOUBLE) IS NOT NULL THEN try_cast(s.msisdn AS DOUBLE) = try_cast(c.msisdn AS DOUBLE) ELSE s.msisdn = c.msisdn END) same
    FROM subscriptions s JOIN customer_master c ON s.customer_id = c.customer_id WHERE s.msisdn IS NOT NULL AND c.msisdn IS NOT NULL GROUP BY 1""")
def fn_f32_loosely_equal(spark: SparkSession, base: str) -> DataFrame:
    """Numbers equal as numbers where both are, else as texts."""
    c = table(spark, base, "customer_master").filter("msisdn IS NOT NULL").select("customer_id", F.col("msisdn").alias("own"))
    joined = table(spark, base, "subscriptions").filter("msisdn IS NOT NULL").select("subscription_id", "customer_id", "msisdn").join(c, "customer_id")
    return joined.groupBy("subscription_id").agg(F.bool_or(loosely_equal(F.col("msisdn"), F.col("own"))).alias("same"))


@query(RQ._knn_sql() + " SELECT query_id, bool_or(label = query_label AND r <= 3) hit_3, bool_or(label = query_label AND r <= 10) hit_10 FROM near GROUP BY 1")
def eval_e06_category_hit(spark: SparkSession, base: str) -> DataFrame:
    vectors = RQ._vectors(spark, base)
    rows = RQ._ranked(spark, base).join(vectors.select("id", "label"), "id").join(RQ._asked(vectors).select("query_id", "query_label"), "query_id")
    hit = F.col("label") == F.col("query_label")
    return rows.groupBy("query_id").agg(F.bool_or(hit & (F.col("rank") <= 3)).alias("hit_3"), F.bool_or(hit).alias("hit_10"))


@query(" UNION ALL ".join(f"(SELECT {w}::DOUBLE weight, query_id, d document_id FROM ({RQ._fused_sql(w)} SELECT * FROM fused WHERE r <= 3))" for w in ("0.0", "0.15", "0.5")))
def eval_e10_weight_sweep(spark: SparkSession, base: str) -> DataFrame:
    """The first three documents under each graph weight; both lists are ranked once."""
    lists = RQ._lists(spark, base, 1.0)
    weights = F.explode(F.array(*[F.lit(w) for w in (0.0, 0.15, 0.5)]))
    swept = lists.withColumn("_w", weights).withColumn("weight", F.when(F.col("list_name") == "vector", 1.0).otherwise(F.col("_w")))
    keyed = swept.select(F.struct(F.col("_w").alias("w"), "query_id").alias("query_id"), "list_name", "document_id", "rank", "weight")
    fused = V.reciprocal_rank_fusion(keyed).filter("rank <= 3")
    return fused.select(F.col("query_id.w").alias("weight"), F.col("query_id.query_id").alias("query_id"), "document_id")


@query(RQ._fused_sql("0.5") + """, rel AS (SELECT DISTINCT q.query_id, CAST(v.id // 5 AS BIGINT) d FROM q JOIN v ON v.label = q.query_label AND v.id <> q.query_id),
    arms AS (SELECT 'vector' arm, query_id, CAST(d AS BIGINT) d, r FROM docs UNION ALL SELECT 'graph', query_id, d, r FROM grown UNION ALL SELECT 'fused', query_id, d, r FROM fused),
    reached AS (SELECT a.arm, a.query_id, min(r) FILTER (rel.d IS NOT NULL AND r <= 5) best FROM arms a LEFT JOIN rel ON a.query_id = rel.query_id AND a.d = rel.d GROUP BY 1, 2)
    SELECT arm, round(sum(coalesce(1.0 / best, 0)) / (SELECT count(DISTINCT query_id) FROM rel), 6)::DOUBLE mrr_5, round(count(best) / (SELECT count(DISTINCT query_id) FROM rel), 6) hit_5 FROM reached GROUP BY 1""")
def eval_e17_arms(spark: SparkSession, base: str) -> DataFrame:
    """Vector, graph and fused lists under the same metrics."""
    arms = {"vector": RQ._vector_list(spark, base), "graph": RQ._graph_list(spark, base), "fused": V.reciprocal_rank_fusion(RQ._lists(spark, base, 0.5))}
    out = [metrics.mean_scores(metrics.query_scores(RQ.judged_documents(spark, base, a), (5,), 5)).select(F.lit(n).alias("arm"), F.col("reciprocal_rank").alias("mrr_5"), "hit_5") for n, a in arms.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"{_GRAPH_SQL} SELECT n.id, count(DISTINCT i.src) n_in, count(DISTINCT o.dst) n_out FROM nodes n LEFT JOIN (SELECT * FROM edges WHERE type = 'OF_CUSTOMER') i ON i.dst = n.id LEFT JOIN (SELECT * FROM edges WHERE type = 'OF_CUSTOMER') o ON o.src = n.id GROUP BY 1")
def graph_g09_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """Neighbours of each node by one edge type, in and out, counted before they meet."""
    edges = _edges(spark, base).filter("type = 'OF_CUSTOMER'")
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("_i"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("_o"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return _nodes(spark, base).select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("_i", "n_in"), zero("_o", "n_out"))


@query("""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'sim swap', ''))) / 8 AS BIGINT) n_matches FROM documents WHERE contains(lower(text), 'sim swap')""")
def graph_g11_by_match_count(spark: SparkSession, base: str) -> DataFrame:
    """Documents that mention a service, with how often."""
    rows = table(spark, base, "documents").select("doc_id", F.lower("text").alias("_t")).filter(F.col("_t").contains("sim swap"))
    return rows.select("doc_id", ((F.length("_t") - F.length(F.replace("_t", F.lit("sim swap"), F.lit("")))) / 8).cast("bigint").alias("n_matches"))


@query(_MENTIONS_SQL + """, s AS (SELECT doc_id FROM m WHERE concept = 'SIM swap') SELECT label, concept, count(*) support FROM m WHERE concept <> 'SIM swap' AND doc_id IN (SELECT doc_id FROM s) GROUP BY 1, 2""")
def graph_g12_profile(spark: SparkSession, base: str) -> DataFrame:
    """What stands beside one service, by support."""
    m = _mentions(spark, base)
    holders = m.filter("concept = 'SIM swap'").select("doc_id")
    return m.filter("concept <> 'SIM swap'").join(holders, "doc_id", "left_semi").groupBy("label", "concept").agg(F.count(F.lit(1)).alias("support"))


@query("""WITH d AS (SELECT document_id, max_by(department, ingested_at) department, upper(trim(max_by(document_type, ingested_at), ' ' || chr(9) || chr(10) || chr(13))) kind FROM canonical_documents GROUP BY 1)
    SELECT department, kind, count(*) n FROM d WHERE department IS NOT NULL AND kind <> '' GROUP BY 1, 2""")
def graph_g13_by_department(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["department", "document_type"])
    kind = F.upper(F.trim("document_type", F.lit(" \t\r\n")))
    return rows.select("department", kind.alias("kind")).filter("department IS NOT NULL AND kind <> ''").groupBy("department", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT customer_id, ticket_id, category FROM tickets WHERE customer_id IS NOT NULL AND ticket_id IS NOT NULL""")
def graph_g14_tickets_of(spark: SparkSession, base: str) -> DataFrame:
    """The tickets of every customer."""
    return table(spark, base, "tickets").filter("customer_id IS NOT NULL AND ticket_id IS NOT NULL").select("customer_id", "ticket_id", "category").distinct()


@query("""WITH d AS (SELECT document_id, max_by(category, ingested_at) category FROM canonical_documents GROUP BY 1), t AS (SELECT category, count(*) n FROM tickets WHERE category IS NOT NULL GROUP BY 1), c AS (SELECT category, count(*) n FROM d WHERE category IS NOT NULL GROUP BY 1)
    SELECT coalesce(t.category, c.category) concept, coalesce(t.n, 0) n_tickets, coalesce(c.n, 0) n_documents, t.n IS NOT NULL AND c.n IS NOT NULL bridges FROM t FULL JOIN c ON lower(t.category) = lower(c.category)""")
def graph_g19_concept_layer(spark: SparkSession, base: str) -> DataFrame:
    """Concepts named on both sides bridge the two graphs; the others are reported unmapped."""
    t = table(spark, base, "tickets").filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("_t"))
    docs = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["category"]).filter("category IS NOT NULL")
    c = docs.groupBy(F.col("category").alias("_category")).agg(F.count(F.lit(1)).alias("_c"))
    joined = t.join(c, F.lower("category") == F.lower("_category"), "full")
    zero = lambda x, n: F.coalesce(x, F.lit(0)).alias(n)
    return joined.select(F.coalesce("category", "_category").alias("concept"), zero("_t", "n_tickets"), zero("_c", "n_documents"), (F.col("_t").isNotNull() & F.col("_c").isNotNull()).alias("bridges"))


_HINTS = ["refund", "recharge", "sim swap", "sim", "roaming pack", "roaming"]


@query("""WITH t AS (SELECT DISTINCT ticket_id, lower(description) d FROM tickets WHERE description IS NOT NULL), h(w) AS (VALUES """ + ", ".join(f"('{w}')" for w in _HINTS) + """),
    p AS (SELECT ticket_id, w, row_number() OVER (PARTITION BY ticket_id, d ORDER BY strpos(d, w), length(w) DESC) n FROM t JOIN h ON contains(d, w)) SELECT DISTINCT ticket_id, w hint FROM p WHERE n = 1""")
def rule_q08_concept_hint(spark: SparkSession, base: str) -> DataFrame:
    """The keyword that comes first, the longest of those at one place."""
    d = F.lower("description")
    places = F.array_compact(F.array(*[F.when(F.instr(d, w) > 0, F.struct(F.instr(d, w).alias("at"), F.lit(-len(w)).alias("n"), F.lit(w).alias("w"))) for w in _HINTS]))
    return table(spark, base, "tickets").filter("description IS NOT NULL").select("ticket_id", F.array_min(places)["w"].alias("hint")).filter("hint IS NOT NULL").distinct()


@query("SELECT DISTINCT ticket_id, 'F' || (ticket_id % 7) || ',D2' cited FROM tickets WHERE ticket_id IS NOT NULL")
def rule_q18_citations(spark: SparkSession, base: str) -> DataFrame:
    """Distinct marks of an answer, in order."""
    answer = F.format_string("See [F%s] and [D2], [F%s].", F.col("ticket_id") % 7, F.col("ticket_id") % 7)
    rows = table(spark, base, "tickets").filter("ticket_id IS NOT NULL").select("ticket_id").distinct()
    return rows.select("ticket_id", F.array_join(rules.citations(answer), ",").alias("cited"))


@query("SELECT chunk_id, any_value(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n]+', ' ', 'g')) text FROM document_chunks WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT text) = 1")
def sup_x03_text_map(spark: SparkSession, base: str) -> DataFrame:
    """Piece texts with whitespace collapsed, for pairing."""
    rows = table(spark, base, "document_chunks").filter("text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("text"), F.max("text").alias("_other")).filter("text = _other")
    return rows.select("chunk_id", F.regexp_replace(F.trim("text", F.lit(" \t\r\n")), "[ \t\r\n]+", " ").alias("text"))


@query("""WITH s AS (SELECT chunk_id, document_id FROM document_chunks WHERE chunk_id IS NOT NULL), v AS (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE chunk_id IS NOT NULL)
    SELECT count(DISTINCT s.chunk_id) n_chunks, (SELECT count(*) FROM v) n_vectors, count(DISTINCT s.chunk_id) FILTER (v.chunk_id IS NOT NULL) n_both FROM s LEFT JOIN v ON s.chunk_id = v.chunk_id""")
def sup_x23_index_integrity(spark: SparkSession, base: str) -> DataFrame:
    """Pieces, vectors and what both sides have."""
    s = table(spark, base, "document_chunks").filter("chunk_id IS NOT NULL").select("chunk_id").distinct().withColumn("_s", F.lit(1))
    v = table(spark, base, "chunk_vectors").filter("chunk_id IS NOT NULL").select("chunk_id").distinct().withColumn("_v", F.lit(1))
    return s.join(v, "chunk_id", "full").agg(F.count("_s").alias("n_chunks"), F.count("_v").alias("n_vectors"), F.count(F.when(F.col("_s").isNotNull() & F.col("_v").isNotNull(), 1)).alias("n_both"))


@query("SELECT doc_kind, approx FROM (SELECT coalesce(doc_kind, '') doc_kind, count(DISTINCT source) > 0 approx FROM documents GROUP BY 1)")
def agg_a29_approximate(spark: SparkSession, base: str) -> DataFrame:
    """A sketch instead of an exact distinct count, within 10 % of it."""
    exact, sketch = F.count_distinct("source"), F.approx_count_distinct("source", 0.02)
    rows = table(spark, base, "documents").groupBy(F.coalesce("doc_kind", F.lit("")).alias("doc_kind")).agg(exact.alias("_e"), sketch.alias("_a"))
    return rows.select("doc_kind", (F.abs(F.col("_a") - F.col("_e")) <= 0.1 * F.col("_e") + 1).alias("approx"))


@query("""SELECT l_orderkey, max(l_linenumber) last_line, sum(l_linenumber) FILTER (l_returnflag = 'R') returned FROM lineitem GROUP BY 1 HAVING count(*) > 5""")
def agg_a12_having(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_line"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("returned"), F.count(F.lit(1)).alias("_n"))
    return rows.filter("_n > 5").drop("_n")
