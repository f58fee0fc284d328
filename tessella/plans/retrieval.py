"""Registered queries: vector search, fusion, reranking and their metrics.

Queries are the rows whose id is divisible by 100, searched against all rows. ``vec_id`` div 5 is a
vector's document, ``label`` its category and what makes it relevant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.vectors import dot
from tessella.operators import metrics, ranking
from tessella.operators import relational as R
from tessella.operators import retrieval as V
from tessella.plans.register import register
from tessella.sources.tables import latest_rows, table

QUERIES, query = register()
GRAPH_WEIGHT = 0.5


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def _ranked(spark: SparkSession, base: str, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank) without the query itself."""
    vectors = _vectors(spark, base)
    near = V.nearest(_asked(vectors), vectors, k + 1).filter("query_id <> id").drop("rank")
    return ranking.top_n(near, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)


def _knn_sql(k: int = 10) -> str:
    return f"""WITH v AS (SELECT vec_id id, CAST(embedding AS DOUBLE[]) e, label FROM embeddings), q AS (SELECT id query_id, e qe, label query_label FROM v WHERE id % 100 = 0),
    s AS (SELECT query_id, query_label, id, label, list_dot_product(qe, e) score FROM q JOIN v ON id <> query_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM s) WHERE r <= {k})"""


@query(_knn_sql() + ' SELECT query_id, id, round(score, 6) score, CAST(r AS INTEGER) "rank" FROM near')
def ret_r01_nearest(spark: SparkSession, base: str) -> DataFrame:
    return _ranked(spark, base).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_VECTOR_LIST_SQL = _knn_sql() + """, docs AS (SELECT query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY r) r FROM (SELECT query_id, id // 5 d, min(r) r FROM near GROUP BY 1, 2))"""


def _vector_list(spark: SparkSession, base: str) -> DataFrame:
    """(query_id, document_id, rank): documents in the order of their first vector."""
    first = _ranked(spark, base).groupBy("query_id", F.expr("id div 5").alias("document_id")).agg(F.min("rank").alias("_r"))
    return ranking.top_n(first, ["query_id"], [F.col("_r").asc()], None).drop("_r")


@query(_VECTOR_LIST_SQL + ' SELECT query_id, CAST(d AS BIGINT) document_id, CAST(r AS INTEGER) "rank" FROM docs')
def ret_r02_documents(spark: SparkSession, base: str) -> DataFrame:
    return _vector_list(spark, base)


@query(_knn_sql(50) + """, m AS (SELECT query_id, CAST(id // 5 AS BIGINT) document_id, max(score) score FROM near GROUP BY 1, 2)
    SELECT query_id, document_id, round(score, 6) score, CAST(r AS INTEGER) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) r FROM m) WHERE r <= 20""")
def ret_r03_best_chunk(spark: SparkSession, base: str) -> DataFrame:
    """More vectors than needed, the best of each document, the first 20 documents."""
    best = _ranked(spark, base, 50).groupBy("query_id", F.expr("id div 5").alias("document_id")).agg(F.max("score").alias("score"))
    return ranking.top_n(best, ["query_id"], [F.col("score").desc(), F.col("document_id").asc()], 20).withColumn("score", F.round("score", 6))


@query(_knn_sql(50) + """, b AS (SELECT query_id, id, score + 0.15 * (CASE WHEN label = query_label THEN 1 ELSE 0 END) score FROM near)
    SELECT query_id, id, round(score, 6) score, CAST(r AS INTEGER) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM b) WHERE r <= 10""")
def ret_r04_boost(spark: SparkSession, base: str) -> DataFrame:
    vectors = _vectors(spark, base)
    labels = vectors.select("id", F.array("label").alias("tags"))
    tagged = _ranked(spark, base, 50).drop("rank").join(labels, "id").join(_asked(vectors).select("query_id", F.array("query_label").alias("query_tags")), "query_id")
    boosted = V.tag_boost(tagged, "query_tags", "tags").select("query_id", "id", "score")
    return ranking.top_n(boosted, ["query_id"], [F.col("score").desc(), F.col("id").asc()], 10).withColumn("score", F.round("score", 6))


_TAGS = {"invoice": ["billing"], "refund": ["billing", "money"], "roaming": ["roaming"], "port": ["porting"], "esim": ["device"], "payment": ["money"]}


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents WHERE text IS NOT NULL), k(w, tag) AS (VALUES """ + ", ".join(f"('{w}', '{t}')" for w, ts in _TAGS.items() for t in ts) + """)
    SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) tags FROM t JOIN k ON list_contains(t.w, k.w) GROUP BY 1""")
def ret_r05_tags(spark: SparkSession, base: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    rows = table(spark, base, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(V.tags_of(words, _TAGS)), ",").alias("tags"))
    return rows.filter("tags <> ''")


@query("""WITH v AS (SELECT vec_id // 8 page, vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings), q AS (SELECT page query_id, vec_id qv, e qe FROM v WHERE page % 100 = 0),
    best AS (SELECT query_id, page id, qv, max(list_dot_product(qe, e)) s FROM q, v GROUP BY 1, 2, 3), total AS (SELECT query_id, id, sum(s) score FROM best GROUP BY 1, 2)
    SELECT query_id, id, round(score, 5) score, CAST(r AS INTEGER) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM total) WHERE r <= 5""")
def ret_r06_max_similarity(spark: SparkSession, base: str) -> DataFrame:
    """Pages of eight vectors, scored by late interaction; pages divisible by 100 ask, the five best answer."""
    pages = _vectors(spark, base).groupBy(F.expr("id div 8").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    asked = pages.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vectors").alias("query_vectors"))
    return V.nearest_pages(asked, pages, 5).withColumn("score", F.round("score", 5))


_GRAPH_SQL = _VECTOR_LIST_SQL + """, hubs AS (SELECT DISTINCT CAST(vec_id // 5 AS BIGINT) d, 'Label' l, label c FROM embeddings UNION SELECT CAST(vec_id // 5 AS BIGINT), 'Bucket', CAST(vec_id // 5 AS BIGINT) % 7 FROM embeddings),
    seeds AS (SELECT query_id, CAST(d AS BIGINT) d, r FROM docs WHERE r <= 5),
    met AS (SELECT s.query_id, m2.d, 1.0::DOUBLE / (1 + s.r) w, m2.l, m2.c FROM seeds s JOIN hubs m1 ON s.d = m1.d JOIN hubs m2 ON m1.l = m2.l AND m1.c = m2.c AND m2.d <> s.d),
    x AS (SELECT query_id, d, round(sum(w), 6) score, count(DISTINCT l || ':' || c) n_shared FROM met GROUP BY 1, 2),
    grown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_shared DESC, d) r FROM x) WHERE r <= 20)"""


def _graph_list(spark: SparkSession, base: str) -> DataFrame:
    doc = F.expr("id div 5").alias("document_id")
    vectors = _vectors(spark, base)
    hubs = vectors.select(doc, F.lit("Label").alias("label"), F.col("label").cast("bigint").alias("concept")).unionByName(vectors.select(doc, F.lit("Bucket").alias("label"), F.expr("(id div 5) % 7").alias("concept")))
    return V.shared_hub_expansion(_vector_list(spark, base).filter("rank <= 5"), hubs, 20)


@query(_GRAPH_SQL + ' SELECT query_id, d document_id, score, n_shared, CAST(r AS INTEGER) "rank" FROM grown')
def ret_r07_expansion(spark: SparkSession, base: str) -> DataFrame:
    return _graph_list(spark, base)


def _fused_sql(weight: str) -> str:
    return f"""{_GRAPH_SQL}, lists AS (SELECT query_id, CAST(d AS BIGINT) d, r, 1.0::DOUBLE w FROM docs UNION ALL SELECT query_id, d, r, {weight}::DOUBLE FROM grown WHERE {weight} > 0),
    f AS (SELECT query_id, d, round(sum(w / (60 + r)), 8) score, min(r) best, count(*) n FROM lists GROUP BY 1, 2),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, d) r FROM f)"""


def _lists(spark: SparkSession, base: str, weight: float) -> DataFrame:
    one = _vector_list(spark, base).select("query_id", F.lit("vector").alias("list_name"), "document_id", "rank", F.lit(1.0).alias("weight"))
    return one.unionByName(_graph_list(spark, base).select("query_id", F.lit("graph").alias("list_name"), "document_id", "rank", F.lit(weight).alias("weight")))


_FUSED_COLUMNS = ' SELECT query_id, d document_id, score, CAST(best AS INTEGER) best_rank, n n_lists, CAST(r AS INTEGER) "rank" FROM fused'


@query(_fused_sql("0.5") + _FUSED_COLUMNS)
def ret_r08_fusion(spark: SparkSession, base: str) -> DataFrame:
    return V.reciprocal_rank_fusion(_lists(spark, base, 0.5))


@query(_fused_sql("1.0") + _FUSED_COLUMNS)
def ret_r09_unweighted(spark: SparkSession, base: str) -> DataFrame:
    return V.reciprocal_rank_fusion(_lists(spark, base, 1.0))


@query(_fused_sql("0.0") + _FUSED_COLUMNS)
def ret_r10_gated_off(spark: SparkSession, base: str) -> DataFrame:
    """A weight of 0 leaves the vector list alone."""
    return V.reciprocal_rank_fusion(_lists(spark, base, 0.0))


@query(_fused_sql("0.5") + " SELECT query_id, count(*) n FROM fused WHERE d NOT IN (SELECT d FROM docs WHERE docs.query_id = fused.query_id) GROUP BY 1")
def ret_r19_added_by_graph(spark: SparkSession, base: str) -> DataFrame:
    """How many documents only the graph list brings."""
    return _graph_list(spark, base).join(_vector_list(spark, base), ["query_id", "document_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


_POOL_SQL = _knn_sql(20) + """, b AS (SELECT query_id k, min(score) low, max(score) high FROM near GROUP BY 1), p AS (SELECT query_id, id, CASE WHEN high = low THEN 0.5 ELSE (score - low) / (high - low) END scaled, (id % 10) / 10.0 title, CASE WHEN label = query_label THEN 1.0 ELSE 0.0 END cat FROM near JOIN b ON query_id = k)"""


def _pool(spark: SparkSession, base: str) -> DataFrame:
    vectors = _vectors(spark, base)
    named = _ranked(spark, base, 20).join(vectors.select("id", "label"), "id").join(_asked(vectors).select("query_id", "query_label"), "query_id")
    return named.select("query_id", "id", "rank", F.col("score").alias("raw"), ((F.col("id") % 10) / 10.0).alias("title"), F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0).alias("category"))


@query(_POOL_SQL + " SELECT query_id, id, round(0.8 * scaled + 0.15 * title + 0.05 * cat, 6) score FROM p")
def ret_r13_combined(spark: SparkSession, base: str) -> DataFrame:
    """0.80 of the pool-normalised score, 0.15 of the title overlap, 0.05 of the category."""
    scored = V.combined_score(_pool(spark, base), "query_id", "raw", {"title": 0.15, "category": 0.05}, 0.8)
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


@query(_POOL_SQL + """, sw AS (SELECT w, query_id, id, w * scaled + (1 - w) * cat score FROM p, (VALUES (0.9::DOUBLE), (0.8::DOUBLE), (0.7::DOUBLE)) t(w))
    SELECT w weight, query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY w, query_id ORDER BY round(score, 9) DESC, id) r FROM sw) WHERE r <= 5""")
def ret_r14_sweep(spark: SparkSession, base: str) -> DataFrame:
    """Three weightings of one pool, retrieved once."""
    scaled = ranking.min_max(_pool(spark, base), "query_id", "raw", 0.5, "scaled")
    swept = scaled.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in (0.9, 0.8, 0.7)])))
    score = F.col("weight") * F.col("scaled") + (1 - F.col("weight")) * F.col("category")
    return ranking.top_n(swept.withColumn("score", F.round(score, 9)), ["weight", "query_id"], [F.col("score").desc(), F.col("id").asc()], 5).select("weight", "query_id", "id")


_RERANK_SQL = _fused_sql("0.5") + """, pool AS (SELECT query_id, d, r, (d * 7919) % 1009 s, NOT EXISTS (SELECT 1 FROM docs WHERE docs.query_id = fused.query_id AND CAST(docs.d AS BIGINT) = fused.d) graph_only FROM fused WHERE r <= 20),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) rr FROM pool),
    g AS (SELECT *, graph_only AND r <= 5 guarded, sum(CASE WHEN graph_only AND r <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) ng, sum(CASE WHEN graph_only AND r <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rr) free FROM z),
    o AS (SELECT 'override' AS mode, query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY rr) fr FROM g
      UNION ALL SELECT 'protect_graph', query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY (guarded OR free <= 5 - ng) DESC, rr) FROM g
      UNION ALL SELECT 'rrf_blend', query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (60 + r) + 1.0::DOUBLE / (60 + rr) DESC, rr) FROM g)
    SELECT mode, query_id, d document_id, CAST(fr AS INTEGER) final_rank FROM o WHERE fr <= 5"""


@query(_RERANK_SQL)
def ret_r15_rerank(spark: SparkSession, base: str) -> DataFrame:
    """The three rules over one pool; an arithmetic stub stands for the model."""
    sources = _lists(spark, base, GRAPH_WEIGHT).groupBy("query_id", "document_id").agg(F.array_sort(F.collect_set("list_name")).alias("sources"))
    pool = V.reciprocal_rank_fusion(_lists(spark, base, GRAPH_WEIGHT)).join(sources, ["query_id", "document_id"]).withColumn("stub", (F.col("document_id") * 7919) % 1009)
    modes = [V.controlled_rerank(pool, "stub", m).select(F.lit(m).alias("mode"), "query_id", "document_id", "final_rank") for m in ("override", "protect_graph", "rrf_blend")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query(_knn_sql(10) + """ SELECT DISTINCT query_id, CASE WHEN label < 5 THEN 'first' ELSE 'second' END source_corpus, CAST(id // 5 AS BIGINT) document_id FROM near""")
def ret_r20_combined_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Two indexes joined into one, searched once, then distinct documents."""
    vectors = _vectors(spark, base)
    halves = [vectors.filter(rule).withColumn("source_corpus", F.lit(n)) for rule, n in (("label < 5", "first"), ("NOT label < 5", "second"))]
    both = halves[0].unionByName(halves[1], allowMissingColumns=True)
    near = V.nearest(_asked(vectors), both, 11).filter("query_id <> id").drop("rank")
    near = ranking.top_n(near, ["query_id"], [F.col("score").desc(), F.col("id").asc()], 10)
    return near.join(both.select("id", "source_corpus"), "id").select("query_id", "source_corpus", F.expr("id div 5").alias("document_id")).distinct()


@query()
def ret_r21_hashed_embedding(spark: SparkSession, base: str) -> DataFrame:
    """Texts as unit vectors without a model; wordless texts have none."""
    rows = table(spark, base, "documents").select("doc_id", V.hashed_embedding(64)("text").alias("v"))
    return rows.select("doc_id", F.col("v").isNull().alias("no_vector"), F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("length"))


@query(_knn_sql(5) + """ SELECT query_id, CAST(id AS VARCHAR) record_id, 'vectors' dataset, CAST(label AS VARCHAR) category, round(score, 6) score FROM near""")
def proj_p13_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Search hits in the common result schema; the explicit score comes first."""
    hits = _ranked(spark, base, 5).join(_vectors(spark, base).select("id", F.col("label").cast("string").alias("category")), "id").withColumn("text", F.lit(None).cast("string")).withColumn("hybrid_score", F.lit(None).cast("double"))
    common = R.candidate_result(hits, "vectors", "nearest", ["hybrid_score", "score"], ["id"])
    return common.select(F.get_json_object("metadata", "$.query_id").cast("bigint").alias("query_id"), "record_id", "dataset", "category", F.round("score", 6).alias("score"))


_RELEVANT_SQL = _knn_sql() + """, rel AS (SELECT query_id, count(*) n FROM q JOIN v ON id <> query_id AND label = query_label GROUP BY 1),
    h AS (SELECT query_id, r, label = query_label hit FROM near)"""


def _judged(spark: SparkSession, base: str) -> DataFrame:
    """Ranked rows with ``relevant`` and ``n_relevant``: those of the query's label, counted per label, not listed per query."""
    vectors = _vectors(spark, base).select("id", "label")
    asked = vectors.filter("id % 100 = 0 AND label IS NOT NULL").select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    totals = vectors.groupBy(F.col("label").alias("query_label")).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    hits = _ranked(spark, base).select("query_id", "id", "rank").join(vectors, "id").withColumnRenamed("id", "document_id")
    judged = asked.join(totals, "query_label").filter("n_relevant > 0").join(hits, "query_id", "left")
    return judged.select("query_id", "n_relevant", "document_id", "rank", F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)).alias("relevant"))


def judged_documents(spark: SparkSession, base: str, ranked: DataFrame) -> DataFrame:
    """Ranked documents (query_id, document_id, rank) judged alike: relevant is a document with another vector of the query's label."""
    vectors = _vectors(spark, base).filter("label IS NOT NULL").select("id", "label", F.expr("id div 5").alias("document_id"))
    held = vectors.groupBy("document_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    totals = held.groupBy("label").agg(F.count(F.lit(1)).alias("_documents"))
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "label", F.col("document_id").alias("_own"))
    alone = held.filter("_n = 1").select(F.col("document_id").alias("_own"), "label", F.lit(1).alias("_alone"))
    asked = asked.join(totals, "label").join(alone, ["_own", "label"], "left").withColumn("n_relevant", F.col("_documents") - F.coalesce("_alone", F.lit(0))).filter("n_relevant > 0")
    marked = asked.join(ranked.select("query_id", "document_id", "rank"), "query_id", "left").join(held, ["document_id", "label"], "left")
    relevant = F.col("_n").isNotNull() & ~((F.col("document_id") == F.col("_own")) & (F.col("_n") == 1))
    return marked.select("query_id", "n_relevant", "document_id", "rank", F.coalesce(relevant, F.lit(False)).alias("relevant"))


def _cut_sql(k: int) -> str:
    hits = f"count(*) FILTER (hit AND r <= {k})"
    return f"CAST(CASE WHEN {hits} > 0 THEN 1 ELSE 0 END AS DOUBLE) hit_{k}, round({hits} / max(n), 6) recall_{k}, round({hits} / {k}, 6) precision_{k}, round({hits} / nullif(count(*) FILTER (r <= {k}), 0), 6) precision_found_{k}"


_SCORES_SQL = _RELEVANT_SQL + f""", scores AS (SELECT rel.query_id, {", ".join(_cut_sql(k) for k in (1, 3, 5, 10))}, round(coalesce(1.0 / min(r) FILTER (hit), 0), 6) reciprocal_rank FROM rel LEFT JOIN h ON rel.query_id = h.query_id GROUP BY 1)"""


@query(_SCORES_SQL + " SELECT * FROM scores")
def eval_e01_query_scores(spark: SparkSession, base: str) -> DataFrame:
    scores = metrics.query_scores(_judged(spark, base))
    return scores.select("query_id", *[F.round(c, 6).alias(c) for c in scores.columns if c != "query_id"])


@query(_SCORES_SQL + " SELECT count(*) n_queries, round(avg(recall_10), 4) recall_10, round(avg(hit_1), 4) hit_1, round(avg(precision_5), 4) precision_5, round(avg(reciprocal_rank), 4) mrr FROM scores")
def eval_e09_mean_scores(spark: SparkSession, base: str) -> DataFrame:
    means = metrics.mean_scores(metrics.query_scores(_judged(spark, base)), 4)
    return means.select("n_queries", "recall_10", "hit_1", "precision_5", F.col("reciprocal_rank").alias("mrr"))


@query(_knn_sql() + " SELECT query_id, round(avg(score) FILTER (r <= 5), 6) relevancy_5, round(avg(score), 6) relevancy_10 FROM near GROUP BY 1")
def eval_e07_relevancy(spark: SparkSession, base: str) -> DataFrame:
    return _ranked(spark, base).groupBy("query_id").agg(F.round(F.avg(F.when(F.col("rank") <= 5, F.col("score"))), 6).alias("relevancy_5"), F.round(F.avg("score"), 6).alias("relevancy_10"))


@query(_knn_sql() + " SELECT query_id, id, CASE WHEN id // 5 = query_id // 5 THEN 'DOCUMENT' WHEN label = query_label THEN 'CATEGORY' ELSE '' END marker FROM near")
def eval_e16_markers(spark: SparkSession, base: str) -> DataFrame:
    """Hits marked by what they share with the query: for reading misses."""
    vectors = _vectors(spark, base)
    named = _ranked(spark, base).join(vectors.select("id", "label"), "id").join(_asked(vectors).select("query_id", "query_label"), "query_id")
    marker = F.when(F.expr("id div 5 = query_id div 5"), "DOCUMENT").when(F.col("label") == F.col("query_label"), "CATEGORY").otherwise("")
    return named.select("query_id", "id", marker.alias("marker"))


@query("""WITH d AS (SELECT document_id, max_by(title, ingested_at) title FROM canonical_documents GROUP BY 1), c AS (SELECT document_id, min(chunk_id) chunk_id FROM document_chunks WHERE chunk_id IS NOT NULL GROUP BY 1)
    SELECT document_id, title, chunk_id FROM d JOIN c USING (document_id)""")
def ret_r18_first_chunk(spark: SparkSession, base: str) -> DataFrame:
    """The piece that stands for a document only the graph gave: its first."""
    docs = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["title"]).select("document_id", "title")
    return docs.join(table(spark, base, "document_chunks").filter("chunk_id IS NOT NULL").groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id")), "document_id")


@query("""WITH t AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) t FROM document_chunks WHERE text IS NOT NULL AND title IS NOT NULL)
    SELECT DISTINCT chunk_id, CASE WHEN len(q) > 0 AND len(t) > 0 THEN round(len(list_intersect(q, t)) / len(q), 6) ELSE 0 END::DOUBLE score FROM t""")
def ret_r12_pair_scorer(spark: SparkSession, base: str) -> DataFrame:
    """Each distinct (title, text) pair of pieces scored once, then joined back: the place for a model."""
    pieces = table(spark, base, "document_chunks").filter("text IS NOT NULL AND title IS NOT NULL").select("chunk_id", "title", "text")
    pairs = pieces.select("title", "text").distinct()
    scored = pairs.withColumn("score", F.round(X.overlap_share(X.terms(F.col("title")), X.terms(F.col("text"))), 6))
    return pieces.join(scored, ["title", "text"]).select("chunk_id", "score").distinct()
