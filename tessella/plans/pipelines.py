"""Registered queries: chains of operators, files written and read back, checks of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import ranking, rules
from tessella.operators import retrieval as V
from tessella.plans import reading
from tessella.plans import retrieval as RQ
from tessella.plans.graphs import _GRAPH_SQL, _edges, _nodes
from tessella.plans.register import register
from tessella.plans.texts import _MENTIONS_SQL, CONCEPTS, _mentions, numeric_tokens_sql
from tessella.sources import files, sinks
from tessella.sources.tables import latest_rows, table

QUERIES, query = register()

# --- retrieval chains -----------------------------------------------------------------------

_GATE_SQL = "(SELECT CASE query_label % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.15 ELSE 0.5 END FROM q WHERE q.query_id = grown.query_id)"


@query(RQ._fused_sql(_GATE_SQL) + """, best AS (SELECT query_id, CAST(id // 5 AS BIGINT) d, arg_min(id, r) representative FROM near GROUP BY 1, 2)
    SELECT fused.query_id, fused.d document_id, score, CAST(r AS INTEGER) "rank", representative FROM fused LEFT JOIN best ON best.query_id = fused.query_id AND best.d = fused.d WHERE r <= 5""")
def ret_r11_select(spark: SparkSession, base: str) -> DataFrame:
    """Gate, fusion, one row a document, the first five; a document stands for its best vector, if it has one."""
    asked = RQ._asked(RQ._vectors(spark, base))
    gate = rules.gate_weight(F.col("query_label") % 3 == 0, F.col("query_label") % 3 == 2)
    weights = asked.select("query_id", gate.alias("weight"))
    one = RQ._vector_list(spark, base).select("query_id", F.lit("vector").alias("list_name"), "document_id", "rank", F.lit(1.0).alias("weight"))
    two = RQ._graph_list(spark, base).join(weights, "query_id").select("query_id", F.lit("graph").alias("list_name"), "document_id", "rank", "weight")
    fused = V.reciprocal_rank_fusion(one.unionByName(two)).filter("rank <= 5").select("query_id", "document_id", "score", "rank")
    best = RQ._ranked(spark, base).groupBy("query_id", F.expr("id div 5").alias("document_id")).agg(F.min_by("id", "rank").alias("representative"))
    return fused.join(best, ["query_id", "document_id"], "left").select("query_id", "document_id", "score", "rank", "representative")


@query(RQ._knn_sql(50) + """, boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score + 0.15 * (CASE WHEN label = query_label THEN 1 ELSE 0 END) DESC, id) b FROM near),
    pages AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page) v FROM (SELECT query_id, id // 8 page, max(score) s FROM near GROUP BY 1, 2)),
    f AS (SELECT b.query_id, id, round(1.0::DOUBLE / (60 + r) + 1.0::DOUBLE / (60 + b) + 0.05::DOUBLE / (1 + v), 8) score FROM boosted b JOIN pages p ON p.query_id = b.query_id AND p.page = b.id // 8),
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) n FROM f),
    docs AS (SELECT query_id, CAST(id // 5 AS BIGINT) document_id, max((id * 7919) % 1009) score FROM pool WHERE n <= 30 GROUP BY 1, 2)
    SELECT query_id, document_id, score, CAST(r AS INTEGER) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) r FROM docs) WHERE r <= 10""")
def ret_r17_visual_bonus(spark: SparkSession, base: str) -> DataFrame:
    """Two lists of pieces fused, a bonus for the rank of their page, the first 30 scored again, the best piece of each document, ten documents; an arithmetic stub stands for the model."""
    vectors = RQ._vectors(spark, base)
    near = RQ._ranked(spark, base, 50).join(vectors.select("id", "label"), "id").join(RQ._asked(vectors).select("query_id", "query_label"), "query_id")
    lifted = F.col("score") + F.lit(0.15) * F.when(F.col("label") == F.col("query_label"), 1).otherwise(0)
    boosted = ranking.top_n(near.withColumn("_lifted", lifted), ["query_id"], [F.col("_lifted").desc(), F.col("id").asc()], None, "_boosted")
    pages = near.groupBy("query_id", F.expr("id div 8").alias("page")).agg(F.max("score").alias("_s"))
    pages = ranking.top_n(pages, ["query_id"], [F.col("_s").desc(), F.col("page").asc()], None, "_visual").select("query_id", "page", "_visual")
    fused = boosted.withColumn("page", F.expr("id div 8")).join(pages, ["query_id", "page"])
    score = F.round(1.0 / (60 + F.col("rank")) + 1.0 / (60 + F.col("_boosted")) + 0.05 / (1 + F.col("_visual")), 8)
    pool = ranking.top_n(fused.select("query_id", "id", score.alias("score")), ["query_id"], [F.col("score").desc(), F.col("id").asc()], 30)
    best = pool.groupBy("query_id", F.expr("id div 5").alias("document_id")).agg(F.max((F.col("id") * 7919) % 1009).alias("score"))
    return ranking.top_n(best, ["query_id"], [F.col("score").desc(), F.col("document_id").asc()], 10)


# --- texts ----------------------------------------------------------------------------------


@query()
def fn_f16_quotable(spark: SparkSession, base: str) -> DataFrame:
    """Pieces as they may be quoted, by digest; SQL here has no look-ahead."""
    rows = table(spark, base, "document_chunks").filter("text IS NOT NULL")
    return rows.select("chunk_id", F.md5(X.quotable(F.col("text"), F.col("chunk_index"))).alias("h"))


@query("""WITH e AS (SELECT DISTINCT edge_id, properties FROM structured_edges WHERE properties IS NOT NULL)
    SELECT edge_id, string_agg(j.key || '=' || coalesce(j.value ->> '$', ''), ' ' ORDER BY j.id) flat FROM e, json_each(properties) j GROUP BY edge_id, properties""")
def fn_f18_flattened(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "structured_edges").filter("properties IS NOT NULL").select("edge_id", "properties").distinct()
    return rows.select("edge_id", X.flattened("properties").alias("flat"))


#: Cues that a mention is denied, supposed or contrasted (fixed values; case ignored).
CUES = r"(?i)\b(?:not|no longer|cannot|can't|without|unable|instead of|rather than|unlike|except|out of scope|do not|don't|never)\b"
_TERMS_SQL = "k(concept) AS (VALUES " + ", ".join(f"('{c}')" for _, c in CONCEPTS) + ")"


@query(f"""WITH {_TERMS_SQL}, found AS (SELECT doc_id, concept, text, strpos(lower(text), lower(concept)) p FROM documents, k WHERE contains(lower(text), lower(concept)))
    SELECT doc_id, concept, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || replace(concept, ' ', '\\s+') || '([^A-Za-z0-9]|$)') evidence_ok, contains(concept, ' ') multiword,
      regexp_matches(left(trim(regexp_replace(substr(text, greatest(p - 61, 0) + 1, p - 1 - greatest(p - 61, 0) + length(concept) + 60), '[ \\t\\r\\n]+', ' ', 'g')), 220), '{CUES.replace("'", "''")}') flagged FROM found""")
def eval_e15_evidence(spark: SparkSession, base: str) -> DataFrame:
    """Every literal occurrence of a concept re-scanned: bounded on both sides, of several words, with a cue of denial near the first."""
    lowered = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(c.lower())), F.struct(
        F.lit(c).alias("concept"), F.col("text").rlike(X.phrase_pattern(c)).alias("evidence_ok"), F.lit(" " in c).alias("multiword"),
        X.snippet(F.col("text"), F.instr(lowered, c.lower()) - 1, F.lit(len(c))).rlike(CUES).alias("flagged"),
    )) for _, c in CONCEPTS]))
    return table(spark, base, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(found).alias("_f")).select("doc_id", "_f.*")


_OLD_CUES, _NEW_CUES, _RELATED = r"(?i)\b(my|mine|i)\b", r"(?i)\b(my|mine|i|our|we|us)\b", r"(?i)\b(related|same|between|via)\b"


def _weight_sql(cues: str) -> str:
    return f"CASE WHEN regexp_matches(description, '{cues}') THEN 0.0 WHEN regexp_matches(description, '{_RELATED}') THEN 0.5 ELSE 0.15 END::DOUBLE"


@query(f"""WITH k AS (SELECT DISTINCT ticket_id, description FROM tickets WHERE description IS NOT NULL), w AS (SELECT ticket_id, {_weight_sql(_OLD_CUES)} old_weight, {_weight_sql(_NEW_CUES)} new_weight FROM k)
    SELECT * FROM w WHERE old_weight <> new_weight""")
def eval_e18_drift(spark: SparkSession, base: str) -> DataFrame:
    """Texts whose gate weight changes under new cues; ``rules.clause_kinds`` gives their trace."""
    t = F.col("description")
    old, new = (rules.gate_weight(t.rlike(cues), t.rlike(_RELATED)) for cues in (_OLD_CUES, _NEW_CUES))
    return reading._questions(spark, base).select("ticket_id", old.alias("old_weight"), new.alias("new_weight")).filter("old_weight <> new_weight")


# --- reading --------------------------------------------------------------------------------


@query("""SELECT DISTINCT customer_id, CASE WHEN customer_id >= 1000 THEN 'exact_filter' ELSE 'unresolved' END AS method, CASE WHEN customer_id >= 1000 THEN 'customer_id' END filter_column, CASE WHEN customer_id >= 1000 THEN CAST(customer_id AS VARCHAR) END filter_value
    FROM customer_master WHERE customer_id > 0""")
def rule_q02_customer(spark: SparkSession, base: str) -> DataFrame:
    """A question about each customer's complaints: the number is read from four digits on."""
    asked = table(spark, base, "customer_master").filter("customer_id > 0").select("customer_id", F.concat(F.lit("List every complaint of customer no. "), F.col("customer_id").cast("string")).alias("question")).distinct()
    return rules.parse_question(asked, "question", reading.TABLES, {}, ["tickets"]).select("customer_id", "method", "filter_column", "filter_value")


@query(reading._PARSED_SQL + """, n AS (SELECT 'tickets' t, status s, count(*) n FROM tickets GROUP BY 2 UNION ALL SELECT 'subscriptions', status, count(*) FROM subscriptions GROUP BY 2),
    every AS (SELECT t, sum(n) n FROM n GROUP BY 1), parsed AS (SELECT ticket_id, tbl AS table_name, value AS filter_value FROM v WHERE tbl IN ('tickets', 'subscriptions'))
    SELECT ticket_id, table_name, CAST(CASE WHEN filter_value IS NULL THEN every.n ELSE coalesce(n.n, 0) END AS BIGINT) n_rows FROM parsed JOIN every ON every.t = table_name LEFT JOIN n ON n.t = table_name AND n.s = filter_value""")
def rule_q06_dispatch(spark: SparkSession, base: str) -> DataFrame:
    """Each question sent to the table it names: how many rows its filter would give. Tables are counted once per status, not per question."""
    read = rules.parse_question(reading._questions(spark, base), "description", reading.TABLES, reading.STATUSES, [])
    counted = [table(spark, base, t).groupBy(F.lit(t).alias("table"), F.col("status").alias("_status")).agg(F.count(F.lit(1)).alias("_n")) for t in ("tickets", "subscriptions")]
    counts = counted[0].unionByName(counted[1])
    every = counts.groupBy("table").agg(F.sum("_n").alias("_every"))
    found = read.join(every, "table").join(counts.withColumnRenamed("_status", "filter_value"), ["table", "filter_value"], "left")
    n_rows = F.when(F.col("filter_value").isNull(), F.col("_every")).otherwise(F.coalesce("_n", F.lit(0)))
    return found.select("ticket_id", F.col("table").alias("table_name"), n_rows.alias("n_rows"))


_BARE_SQL = r"regexp_replace(s, '\[[FD][0-9]+\]', '', 'g')"


@query(f"""WITH n AS (SELECT DISTINCT ticket_id, resolution_notes, description, category, status FROM tickets WHERE resolution_notes IS NOT NULL),
    a AS (SELECT ticket_id, status, regexp_replace(resolution_notes, '(?s)^(.*?)([.!?]?)[ \\t\\r\\n]*$', '\\1 [F1]\\2') answer, concat_ws(' ', description, category, status) support FROM n),
    t AS (SELECT *, {numeric_tokens_sql("support")} known, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda z: trim(z, ' ' || chr(9) || chr(10) || chr(13))), lambda z: z <> '') ss FROM a)
    SELECT ticket_id, array_to_string(list_sort(list_distinct(list_concat(
      CASE WHEN regexp_matches(answer, '(^|[^0-9])[0-9]{{10}}([^0-9]|$)|[\\w.+-]+@[\\w-]+\\.[\\w.-]+') THEN ['R4'] ELSE CAST([] AS VARCHAR[]) END,
      flatten(list_transform(ss, lambda s: CASE WHEN contains(s, '[F1]') THEN list_transform(list_filter({numeric_tokens_sql(_BARE_SQL)}, lambda y: NOT list_contains(known, y)), lambda y: 'R3:' || y)
        WHEN regexp_matches({_BARE_SQL}, '[0-9₹$€£]') OR coalesce(regexp_matches(status, '^\\p{{L}}{{3,}}$') AND list_contains(regexp_extract_all({_BARE_SQL}, '\\w+'), status), FALSE) THEN ['R1'] ELSE CAST([] AS VARCHAR[]) END))))), ',') problems FROM t""")
def rule_q17_notes(spark: SparkSession, base: str) -> DataFrame:
    """The notes of each ticket, read as an answer whose last sentence cites the ticket's row: what they state without support."""
    rows = table(spark, base, "tickets").filter("resolution_notes IS NOT NULL").select("ticket_id", "resolution_notes", "description", "category", "status").distinct()
    cited = F.regexp_replace("resolution_notes", r"(?s)^(.*?)([.!?]?)[ \t\r\n]*$", "$1 [F1]$2")
    support = F.create_map(F.lit("F1"), F.concat_ws(" ", "description", "category", "status"))
    read = rows.select("ticket_id", cited.alias("answer"), support.alias("support"), F.array("status").alias("statuses"))
    return rules.groundedness(read, "answer", "support", "statuses").select("ticket_id", F.array_join(F.array_sort("problems"), ",").alias("problems"))


# --- files written and read back ------------------------------------------------------------

_NEWEST_SQL = "WITH d AS (SELECT document_id, max_by(title, ingested_at) title, max_by(category, ingested_at) category FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1)"


def _newest(spark: SparkSession, base: str) -> DataFrame:
    return latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["title", "category"])


@query(_NEWEST_SQL + """ SELECT 'json' file_type, document_id, trim(regexp_replace(coalesce(title, ''), '[ \\t\\r\\n]+', ' ', 'g')) title FROM d UNION ALL SELECT 'txt', document_id, '' FROM d""")
def scan_s06_documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents written as question files and as plain texts, read by file type; titles come back as answers."""
    place = sinks.scratch(spark, "files")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "[ \t\r\n]+", " "))
    rows = _newest(spark, base).select("document_id", title.alias("title"), "category")
    rows.select(F.col("document_id").alias("question"), F.col("title").alias("answer"), F.col("category").alias("category_name")).write.json(f"{place}/asked")
    rows.select(F.concat(F.lit("Id: "), "document_id")).write.text(f"{place}/plain")
    texts = files.read_documents(spark, place)
    asked = texts.filter("file_type = 'json'").select("file_type", F.explode(F.split("text", "\n\n")).alias("_entry"))
    answers = asked.select("file_type", F.regexp_extract("_entry", "^Question: ([^\n]*)", 1).alias("document_id"), F.regexp_extract("_entry", "(?m)^Answer: (.*)$", 1).alias("title"))
    lines = texts.filter("file_type = 'txt'").select("file_type", F.explode(F.split("text", "\n")).alias("_line")).filter(F.startswith("_line", F.lit("Id: ")))
    plain = lines.select("file_type", F.substring("_line", 5, 1 << 20).alias("document_id"), F.lit("").alias("title"))
    return answers.unionByName(plain)


@query("SELECT DISTINCT CAST(ticket_id AS VARCHAR) query_id, description AS query FROM tickets WHERE ticket_id IS NOT NULL AND description IS NOT NULL")
def scan_s15_queries(spark: SparkSession, base: str) -> DataFrame:
    """Search queries as JSON lines."""
    place = sinks.scratch(spark, "queries")
    rows = table(spark, base, "tickets").filter("ticket_id IS NOT NULL AND description IS NOT NULL").select(F.col("ticket_id").cast("string").alias("query_id"), F.col("description").alias("query")).distinct()
    sinks.write_once(rows, place)
    return files.read_json_lines(spark, place, "query_id string, query string")


@query(_NEWEST_SQL + ", c AS (SELECT document_id, count(DISTINCT chunk_id) n FROM document_chunks GROUP BY 1) SELECT d.document_id, 'kb/' || d.document_id || '.md' path, coalesce(n, 0) n_chunks FROM d LEFT JOIN c ON c.document_id = d.document_id")
def scan_s17_manifest(spark: SparkSession, base: str) -> DataFrame:
    """A manifest whose ids and paths are unique, joined to the pieces by path."""
    place = sinks.scratch(spark, "manifest")
    path = F.concat(F.lit("kb/"), "document_id", F.lit(".md"))
    sinks.write_once(_newest(spark, base).select("document_id", path.alias("path")), place)
    entries = files.read_manifest(spark, place, "document_id string, path string", lines=True)
    pieces = table(spark, base, "document_chunks").select(path.alias("path"), "chunk_id").groupBy("path").agg(F.count_distinct("chunk_id").alias("_n"))
    return entries.join(pieces, "path", "left").select("document_id", "path", F.coalesce("_n", F.lit(0)).alias("n_chunks"))


@query("SELECT DISTINCT CAST(ticket_id AS VARCHAR) question_id, description AS question FROM tickets WHERE ticket_id IS NOT NULL AND description IS NOT NULL")
def scan_s24_questions(spark: SparkSession, base: str) -> DataFrame:
    """Questions in lists under one of three names or none, one list a line."""
    place = sinks.scratch(spark, "questions")
    rows = table(spark, base, "tickets").filter("ticket_id IS NOT NULL AND description IS NOT NULL").select("ticket_id", "description").distinct()
    lists = rows.groupBy((F.col("ticket_id") % 4).alias("_form"), F.expr("ticket_id div 64").alias("_list")).agg(F.collect_list(F.struct(F.col("ticket_id").cast("string").alias("question_id"), F.col("description").alias("question"))).alias("_q"))
    form = F.col("_form")
    named = [F.when(form == i, F.to_json(F.struct(F.col("_q").alias(n)))) for i, n in enumerate(("questions", "results", "queries"))]
    lists.select(F.coalesce(*named, F.to_json("_q"))).write.text(place)
    return files.question_list(spark, place, lines=True)


_INDEXED_SQL = """WITH v AS (SELECT chunk_id, CAST(max_by(embedding, embedded_at) AS DOUBLE[]) e FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY 1),
    c AS (SELECT chunk_id, min(document_id) document_id FROM document_chunks WHERE chunk_id IS NOT NULL GROUP BY 1)
    SELECT chunk_id, document_id, len(e) dim, round(e[1], 5) first FROM v JOIN c USING (chunk_id) WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(_INDEXED_SQL)
def sink_k05_index(spark: SparkSession, base: str) -> DataFrame:
    """Vectors and metadata matched by id, checked and written as one table; a vector read back is the one written."""
    e = F.col("embedding")
    newest = latest_rows(table(spark, base, "chunk_vectors"), "chunk_id", "embedded_at", ["embedding"]).select("chunk_id", "embedding")
    vectors = newest.filter((F.size(e) == 64) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    pieces = table(spark, base, "document_chunks").filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("document_id").alias("document_id"))
    place = sinks.scratch(spark, "index")
    sinks.write_vectors(vectors.join(pieces, "chunk_id", "left_semi"), pieces.join(vectors, "chunk_id", "left_semi"), place, "chunk_id", 64)
    rows = spark.read.parquet(f"{place}/vectors")
    return rows.select("chunk_id", "document_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query(f"{_GRAPH_SQL} SELECT 'node' kind, id AS a, label AS b, '' c FROM nodes UNION ALL SELECT 'edge', src, dst, type FROM edges")
def sink_k07_graph(spark: SparkSession, base: str) -> DataFrame:
    """Nodes and edges as JSON lines, read back."""
    place = sinks.scratch(spark, "graph")
    sinks.export_graph(_nodes(spark, base).select("id", "label"), _edges(spark, base).select("src", "dst", "type"), place, "json")
    nodes = spark.read.schema("id string, label string").json(f"{place}/nodes").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.lit("").alias("c"))
    edges = spark.read.schema("src string, dst string, type string").json(f"{place}/edges").select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c"))
    return nodes.unionByName(edges)


#: Blank rows per document in a template for labels, for concepts the reader finds missing (fixed value).
BLANK_ROWS = 3


@query(_MENTIONS_SQL + f""", d AS (SELECT DISTINCT doc_id FROM m) SELECT doc_id, label, concept, '1' predicted, 1::BIGINT n FROM m
    UNION ALL SELECT doc_id, NULL, NULL, '0', {BLANK_ROWS} FROM d""")
def sink_k13_labels(spark: SparkSession, base: str) -> DataFrame:
    """A template for labels as CSV: a row per mention and blank ones per document for what was missed."""
    place = sinks.scratch(spark, "labels")
    found = _mentions(spark, base)
    blank = found.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("concept"), F.lit(0).alias("predicted"), F.explode(F.sequence(F.lit(1), F.lit(BLANK_ROWS))).alias("_i")).drop("_i")
    rows = found.withColumn("predicted", F.lit(1)).unionByName(blank).withColumn("is_correct", F.lit(None).cast("string"))
    rows.write.option("header", True).csv(place)
    read = spark.read.csv(place, header=True, schema="doc_id bigint, label string, concept string, predicted string, is_correct string")
    return read.groupBy("doc_id", "label", "concept", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_GRAPH_SQL} SELECT label, count(*) n FROM nodes WHERE label NOT IN ('Ticket', 'Plan') GROUP BY 1 UNION ALL SELECT 'Plan', 1")
def sink_k10_reset(spark: SparkSession, base: str) -> DataFrame:
    """Nodes by label, of which two labels are owned: a reset takes these away and leaves the others; one is then written anew."""
    place = sinks.scratch(spark, "owned")
    nodes = _nodes(spark, base).select("id", F.col("label").alias("part"))
    sinks.write_partitioned(nodes, place, "part")
    sinks.reset_owned(spark, place, "part", ["Ticket", "Plan"])
    sinks.write_partitioned(spark.createDataFrame([("Plan::0", "Plan")], "id string, part string"), place, "part")
    return spark.read.schema("id string, part string").parquet(place).groupBy(F.col("part").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- reports --------------------------------------------------------------------------------


@query(f"""{_GRAPH_SQL}, ends AS (SELECT src id FROM edges UNION ALL SELECT dst FROM edges), degree AS (SELECT n.id, n.label, count(ends.id) d FROM nodes n LEFT JOIN ends ON ends.id = n.id GROUP BY 1, 2)
    SELECT label, count(*) n_nodes, count(*) FILTER (d = 0) n_isolated, CAST(max(d) AS BIGINT) most, round(avg(d), 4) mean FROM degree GROUP BY 1""")
def graph_e20_report(spark: SparkSession, base: str) -> DataFrame:
    """Nodes, isolated ones, largest and mean degree by label; ends are counted before they meet the nodes."""
    ends = _edges(spark, base).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    degree = F.coalesce("_d", F.lit(0))
    rows = _nodes(spark, base).select("id", "label").join(ends, "id", "left").select("label", degree.alias("_d"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("_d") == 0).alias("n_isolated"), F.max("_d").cast("bigint").alias("most"), F.round(F.avg("_d"), 4).alias("mean"))


@query("""WITH d AS (SELECT lower(category) concept, count(*) n FROM (SELECT document_id, max_by(category, ingested_at) category FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1) WHERE category IS NOT NULL GROUP BY 1),
    t AS (SELECT DISTINCT customer_id, ticket_id, lower(category) concept FROM tickets WHERE customer_id IS NOT NULL AND ticket_id IS NOT NULL AND category IS NOT NULL)
    SELECT customer_id, count(DISTINCT ticket_id) n_tickets, count(DISTINCT t.concept) n_concepts, CAST(coalesce(sum(n) FILTER (first), 0) AS BIGINT) n_documents
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, concept ORDER BY ticket_id) = 1 first FROM t) t LEFT JOIN d ON d.concept = t.concept GROUP BY 1""")
def graph_g18_customer_documents(spark: SparkSession, base: str) -> DataFrame:
    """From a customer over tickets and their concepts to the documents of the same concept, counted per concept before they meet."""
    docs = _newest(spark, base).filter("category IS NOT NULL").groupBy(F.lower("category").alias("concept")).agg(F.count(F.lit(1)).alias("_n"))
    rows = table(spark, base, "tickets").filter("customer_id IS NOT NULL AND ticket_id IS NOT NULL AND category IS NOT NULL").select("customer_id", "ticket_id", F.lower("category").alias("concept")).distinct()
    tickets = rows.groupBy("customer_id").agg(F.count_distinct("ticket_id").alias("n_tickets"))
    concepts = rows.select("customer_id", "concept").distinct().join(docs, "concept", "left")
    reached = concepts.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_concepts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_documents"))
    return tickets.join(reached, "customer_id").select("customer_id", "n_tickets", "n_concepts", "n_documents")


@query(reading._PARSED_SQL.replace("SELECT DISTINCT ticket_id, description FROM", "SELECT DISTINCT ticket_id, description, resolution_notes, category FROM") + f""",
    f AS (SELECT *, {numeric_tokens_sql("description")} facts, {numeric_tokens_sql("coalesce(resolution_notes, '')")} said FROM v)
    SELECT coalesce(category, '') category, count(*) n, round(avg(CASE WHEN tbl IS NOT NULL THEN 1.0 ELSE 0 END), 6) routed, round(coalesce(sum(len(list_intersect(facts, said))) / nullif(sum(len(facts)), 0), 1.0), 6) fact_recall,
      count(*) FILTER (regexp_matches(coalesce(resolution_notes, ''), '(^|[^0-9])[0-9]{{10}}([^0-9]|$)')) leaks FROM f GROUP BY 1""")
def eval_e13_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """Per category: questions sent to a table, facts of the question repeated in the notes, and notes that show a ten-digit number."""
    rows = table(spark, base, "tickets").filter("description IS NOT NULL").select("ticket_id", "description", "resolution_notes", "category").distinct()
    read = rules.parse_question(rows, "description", reading.TABLES, reading.STATUSES, [])
    notes = F.coalesce("resolution_notes", F.lit(""))
    facts, said = X.numeric_tokens(F.col("description")), X.numeric_tokens(notes)
    judged = read.select(F.coalesce("category", F.lit("")).alias("category"), F.col("table").isNotNull().cast("double").alias("_r"), F.size(facts).alias("_f"), F.size(F.array_intersect(facts, said)).alias("_s"), notes.rlike("(^|[^0-9])[0-9]{10}([^0-9]|$)").alias("_l"))
    recall = F.coalesce(F.sum("_s") / F.nullif(F.sum("_f"), F.lit(0)), F.lit(1.0))
    return judged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_r"), 6).alias("routed"), F.round(recall, 6).alias("fact_recall"), F.count_if("_l").alias("leaks"))


@query("""WITH t AS (SELECT DISTINCT customer_id, ticket_id FROM tickets WHERE customer_id IS NOT NULL AND ticket_id IS NOT NULL), s AS (SELECT DISTINCT plan_id, subscription_id FROM subscriptions WHERE plan_id IS NOT NULL AND subscription_id IS NOT NULL),
    d AS (SELECT document_id, max_by(category, ingested_at) category FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1)
    SELECT 'tickets of customer ' || customer_id question, count(*) expected FROM t GROUP BY 1 UNION ALL SELECT 'subscriptions on plan ' || plan_id, count(*) FROM s GROUP BY 1 UNION ALL SELECT 'documents about ' || category, count(*) FROM d WHERE category IS NOT NULL GROUP BY 1""")
def eval_e21_benchmark(spark: SparkSession, base: str) -> DataFrame:
    """Questions with their answers as the tables give them, none typed; a question without an answer fails the query."""
    tickets = table(spark, base, "tickets").filter("customer_id IS NOT NULL AND ticket_id IS NOT NULL").select(F.concat(F.lit("tickets of customer "), F.col("customer_id").cast("string")).alias("question"), "ticket_id")
    plans = table(spark, base, "subscriptions").filter("plan_id IS NOT NULL AND subscription_id IS NOT NULL").select(F.concat(F.lit("subscriptions on plan "), F.col("plan_id").cast("string")).alias("question"), "subscription_id")
    documents = _newest(spark, base).filter("category IS NOT NULL").select(F.concat(F.lit("documents about "), "category").alias("question"), "document_id")
    out = [rows.distinct().groupBy("question").agg(F.count(F.lit(1)).alias("expected")) for rows in (tickets, plans, documents)]
    every = out[0].unionByName(out[1]).unionByName(out[2])
    anchored = F.when(F.col("question").isNotNull() & (F.col("expected") > 0), F.col("expected")).otherwise(F.raise_error(F.lit("a question without an answer")).cast("bigint"))
    return every.select("question", anchored.alias("expected"))
