"""Registered queries: cleaning, chunking, matching and checking of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graph, metrics
from tessella.operators.chunking import word_chunks
from tessella.operators.validation import chunk_violations, vector_violations
from tessella.plans.register import register
from tessella.sources.tables import BLANKS, latest_rows, table

QUERIES, query = register()
#: Phrases looked for in texts: label, concept.
CONCEPTS = [
    ("Service", "port-in request"), ("Service", "data add-on"), ("Service", "roaming pack"), ("Service", "security deposit"), ("Service", "address update"), ("Service", "SIM swap"),
    ("Service", "eSIM profile"), ("Channel", "payment switch"), ("Channel", "order queue"), ("Channel", "core router"), ("Requirement", "invoice"), ("Requirement", "form"),
]
AS_OF = "2025-06-30"


def _texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", "text")


_LINED = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"
_CLEAN_SQL = f"""regexp_replace(regexp_replace(array_to_string(list_transform({_LINED.replace("regexp_replace(text, ", "regexp_replace(translate(text, '•▪●', '---'), ")}, lambda l: regexp_replace(l, '^[ \\t]+|[ \\t]+$', '', 'g')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')"""


@query(f"SELECT doc_id, md5({_CLEAN_SQL}) h FROM documents WHERE text IS NOT NULL")
def fn_f04_clean(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).filter("text IS NOT NULL").select("doc_id", F.md5(X.clean(F.col("text"))).alias("h"))


@query()
def fn_f01_nfkc(spark: SparkSession, base: str) -> DataFrame:
    """Whether the normal form differs, and its length; no SQL engine at hand has NFKC."""
    rows = _texts(spark, base).filter("text IS NOT NULL").withColumn("composed", X.nfkc("text"))
    return rows.select("doc_id", (F.col("composed") != F.col("text")).alias("changed"), F.length("composed").alias("n_chars"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')), ' '), lambda x: x <> '') ws, text FROM documents),
    n AS (SELECT *, len(ws) n FROM w WHERE len(ws) > 0),
    c AS (SELECT doc_id, ws, n, text, unnest(CASE WHEN n <= 250 THEN [0] ELSE range(0, CAST((ceil((n - 40) / 210.0) - 1) * 210 + 1 AS BIGINT), 210) END) s FROM n)
    SELECT doc_id, doc_id || '_chunk_' || lpad(CAST(CAST(s / 210 AS BIGINT) AS VARCHAR), 3, '0') chunk_id, CAST(s / 210 AS INTEGER) chunk_index, CAST(len(list_slice(ws, s + 1, s + 250)) AS INTEGER) n_words,
      md5(CASE WHEN n <= 250 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) ELSE array_to_string(list_slice(ws, s + 1, s + 250), ' ') END) h FROM c""")
def fn_f05_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Windows of 250 words, 40 shared."""
    return word_chunks(_texts(spark, base), "doc_id", "text").select("doc_id", "chunk_id", "chunk_index", "n_words", F.md5("chunk_text").alias("h"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' +([.,;:!?])', '\\1', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) h
    FROM documents WHERE text IS NOT NULL""")
def fn_f06_extracted(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).filter("text IS NOT NULL").select("doc_id", F.md5(X.clean_extracted(F.col("text"))).alias("h"))


@query("""SELECT doc_id, md5(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda l: length(regexp_replace(l, '[^\\p{L}\\p{M}]', '', 'g')) = 0 OR length(regexp_replace(l, '[^\\x{0900}-\\x{097F}]', '', 'g')) <= 0.3 * length(regexp_replace(l, '[^\\p{L}\\p{M}]', '', 'g'))), chr(10)), '')) h
    FROM documents WHERE text IS NOT NULL""")
def fn_f07_script_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines mostly in one script taken out."""
    return _texts(spark, base).filter("text IS NOT NULL").select("doc_id", F.md5(X.without_script_lines(F.col("text"))).alias("h"))


@query("SELECT DISTINCT file_path, 'DOC_' || regexp_replace(regexp_replace(upper(regexp_replace(file_path, '^.*/|\\.[^./]*$', '', 'g')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') id FROM canonical_documents WHERE file_path IS NOT NULL")
def fn_f09_identifier(spark: SparkSession, base: str) -> DataFrame:
    stem = F.regexp_replace("file_path", r"^.*/|\.[^./]*$", "")
    return table(spark, base, "canonical_documents").filter("file_path IS NOT NULL").select("file_path", X.identifier(stem, "DOC_").alias("id")).distinct()


@query("SELECT DISTINCT chunk_id, regexp_replace(chunk_id, '_chunk_[0-9]+$', '') document, try_cast(regexp_extract(chunk_id, '_chunk_([0-9]+)$', 1) AS INTEGER) number FROM document_chunks")
def fn_f14_chunk_keys(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "document_chunks").select("chunk_id", X.document_key(F.col("chunk_id")).alias("document"), X.chunk_number(F.col("chunk_id")).alias("number")).distinct()


@query("""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) n FROM documents WHERE text IS NOT NULL""")
def fn_f19_sentences(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).filter("text IS NOT NULL").select("doc_id", F.size(X.sentences_simple(F.col("text"))).cast("bigint").alias("n"))


def numeric_tokens_sql(text: str) -> str:
    """The tokens of ``functions.text.numeric_tokens`` as a sorted list."""
    date, time, number = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}(?::[0-9]{2})?", r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
    dated = f"regexp_replace({text}, '{date}', ' ', 'g')"
    plain = "replace(x, ',', '')"
    short = f"regexp_replace(CASE WHEN contains(x, '.') THEN regexp_replace({plain}, '\\.?0+$', '') ELSE {plain} END, '^0+([0-9])', '\\1')"
    return f"""list_sort(list_distinct(list_concat(list_transform(regexp_extract_all({text}, '{date}'), lambda x: 'date:' || x), list_transform(regexp_extract_all({dated}, '{time}'), lambda x: 'time:' || x),
      list_transform(regexp_extract_all(regexp_replace({dated}, '{time}', ' ', 'g'), '{number}'), lambda x: {short}))))"""


@query(f"SELECT DISTINCT ticket_id, array_to_string({numeric_tokens_sql('description')}, ' ') tokens FROM tickets WHERE description IS NOT NULL")
def fn_f20_numeric_tokens(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tickets").filter("description IS NOT NULL").select("ticket_id", F.array_join(X.numeric_tokens(F.col("description")), " ").alias("tokens")).distinct()


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), lambda w: left(w, 6)))), ' ') stems FROM documents WHERE text IS NOT NULL""")
def fn_f21_stems(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).filter("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(X.stems(F.col("text"))), " ").alias("stems"))


@query("""WITH d AS (SELECT document_id, max_by(title, ingested_at) title, max_by(content, ingested_at) content FROM canonical_documents GROUP BY 1),
    t AS (SELECT document_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')) q, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+')) c FROM d)
    SELECT document_id, round(CASE WHEN len(q) > 0 AND len(c) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0 END, 6) overlap FROM t""")
def fn_f22_title_overlap(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["title", "content"])
    t, c = (X.terms(F.coalesce(F.col(x), F.lit(""))) for x in ("title", "content"))
    return rows.select("document_id", F.round(X.overlap_share(t, c), 6).alias("overlap"))


_TERMS = {"porting": ["port", "number lock"], "billing": ["invoice", "refund", "top-up"], "roaming": ["roam*", "international pack"]}


@query(" UNION ALL ".join(
    f"SELECT '{k}' topic, count(*) n FROM documents WHERE regexp_matches(text, '(?i){'|'.join(X.term_pattern(t).removeprefix('(?i)') for t in v)}')" for k, v in _TERMS.items()))
def fn_f23_terms(spark: SparkSession, base: str) -> DataFrame:
    """Documents with any inflected term of a topic, in one pass."""
    counts = _texts(spark, base).agg(*[F.count_if(X.any_term(F.col("text"), v)).alias(k) for k, v in _TERMS.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("topic"), F.col(k).alias("n")) for k in _TERMS])).alias("_t")).select("_t.*")


def _mentions(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, label, concept) of each bounded phrase in a text."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(X.phrase_pattern(c)), F.struct(F.lit(label).alias("label"), F.lit(c).alias("concept"))) for label, c in CONCEPTS]))
    return _texts(spark, base).filter("text IS NOT NULL").select("doc_id", F.explode(hits).alias("_m")).select("doc_id", "_m.label", "_m.concept")


_MENTIONS_SQL = "WITH k(label, concept) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in CONCEPTS) + """),
    m AS (SELECT doc_id, label, concept FROM documents, k WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || replace(concept, ' ', '\\s+') || '([^A-Za-z0-9]|$)'))"""


@query(_MENTIONS_SQL + " SELECT * FROM m")
def graph_g03_mentions(spark: SparkSession, base: str) -> DataFrame:
    return _mentions(spark, base)


@query(_MENTIONS_SQL + " SELECT label, concept, count(DISTINCT doc_id) n_documents FROM m GROUP BY 1, 2")
def graph_a17_coverage(spark: SparkSession, base: str) -> DataFrame:
    return _mentions(spark, base).groupBy("label", "concept").agg(F.count(F.lit(1)).alias("n_documents"))


@query(_MENTIONS_SQL + " SELECT a.concept item_a, b.concept item_b, count(*) support FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.concept < b.concept GROUP BY 1, 2")
def graph_a18_co_occurrence(spark: SparkSession, base: str) -> DataFrame:
    return graph.co_occurrence(_mentions(spark, base), "doc_id", "concept")


@query(_MENTIONS_SQL + " SELECT doc_id, label, string_agg(concept, ',' ORDER BY concept) concepts FROM m GROUP BY 1, 2")
def graph_g21_document_concepts(spark: SparkSession, base: str) -> DataFrame:
    return _mentions(spark, base).groupBy("doc_id", "label").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))


@query(_MENTIONS_SQL + " SELECT coalesce(doc_kind, '') doc_kind, count(*) n_documents, count(DISTINCT m.doc_id) n_with FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM m) m ON d.doc_id = m.doc_id GROUP BY 1")
def graph_a16_content_stats(spark: SparkSession, base: str) -> DataFrame:
    named = _mentions(spark, base).select("doc_id").distinct().withColumn("_m", F.lit(1))
    rows = table(spark, base, "documents").select("doc_id", F.coalesce("doc_kind", F.lit("")).alias("doc_kind")).join(named, "doc_id", "left")
    return rows.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_documents"), F.count("_m").alias("n_with"))


@query("""SELECT ticket_id, strpos(lower(description), 'refund') - 1 at_char, left(trim(regexp_replace(substr(description, greatest(strpos(lower(description), 'refund') - 61, 0) + 1, strpos(lower(description), 'refund') - 1 - greatest(strpos(lower(description), 'refund') - 61, 0) + 66), '[ \\t\\r\\n]+', ' ', 'g')), 220) evidence
    FROM (SELECT DISTINCT ticket_id, description FROM tickets) WHERE lower(description) LIKE '%refund%'""")
def fn_f25_evidence(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "tickets").select("ticket_id", "description").distinct().withColumn("at_char", F.instr(F.lower("description"), "refund") - 1).filter("at_char >= 0")
    return rows.select("ticket_id", F.col("at_char").cast("bigint").alias("at_char"), X.snippet(F.col("description"), F.col("at_char"), F.lit(6)).alias("evidence"))


@query(" UNION ALL ".join(f"SELECT '{k}' rule, CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) n_found, count(*) FILTER (regexp_matches(text, '{p}')) n_documents FROM documents" for k, p in X.SPACING.items()))
def fn_f27_spacing(spark: SparkSession, base: str) -> DataFrame:
    """Places where a space may be missing, by rule, in one pass."""
    sums = [F.struct(F.lit(k).alias("rule"), F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).alias("n_found"), F.count_if(F.col("text").rlike(p)).alias("n_documents")) for k, p in X.SPACING.items()]
    return _texts(spark, base).agg(F.array(*sums).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


@query(f"SELECT subscription_id, strftime(expiry_date, '%Y-%m-%d') expiry, expiry_date < DATE '{AS_OF}' passed FROM subscriptions WHERE expiry_date IS NOT NULL")
def fn_f28_expired(spark: SparkSession, base: str) -> DataFrame:
    day = F.to_date(F.substr(F.date_format("expiry_date", "yyyy-MM-dd HH:mm:ss"), F.lit(1), F.lit(10)))
    return table(spark, base, "subscriptions").filter("expiry_date IS NOT NULL").select("subscription_id", F.date_format("expiry_date", "yyyy-MM-dd").alias("expiry"), (day < F.to_date(F.lit(AS_OF))).alias("passed"))


@query("""WITH t AS (SELECT coalesce(doc_kind, '') doc_kind, length(text) c, len(list_filter(string_split(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')), ' '), lambda x: x <> '')) w FROM documents WHERE text IS NOT NULL)
    SELECT doc_kind, count(*) n, min(c) min_chars, max(c) max_chars, round(avg(c), 2) avg_chars, min(w) min_words, max(w) max_words, round(avg(w), 2) avg_words FROM t GROUP BY 1""")
def agg_a20_text_stats(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").filter("text IS NOT NULL").select(F.coalesce("doc_kind", F.lit("")).alias("doc_kind"), F.length("text").alias("chars"), F.size(X.word_list(F.col("text"))).alias("words"))
    stats = [f(F.col(c).cast("bigint")).alias(f"{n}_{c}") for c in ("chars", "words") for n, f in (("min", F.min), ("max", F.max), ("avg", lambda x: F.round(F.avg(x), 2)))]
    return rows.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), *stats)


@query("""WITH d AS (SELECT DISTINCT category, document_id FROM canonical_documents WHERE category IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY document_id) i FROM d)
    SELECT category, count(*) n, string_agg(document_id, ',' ORDER BY document_id) FILTER (i <= 5) samples FROM r GROUP BY 1""")
def agg_a21_samples(spark: SparkSession, base: str) -> DataFrame:
    """Documents per category and its first five: counts and samples come from separate, bounded aggregates."""
    from tessella.operators.ranking import top_n

    rows = table(spark, base, "canonical_documents").filter("category IS NOT NULL").select("category", "document_id").distinct()
    few = top_n(rows, ["category"], [F.col("document_id").asc()], 5).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("samples"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(few, "category")


@query("""WITH c AS (SELECT document_type, document_id, count(DISTINCT chunk_id) n FROM document_chunks WHERE document_type IS NOT NULL GROUP BY 1, 2)
    SELECT document_type, count(*) n_documents, min(n) least, max(n) most, round(avg(n), 4) mean FROM c GROUP BY 1""")
def agg_a22_chunks_per_document(spark: SparkSession, base: str) -> DataFrame:
    per = table(spark, base, "document_chunks").filter("document_type IS NOT NULL").groupBy("document_type", "document_id").agg(F.count_distinct("chunk_id").alias("n"))
    return per.groupBy("document_type").agg(F.count(F.lit(1)).alias("n_documents"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


_REQUIRED = ["chunk_id", "document_id", "chunk_index", "text", "title", "document_type"]


@query("WITH c AS (SELECT * FROM document_chunks) " + " UNION ALL ".join(f"SELECT 'missing_{c}' rule, count(*) FILTER ({c} IS NULL) n_rows FROM c" for c in _REQUIRED) + """
    UNION ALL SELECT 'empty_text', count(*) FILTER (text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') FROM c UNION ALL SELECT 'negative_index', count(*) FILTER (chunk_index < 0) FROM c
    UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT chunk_id FROM c WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'broken_sequence', count(*) FILTER (NOT coalesce(lo = 0 AND hi + 1 = n AND d = n, false)) FROM (SELECT min(chunk_index) lo, max(chunk_index) hi, count(*) n, count(DISTINCT chunk_index) d FROM c WHERE document_id IS NOT NULL GROUP BY document_id)""")
def eval_e11_chunks(spark: SparkSession, base: str) -> DataFrame:
    return chunk_violations(table(spark, base, "document_chunks"), _REQUIRED)


@query("""WITH v AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) e FROM chunk_vectors)
    SELECT 'null_vector' rule, count(*) FILTER (e IS NULL) n_rows FROM v UNION ALL SELECT 'wrong_length', count(*) FILTER (len(e) <> 64) FROM v
    UNION ALL SELECT 'nan', count(*) FILTER (len(list_filter(e, lambda x: isnan(x))) > 0) FROM v UNION ALL SELECT 'infinite', count(*) FILTER (len(list_filter(e, lambda x: isinf(x))) > 0) FROM v
    UNION ALL SELECT 'not_unit', count(*) FILTER (len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL)) = 0 AND abs(sqrt(list_dot_product(e, e)) - 1) > 0.001) FROM v
    UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT chunk_id FROM v GROUP BY 1 HAVING count(*) > 1)""")
def eval_e12_vectors(spark: SparkSession, base: str) -> DataFrame:
    return vector_violations(table(spark, base, "chunk_vectors"), "chunk_id", "embedding", 64)


@query("""WITH d AS (SELECT DISTINCT file_path, document_id FROM canonical_documents), c AS (SELECT file_path, count(DISTINCT chunk_id) n FROM document_chunks GROUP BY 1)
    SELECT document_id, d.file_path, coalesce(n, 0) n_chunks FROM d LEFT JOIN c ON d.file_path = c.file_path""")
def join_j16_by_path(spark: SparkSession, base: str) -> DataFrame:
    """Documents and their pieces by path; paths without a piece count 0."""
    docs = table(spark, base, "canonical_documents").select("file_path", "document_id").distinct()
    pieces = table(spark, base, "document_chunks").groupBy("file_path").agg(F.count_distinct("chunk_id").alias("_n"))
    return docs.join(pieces, "file_path", "left").select("document_id", "file_path", F.coalesce("_n", F.lit(0)).alias("n_chunks"))


@query("""WITH d AS (SELECT document_id, max_by(title, ingested_at) title, max_by(tags, ingested_at) tags, max_by(related_ids, ingested_at) related_ids, max_by(version, ingested_at) v FROM canonical_documents GROUP BY 1)
    SELECT document_id, coalesce(title, 'unspecified') title, coalesce(v, 'unspecified') AS version, len(coalesce(tags, [])) n_tags, len(coalesce(related_ids, [])) n_related FROM d""")
def sup_x02_defaults(spark: SparkSession, base: str) -> DataFrame:
    """Canonical documents with the defaults of optional fields."""
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["title", "tags", "related_ids", "version"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return rows.select("document_id", *[F.coalesce(c, F.lit("unspecified")).alias(c) for c in ("title", "version")], F.when(F.col("tags").isNull(), 0).otherwise(size("tags")).alias("n_tags"), F.when(F.col("related_ids").isNull(), 0).otherwise(size("related_ids")).alias("n_related"))


@query("SELECT coalesce(file_type, '') file_type, count(*) n FROM canonical_documents GROUP BY 1")
def sup_x24_file_types(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "canonical_documents").groupBy(F.coalesce("file_type", F.lit("")).alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT document_id, max_by(content, ingested_at) content FROM canonical_documents GROUP BY 1)
    SELECT CASE WHEN content IS NULL OR length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 200 THEN 'rejected' ELSE 'kept' END verdict, count(*) n FROM d GROUP BY 1""")
def sink_k03_quarantine(spark: SparkSession, base: str) -> DataFrame:
    """Contents under 200 characters are set aside, none is lost."""
    rows = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["content"])
    short = F.col("content").isNull() | (F.length(F.trim("content", F.lit(BLANKS))) < 200)
    return rows.groupBy(F.when(short, "rejected").otherwise("kept").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(_MENTIONS_SQL + """, p AS (SELECT DISTINCT doc_id FROM m), c AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND d.doc_kind = 'faq') tp, count(*) FILTER (p.doc_id IS NOT NULL AND coalesce(d.doc_kind <> 'faq', true)) fp, count(*) FILTER (p.doc_id IS NULL AND d.doc_kind = 'faq') fn FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1 FROM c""")
def eval_a27_labels(spark: SparkSession, base: str) -> DataFrame:
    """A flag from mentions against a label column."""
    named = _mentions(spark, base).select("doc_id").distinct().withColumn("_m", F.lit(True))
    rows = table(spark, base, "documents").select("doc_id", "doc_kind").join(named, "doc_id", "left")
    return metrics.precision_recall(rows, F.coalesce("_m", F.lit(False)), F.coalesce(F.col("doc_kind") == "faq", F.lit(False)))
