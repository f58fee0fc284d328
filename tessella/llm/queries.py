"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.llm import boilerplate, neighbours, packing, sentences, splitting, tokens
from tessella.sources.tables import latest_rows, table


def _similar(spark: SparkSession, base: str) -> DataFrame:
    current = latest_rows(table(spark, base, "chunk_vectors"), "chunk_id", "embedded_at", ["embedding"])
    return neighbours.similar_vectors(current.select(F.col("chunk_id").alias("id"), "embedding"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """(chunk_id_a, chunk_id_b): pairs of cosine 0.90 or more, one among the 10 nearest of the other.

    Similarities of stored vectors are right to 0.0001; pairs that close to 0.90 are settled by the vectors themselves.
    """
    near = _similar(spark, base).filter(F.col("similarity") >= 0.9 - 1e-4)
    pairs = near.groupBy(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).agg(F.max("similarity").alias("similarity"))
    doubtful = pairs.filter(F.col("similarity") < 0.9 + 1e-4)
    vectors = latest_rows(table(spark, base, "chunk_vectors"), "chunk_id", "embedded_at", ["embedding"])
    for end, name in (("chunk_id_a", "_a"), ("chunk_id_b", "_b")):
        doubtful = doubtful.join(vectors.select(F.col("chunk_id").alias(end), F.transform("embedding", lambda x: x.cast("double")).alias(name)), end)
    settled = doubtful.filter(cosine(F.col("_a"), F.col("_b")) >= 0.9)
    names = ["chunk_id_a", "chunk_id_b"]
    return pairs.filter(F.col("similarity") >= 0.9 + 1e-4).select(*names).unionByName(settled.select(*names))


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """(chunk_id, neighbour_id, rank, similarity): the 10 most similar chunks of each chunk."""
    return _similar(spark, base).select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("similarity", 4).alias("similarity"))


def _contents(spark: SparkSession, base: str) -> DataFrame:
    current = latest_rows(table(spark, base, "canonical_documents"), "document_id", "ingested_at", ["content"])
    return current.select(F.col("document_id").alias("id"), "content")


def _long_contents(spark: SparkSession, base: str) -> DataFrame:
    """Counting contents; those within the limit travel as null."""
    rows = table(spark, base, "canonical_documents").select("document_id", "ingested_at", F.when(F.length("content") > 1500, F.col("content")).alias("content"))
    return latest_rows(rows, "document_id", "ingested_at", ["content"]).select(F.col("document_id").alias("id"), "content")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """(document_id, cut_level) of each content over 1,500 characters."""
    return splitting.oversized(_long_contents(spark, base)).select(F.col("id").alias("document_id"), "cut_level")


def p2_chunks(spark: SparkSession, base: str) -> DataFrame:
    """(document_id, chunk_index, start, stop, text): the pieces of each content over 1,500 characters."""
    return splitting.pieces(_long_contents(spark, base)).withColumnRenamed("id", "document_id")


def p2_check(spark: SparkSession, base: str) -> DataFrame:
    """(documents, over_limit, lost, wrong_overlaps): how many pieces break a promise; one row, zeros but for the documents.

    ``lost``: places between pieces, or at either end, that leave out more than blanks. ``wrong_overlaps``:
    seams that repeat more than 200 characters, or fewer than 100 although they repeat some and more than blanks lie before.
    """
    cuts = splitting.oversized(_long_contents(spark, base)).select("text", "starts", "ends", F.size("starts").alias("n"))
    seams = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.get("ends", i - 1).alias("stop"), F.get("starts", i).alias("start")))
    seams = F.when(F.col("n") > 1, seams).otherwise(F.array().cast("array<struct<stop:int,start:int>>"))
    part = lambda a, b: F.substr(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    blank = lambda t: ~t.rlike("[^ \\t\\r\\n]")
    number = lambda array, test: F.size(F.filter(array, test)).cast("bigint")
    over = number(F.zip_with("starts", "ends", lambda a, b: b - a), lambda n: (n > 1500) | (n <= 0))
    lost = number(seams, lambda s: ~blank(part(s["stop"], s["start"]))) + F.when((F.get("starts", F.lit(0)) == 0) & (F.element_at("ends", -1) == F.length("text")), 0).otherwise(1)
    repeats = number(seams, lambda s: (s["stop"] - s["start"] > 200) | ((s["stop"] - s["start"]).between(1, 99) & ~blank(part(s["stop"] - 100, s["start"]))))
    zero = F.lit(0).cast("bigint")
    return cuts.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(over), zero).alias("over_limit"), F.coalesce(F.sum(lost), zero).alias("lost"), F.coalesce(F.sum(repeats), zero).alias("wrong_overlaps"))


def _documents(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """(document_id, line_no) of each line repeated across its document type."""
    lines = boilerplate.repeated_lines(boilerplate.counting_documents(table(spark, base, "canonical_documents")))
    return lines.select(F.col("id").alias("document_id"), "line_no")


def p5_blocks(spark: SparkSession, base: str) -> DataFrame:
    """(document_type, length, documents, lines): repeated blocks of two or more lines, as compared."""
    dealt = boilerplate.shards(boilerplate.counting_documents(table(spark, base, "canonical_documents")))
    blocks = boilerplate.frequent_blocks(dealt, 0.1, 4).filter("length > 1")
    return boilerplate.block_texts(blocks, _contents(spark, base)).select(F.col("source").alias("document_type"), "length", "documents", "lines")


def p5_clean(spark: SparkSession, base: str) -> DataFrame:
    """(document_id, content) of every document, without the lines repeated across its type."""
    lines = boilerplate.repeated_lines(boilerplate.counting_documents(table(spark, base, "canonical_documents")))
    return boilerplate.without_lines(_contents(spark, base), lines).withColumnRenamed("id", "document_id")


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, ids): token ids of every text, an empty list for null and empty ones."""
    return tokens.encode(_documents(spark, base)).withColumnRenamed("id", "doc_id")


def p6_offsets(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, ids, starts, ends): token ids with the characters each covers."""
    return tokens.encode_with_offsets(_documents(spark, base)).withColumnRenamed("id", "doc_id")


def p6_decoded(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, text): encoded and decoded again; null texts come out empty."""
    return tokens.decode(tokens.encode(_documents(spark, base))).withColumnRenamed("id", "doc_id")


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, text): encoded, decoded in pieces of three tokens that cut characters, and put together."""
    pieces = tokens.decode_in_pieces(tokens.encode(_documents(spark, base)), 3)
    return pieces.select(F.col("id").alias("doc_id"), F.array_join("pieces", "").alias("text"))


def _packed(spark: SparkSession, base: str) -> DataFrame:
    documents = _documents(spark, base)
    budgets = table(spark, base, "token_budgets").select(F.col("budget_id").alias("capacity_id"), F.col("capacity_tokens").alias("capacity"))
    return packing.pack(tokens.sizes(documents), budgets, documents.agg(F.count(F.lit(1))))


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    """(budget_id, group, bin, doc_id, part, start, tokens): the container of each text, for each budget."""
    return _packed(spark, base).withColumnsRenamed({"capacity_id": "budget_id", "id": "doc_id"})


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """(budget_id, containers, tokens, fill): containers used and the share of their room in use."""
    bins = _packed(spark, base).groupBy("capacity_id", "group", "bin").agg(F.sum("tokens").alias("tokens"))
    used = bins.groupBy(F.col("capacity_id").alias("budget_id")).agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    budgets = table(spark, base, "token_budgets").select("budget_id", "capacity_tokens").distinct()
    return used.join(budgets, "budget_id").select("budget_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))


def p7_check(spark: SparkSession, base: str) -> DataFrame:
    """(budget_id, overfull, wrong_sizes, needless_splits): containers and texts that break a promise; zeros."""
    packed = _packed(spark, base).withColumnRenamed("capacity_id", "budget_id")
    sized = tokens.sizes(_documents(spark, base)).select("id", F.col("tokens").alias("size"))
    budgets = table(spark, base, "token_budgets").select("budget_id", "capacity_tokens").distinct()
    bins = packed.groupBy("budget_id", "group", "bin").agg(F.sum("tokens").alias("_t")).join(budgets, "budget_id")
    overfull = bins.groupBy("budget_id").agg(F.count_if(F.col("_t") > F.col("capacity_tokens")).alias("overfull"))
    texts = packed.groupBy("budget_id", "id").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n")).join(budgets, "budget_id").join(sized, "id", "full")
    held = texts.groupBy("budget_id").agg(
        F.count_if(F.col("_t").isNull() | F.col("size").isNull() | (F.col("_t") != F.col("size"))).alias("wrong_sizes"), F.count_if((F.col("_n") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("needless_splits")
    )
    return held.join(overfull, "budget_id", "left").select("budget_id", "overfull", "wrong_sizes", "needless_splits")


def _sentences(spark: SparkSession, base: str) -> DataFrame:
    return sentences.sentences(table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_kind").alias("kind")))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, start_char, end_char) of each sentence of each text."""
    return _sentences(spark, base).select(F.col("id").alias("doc_id"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"))


def p8_texts(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, sentence_no, sentence) in order, numbered from 0."""
    texts = table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text")
    number = F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1
    rows = _sentences(spark, base).withColumn("sentence_no", number).join(texts, "id")
    return rows.select(F.col("id").alias("doc_id"), "sentence_no", F.substr("text", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("sentence"))


_PAIRS_SQL = """
WITH newest AS (SELECT chunk_id, max_by(embedding, embedded_at) e FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY 1),
v AS (
  SELECT chunk_id, CAST(e AS DOUBLE[]) e FROM newest
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.chunk_id a, b.chunk_id b, list_cosine_similarity(a.e, b.e) s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) n FROM pairs)
SELECT DISTINCT least(a, b) chunk_id_a, greatest(a, b) chunk_id_b FROM ranked WHERE n <= 10 AND s >= 0.9
"""

_CUT_LEVEL_SQL = r"""
WITH counting AS (
  SELECT document_id, max_by(content, ingested_at) content FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1
), texts AS (
  SELECT document_id, trim(regexp_replace(content, '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) t FROM counting
), long AS (SELECT * FROM texts WHERE length(t) > 1500),
measured AS (
  SELECT document_id,
    list_max(list_transform(regexp_split_to_array(t, '\n[ \t\r]*\n[ \t\r\n]*'), lambda p: length(trim(p, ' ' || chr(9) || chr(10) || chr(13))))) p,
    list_max(list_transform(string_split(t, chr(10)), lambda p: length(trim(p, ' ' || chr(9) || chr(10) || chr(13))))) l,
    list_max(list_transform(regexp_split_to_array(t, '[ \t\r\n]+'), lambda p: length(p))) w
  FROM long
)
SELECT document_id, CASE WHEN p <= 1500 THEN 'paragraph' WHEN l <= 1500 THEN 'line' WHEN w <= 1500 THEN 'word' ELSE 'run' END cut_level FROM measured
"""

_CHECK_SQL = _CUT_LEVEL_SQL[: _CUT_LEVEL_SQL.index("long AS")].rstrip(", \n") + " SELECT count(*) documents, 0 over_limit, 0 lost, 0 wrong_overlaps FROM texts WHERE length(t) > 1500"

_LINES_SQL = r"""
WITH counting AS (
  SELECT document_id, max_by(content, ingested_at) content, upper(trim(max_by(document_type, ingested_at), ' ' || chr(9) || chr(10) || chr(13))) kind
  FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1
), docs AS (SELECT * FROM counting WHERE kind <> ''),
split AS (SELECT document_id, kind, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) parts FROM docs WHERE content IS NOT NULL),
lines AS (SELECT document_id, kind, unnest(parts) line, generate_subscripts(parts, 1) line_no FROM split),
keyed AS (
  SELECT document_id, kind, line_no, regexp_replace(lower(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g'))), '[0-9]+', '0', 'g') k
  FROM lines WHERE regexp_matches(line, '\p{L}')
), spread AS (SELECT kind, k, count(DISTINCT document_id) n FROM keyed GROUP BY 1, 2),
totals AS (SELECT kind, count(*) total FROM docs GROUP BY 1),
frequent AS (SELECT kind, k FROM spread JOIN totals USING (kind) WHERE n >= 4 AND n * 10 >= total)
"""

_BLOCKS_SQL = r"""
, placed AS (SELECT document_id, kind, k, row_number() OVER (PARTITION BY document_id ORDER BY line_no) p FROM keyed),
around AS (
  SELECT *, lag(k) OVER w before, f.k IS NOT NULL often FROM placed LEFT JOIN frequent f USING (kind, k) WINDOW w AS (PARTITION BY document_id ORDER BY p)
), runs AS (
  SELECT *, p - row_number() OVER (PARTITION BY document_id ORDER BY p) run FROM around WHERE often
), stretches AS (
  SELECT document_id, kind, run, list(k ORDER BY p) ks, list(before ORDER BY p) befores, min(p) p FROM runs GROUP BY 1, 2, 3
), firsts AS (SELECT *, unnest(range(1, len(ks) + 1)) i FROM stretches),
spans AS (SELECT *, unnest(range(i + 1, len(ks) + 1)) j FROM firsts),
places AS (
  SELECT s.kind, s.document_id, ks[i:j] block, befores[i] before, n.k AS following FROM spans s LEFT JOIN placed n ON n.document_id = s.document_id AND n.p = s.p + j
), blocks AS (
  SELECT kind, block, count(DISTINCT document_id) documents FROM places GROUP BY 1, 2
  HAVING (count(DISTINCT before) > 1 OR count(*) > count(before)) AND (count(DISTINCT following) > 1 OR count(*) > count(following))
)
SELECT kind document_type, CAST(len(block) AS INTEGER) length, documents, array_to_string(block, chr(10)) lines FROM blocks JOIN totals USING (kind) WHERE documents >= 4 AND documents * 10 >= total
"""

_CLEAN_SQL = """
, gone AS (SELECT document_id, line_no FROM keyed JOIN frequent USING (kind, k)),
kept AS (
  SELECT document_id, string_agg(line, chr(10) ORDER BY line_no) content
  FROM lines ANTI JOIN gone USING (document_id, line_no) GROUP BY 1
), contents AS (SELECT document_id, max_by(content, ingested_at) content FROM canonical_documents WHERE document_id IS NOT NULL GROUP BY 1)
SELECT c.document_id, CASE WHEN c.document_id IN (SELECT document_id FROM gone) THEN coalesce(k.content, '') ELSE c.content END content
FROM contents c LEFT JOIN kept k ON c.document_id = k.document_id
"""

#: name -> (query, its SQL twin or None)
QUERIES = {
    "p1_found": (p1_found, _PAIRS_SQL),
    "p1_neighbours": (p1_neighbours, None),
    "p2_found": (p2_found, _CUT_LEVEL_SQL),
    "p2_chunks": (p2_chunks, None),
    "p2_check": (p2_check, _CHECK_SQL),
    "p5_found": (p5_found, _LINES_SQL + "SELECT document_id, CAST(line_no AS BIGINT) line_no FROM keyed JOIN frequent USING (kind, k)"),
    "p5_blocks": (p5_blocks, _LINES_SQL + _BLOCKS_SQL),
    "p5_clean": (p5_clean, _LINES_SQL + _CLEAN_SQL),
    "p6_ids": (p6_ids, None),
    "p6_offsets": (p6_offsets, None),
    "p6_decoded": (p6_decoded, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "p6_pieces": (p6_pieces, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "p7_packed": (p7_packed, None),
    "p7_fill": (p7_fill, None),
    "p7_check": (p7_check, "SELECT DISTINCT budget_id, 0 overfull, 0 wrong_sizes, 0 needless_splits FROM token_budgets"),
    "p8_found": (p8_found, None),
    "p8_texts": (p8_texts, None),
}
