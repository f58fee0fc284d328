"""Vector search, score boosts, rank fusion and reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import min_max, top_n


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of largest inner product with each query, exactly.

    ``queries``: query_id, query (array); ``vectors``: id, embedding. Both sides are cut into
    blocks of about ``block`` rows and every pair of blocks is one matrix product in one task; only
    the k best of a block leave it. A query's own id is not excluded. Rows with a null vector take
    no part; ties go to the smaller id. Vectors must be of one length.
    """
    q, v = queries.filter("query IS NOT NULL"), vectors.filter("embedding IS NOT NULL")
    n_q, n_v = (max(1, -(-x.count() // block)) for x in (q, v))
    q = q.select("query_id", F.col("query").cast("array<double>").alias("_vector"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"))
    v = v.select("id", F.col("embedding").cast("array<double>").alias("_vector"), F.pmod(F.xxhash64("id"), F.lit(n_v)).cast("int").alias("vb2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("qb2"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"].iloc[:0], "id": right["id"].iloc[:0], "score": pd.Series(dtype="float64")})
        right = right.sort_values("id", ignore_index=True)
        scores = np.stack(left["_vector"].to_list()) @ np.stack(right["_vector"].to_list()).T
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), at.shape[1]), "id": right["id"].to_numpy()[at.ravel()], "score": np.take_along_axis(scores, at, 1).ravel()})

    kinds = dict(q.dtypes) | dict(v.dtypes)
    pairs = q.groupBy("qb", "vb").cogroup(v.groupBy("qb2", "vb2")).applyInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_n(pairs, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)


def nearest_pages(queries: DataFrame, pages: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(query_id, id, score, rank): the k pages of highest late-interaction score for each query, exactly.

    ``queries``: query_id, query_vectors; ``pages``: id, vectors; both arrays of vectors of one
    length, none empty. The score sums, over a query's vectors, the best inner product with a page
    vector. Cut into pairs of blocks like ``nearest``.
    """
    n_q, n_v = (max(1, -(-x.count() // block)) for x in (queries, pages))
    q = queries.select("query_id", F.col("query_vectors").cast("array<array<double>>").alias("_vectors"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"))
    v = pages.select("id", F.col("vectors").cast("array<array<double>>").alias("_vectors"), F.pmod(F.xxhash64("id"), F.lit(n_v)).cast("int").alias("vb2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("qb2"))

    def stacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sizes = rows["_vectors"].map(len).to_numpy()
        return np.stack([x for vs in rows["_vectors"] for x in vs]), np.r_[0, np.cumsum(sizes)[:-1]]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"].iloc[:0], "id": right["id"].iloc[:0], "score": pd.Series(dtype="float64")})
        right = right.sort_values("id", ignore_index=True)
        (a, a_at), (b, b_at) = stacked(left), stacked(right)
        scores = np.add.reduceat(np.maximum.reduceat(a @ b.T, b_at, axis=1), a_at, axis=0)
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), at.shape[1]), "id": right["id"].to_numpy()[at.ravel()], "score": np.take_along_axis(scores, at, 1).ravel()})

    kinds = dict(q.dtypes) | dict(v.dtypes)
    pairs = q.groupBy("qb", "vb").cogroup(v.groupBy("qb2", "vb2")).applyInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_n(pairs, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)


def tag_boost(ranked: DataFrame, query_tags: str, item_tags: str, weight: float = 0.15) -> DataFrame:
    """``score`` plus ``weight`` for each tag that query and item share."""
    return ranked.withColumn("score", F.col("score") + F.lit(weight) * F.size(F.array_intersect(query_tags, item_tags)))


def tags_of(words: Column, concepts: dict[str, list[str]]) -> Column:
    """The distinct tags of the concepts whose word occurs, in the words' order."""
    table = F.create_map(*[x for word, tags in concepts.items() for x in (F.lit(word), F.array(*map(F.lit, tags)))])
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(table[w], F.array().cast("array<string>")))))


def reciprocal_rank_fusion(ranking: DataFrame, k: int = 60, digits: int = 8) -> DataFrame:
    """(query_id, document_id, score, best_rank, n_lists, rank) over weighted lists.

    ``ranking``: query_id, list_name, document_id, rank, weight. A document counts once per list,
    at its best rank; lists of weight 0 or less are left out. Order: score, best rank, id.
    """
    once = ranking.filter("weight > 0 AND document_id IS NOT NULL").groupBy("query_id", "list_name", "document_id").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    fused = once.groupBy("query_id", "document_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), digits).alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("n_lists"))
    return top_n(fused, ["query_id"], [F.col("score").desc(), F.col("best_rank").asc(), F.col("document_id").asc()], None)


def shared_hub_expansion(seeds: DataFrame, mentions: DataFrame, limit: int, digits: int = 6, block: int = 2048) -> DataFrame:
    """(query_id, document_id, score, n_shared, rank): documents that share hubs with the seeds.

    ``seeds``: query_id, document_id, rank; ``mentions``: document_id, label, concept. Each shared
    (label, concept) of a seed adds 1 / (1 + the seed's rank). A seed is no neighbour of itself but
    may be one of another seed. Seeds' weights are summed per (query, hub); then queries and
    documents meet in blocks of about ``block`` rows, like ``nearest``, and only the ``limit`` best
    of a block leave it: a hub that nearly all documents hold costs no rows. Rows with a null
    document, label or concept take no part.
    """
    m = mentions.filter("document_id IS NOT NULL AND label IS NOT NULL AND concept IS NOT NULL").select("document_id", F.concat_ws("\x01", "label", "concept").alias("hub")).distinct()
    held = seeds.filter("document_id IS NOT NULL").join(m, "document_id").select("query_id", "document_id", "hub", (1.0 / (1.0 + F.col("rank"))).alias("_w"))
    weighed = held.groupBy("query_id", "hub").agg(F.sum("_w").alias("_sum"), F.collect_list(F.struct("document_id", F.col("_w").alias("w"))).alias("_own"))
    asked = weighed.groupBy("query_id").agg(F.collect_list(F.struct("hub", "_sum", "_own")).alias("_hubs"))
    found = m.groupBy("document_id").agg(F.collect_list("hub").alias("_hubs"))
    n_q, n_d = max(1, -(-seeds.select("query_id").distinct().count() // max(1, block // 8))), max(1, -(-found.count() // block))
    q = asked.select("query_id", "_hubs", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("db"))
    d = found.select("document_id", "_hubs", F.pmod(F.xxhash64("document_id"), F.lit(n_d)).cast("int").alias("db2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("qb2"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "document_id", "score", "n_shared"]
        none = pd.DataFrame({"query_id": left["query_id"].iloc[:0], "document_id": right["document_id"].iloc[:0], "score": pd.Series(dtype="float64"), "n_shared": pd.Series(dtype="int64")})
        right = right.sort_values("document_id", ignore_index=True)
        place = {h: i for i, h in enumerate(dict.fromkeys(x["hub"] for hubs in left["_hubs"] for x in hubs))}
        links = [(i, place[h]) for i, hubs in enumerate(right["_hubs"]) for h in hubs if h in place]
        if not links:
            return none
        doc, hub = np.array(links).T
        weights, number = np.zeros((len(left), len(place))), np.zeros((len(left), len(place)), np.int64)
        for i, hubs in enumerate(left["_hubs"]):
            for x in hubs:
                weights[i, place[x["hub"]]], number[i, place[x["hub"]]] = x["_sum"], len(x["_own"])
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        met = doc[starts]
        score, shared = np.add.reduceat(weights[:, hub], starts, axis=1), np.add.reduceat((number > 0)[:, hub].astype(np.int64), starts, axis=1)
        at = {right["document_id"].iat[k]: j for j, k in enumerate(met)}
        for i, hubs in enumerate(left["_hubs"]):  # what a seed adds to itself is taken back
            for x in hubs:
                for own in x["_own"]:
                    if (j := at.get(own["document_id"])) is not None:
                        score[i, j] -= own["w"]
                        shared[i, j] -= len(x["_own"]) == 1
        score = np.round(score, digits)
        out = []
        for i, query in enumerate(left["query_id"]):
            order = np.lexsort((met, -shared[i], -score[i]))
            order = order[shared[i, order] > 0][:limit]
            out.append(pd.DataFrame({"query_id": query, "document_id": right["document_id"].to_numpy()[met[order]], "score": score[i, order], "n_shared": shared[i, order]}))
        return pd.concat(out, ignore_index=True)[columns] if out else none

    kinds = dict(q.dtypes) | dict(d.dtypes)
    schema = f"query_id {kinds['query_id']}, document_id {kinds['document_id']}, score double, n_shared bigint"
    scored = q.groupBy("qb", "db").cogroup(d.groupBy("qb2", "db2")).applyInPandas(best, schema).withColumn("score", F.round("score", digits))
    return top_n(scored, ["query_id"], [F.col("score").desc(), F.col("n_shared").desc(), F.col("document_id").asc()], limit)


def combined_score(rows: DataFrame, pool: str, scorer: str, parts: dict[str, float], scorer_weight: float, constant: float = 0.5) -> DataFrame:
    """``score``: the weighted sum of the pool-normalised ``scorer`` and other columns."""
    scaled = min_max(rows, pool, scorer, constant, "_scaled")
    total = F.lit(scorer_weight) * F.col("_scaled")
    for column, weight in parts.items():
        total = total + F.lit(weight) * F.coalesce(F.col(column), F.lit(0.0))
    return scaled.withColumn("score", total).drop("_scaled")


def controlled_rerank(pool: DataFrame, scorer: str, mode: str, cap: int = 20, top_k: int = 5, weight: float = 1.0, k: int = 60, protected_rank: int = 5) -> DataFrame:
    """The ``top_k`` of each query after a second scorer, under one of three rules.

    ``pool``: query_id, document_id, rank, sources (array), and ``scorer``. The first ``cap`` are
    scored. ``override``: by scorer. ``rrf_blend``: 1/(k+rank) + weight/(k+rerank rank), ties by
    rerank rank. ``protect_graph``: as override, but documents only the graph gave within
    ``protected_rank`` are kept if they would fall out, taking the last places. A null score
    anywhere in a query's pool keeps its order and says ``fallback`` in ``rerank_status``.
    """
    capped = pool.filter(F.col("rank") <= cap)
    failed = F.max(F.col(scorer).isNull()).over(Window.partitionBy("query_id"))
    scored = capped.withColumn("_failed", failed).withColumn("rerank_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(scorer).desc_nulls_last(), "rank")))
    if mode == "override":
        order = [F.col("rerank_rank")]
    elif mode == "rrf_blend":
        scored = scored.withColumn("_blend", 1.0 / (k + F.col("rank")) + F.lit(weight) / (k + F.col("rerank_rank")))
        order = [F.col("_blend").desc(), F.col("rerank_rank")]
    elif mode == "protect_graph":
        guarded = (F.col("rank") <= protected_rank) & (F.col("sources") == F.array(F.lit("graph")))
        n_guarded = F.sum(F.when(guarded, 1).otherwise(0)).over(Window.partitionBy("query_id"))
        free = F.sum(F.when(~guarded, 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rerank_rank"))
        scored = scored.withColumn("_kept", guarded | (free <= F.lit(top_k) - n_guarded))
        order = [F.col("_kept").desc(), F.col("rerank_rank")]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    kept = scored.withColumn("_reranked", final).withColumn("final_rank", F.when(F.col("_failed"), F.col("rank")).otherwise(F.col("_reranked")))
    return kept.filter(F.col("final_rank") <= top_k).withColumn("rerank_status", F.when(F.col("_failed"), "fallback").otherwise("ok")).drop("_failed", "_blend", "_kept", "_reranked")


def hashed_embedding(dim: int = 64):  # noqa: ANN201
    """A deterministic embedding of texts for use without a model: hashed words, unit length; null for null or wordless texts."""

    @F.pandas_udf("array<double>")
    def embed(words: pd.Series) -> pd.Series:
        sizes = words.map(len).to_numpy()
        hashes = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
        cells = np.repeat(np.arange(len(words)), sizes) * dim + hashes % dim
        vectors = np.bincount(cells, np.where(hashes >> 32 & 1, 1.0, -1.0), len(words) * dim).reshape(-1, dim)
        lengths = np.linalg.norm(vectors, axis=1)
        return pd.Series([v / n if n else None for v, n in zip(vectors, lengths)])

    def of(text: Column | str) -> Column:
        split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
        return embed(F.transform(split, lambda w: F.xxhash64(w)))

    return of
