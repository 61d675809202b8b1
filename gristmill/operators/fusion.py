"""Fusing a semantic and a lexical result list of each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.skew import HOT_ROWS, numbered, split_join
from gristmill.session import cut_lineage, estimated_bytes

RRF_K = 60
QUERY_CHARS = 200  # of a query that a reranker reads


def ranked(df: DataFrame, query: str, item: str, score: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds rank, from 0 by falling score, ties by item; rows without a score are dropped. A query's list may be of any length."""
    kept = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    return numbered(kept, [query], [F.desc(score), F.col(item)], "rank", hot_rows).withColumn("rank", F.col("rank") - 1)


def reciprocal_rank(lists: list[DataFrame], query: str, item: str, k: int = RRF_K) -> DataFrame:
    """(query, item, score): the sum of 1 / (rank + k) over the lists that hold the item, as one aggregation of their union."""
    parts = [df.select(query, item, (F.lit(1.0) / (F.col("rank") + k)).alias("score")) for df in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(query, item).agg(F.sum("score").alias("score"))


def _both(semantic: DataFrame, lexical: DataFrame, query: str, item: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Normalised arms: 1 - distance / largest distance, score / largest score; a largest value of 0 gives 1 and 0.

    Both arms meet in one aggregation by query and item, the largest values are partial maxima by query, and hot queries take theirs by broadcast.
    """
    none = F.lit(None).cast("double")
    union = semantic.select(query, item, F.col("distance").cast("double").alias("distance"), none.alias("score")).unionByName(lexical.select(query, item, none.alias("distance"), F.col("score").cast("double").alias("score")))
    rows = union.groupBy(query, item).agg(F.max("distance").alias("distance"), F.max("score").alias("score"))
    most = union.groupBy(query).agg(F.max("distance").alias("_far"), F.max("score").alias("_top"), F.count(F.lit(1)).alias("_n"))
    joined = split_join(rows, most.drop("_n"), [query], most.select(query, F.col("_n").alias("n")), hot_rows, null_safe=[query])
    near = F.when(F.col("_far") > 0, 1 - F.col("distance") / F.col("_far")).otherwise(1.0)
    share = F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0)
    return joined.select(query, item, F.when(F.col("distance").isNotNull(), near).alias("semantic"), F.when(F.col("score").isNotNull(), share).alias("lexical"))


def weighted(semantic: DataFrame, lexical: DataFrame, query: str, item: str, semantic_weight: float = 0.6, lexical_weight: float = 0.4) -> DataFrame:
    """(query, item, score) by weighted sum of the normalised arms, an absent arm counting 0."""
    return _both(semantic, lexical, query, item).select(query, item, (semantic_weight * F.coalesce("semantic", F.lit(0.0)) + lexical_weight * F.coalesce("lexical", F.lit(0.0))).alias("score"))


def maximum(semantic: DataFrame, lexical: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item, score): the larger of the normalised arms, each item once."""
    return _both(semantic, lexical, query, item).select(query, item, F.greatest(F.coalesce("semantic", F.lit(0.0)), F.coalesce("lexical", F.lit(0.0))).alias("score"))


def fuse(semantic: DataFrame, lexical: DataFrame, query: str, item: str, method: str = "rrf", **options) -> DataFrame:
    """``semantic`` is (query, item, distance), ``lexical`` (query, item, score), both with their rank if they are results of a search; method rrf, weighted or max."""
    if method == "rrf":
        numbered_arms = "rank" in semantic.columns and "rank" in lexical.columns  # searches number their results from 1
        near = semantic if numbered_arms else ranked(semantic.withColumn("_near", -F.col("distance")), query, item, "_near")
        words = lexical if numbered_arms else ranked(lexical, query, item, "score")
        return reciprocal_rank([df.withColumn("rank", F.col("rank") - 1) if numbered_arms else df for df in (near, words)], query, item, **options)
    return {"weighted": weighted, "max": maximum}[method](semantic, lexical, query, item, **options)


def top(df: DataFrame, query: str, item: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), item)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_items(queries: DataFrame, chunks: DataFrame, k: int = 5, method: str = "rrf", frameworks: list[str] | None = None, over_fetch: int = 2, **options) -> DataFrame:
    """(query_id, id, score, rank) of both arms fused; queries are (id, tokens, embedding), chunks (id, framework_name, tokens, embedding).

    Each arm is asked for ``over_fetch * k``, both arms see only ``frameworks`` if given, and an item found by one arm alone is kept.
    """
    from gristmill.operators.lexical import bm25_top_k
    from gristmill.operators.vector import nearest

    if frameworks is not None:
        chunks = chunks.filter(F.col("framework_name").isin(frameworks))
    # k results a query, written once: what follows reads them several times
    semantic = cut_lineage(nearest(queries, chunks, over_fetch * k).select("query_id", "id", "distance", "rank"))
    lexical = cut_lineage(bm25_top_k(queries, chunks, over_fetch * k).select("query_id", "id", "score", "rank"))
    return top(fuse(semantic, lexical, "query_id", "id", method, **options), "query_id", "id", k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5, method: str = "rrf", frameworks: list[str] | None = None, over_fetch: int = 2, **options) -> DataFrame:
    """``hybrid_items`` with the text of each item."""
    return with_columns_of(hybrid_items(queries, chunks, k, method, frameworks, over_fetch, **options), chunks, "text")


def with_columns_of(found: DataFrame, chunks: DataFrame, *columns: str, most_bytes: int = 32 << 20) -> DataFrame:
    """``found`` with columns of its chunks. The found rows, k a query, are written and sent to the chunks if they are small, so no text is shuffled but of what was found; items without a chunk go."""
    found = cut_lineage(found)
    small = estimated_bytes(found) <= most_bytes // 4
    return chunks.select("id", *columns).join(F.broadcast(found) if small else found, "id")


def enhanced_search(queries: DataFrame, chunks: DataFrame, k: int = 7, hybrid: bool = True, reranker: Callable[[list[str], list[str]], list[float]] | None = None, rerank_results: bool = True, frameworks: list[str] | None = None, indexed: DataFrame | None = None, **options) -> DataFrame:
    """(query_id, id, text, framework_name, distance, rerank_score, confidence, rank_change, rank, retrieval_method): hybrid search, then reranking.

    ``2 * k`` results come from hybrid search, each of whose arms is asked for ``4 * k``, or with ``hybrid=False`` from vectors alone. Their distance is 1 - the
    fused score, 0.5 where that is 0. Reranked results, of which the best ``k`` stay, have 1 - rerank_score instead. ``reranker`` scores batches of
    (query, passage), both cut to length; without one, or where it fails, every candidate scores 0.5. Queries are (id, text, tokens, embedding), chunks
    (id, framework_name, text, section_title, subsection_title); their (id, framework_name, tokens, embedding) are taken from ``indexed``, by default from ``chunks``.
    """
    indexed = chunks if indexed is None else indexed
    from gristmill.operators.rerank import rerank, scored_by
    from gristmill.operators.vector import nearest

    if hybrid:
        found = hybrid_items(queries, indexed, 2 * k, frameworks=frameworks, **options)
        found = found.select("query_id", "id", F.when(F.col("score") != 0, 1 - F.col("score")).otherwise(0.5).alias("distance"), F.col("rank").alias("found_rank"))
    else:
        part = indexed if frameworks is None else indexed.filter(F.col("framework_name").isin(frameworks))
        found = nearest(queries, part, 2 * k).select("query_id", "id", "distance", F.col("rank").alias("found_rank"))
    name = "hybrid" if hybrid else "semantic"
    rows = with_columns_of(found, chunks, "text", "framework_name", "section_title", "subsection_title")
    if not rerank_results:
        none = F.lit(None).cast("double")
        return rows.filter(F.col("found_rank") <= k).select("query_id", "id", "text", "framework_name", "distance", none.alias("rerank_score"), none.alias("confidence"), F.lit(None).cast("int").alias("rank_change"), F.col("found_rank").alias("rank"), F.lit(name).alias("retrieval_method"))
    score = None
    if reranker is not None:
        asked = queries.select(F.col("id").alias("query_id"), T.truncate_passage(F.col("text"), QUERY_CHARS).alias("_asked"))
        passage = T.passage(F.col("section_title"), F.col("subsection_title"), F.col("framework_name"), F.col("text"))
        rows = scored_by(rows.join(asked, "query_id").withColumn("_passage", passage), "_asked", "_passage", reranker, "_score")
        score = F.col("_score")
    best = rerank(rows.withColumn("_near", -F.col("distance")), "query_id", "id", "_near", score, top_k=k, keep=["text", "framework_name"])
    return best.select("query_id", "id", "text", "framework_name", (1 - F.col("rerank_score")).alias("distance"), "rerank_score", "confidence", "rank_change", "rank", F.lit(f"{name}+rerank").alias("retrieval_method"))
