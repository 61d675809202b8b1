"""Reranking the candidates of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, THRESHOLD, RESCUE_SHARE = 50, 0.3, 0.3


def confidence(score: Column) -> Column:
    return F.abs(score - 0.5) * 2


def rerank(df: DataFrame, query: str, item: str, original: str, score: Column | None = None, candidates: int = CANDIDATES, threshold: float = THRESHOLD, top_k: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """query, item, original_rank, rerank_score, confidence, rank, rank_change (original - new, positive up), and the columns of ``keep``.

    The best ``candidates`` by ``original`` are rescored; without a score all get 0.5. If any score of a query lies outside [0, 1] its scores
    are min-max normalised. Candidates under ``threshold`` go, unless fewer than 30 percent would stay: then the best
    max(5, half) stay. Missing scores count 0.5; ties go to the earlier original rank.
    """
    whole = Window.partitionBy(query)
    first = whole.orderBy(F.desc_nulls_last(original), item)
    pool = df.withColumn("original_rank", F.row_number().over(first)).filter(F.col("original_rank") <= candidates)
    value = F.lit(0.5) if score is None else F.coalesce(F.when(~F.isnan(score), score), F.lit(0.5))
    pool = pool.withColumn("_raw", value)
    low, high = F.min("_raw").over(whole), F.max("_raw").over(whole)
    scaled = F.when((low < 0) | (high > 1), (F.col("_raw") - low) / (high - low + 1e-8)).otherwise(F.col("_raw"))
    pool = pool.withColumn("rerank_score", scaled).withColumn("confidence", confidence(F.col("rerank_score")))
    order = whole.orderBy(F.desc(F.round("rerank_score", 9)), "original_rank")
    pool = pool.withColumn("rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_kept", F.count_if(F.col("rerank_score") >= threshold).over(whole))
    rescue = F.col("_kept") < RESCUE_SHARE * F.col("_n")
    stays = F.when(rescue, F.col("rank") <= F.greatest(F.lit(5), F.floor(F.col("_n") / 2))).otherwise(F.col("rerank_score") >= threshold)
    pool = pool.filter(stays).withColumn("rank_change", F.col("original_rank") - F.col("rank"))
    out = pool.select(query, item, "original_rank", "rerank_score", "confidence", "rank", "rank_change", *(keep or []))
    return out.filter(F.col("rank") <= top_k) if top_k else out


def ensemble(lists: list[tuple[DataFrame, float]], query: str, item: str) -> DataFrame:
    """Weighted mean of several rerankers' scores by item; confidence is the score, at most 1. An item absent from a list counts 0 there."""
    total = sum(w for _, w in lists)
    union = None
    for df, weight in lists:
        part = df.select(query, item, (F.col("rerank_score") * (weight / total)).alias("_part"))
        union = part if union is None else union.unionByName(part)
    scored = union.groupBy(query, item).agg(F.sum("_part").alias("rerank_score"))
    order = Window.partitionBy(query).orderBy(F.desc(F.round("rerank_score", 9)), item)
    return scored.withColumn("confidence", F.least(F.lit(1.0), F.col("rerank_score"))).withColumn("rank", F.row_number().over(order))


def statistics(df: DataFrame, by: list[str]) -> DataFrame:
    """Moments and medians of scores, confident and doubtful items, movements."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg("rerank_score").alias("mean_score"),
        F.stddev_pop("rerank_score").alias("std_score"),
        F.min("rerank_score").alias("min_score"),
        F.max("rerank_score").alias("max_score"),
        F.median("rerank_score").alias("median_score"),
        F.count_if(F.col("confidence") > 0.7).alias("confident"),
        F.count_if(F.col("confidence") < 0.3).alias("doubtful"),
        F.avg(F.abs("rank_change")).alias("mean_change"),
        F.count_if(F.col("rank_change") > 0).alias("promoted"),
        F.count_if(F.col("rank_change") < 0).alias("demoted"),
        F.count_if(F.col("rank_change") == 0).alias("unchanged"),
    )


def scored_by(df: DataFrame, query_text: str, passage_text: str, scorer: Callable[[list[str], list[str]], list[float]] | None = None, into: str = "rerank_score", build: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None) -> DataFrame:
    """Adds the scores of a pluggable scorer, called on batches of (query, passage); an error gives 0.5 for its batch.

    Instead of a scorer, ``build`` may make one, once in each task, for models that are loaded and cannot be sent; if that fails, all its scores are 0.5.
    """
    @F.pandas_udf("double")
    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            use = scorer or build()
        except Exception:  # noqa: BLE001  without a model the order stays as it is
            use = None
        for q, p in parts:
            try:
                found = pd.Series(use(q.fillna("").tolist(), p.fillna("").tolist()), dtype="float64")
            except Exception:  # noqa: BLE001
                found = pd.Series([0.5] * len(q))
            yield found

    return df.withColumn(into, scores(F.col(query_text), F.col(passage_text)))
