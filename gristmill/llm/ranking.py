"""Problem 7: one ranking from differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.skew import meet, numbered, split_hot, split_join
from gristmill.session import cut_lineage

HOT_ROWS = 1_000_000
BINS = 256


def clean_scores(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row per (group, item), NaN turned to null. Rows are laid out by group once; no later step of a small group shuffles again."""
    columns = [F.when(~F.isnan(s), F.col(s)).alias(s) for s in scores]
    laid = df.select(group, item, *columns).repartition(group)
    return laid.groupBy(group, item).agg(*(F.max(s).alias(s) for s in scores))


def _small_ranks(df: DataFrame, group: str, scores: list[str]) -> DataFrame:
    whole = Window.partitionBy(group)
    for s in scores:
        order = whole.orderBy(F.col(s).desc_nulls_last())
        df = df.withColumn(f"{s}_rank", F.when(F.col(s).isNotNull(), F.rank().over(order))).withColumn(f"{s}_ties", F.when(F.col(s).isNotNull(), F.count(F.lit(1)).over(order.rangeBetween(0, 0)))).withColumn(f"{s}_n", F.count(s).over(whole))
    return df


def _hot_ranks(df: DataFrame, group: str, scores: list[str], hot_rows: int) -> DataFrame:
    """The same columns for groups too large for one task: values are counted, binned by quantile, and ranked bin by bin."""
    df = cut_lineage(df)
    for s in scores:
        values = df.filter(F.col(s).isNotNull()).groupBy(group, s).agg(F.count(F.lit(1)).alias("_ties"))
        edges = values.groupBy(group).agg(F.percentile_approx(s, [i / BINS for i in range(1, BINS)], 10_000).alias("_edges"), F.sum("_ties").alias("_n"))
        binned = meet(values, edges, [group]).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col(s))))
        sums = binned.groupBy(group, "_bin").agg(F.sum("_ties").alias("_in"))
        above = sums.withColumn("_above", F.coalesce(F.sum("_in").over(Window.partitionBy(group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_in")
        inner = Window.partitionBy(group, "_bin").orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, -1)
        ranked = binned.withColumn("_before", F.coalesce(F.sum("_ties").over(inner), F.lit(0)))
        ranked = meet(ranked, above, [group, "_bin"])
        # each step reads the rows several times, so what it made is written once before the next begins
        ranked = cut_lineage(ranked.select(group, s, (F.col("_above") + F.col("_before") + 1).cast("int").alias(f"{s}_rank"), F.col("_ties").alias(f"{s}_ties")))
        df = split_join(df, ranked, [group, s], ranked.select(group, s, F.col(f"{s}_ties").alias("n")), hot_rows, "left", null_safe=[group])
        df = meet(df, edges.select(group, F.col("_n").alias(f"{s}_n")), [group], "left").fillna(0, [f"{s}_n"])
        df = cut_lineage(df)
    return df


def score_ranks(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Competition rank (1 best), number of ties and of scored items, per score, of each (group, item); null where the score is missing.

    Groups up to ``hot_rows`` rows are ranked by windows over one common layout; larger ones by counted values in quantile bins, so that no
    task holds such a group.
    """
    cold, large = split_hot(df, [group], hot_rows)
    small = _small_ranks(clean_scores(cold, group, item, scores), group, scores)
    if large is None:
        return small
    columns = [F.when(~F.isnan(s), F.col(s)).alias(s) for s in scores]
    large = large.select(group, item, *columns).groupBy(group, item).agg(*(F.max(s).alias(s) for s in scores))
    return small.unionByName(_hot_ranks(large, group, scores, hot_rows).select(*small.columns))


def order_statistic(x: Column, j: int, k: int) -> Column:
    """P(the j-th smallest of k uniform values <= x), the beta(j, k - j + 1) distribution function."""
    return reduce(lambda a, b: a + b, (F.lit(float(math.comb(k, i))) * F.pow(x, F.lit(i)) * F.pow(1 - x, F.lit(k - i)) for i in range(j, k + 1)))


def _rho(ranks: Column, size: int) -> Column:
    """Corrected minimum of the order-statistic probabilities of an array of normalised ranks in rising order."""
    rho = F.lit(1.0)
    for k in range(1, size + 1):
        least = [order_statistic(F.element_at(ranks, j), j, k) for j in range(1, k + 1)]
        least = F.least(*least) if k > 1 else least[0]
        rho = F.when(F.size(ranks) == k, F.least(least * k, F.lit(1.0))).otherwise(rho)
    return rho


def _normalised(ranks: list[Column], scores: list[str]) -> Column:
    """Middle ranks over the number of scored items, in rising order; ``ranks`` are the first ranks among equals."""
    shares = ((r + (F.col(f"{s}_ties") - 1) / 2) / F.col(f"{s}_n") for r, s in zip(ranks, scores))
    return F.array_sort(F.array_compact(F.array(*(F.when(x > 1, 1.0).otherwise(x) for x in shares))))


def significance(df: DataFrame, scores: list[str]) -> DataFrame:
    """Adds ``rho``: the least order-statistic probability of the sorted normalised ranks, times their number, at most 1.

    A rank is normalised by the number of items scored in its list, ties take their middle rank, and missing scores leave
    the remaining ranks to decide. Without any score rho is 1.
    """
    df = df.withColumn("_ranks", _normalised([F.col(f"{s}_rank") for s in scores], scores))
    mean = F.when(F.size("_ranks") > 0, F.aggregate("_ranks", F.lit(0.0), lambda a, x: a + x) / F.size("_ranks")).otherwise(F.lit(1.0))
    return df.withColumn("rho", _rho(F.col("_ranks"), len(scores))).withColumn("mean_rank", mean).drop("_ranks")


def aggregate_rankings(df: DataFrame, group: str = "search_id", item: str = "chunk_id", scores: tuple[str, ...] = ("semantic_score", "bm25_score", "rerank_score"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """rho, mean_rank and the ranks of every (group, item), repeated rows counting once; see ``with_positions`` for the order."""
    return significance(score_ranks(df, group, item, list(scores), hot_rows), list(scores))


def with_positions(ranked: DataFrame, group: str = "search_id", item: str = "chunk_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """position from 1 within the group, of any size: by rho, then mean normalised rank, both to twelve decimals, then item."""
    return numbered(ranked, [group], [F.round("rho", 12), F.round("mean_rank", 12), F.col(item)], "position", hot_rows)


def sole_leaders(ranked: DataFrame, group: str = "search_id", item: str = "chunk_id", scores: tuple[str, ...] = ("semantic_score", "bm25_score", "rerank_score"), within: int = 3) -> DataFrame:
    """(group, item) of the groups with exactly one item that has all scores and stands among the first ``within`` of each.

    Candidates come from the aggregated ranking. rho never falls when a rank does, so a leader's rho is at most that of an item that
    stands exactly at ``within`` in every list with as many ties; only items within that bound are compared rank by rank.
    """
    bound = _rho(_normalised([F.lit(float(within))] * len(scores), list(scores)), len(scores))
    likely = ranked.filter(F.col("rho") <= bound + 1e-9)
    leads = reduce(lambda a, b: a & b, (F.col(f"{s}_rank") <= within for s in scores))
    leaders = likely.filter(leads).groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(item).alias(item))
    return leaders.filter(F.col("_n") == 1).select(group, item)
