"""Operation metrics from event rows: durations between checkpoints and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.skew import hot_from, meet

SLICES = 1024  # of a hot component


def checkpoint_durations(events: DataFrame, by: str, at: str, key: str, slice_rows: int = 1_000_000) -> DataFrame:
    """Seconds since the previous event of the same component in order of time and key; 0 for its first.

    A component may hold any share of the events, so its events are ordered within slices of time. A component's slices are as many as its rows fill at
    ``slice_rows`` each, between edges at the quantiles of its times; events of one instant are ordered by their key alone and differ by 0 seconds, so only the first of them needs the event before. That is
    the last of the component's earlier instants, found among one row per instant.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    instants = events.groupBy(F.col(by).alias("_by"), micros.alias("_at")).agg(F.min(key).alias("_first"))
    counts = instants.groupBy("_by").agg(F.count(F.lit(1)).alias("n"))
    large = hot_from(counts, slice_rows).select("_by")
    edges = meet(instants, large, ["_by"], "left_semi").groupBy("_by").agg(F.percentile_approx("_at", [i / SLICES for i in range(1, SLICES)], 10_000).alias("_edges"))
    sliced = meet(instants, edges, ["_by"], "left").withColumn("_slice", F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col("_at"))), F.lit(0))).drop("_edges")
    lasts = sliced.groupBy("_by", "_slice").agg(F.max("_at").alias("_last"))
    earlier = lasts.select("_by", "_slice", F.lag("_last").over(Window.partitionBy("_by").orderBy("_slice")).alias("_before"))
    inside = sliced.withColumn("_inside", F.lag("_at").over(Window.partitionBy("_by", "_slice").orderBy("_at")))
    e = earlier.select(F.col("_by").alias("_b"), F.col("_slice").alias("_s"), "_before")
    gaps = inside.join(e, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_slice") == F.col("_s")), "left").select("_by", "_at", "_first", ((F.col("_at") - F.coalesce("_inside", "_before")) / 1e6).alias("_gap"))
    here = events.select(by, key, at, micros.alias("_micros"))
    met = here.join(gaps, F.col(by).eqNullSafe(F.col("_by")) & F.col("_micros").eqNullSafe(F.col("_at")), "left")
    return met.select(by, key, at, F.when(F.col(key) == F.col("_first"), F.coalesce("_gap", F.lit(0.0))).otherwise(F.lit(0.0)).alias("seconds"))


def component_metrics(events: DataFrame, by: list[str], failed, amount: str) -> DataFrame:
    """Operations, failures, total and mean amount, and success rate in percent."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(failed).alias("failures"), F.sum(amount).alias("total"), F.coalesce(F.avg(amount), F.lit(0.0)).alias("mean"),
        F.coalesce(F.try_divide(F.count_if(~failed) * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"),
    )
