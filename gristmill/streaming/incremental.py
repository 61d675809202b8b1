"""Reports that follow a stream of results, an extension of the batch aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.reporting import or_zero


def windowed_scores(stream: DataFrame, at: str = "loaded_at", key: str = "response_id", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Scores by model and event-time window; a response that comes twice within ``delay`` counts once, later rows than that are dropped."""
    fresh = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key])
    out = fresh.groupBy(F.window("_at", width), "model_name").agg(F.count(F.lit(1)).alias("total"), F.count("accuracy_score").alias("scored"), or_zero(F.avg("accuracy_score")).alias("mean_score"))
    return out.select(F.col("window.start").alias("window_start"), "model_name", "total", "scored", "mean_score")


def follow_summary(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps partial sums by model and mode, a folder per micro-batch. A batch that is run again replaces its own folder, so nothing counts twice."""

    def store(batch: DataFrame, number: int) -> None:
        sums = batch.dropDuplicates(["response_id"]).groupBy("model_name", F.coalesce("evaluation_mode", F.lit("unknown")).alias("mode")).agg(F.count(F.lit(1)).alias("total"), F.count("accuracy_score").alias("scored"), F.sum("accuracy_score").alias("sum"), F.min("accuracy_score").alias("low"), F.max("accuracy_score").alias("high"))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of all batches so far, merged."""
    parts = spark.read.parquet(folder)
    return parts.groupBy("model_name", "mode").agg(F.sum("total").alias("total"), F.sum("scored").alias("scored"), or_zero(F.try_divide(F.sum("sum"), F.sum("scored"))).alias("mean_score"), or_zero(F.min("low")).alias("min_score"), or_zero(F.max("high")).alias("max_score"))
