"""Aggregation of scored responses by model, mode and question metadata, and comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.skew import HOT_ROWS, split_join

BINS = 256


def distinct_rows(df: DataFrame, key: str, *columns) -> DataFrame:
    """The wanted columns, one row a key; rows that share a key differ in nothing that is kept."""
    return df.select(key, *columns).dropDuplicates([key])


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def run_summary(df: DataFrame, model: str, mode: str, score: str) -> DataFrame:
    """Mean and number of scores overall, by model, by mode, and by both, in one pass; level tells which. Null modes are 'unknown'."""
    rows = df.select(F.col(model).alias("model"), F.coalesce(F.col(mode), F.lit("unknown")).alias("mode"), F.col(score).alias("score"))
    level = F.when(F.grouping_id() == 0, "model_mode").when(F.grouping_id() == 1, "model").when(F.grouping_id() == 2, "mode").otherwise("overall")
    sets = [[F.col("model"), F.col("mode")], [F.col("model")], [F.col("mode")], []]
    return rows.groupingSets(sets, "model", "mode").agg(level.alias("level"), F.count("score").alias("scored"), F.count(F.lit(1)).alias("total"), or_zero(F.avg("score")).alias("mean_score"))


def score_metrics(df: DataFrame, by: list[str], score: str, error: str | None = None) -> DataFrame:
    """Totals, scored and failed counts, mean, sample deviation, least and largest, success rate in percent; zeros where there is nothing."""
    errors = [F.count(error).alias("scoring_errors")] if error else []
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(score).alias("scored"),
        F.count_if(F.col(score).isNull()).alias("failed"),
        *errors,
        or_zero(F.avg(score)).alias("mean_score"),
        or_zero(F.stddev_samp(score)).alias("std_score"),
        or_zero(F.min(score)).alias("min_score"),
        or_zero(F.max(score)).alias("max_score"),
        or_zero(F.try_divide(F.count(score) * 100.0, F.count(F.lit(1)))).alias("success_rate"),
    )


def best_and_worst(df: DataFrame, by: str, score: str) -> DataFrame:
    """One row: the groups with the largest and the least mean score, ties to the first name; null and 0.0 without any scores."""
    means = df.groupBy(by).agg(F.avg(score).alias("mean")).filter("mean is not null")
    first = lambda c: F.struct(c, F.col(by))
    low = F.min(first(F.col("mean")))
    high = F.min(first(-F.col("mean")))
    return means.agg(high[by].alias("best"), or_zero(-high["col1"]).alias("best_mean"), low[by].alias("worst"), or_zero(low["mean"]).alias("worst_mean"))


def quality_distribution(df: DataFrame, by: list[str], score: str, response: str | None = None) -> DataFrame:
    """Counts and percentages of high, medium and low scores; with a response also replies that begin like errors or failures."""
    bucket = T.quality_bucket(F.col(score))
    counts = [F.count_if(bucket == b).alias(b) for b in ("high", "medium", "low")]
    shares = [or_zero(F.try_divide(F.count_if(bucket == b) * 100.0, F.count(score))).alias(f"{b}_share") for b in ("high", "medium", "low")]
    extra = []
    if response:
        extra = [F.count_if(F.col(response).startswith("Error:")).alias("error_count"), F.count_if(F.col(response).startswith("MODEL_FAILURE:") | F.col(response).startswith("TASK_FAILURE:")).alias("failure_count")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, *shares, *extra)


def kth_smallest(df: DataFrame, by: list[str], value: str, k: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per group, the ``k``-th smallest value (``k`` may use ``n``, the group's number of values); exact, and no group meets in one task.

    Values are counted with partial sums, binned between approximate quantiles, and only the bin that holds the wanted rank is looked into. Of the groups only
    those with many values take their quantiles by broadcast, the others meet theirs in a shuffle.
    """
    df = df.withColumn("_all", F.lit(0)) if not by else df
    by = by or ["_all"]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy(*by).agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 10_000).alias("_edges"), F.sum("_c").alias("n")).withColumn("_k", k.cast("long"))
    binned = split_join(counts, edges, by, sizes, hot_rows, null_safe=by).withColumn("_bin", F.size(F.filter("_edges", lambda x: x <= F.col(value)))).drop("_edges")
    sums = binned.groupBy(*by, "_k", "_bin").agg(F.sum("_c").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy(*by).orderBy("_bin"))
    hit = sums.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_in") < F.col("_k"))).select(*by, F.col("_bin").alias("_hit"), (F.col("_upto") - F.col("_in")).alias("_before"))
    inside = split_join(binned, hit, by, sizes, hot_rows, null_safe=by).filter(F.col("_bin") == F.col("_hit"))
    place = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by).orderBy(value))
    found = inside.withColumn("_place", place).filter(F.col("_place") >= F.col("_k")).groupBy(*by).agg(F.min(value).alias("kth"), F.first("n").alias("n"))
    return found.drop("_all")


def score_summary(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """count, mean, upper median (the value at place n div 2, from 0), least, largest, and the shares of four bins."""
    value = F.col(score)
    share = lambda c: or_zero(F.try_divide(F.count_if(c) * 1.0, F.count(score)))
    sums = df.groupBy(*by).agg(
        F.count(score).alias("scored"), or_zero(F.avg(score)).alias("mean_score"), or_zero(F.min(score)).alias("min_score"), or_zero(F.max(score)).alias("max_score"),
        share(value >= 0.9).alias("excellent"), share((value >= 0.8) & (value < 0.9)).alias("good"), share((value >= 0.7) & (value < 0.8)).alias("fair"), share(value < 0.7).alias("poor"),
    )
    medians = kth_smallest(df, by, score, F.floor(F.col("n") / 2) + 1).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("kth").alias("upper_median"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return sums.join(medians, on, "left").drop(*[f"_{c}" for c in by]).withColumn("upper_median", or_zero(F.col("upper_median")))


def sums_by_question(df: DataFrame, question: str, score: str, *more: str) -> DataFrame:
    """Partial sums of the scores by question text, so that whatever is joined next meets each question once."""
    return df.filter(F.col(score).isNotNull()).groupBy(question, *more).agg(F.count(score).alias("_n"), F.sum(score).alias("_sum"), F.min(score).alias("_min"), F.max(score).alias("_max"))


def with_metadata(sums: DataFrame, questions: DataFrame, question: str, text: str = "input", metadata: str = "metadata", order: str = "question_id") -> DataFrame:
    """The metadata of each question text, of the last by ``order`` where texts repeat; questions without any keep nulls."""
    last = questions.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias(question)).agg(F.max_by(metadata, order).alias(metadata))
    return sums.join(last, question, "left")


def merge_sums(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("_n").alias("scored"), (F.sum("_sum") / F.sum("_n")).alias("mean_score"), F.min("_min").alias("min_score"), F.max("_max").alias("max_score"))


def by_dimensions(sums: DataFrame, dimensions: list[str], metadata: str = "metadata") -> DataFrame:
    """Statistics by the value of each dimension, all dimensions in one aggregation; missing values are 'unknown'."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"{metadata}.{d}"), F.lit("unknown")).alias("value")) for d in dimensions))
    return merge_sums(sums.select("*", F.inline(pairs)), "dimension", "value")


def by_list_dimension(sums: DataFrame, dimension: str, metadata: str = "metadata") -> DataFrame:
    """Statistics by each element of a comma list, trimmed; an element named twice counts twice, a missing list is 'unknown'."""
    parts = F.transform(F.split(F.coalesce(F.col(f"{metadata}.{dimension}"), F.lit("unknown")), ","), T.strip)
    return merge_sums(sums.select("*", F.explode(parts).alias("value")), "value")


def recommendations(dimensions: DataFrame, frameworks: DataFrame, expert_gap: float = 0.1, framework_gap: float = 0.15, least_category: float = 0.7) -> DataFrame:
    """(rule, subject, value): experts' questions scored well below intermediate ones, frameworks far apart, a weak lowest category."""
    of = lambda name: F.max(F.when((F.col("dimension") == "difficulty") & (F.col("value") == name), F.col("mean_score")))
    hard = dimensions.agg(of("expert").alias("e"), of("intermediate").alias("i")).filter(F.col("e") < F.col("i") - expert_gap).select(F.lit("expert_gap").alias("rule"), F.lit("expert").alias("subject"), (F.col("i") - F.col("e")).alias("value"))
    apart = frameworks.agg(F.min(F.struct("mean_score", "value")).alias("low"), F.max("mean_score").alias("high")).filter(F.col("high") - F.col("low.mean_score") > framework_gap).select(F.lit("framework_gap").alias("rule"), F.col("low.value").alias("subject"), (F.col("high") - F.col("low.mean_score")).alias("value"))
    weak = dimensions.filter("dimension = 'category'").agg(F.min(F.struct("mean_score", "value")).alias("low")).filter(F.col("low.mean_score") < least_category).select(F.lit("weak_category").alias("rule"), F.col("low.value").alias("subject"), F.col("low.mean_score").alias("value"))
    return hard.unionByName(apart).unionByName(weak)


def compare_runs(current: DataFrame, previous: DataFrame, model: str, score: str, band: float = 0.05) -> DataFrame:
    """Per model of either run: both means, their difference, and improved, regressed, stable, new or removed."""
    mean = lambda df, name: df.groupBy(model).agg(or_zero(F.avg(score)).alias(name))
    both = mean(current, "current_mean").join(mean(previous, "previous_mean"), model, "full")
    change = F.col("current_mean") - F.col("previous_mean")
    status = F.when(F.col("previous_mean").isNull(), "new").when(F.col("current_mean").isNull(), "removed").when(change > band, "improved").when(change < -band, "regressed").otherwise("stable")
    return both.withColumn("change", change).withColumn("status", status)


def judge_statistics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of the outcomes of merged judges."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    rate = lambda c: c / F.greatest(F.lit(1), F.count(F.lit(1)))
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), n("both", "first").alias("first_successes"), n("second", "none").alias("first_failures"), n("both", "second").alias("second_successes"), n("first", "none").alias("second_failures"),
        rate(n("both", "first")).alias("first_rate"), rate(n("both", "second")).alias("second_rate"), rate(n("both")).alias("dual_rate"), F.count_if("flagged").alias("flagged"),
    )
