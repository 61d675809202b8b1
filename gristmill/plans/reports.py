"""Queries that aggregate scores and questions: by model, mode and metadata, run comparison, plans and registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import evaluation, metrics, registry, reporting
from gristmill.plans import sqltext as S
from gristmill.session import table

MODES = ["no_context", "full_framework", "rag"]


def scores(spark, d, *more):
    return reporting.distinct_rows(table(spark, d, "eval_results"), "response_id", "model_name", "evaluation_mode", "accuracy_score", *more)


def rounded(df, *columns):
    """Six decimals; the small shift sends means that end in an exact half the same way in every engine."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in columns})


def model_mode_summary(spark, d):
    return rounded(reporting.run_summary(scores(spark, d), "model_name", "evaluation_mode", "accuracy_score"), "mean_score")


def mode_summary(spark, d):
    """Every known mode, 0.0 where it has no scores."""
    means = scores(spark, d).groupBy(F.col("evaluation_mode").alias("mode")).agg(F.avg("accuracy_score").alias("m"), F.count("accuracy_score").alias("n"))
    known = spark.range(1).select(F.explode(F.array(*(F.lit(m) for m in [*MODES, "raw_files"]))).alias("mode"))
    return known.join(means, "mode", "left").select("mode", F.coalesce("n", F.lit(0)).alias("scored"), F.round(F.coalesce("m", F.lit(0.0)) + 1e-10, 6).alias("mean_score"))


def benchmark_metrics(spark, d):
    out = reporting.score_metrics(scores(spark, d, "scoring_error"), [], "accuracy_score", "scoring_error")
    return rounded(out, "mean_score", "std_score", "min_score", "max_score", "success_rate")


def best_worst_model(spark, d):
    return rounded(reporting.best_and_worst(scores(spark, d), "model_name", "accuracy_score"), "best_mean", "worst_mean")


def model_quality_distribution(spark, d):
    out = reporting.quality_distribution(scores(spark, d, "model_response"), ["model_name"], "accuracy_score", "model_response")
    return rounded(out, "high_share", "medium_share", "low_share")


def model_mode_stats(spark, d):
    out = reporting.score_metrics(scores(spark, d), ["model_name", "evaluation_mode"], "accuracy_score")
    return rounded(out, "mean_score", "std_score", "min_score", "max_score", "success_rate")


def score_summary(spark, d):
    out = reporting.score_summary(scores(spark, d), ["model_name"], "accuracy_score")
    return rounded(out, "mean_score", "min_score", "max_score", "upper_median", "excellent", "good", "fair", "poor")


def _sums(spark, d, *more):
    rows = reporting.distinct_rows(table(spark, d, "eval_results"), "response_id", "question", "accuracy_score", *more)
    sums = reporting.sums_by_question(rows, "question", "accuracy_score", *more)
    return reporting.with_metadata(sums, table(spark, d, "cyber_evals").select("question_id", "input", "metadata"), "question")


def metadata_dims_breakdown(spark, d):
    return rounded(reporting.by_dimensions(_sums(spark, d), ["difficulty", "category", "question_type"]), "mean_score", "min_score", "max_score")


def metadata_multivalue_breakdown(spark, d):
    return rounded(reporting.by_list_dimension(_sums(spark, d), "framework"), "mean_score", "min_score", "max_score")


def recommendations(spark, d):
    sums = _sums(spark, d)
    out = reporting.recommendations(reporting.by_dimensions(sums, ["difficulty", "category", "question_type"]), reporting.by_list_dimension(sums, "framework"))
    return rounded(out, "value")


def run_comparison(spark, d):
    """The mode rag as the current run against no_context as the previous one."""
    rows = scores(spark, d)
    return rounded(reporting.compare_runs(rows.filter("evaluation_mode = 'rag'"), rows.filter("evaluation_mode = 'no_context'"), "model_name", "accuracy_score"), "current_mean", "previous_mean", "change")


def report_rows(spark, d):
    out = reporting.score_metrics(scores(spark, d), ["model_name"], "accuracy_score")
    return rounded(out.select("model_name", "total", "scored", "mean_score", T.score_class(F.col("mean_score")).alias("class")), "mean_score")


def scores_by_method(spark, d):
    """Entries, mean and extremes of each kind of stored score."""
    rows = reporting.distinct_rows(table(spark, d, "eval_results"), "response_id", F.map_values("scores").alias("v"), F.map_keys("scores").alias("k"))
    entries = rows.select(F.explode(F.arrays_zip("k", "v")).alias("x")).select(F.col("x.k").alias("method"), F.col("x.v.score").alias("score"))
    return rounded(reporting.score_metrics(entries, ["method"], "score").select("method", "total", "scored", "failed", "mean_score", "std_score"), "mean_score", "std_score")


def completion_counts(spark, d):
    rows = scores(spark, d, "model_response")
    done = ~F.coalesce(F.col("model_response").startswith("TASK_FAILURE"), F.lit(False))
    return rows.groupBy("model_name", "evaluation_mode").agg(F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"))


def framework_detection(spark, d):
    rows = table(spark, d, "cyber_evals").select("question_id", F.array_join(T.detect_frameworks(F.col("input")), "|").alias("frameworks"))
    return rows.dropDuplicates(["question_id"])


def question_filter(spark, d):
    wanted = evaluation.filter_questions(table(spark, d, "cyber_evals"), difficulty="expert", question_type="scenario", framework="HIPAA")
    return wanted.select("question_id").distinct()


def evaluation_plan(spark, d):
    """Prompts of every question for each model and mode, summed up."""
    names = registry.configured_models(",".join(r.name for r in table(spark, d, "models").select("name").orderBy("name").collect()))
    questions = table(spark, d, "cyber_evals").select("question_id", "input").dropDuplicates(["question_id"])
    plan = evaluation.evaluation_plan(questions, names, tuple(MODES)).withColumn("prompt", evaluation.prompt(F.col("input")))
    return plan.groupBy("model_name", "mode").agg(F.count(F.lit(1)).alias("prompts"), F.sum(F.length("prompt")).alias("prompt_chars"))


def evaluation_modes(spark, d):
    """Models, the first ten questions by their id, and the modes that are switched on."""
    names = [r.name for r in evaluation.first_n(table(spark, d, "models").select("name"), 3, "name").collect()]
    questions = evaluation.first_n(table(spark, d, "cyber_evals").select("question_id").distinct(), 10, "question_id")
    return evaluation.evaluation_plan(questions, names, evaluation.enabled_modes(rag=False))


def running_progress(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    out = evaluation.with_progress(rows, ["user_id"], [F.col("ts"), F.col("event_id")])
    return out.select("event_id", "user_id", F.col("done").cast("long").alias("done"), F.round(F.col("progress") + 1e-10, 6).alias("progress"))


def model_scores(spark, d):
    score = registry.model_score(F.col("id"), F.col("context_length"), F.col("training_data_cutoff"), F.lit("2025-06-30"))
    return table(spark, d, "models").select("id", F.round(score + 1e-10, 6).alias("score"))


def model_registry_select(spark, d):
    rows = registry.select_models(table(spark, d, "models"), ["tools"], 0.5, 5)
    return rows.select("id", registry.infer_provider(F.col("provider"), F.col("id")).alias("provider"), registry.context_bucket(F.col("context_length")).alias("context"), F.array_join(registry.inferred_capabilities(F.col("capabilities"), F.col("context_length")), "|").alias("capabilities"), F.round(F.col("performance_score") + 1e-10, 6).alias("performance_score"))


def model_registry_stats(spark, d):
    return registry.model_statistics(table(spark, d, "models"))


def checkpoint_durations(spark, d):
    out = metrics.checkpoint_durations(table(spark, d, "events"), "user_id", "ts", "event_id")
    return out.select("event_id", "user_id", F.round(F.col("seconds") + 1e-10, 6).alias("seconds"))


def component_metrics(spark, d):
    out = metrics.component_metrics(table(spark, d, "events"), ["user_id"], F.col("event_type") == "error", "value")
    return rounded(out, "total", "mean", "success_rate")


QUERIES = {
    f.__name__: f
    for f in (
        model_mode_summary, mode_summary, benchmark_metrics, best_worst_model, model_quality_distribution, model_mode_stats, score_summary, metadata_dims_breakdown, metadata_multivalue_breakdown, recommendations, run_comparison, report_rows,
        scores_by_method, completion_counts, framework_detection, question_filter, evaluation_plan, evaluation_modes, running_progress, model_scores, model_registry_select, model_registry_stats, checkpoint_durations, component_metrics,
    )
}

# ---- SQL

_E = "e AS (SELECT DISTINCT ON (response_id) * FROM eval_results)"
_METRICS = """count(*) AS total, count(accuracy_score) AS scored, count(*) - count(accuracy_score) AS failed, {errors} round(coalesce(avg(accuracy_score), 0.0) + 1e-10, 6) AS mean_score, round(coalesce(stddev_samp(accuracy_score), 0.0) + 1e-10, 6) AS std_score,
    round(coalesce(min(accuracy_score), 0.0) + 1e-10, 6) AS min_score, round(coalesce(max(accuracy_score), 0.0) + 1e-10, 6) AS max_score, round(count(accuracy_score) * 100.0::DOUBLE / count(*) + 1e-10, 6) AS success_rate"""
_STATS = "count(s) AS scored, round(avg(s) + 1e-10, 6) AS mean_score, round(min(s) + 1e-10, 6) AS min_score, round(max(s) + 1e-10, 6) AS max_score"
_M = f"{_E}, l AS (SELECT input, arg_max(metadata, question_id) AS metadata FROM cyber_evals WHERE input IS NOT NULL GROUP BY input), m AS (SELECT accuracy_score AS s, metadata FROM e LEFT JOIN l ON e.question = l.input WHERE accuracy_score IS NOT NULL)"
_DIMS = " UNION ALL ".join(f"SELECT '{n}' AS dimension, coalesce(metadata.{n}, 'unknown') AS value, s FROM m" for n in ("difficulty", "category", "question_type"))
_LIST = f"SELECT unnest(list_transform(string_split(coalesce(metadata.framework, 'unknown'), ','), lambda f: {S.strip('f')})) AS value, s FROM m"
_BUCKET = "CASE WHEN accuracy_score > 0.8 THEN 'high' WHEN accuracy_score >= 0.4 THEN 'medium' WHEN accuracy_score IS NOT NULL THEN 'low' END"
_COUNT = lambda b: f"count(*) FILTER ({_BUCKET} = '{b}')"
_MEANS = "SELECT model_name, avg(accuracy_score) AS m FROM e GROUP BY model_name HAVING avg(accuracy_score) IS NOT NULL"
SQL = {
    "model_mode_summary": f"""WITH {_E}, r AS (SELECT model_name AS model, coalesce(evaluation_mode, 'unknown') AS mode, accuracy_score FROM e)
        SELECT model, mode, CASE GROUPING(model, mode) WHEN 0 THEN 'model_mode' WHEN 1 THEN 'model' WHEN 2 THEN 'mode' ELSE 'overall' END AS level, count(accuracy_score) AS scored, count(*) AS total, round(coalesce(avg(accuracy_score), 0.0) + 1e-10, 6) AS mean_score
        FROM r GROUP BY GROUPING SETS ((model, mode), (model), (mode), ())""",
    "mode_summary": f"WITH {_E} SELECT k.mode, count(accuracy_score) AS scored, round(coalesce(avg(accuracy_score), 0.0) + 1e-10, 6) AS mean_score FROM (VALUES ('no_context'), ('full_framework'), ('rag'), ('raw_files')) k(mode) LEFT JOIN e ON e.evaluation_mode = k.mode GROUP BY k.mode",
    "benchmark_metrics": f"WITH {_E} SELECT {_METRICS.format(errors='count(scoring_error) AS scoring_errors,')} FROM e",
    "best_worst_model": f"WITH {_E}, g AS ({_MEANS}) SELECT (SELECT model_name FROM g ORDER BY m DESC, model_name LIMIT 1) AS best, round((SELECT max(m) FROM g) + 1e-10, 6) AS best_mean, (SELECT model_name FROM g ORDER BY m, model_name LIMIT 1) AS worst, round((SELECT min(m) FROM g) + 1e-10, 6) AS worst_mean",
    "model_quality_distribution": f"""WITH {_E} SELECT model_name, count(*) AS total, {', '.join(f'{_COUNT(b)} AS {b}' for b in ('high', 'medium', 'low'))}, {', '.join(f'round(coalesce({_COUNT(b)} * 100.0::DOUBLE / nullif(count(accuracy_score), 0), 0.0) + 1e-10, 6) AS {b}_share' for b in ('high', 'medium', 'low'))},
        count(*) FILTER (starts_with(model_response, 'Error:')) AS error_count, count(*) FILTER (starts_with(model_response, 'MODEL_FAILURE:') OR starts_with(model_response, 'TASK_FAILURE:')) AS failure_count FROM e GROUP BY model_name""",
    "model_mode_stats": f"WITH {_E} SELECT model_name, evaluation_mode, {_METRICS.format(errors='')} FROM e GROUP BY ALL",
    "score_summary": f"""WITH {_E} SELECT model_name, count(accuracy_score) AS scored, round(coalesce(avg(accuracy_score), 0.0) + 1e-10, 6) AS mean_score, round(coalesce(min(accuracy_score), 0.0) + 1e-10, 6) AS min_score, round(coalesce(max(accuracy_score), 0.0) + 1e-10, 6) AS max_score,
        round(count(*) FILTER (accuracy_score >= 0.9) / count(accuracy_score) + 1e-10, 6) AS excellent, round(count(*) FILTER (accuracy_score >= 0.8 AND accuracy_score < 0.9) / count(accuracy_score) + 1e-10, 6) AS good,
        round(count(*) FILTER (accuracy_score >= 0.7 AND accuracy_score < 0.8) / count(accuracy_score) + 1e-10, 6) AS fair, round(count(*) FILTER (accuracy_score < 0.7) / count(accuracy_score) + 1e-10, 6) AS poor,
        round(list_sort(list(accuracy_score) FILTER (accuracy_score IS NOT NULL))[count(accuracy_score) // 2 + 1] + 1e-10, 6) AS upper_median FROM e GROUP BY model_name""",
    "metadata_dims_breakdown": f"WITH {_M} SELECT dimension, value, {_STATS} FROM ({_DIMS}) GROUP BY ALL",
    "metadata_multivalue_breakdown": f"WITH {_M} SELECT value, {_STATS} FROM ({_LIST}) GROUP BY ALL",
    "recommendations": f"""WITH {_M}, d AS (SELECT dimension, value, avg(s) AS a FROM ({_DIMS}) GROUP BY ALL), f AS (SELECT value, avg(s) AS a FROM ({_LIST}) GROUP BY ALL),
        h AS (SELECT max(a) FILTER (value = 'expert') AS e, max(a) FILTER (value = 'intermediate') AS i FROM d WHERE dimension = 'difficulty'), lf AS (SELECT value, a FROM f ORDER BY a, value LIMIT 1), lc AS (SELECT value, a FROM d WHERE dimension = 'category' ORDER BY a, value LIMIT 1)
        SELECT 'expert_gap' AS rule, 'expert' AS subject, round(i - e + 1e-10, 6) AS value FROM h WHERE e < i - 0.1 UNION ALL SELECT 'framework_gap', lf.value, round((SELECT max(a) FROM f) - lf.a + 1e-10, 6) FROM lf WHERE (SELECT max(a) FROM f) - lf.a > 0.15
        UNION ALL SELECT 'weak_category', lc.value, round(lc.a + 1e-10, 6) FROM lc WHERE lc.a < 0.7""",
    "run_comparison": f"""WITH {_E}, c AS (SELECT model_name, coalesce(avg(accuracy_score), 0.0) AS x FROM e WHERE evaluation_mode = 'rag' GROUP BY 1), p AS (SELECT model_name, coalesce(avg(accuracy_score), 0.0) AS y FROM e WHERE evaluation_mode = 'no_context' GROUP BY 1)
        SELECT model_name, round(x + 1e-10, 6) AS current_mean, round(y + 1e-10, 6) AS previous_mean, round(x - y + 1e-10, 6) AS change, CASE WHEN y IS NULL THEN 'new' WHEN x IS NULL THEN 'removed' WHEN x - y > 0.05 THEN 'improved' WHEN x - y < -0.05 THEN 'regressed' ELSE 'stable' END AS status FROM c FULL JOIN p USING (model_name)""",
    "report_rows": f"WITH {_E} SELECT model_name, count(*) AS total, count(accuracy_score) AS scored, round(coalesce(avg(accuracy_score), 0.0) + 1e-10, 6) AS mean_score, CASE WHEN coalesce(avg(accuracy_score), 0.0) >= 0.8 THEN 'high' WHEN coalesce(avg(accuracy_score), 0.0) >= 0.4 THEN 'medium' ELSE 'low' END AS class FROM e GROUP BY model_name",
    "scores_by_method": f"WITH {_E}, s AS (SELECT unnest(map_entries(scores)) AS x FROM e) SELECT x.key AS method, count(*) AS total, count(x.value.score) AS scored, count(*) - count(x.value.score) AS failed, round(coalesce(avg(x.value.score), 0.0) + 1e-10, 6) AS mean_score, round(coalesce(stddev_samp(x.value.score), 0.0) + 1e-10, 6) AS std_score FROM s GROUP BY 1",
    "completion_counts": f"WITH {_E} SELECT model_name, evaluation_mode, count(*) FILTER (NOT coalesce(starts_with(model_response, 'TASK_FAILURE'), FALSE)) AS completed, count(*) AS total FROM e GROUP BY ALL",
    "framework_detection": f"SELECT question_id, array_to_string({S.detected('input')}, '|') AS frameworks FROM (SELECT DISTINCT ON (question_id) * FROM cyber_evals)",
    "question_filter": f"SELECT DISTINCT question_id FROM cyber_evals WHERE metadata.difficulty = 'expert' AND metadata.question_type = 'scenario' AND list_contains(list_transform(string_split(metadata.framework, ','), lambda f: {S.strip('f')}), 'HIPAA')",
    "evaluation_plan": f"WITH q AS (SELECT DISTINCT ON (question_id) question_id, input FROM cyber_evals) SELECT m.name AS model_name, o.mode, count(*) AS prompts, CAST(sum(length(replace({S.quoted(evaluation.ASK)}, '{{q}}', input))) AS BIGINT) AS prompt_chars FROM q, models m, (VALUES ('no_context'), ('full_framework'), ('rag')) o(mode) GROUP BY ALL",
    "evaluation_modes": "WITH q AS (SELECT DISTINCT question_id FROM cyber_evals ORDER BY question_id LIMIT 10), m AS (SELECT name FROM models ORDER BY name LIMIT 3) SELECT question_id, name AS model_name, mode FROM q, m, (VALUES ('no_context'), ('full_framework')) o(mode)",
    "running_progress": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, round(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100.0::DOUBLE / count(*) OVER (PARTITION BY user_id) + 1e-10, 6) AS progress FROM events",
    "model_scores": f"""SELECT id, round(least(context_length / 5000, 20.0) + coalesce(greatest(0.0, 10 - date_diff('day', CASE WHEN regexp_matches(training_data_cutoff, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(substr(training_data_cutoff, 1, 10) AS DATE) END, DATE '2025-06-30') / 100), 0.0)
        + CASE {' '.join(f"WHEN {S.contains_any('lower(id)', names)} THEN {points}" for names, points in registry.NAME_TIERS)} ELSE 0 END + 1e-10, 6) AS score FROM models""",
    "model_registry_select": """SELECT id, provider, CASE WHEN context_length < 8000 THEN 'small' WHEN context_length < 32000 THEN 'medium' WHEN context_length < 128000 THEN 'large' ELSE 'very_large' END AS context,
        array_to_string(list_sort(list_distinct(list_concat(capabilities, CASE WHEN context_length > 128000 THEN ['very_large_context'] WHEN context_length > 32000 THEN ['large_context'] ELSE [] END))), '|') AS capabilities, round(performance_score + 1e-10, 6) AS performance_score
        FROM models WHERE is_available AND performance_score >= 0.5 AND list_contains(capabilities, 'tools') ORDER BY performance_score DESC, id LIMIT 5""",
    "model_registry_stats": """WITH u AS (SELECT 'provider' AS "grouping", coalesce(provider, 'unknown') AS value FROM models
        UNION ALL SELECT 'context', CASE WHEN context_length < 8000 THEN 'small' WHEN context_length < 32000 THEN 'medium' WHEN context_length < 128000 THEN 'large' ELSE 'very_large' END FROM models
        UNION ALL SELECT 'score', CASE WHEN performance_score < 0.3 THEN 'low' WHEN performance_score < 0.7 THEN 'medium' ELSE 'high' END FROM models UNION ALL SELECT 'available', CAST(is_available AS VARCHAR) FROM models
        UNION ALL SELECT 'capability', unnest(list_distinct(list_concat(capabilities, CASE WHEN context_length > 128000 THEN ['very_large_context'] WHEN context_length > 32000 THEN ['large_context'] ELSE [] END))) FROM models)
        SELECT "grouping", value, count(*) AS models FROM u GROUP BY ALL""",
    "checkpoint_durations": "SELECT event_id, user_id, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 0.0) + 1e-10, 6) AS seconds FROM events",
    "component_metrics": "SELECT user_id, count(*) AS operations, count(*) FILTER (event_type = 'error') AS failures, round(sum(value) + 1e-10, 6) AS total, round(coalesce(avg(value), 0.0) + 1e-10, 6) AS mean, round(count(*) FILTER (NOT event_type = 'error') * 100.0::DOUBLE / count(*) + 1e-10, 6) AS success_rate FROM events GROUP BY user_id",
}
