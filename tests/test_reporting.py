import hashlib

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evaluation, metrics, registry, reporting as P
from gristmill.plans import corpus


@pytest.fixture(scope="module")
def rows(spark):
    data = [("r1", "m1", "rag", 0.9, "q1"), ("r2", "m1", "rag", None, "q1"), ("r3", "m1", None, 0.5, "q2"), ("r4", "m2", "rag", 0.4, "q1"), ("r5", "m3", "rag", None, "q9"), ("r6", "m2", "raw", 0.8, None)]
    return spark.createDataFrame(data, "response_id string, model string, mode string, score double, question string")


def test_summary(rows):
    got = {(r.level, r.model, r.mode): (r.scored, r.total, round(r.mean_score, 6)) for r in P.run_summary(rows, "model", "mode", "score").collect()}
    assert got["overall", None, None] == (4, 6, 0.65)
    assert got["model", "m3", None] == (0, 1, 0.0) and got["mode", None, "unknown"] == (1, 1, 0.5) and got["model_mode", "m1", "rag"] == (1, 2, 0.9)


def test_metrics(rows):
    one = {r.model: r for r in P.score_metrics(rows, ["model"], "score").collect()}
    assert one["m1"].std_score == pytest.approx(0.282843, abs=1e-6) and one["m3"].std_score == 0.0 and one["m3"].success_rate == 0.0 and one["m2"].success_rate == 100.0
    empty = P.score_metrics(rows.limit(0), [], "score").first()
    assert (empty.total, empty.mean_score, empty.success_rate) == (0, 0.0, 0.0)


def test_best_and_worst(rows, spark):
    assert tuple(P.best_and_worst(rows, "model", "score").first())[::2] == ("m1", "m2")
    tie = spark.createDataFrame([("b", 0.5), ("a", 0.5)], "model string, score double")
    assert tuple(P.best_and_worst(tie, "model", "score").first()) == ("a", 0.5, "a", 0.5)
    assert tuple(P.best_and_worst(tie.limit(0), "model", "score").first()) == (None, 0.0, None, 0.0)


def test_upper_median_is_exact_for_any_size(spark):
    import random

    rng = random.Random(1)
    data = [(g, rng.choice([round(rng.random(), 3), 0.5])) for g in [None, "a", "b"] for _ in range(rng.randint(900, 1500))] + [("one", 0.7), ("two", 0.2), ("two", 0.4), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.kth for r in P.kth_smallest(df, ["g"], "v", F.floor(F.col("n") / 2) + 1).collect()}
    for g in {d[0] for d in data} - {"none"}:
        values = sorted(v for k, v in data if k == g and v is not None)
        assert got[g] == values[len(values) // 2]
    assert "none" not in got
    summary = {r.g: r for r in P.score_summary(df, ["g"], "v").collect()}
    assert summary["two"].upper_median == 0.4 and summary["none"].upper_median == 0.0 and summary["one"].fair == 1.0


def test_metadata(rows, spark):
    questions = spark.createDataFrame([("1", "q1", ("expert", "A, B ,A")), ("2", "q1", ("basic", "B")), ("3", "q2", (None, None))], "question_id string, input string, metadata struct<difficulty: string, framework: string>")
    sums = P.with_metadata(P.sums_by_question(rows, "question", "score"), questions, "question")
    got = {r.value: (r.scored, round(r.mean_score, 6)) for r in P.by_dimensions(sums, ["difficulty"]).collect()}
    assert got == {"basic": (2, 0.65), "unknown": (2, 0.65)}
    lists = {r.value: r.scored for r in P.by_list_dimension(sums, "framework").collect()}
    assert lists == {"B": 2, "unknown": 2}


def test_comparison(spark):
    make = lambda rows: spark.createDataFrame(rows, "model string, score double")
    got = {r.model: r.status for r in P.compare_runs(make([("a", 0.5), ("b", 0.75), ("c", 0.25), ("n", 1.0)]), make([("a", 0.5), ("b", 0.5), ("c", 0.5), ("x", None)]), "model", "score").collect()}
    assert got == {"a": "stable", "b": "improved", "c": "regressed", "n": "new", "x": "removed"}


def test_plan_and_contexts(spark):
    questions = spark.createDataFrame([("1", "why", ("expert", "SOC 2, GDPR"))], "question_id string, input string, metadata struct<difficulty: string, framework: string>")
    assert evaluation.filter_questions(questions, framework="GDPR", difficulty="expert", unknown="x").count() == 1 and evaluation.filter_questions(questions, framework="SOC").count() == 0
    plan = evaluation.evaluation_plan(questions, ["m1", "m2"]).withColumn("prompt", evaluation.prompt(F.col("input")))
    assert plan.count() == 6 and plan.first().prompt.startswith("Question: why\n\n") and evaluation.evaluation_plan(questions, []).count() == 0

    def client(model, prompt):
        if model == "m2":
            raise ValueError("down")
        return "fine"

    got = {(r.model_name, r.model_response) for r in evaluation.call_models(plan, client, pause=lambda s: None).collect()}
    assert got == {("m1", "fine"), ("m2", "MODEL_FAILURE: Model query failed after 3 attempts: down")}
    assert {r.model_response for r in evaluation.call_models(plan.withColumn("prompt", F.lit(None).cast("string")), client).collect()} == {"TASK_FAILURE: no model or no prompt"}
    chunks = spark.createDataFrame([("f", "d", 1, "two"), ("f", "d", 0, "one"), ("f", "e", 0, "x")], "framework string, document string, position int, text string")
    got = {r.document: r.context for r in evaluation.context_blocks(chunks, ["framework", "document"], "position").collect()}
    assert got == {"d": "## d\none\n\ntwo", "e": "## e\nx"}


def test_contexts_of_any_size(spark, tmp_path):
    rows = spark.range(100_002).select(F.concat_ws("_", F.lit("f"), F.lit("big"), F.col("id").cast("string")).alias("chunk_id"), F.lit("f").alias("framework_name"), F.lit("big").alias("document"), F.col("id").cast("int").alias("position"), F.concat(F.lit("té"), F.col("id").cast("string")).alias("text"))
    few = spark.createDataFrame([("n0", None, "n", 1, "two"), ("n1", None, "n", 0, "one"), ("n1", None, "n", 0, "one"), ("z0", "f", "z", 0, None), ("z1", "f", "z", 1, "x")], "chunk_id string, framework_name string, document string, position int, text string")
    rows.unionByName(few).write.parquet(f"{tmp_path}/chunks.parquet")
    whole = "## big\n" + "\n\n".join(f"té{i}" for i in range(100_002))
    want = {("f", "big", 100_002, whole), (None, "n", 2, "## n\none\n\ntwo"), ("f", "z", 2, "## z\nx")}
    got = {tuple(r) for r in corpus.raw_contexts(spark, str(tmp_path)).collect()}
    assert got == {(f, d, n, len(t), hashlib.md5(t.encode()).hexdigest()) for f, d, n, t in want}
    blocks = evaluation.context_blocks(rows, ["framework_name", "document"], "position", block_chars=10_000).orderBy("block").collect()
    assert len(blocks) > 50 and all(len(b.context) <= 10_000 for b in blocks) and [b.block for b in blocks] == list(range(len(blocks)))
    assert "".join(b.context for b in blocks) == whole and blocks[-1].parts == 100_002 and blocks[-1].context_chars == len(whole)


def test_registry_and_metrics(spark):
    assert registry.configured_models(" a, ,b ") == ["a", "b"]
    with pytest.raises(ValueError):
        registry.configured_models(" , ")
    models = spark.createDataFrame([("openai/x", None, 200_000, ["tools"], 0.5, True), ("y", "p", 4000, None, 0.9, True), ("z", "p", 64_000, ["tools"], 0.9, False)], "id string, provider string, context_length int, capabilities array<string>, performance_score double, is_available boolean")
    assert [r.id for r in registry.select_models(models).collect()] == ["y", "openai/x"] and [r.id for r in registry.select_models(models, ["tools"]).collect()] == ["openai/x"]
    assert models.select(registry.infer_provider(F.col("provider"), F.col("id")).alias("p")).first().p == "openai"
    stats = {(r.grouping, r.value): r.models for r in registry.model_statistics(models).collect()}
    assert stats["capability", "very_large_context"] == 1 and stats["capability", "large_context"] == 1 and stats["context", "small"] == 1
    events = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:01.5"), (3, "b", "2024-01-01 00:00:09")], "k int, c string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r.k: r.seconds for r in metrics.checkpoint_durations(events, "c", "t", "k").collect()} == {1: 0.0, 2: 1.5, 3: 0.0}
