import json

import pytest
from pyspark.sql import functions as F

from gristmill.sources import readers, writers
from gristmill.streaming import incremental


def test_frameworks_and_documents(spark, tmp_path):
    for name, documents in (("b", ["two.md", "gone.md"]), ("a", ["one.md"])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "metadata.toml").write_text(f'[framework]\nname = "{name}"\nfull_name = "Full {name}"\n[files]\ndocuments = {json.dumps(documents)}\n[metadata]\ndomain = "x"\n')
    (tmp_path / "LICENSE").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "a" / "one.md").write_text("# One\n\ntext")
    (tmp_path / "b" / "two.md").write_text("two")
    found = readers.scan_frameworks(spark, str(tmp_path))
    assert [r.name for r in found.select("framework.name").collect()] == ["a", "b"]
    documents, missing = readers.read_documents(spark, found)
    assert {(r.framework_name, r.document, r.text) for r in documents.collect()} == {("a", "one.md", "# One\n\ntext"), ("b", "two.md", "two")}
    assert [r.document for r in missing.collect()] == ["gone.md"]
    assert {r.folder: r.context for r in readers.read_raw_contexts(spark, str(tmp_path)).collect()} == {"a": "## one.md\n# One\n\ntext", "b": "## two.md\ntwo"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": "1", "input": "x", "metadata": {"framework": "A"}}\n\n{"question_id": "2"}\n')
    assert [r.question_id for r in readers.read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("question_id").collect()] == ["1", "2"]
    (tmp_path / "bad.jsonl").write_text('{"question_id": \n')
    with pytest.raises(Exception):
        readers.read_questions(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"framework": {"name": "a"}}, "chunks": [{"chunk_id": "a_d_0", "text": "t", "char_count": 1}], "total_chunks": 1}, indent=1))
    assert readers.read_chunk_files(spark, str(tmp_path / "c.json")).first().chunk_id == "a_d_0"


def test_config():
    config = readers.Config(text="[A]\nn = 3\nf = yes\nl = a, ,b\n")
    assert config.get("A", "n", kind=int) == 3 and config.get("A", "f", kind=bool) is True and config.get("A", "l", kind=list) == ["a", "b"] and config.get("A", "x", 7) == 7
    with pytest.raises(KeyError):
        config.get("A", "x")


@pytest.fixture(scope="module")
def results(spark):
    rows = [("r1", "m<1>", "rag", 0.9, None, "2024-01-01 10:00:00"), ("r2", "m<1>", "rag", None, "e", "2024-01-01 11:00:00"), ("r3", "m2", "raw", 0.3, None, "2024-01-02 10:00:00")]
    return spark.createDataFrame(rows, "response_id string, model_name string, evaluation_mode string, accuracy_score double, scoring_error string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))


def test_sinks(spark, tmp_path, results):
    chunks = spark.createDataFrame([("a", "a_0", "t", [0.5]), ("b", "b_0", "u", None)], "framework_name string, chunk_id string, text string, embedding array<float>")
    for _ in range(2):  # writing again replaces
        writers.write_chunks(chunks, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    writers.write_vectors(chunks, str(tmp_path / "vectors"))
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 1
    writers.write_results(results, str(tmp_path / "results"))
    assert readers.read_results(spark, str(tmp_path / "results")).count() == 3
    found = writers.write_metrics(results, str(tmp_path / "metrics.json"))
    assert found["overall"]["total"] == 3 and json.loads((tmp_path / "metrics.json").read_text())["models"][0]["model_name"] == "m<1>"
    writers.write_report(results, str(tmp_path / "report.html"), "A & B")
    page = (tmp_path / "report.html").read_text()
    assert "m&lt;1&gt;" in page and "A &amp; B" in page and "class='high'" in page and "class='low'" in page
    assert {r["status"] for r in writers.write_comparison(results, results, str(tmp_path / "cmp.json"))} == {"stable"}
    models = spark.createDataFrame([("m", 0.5)], "id string, performance_score double")
    writers.write_models(models, str(tmp_path / "models"), "2024-01-01 00:00:00")
    assert readers.read_models(spark, str(tmp_path / "models"), "2024-01-01 12:00:00", 24).count() == 1
    assert readers.read_models(spark, str(tmp_path / "models"), "2024-01-03 00:00:00", 24).count() == 0


def test_streams(spark, tmp_path, results):
    source = str(tmp_path / "in")
    results.unionByName(results.filter("response_id = 'r1'")).write.parquet(source)
    stream = lambda: spark.readStream.schema(results.schema).parquet(source)
    for extra in (False, True):
        if extra:
            results.withColumn("response_id", F.concat(F.lit("x"), "response_id")).write.mode("append").parquet(source)
        incremental.follow_summary(stream(), str(tmp_path / "sums"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.model_name, r.mode): (r.total, r.scored, r.mean_score) for r in incremental.read_summary(spark, str(tmp_path / "sums")).collect()}
    assert got == {("m<1>", "rag"): (4, 2, 0.9), ("m2", "raw"): (2, 2, 0.3)}
    query = incremental.windowed_scores(stream()).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.model_name, r.total) for r in spark.sql("SELECT * FROM windows").collect()} == {("m<1>", 4), ("m2", 2)}
