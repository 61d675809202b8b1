import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import scoring as C
from gristmill.functions import text as T
from gristmill.operators import chunking, evaluation, fusion, metrics, registry, reporting, skew
from gristmill.operators.index import SearchIndex
from gristmill.plans import corpus
from gristmill.sources import readers, writers


def test_numbers_within_hot_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b", "c"]), rng.randint(0, 20), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        for n, (_, k) in enumerate(sorted((-v, k) for x, v, k in rows if x == g), 1):
            want[k] = n
    for hot in (10**6, 100):
        assert {r.k: r["rank"] for r in skew.numbered(df, ["g"], [F.desc("v"), F.col("k")], hot_rows=hot).collect()} == want
    done = {r.k: (r.done, r.progress) for r in evaluation.with_progress(df, ["g"], [F.desc("v"), F.col("k")], hot_rows=100).collect()}
    sizes = {g: sum(r[0] == g for r in rows) for g in {r[0] for r in rows}}
    assert all(done[k] == (want[k], want[k] * 100.0 / sizes[g]) for g, _, k in rows)
    assert skew.numbered(df.limit(0), ["g"], ["k"]).collect() == []


def test_durations_and_medians_of_hot_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 400) * 1_000_000, i) for i in range(1500)] + [("a", None, 5000)]
    df = spark.createDataFrame(rows, "c string, us long, k int").withColumn("t", F.timestamp_micros("us"))
    want = {5000: 0.0}
    for c in {r[0] for r in rows}:
        at = sorted((u, k) for x, u, k in rows if x == c and u is not None)
        want |= {k: (u - at[i - 1][0]) / 1e6 if i else 0.0 for i, (u, k) in enumerate(at)}
    for hot in (10**6, 50):
        assert {r.k: r.seconds for r in metrics.checkpoint_durations(df, "c", "t", "k", slice_rows=hot).collect()} == want
        got = {r.c: r.kth for r in reporting.kth_smallest(df, ["c"], "us", F.floor(F.col("n") / 2) + 1, hot_rows=hot).collect()}
        assert got == {c: sorted(u for x, u, _ in rows if x == c and u is not None)[sum(x == c and u is not None for x, u, _ in rows) // 2] for c in {r[0] for r in rows}}
    assert reporting.kth_smallest(df, [], "us", F.lit(1)).first().kth == min(u for _, u, _ in rows if u is not None)


@pytest.fixture(scope="module")
def library(spark):
    rows = [(f"c{i}", "gdpr" if i % 2 else "hipaa", f"access word{i} control " + "audit " * (i % 3), "Part" if i % 2 else None, None) for i in range(20)]
    chunks = spark.createDataFrame(rows, "id string, framework_name string, text string, section_title string, subsection_title string")
    chunks = chunks.withColumn("tokens", T.tokenize(F.col("text"))).withColumn("embedding", F.array(F.lit(1.0), F.substring("id", 2, 9).cast("double") / 10))
    queries = spark.createDataFrame([("q", "where is word3 of access", [1.0, 0.3])], "id string, text string, embedding array<double>").withColumn("tokens", T.tokenize(F.col("text")))
    return queries, chunks


def test_enhanced_search(spark, library):
    queries, chunks = library
    best = lambda asked, passages: [0.9 if "word6 " in p else 0.5 for p in passages]
    got = fusion.enhanced_search(queries, chunks, 4, reranker=best).orderBy("rank").collect()
    assert len(got) == 4 and got[0].id == "c6" and abs(got[0].distance - 0.1) < 1e-9 and got[0].retrieval_method == "hybrid+rerank" and got[0].text.startswith("access word6")
    assert got[0].rank_change > 0

    def down(asked, passages):
        raise ValueError("no model")

    for scorer in (down, None):  # every candidate scores 0.5 and keeps its place
        rows = fusion.enhanced_search(queries, chunks, 4, reranker=scorer).orderBy("rank").collect()
        assert {r.rerank_score for r in rows} == {0.5} and {r.rank_change for r in rows} == {0}
    plain = fusion.enhanced_search(queries, chunks, 4, rerank_results=False).orderBy("rank").collect()
    assert [r.id for r in plain] == [r.id for r in rows] and {r.retrieval_method for r in plain} == {"hybrid"}
    semantic = fusion.enhanced_search(queries, chunks, 2, hybrid=False, rerank_results=False, frameworks=["gdpr"]).orderBy("rank").collect()
    assert [r.id for r in semantic] == ["c3", "c1"] or [r.id for r in semantic] == ["c3", "c5"]
    assert fusion.enhanced_search(queries.limit(0), chunks, 4).collect() == []


def test_index_is_written_read_and_searched_as_one(spark, library, tmp_path):
    queries, chunks = library
    for _ in range(2):  # writing again replaces
        index = SearchIndex.write(chunks, str(tmp_path / "index"))
    again = SearchIndex(spark, str(tmp_path / "index"))
    want = {(r.id, round(r.score, 9)) for r in fusion.hybrid_items(queries, chunks, 5).collect()}
    assert {(r.id, round(r.score, 9)) for r in index.hybrid(queries, 5).collect()} == want == {(r.id, round(r.score, 9)) for r in again.hybrid(queries, 5).collect()}


def test_context_selection(spark):
    questions = spark.createDataFrame([("1", "What does GDPR and HIPAA ask?"), ("2", "Nothing named"), ("3", "PCI DSS only"), ("4", None)], "question_id string, input string")
    there = spark.createDataFrame([("hipaa",), ("gdpr",), ("cmmc",), (None,)], "framework_name string")
    got = {}
    for r in evaluation.select_contexts(questions, there).orderBy("question_id", "pos").collect():
        got.setdefault(r.question_id, []).append(r.framework_name)
    assert got == {"1": ["hipaa", "gdpr"], "2": ["cmmc"], "3": ["cmmc"], "4": ["cmmc"]}
    folders = spark.createDataFrame([("pci-dss",), ("soc2-trust-services",)], "framework_name string")
    assert {r.question_id: r.framework_name for r in evaluation.select_contexts(questions, folders, folders=True).collect()} == dict.fromkeys("1234", "pci-dss")
    assert evaluation.select_contexts(questions, there.limit(0)).collect() == []


def test_retries_and_judges(spark):
    tried, paused = [], []

    def flaky():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("down")
        return "up"

    assert evaluation.with_retries(flaky, 3, pause=paused.append) == "up" and paused == [1.0, 2.0]
    with pytest.raises(OSError):
        evaluation.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), 2, pause=paused.append)
    assert evaluation.backoff_seconds(20) == 60.0
    rows = [("a", "A complete answer about access control policies.", "p1"), ("b", "n/a", "p2"), ("c", "Another complete answer about the audit trail.", "fail"), ("d", "A third complete answer about the audit trail.", "odd")]
    df = spark.createDataFrame(rows, "k string, model_response string, judge_prompt string")

    def judge(text):
        if text == "fail":
            raise OSError("down")
        return '{"score": 0.7}' if text == "p1" else "no number"

    got = {r.k: (r.judge_score, r.judge_error) for r in evaluation.judged(df, judge, pause=lambda s: None).collect()}
    assert got["a"] == (0.7, None) and got["b"][0] == 0.0 and got["b"][1].startswith("invalid") and "down" in got["c"][1] and got["d"] == (0.0, "no score in reply")


def test_modes_and_first_rows(spark):
    assert evaluation.enabled_modes() == evaluation.MODES and evaluation.enabled_modes(False, False, False) == evaluation.MODES and evaluation.enabled_modes(rag=False) == evaluation.MODES[:2]
    df = spark.range(9)
    assert [r.id for r in evaluation.first_n(df, 2, "id").collect()] == [0, 1] and evaluation.first_n(df, None).count() == 9


def test_methods_by_name(spark):
    df = spark.createDataFrame([("Access control AC-2 applies here.", "Which control?", "AC-2", 0.4), (None, None, None, None)], "model_response string, question string, ideal_answer string, j double")
    staged, x = C.Response.stage(df, "model_response", "question", "ideal_answer")
    scores = C.score_by(x, F.col("j"), tuple(C.METHODS))
    got = staged.select(*(c.alias(n) for n, c in scores.items())).collect()
    assert got[0].control_reference == 1.0 and got[0].llm_judge == 0.4 and got[1].llm_judge == 0.0 and list(C.score_by(x, F.col("j"))) == list(C.DEFAULT_METHODS)
    with pytest.raises(ValueError):
        C.score_by(x, F.col("j"), ("vibes",))


def test_durations_as_text_and_model_scores(spark):
    df = spark.createDataFrame([(5.0,), (90.0,), (7200.0,)], "s double")
    assert [r[0] for r in df.select(T.duration(F.col("s"))).collect()] == ["5.0s", "1.5m", "2.0h"]
    models = spark.createDataFrame([("x/GPT-4o", 128000, "2025-01-01"), ("x/pro", 50000, "2023-04"), (None, None, None)], "id string, n int, c string")
    got = [r[0] for r in models.select(registry.model_score(F.col("id"), F.col("n"), F.col("c"), F.lit("2025-04-11"))).collect()]
    assert got == [20.0 + 9.0 + 10.0, 10.0 + 5.0, 0.0]


def test_sources_tell_what_is_wrong(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "metadata.toml").write_text('[framework]\nname = "a"\n[files]\ndocuments = ["one.md", "gone.md", "bad.md"]\n')
    (folder / "one.md").write_text("text é")
    (folder / "bad.md").write_bytes(b"\xff\xfe\xff")
    documents, errors = readers.read_documents(spark, readers.scan_frameworks(spark, str(tmp_path)))
    assert [r.text for r in documents.collect()] == ["text é"]
    assert {(r.document, r.error_type) for r in errors.collect()} == {("gone.md", "missing"), ("bad.md", "encoding")}
    with pytest.raises(ValueError):
        readers.read_raw_contexts(spark, str(tmp_path), most_chars=3)
    for name, chunk in (("a_chunks.json", "old"), ("b_chunks.json", "new")):
        (tmp_path / name).write_text(json.dumps({"metadata": {"framework": {"name": "f"}}, "chunks": [{"chunk_id": chunk}]}))
    assert [r.chunk_id for r in readers.read_chunk_files(spark, str(tmp_path / "*_chunks.json")).collect()] == ["new"]
    with pytest.raises(readers.UnreadableFile):
        readers.load_json(spark, str(tmp_path / "none.json"), "a int")
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert readers.load_json(spark, str(tmp_path / "x.json"), "a int").first().a == 1
    monkeypatch.setenv("GRIST_N", "7")
    monkeypatch.setenv("GRIST_B", "yes")
    assert readers.environment("GRIST_N", 1, int) == 7 and readers.environment("GRIST_B", False, bool) is True and readers.environment("GRIST_X", 2.5, float) == 2.5 and readers.environment("GRIST_B", 3, int) == 3


def test_reports_as_a_whole(spark, tmp_path):
    rows = [("r1", "m1", "rag", 0.9, None), ("r2", "m1", "no_context", 0.0, None), ("r3", "m2", "rag", 0.3, None)]
    df = spark.createDataFrame(rows, "response_id string, model_name string, evaluation_mode string, accuracy_score double, scoring_error string")
    paths = writers.write_all_reports(df, str(tmp_path / "out"), df)
    assert set(paths) == {"metrics", "report", "comparison"} and "Modes of each model" in open(paths["report"]).read()
    said = writers.console_summary(df)
    assert "responses: 3" in said and "    rag: 0.900" in said and "    no context" not in said
    with pytest.raises(ValueError):
        writers.write_vectors(df, str(tmp_path / "v"))


def test_blank_stretches_do_not_end_a_document():
    text = "First sentence here. " * 10 + " " * 900 + "Last sentence here. " * 10
    assert any("Last" in p for p in chunking.chunk_texts(text, 200, 20)) and not any("Last" in p for p in chunking.chunk_texts(text, 200, 20, compat=True))


def test_chunks_of_the_tables_against_plain_python(spark, small):
    import hashlib
    import re

    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "framework", "text").collect()
    space = r"[\s\x0b\x85  -     　\xa0]"
    want = {}
    for r in rows:
        if r.text is not None:
            clean = re.sub(r"[ \t]+", " ", re.sub(rf"\n{space}*\n{space}*\n+", "\n\n", r.text))
            for i, piece in enumerate(chunking.chunk_texts(clean)):
                if len(piece.encode()) <= 12288:
                    want[f"{r.framework}_{r.doc_id}_{i}" if r.framework is not None else f"{r.doc_id}_{i}"] = (piece, len(piece), hashlib.md5(piece.encode()).hexdigest())
    got = {r.chunk_id: (r.text, r.char_count, r.chunk_hash) for r in corpus.smart_chunks(spark, small).collect()}
    assert got == want


def test_sections_follow_the_headers(spark):
    text = "Before.\n\n# A\n\none\n\n## B\n\n" + "A sentence of B. " * 30 + "\n# C\nlast"
    found = chunking.section_texts(text, 200, 20)
    assert [p for p, _ in found][:3] == [[], ["A"], ["A", "B"]] and found[-1] == (["C"], "# C\nlast") and all(len(t) <= 300 for _, t in found)
    df = spark.createDataFrame([("f", "d", text), ("f", "e", None), ("f", "g", "  ")], "framework string, document string, text string")
    rows = chunking.section_chunks(df, "framework", "document", limit=200, overlap=20).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(found) + 1)) and rows[0].chunk_id == "f_d_1"


def test_clients_models_and_settings(spark):
    from gristmill.operators import rerank

    def down(*a):
        raise OSError("down")

    assert evaluation.first_working(down, lambda m, t: f"{m}:{t}")("a", "b") == "a:b"
    with pytest.raises(OSError):
        evaluation.first_working(down, down)("a", "b")
    models = spark.createDataFrame([("m", "M", None, 8, ["x"], {"a": "1"}, None, 0.5, True)], "id string, name string, provider string, context_length int, capabilities array<string>, pricing map<string,string>, training_data_cutoff string, performance_score double, is_available boolean")
    assert registry.from_json(registry.to_json(models)).collect() == models.collect()
    pairs = spark.createDataFrame([("q", "p")], "q string, p string")
    assert rerank.scored_by(pairs, "q", "p", build=lambda: lambda q, p: [0.25] * len(q)).first().rerank_score == 0.25
    assert rerank.scored_by(pairs, "q", "p", build=down).first().rerank_score == 0.5
    assert readers.Config(text="[A]\nx = 1\ny =\n").missing({"A": ["x", "y", "z"], "B": ["w"]}) == ["A.y", "A.z", "B.w"]
