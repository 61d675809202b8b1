import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import fusion, lexical, rerank, vector
from gristmill.operators.index import SearchIndex
from gristmill.plans.retrieval import six_decimals

DOCS = [("doc1", "Access control policies must be implemented for all systems"), ("doc2", "Security controls require regular audit and assessment procedures"), ("doc3", "Data encryption standards should follow industry best practices")]


def tokens(spark, rows):
    return lexical.tokens_of(spark.createDataFrame(rows, "i string, text string"), "i", F.col("text"))


def test_bm25_known_values(spark, tmp_path):
    corpus = tokens(spark, DOCS)
    queries = tokens(spark, [("q", "access control security"), ("stop", "the and of")])
    got = {r.id: round(r.score, 6) for r in lexical.bm25_top_k(queries, corpus).collect()}
    assert got == {"doc1": 1.041009, "doc2": 0.520504}
    lexical.write_index(corpus, str(tmp_path))
    index = lexical.read_index(spark, str(tmp_path))
    again = {r.id: round(r.score, 6) for r in lexical.score_postings(queries, index).collect()}
    assert again == got and index["term_stats"].count() == 22


def test_bm25_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03d}", " ".join(rng.choice(words[: rng.randint(1, 30)]) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [("d000x", docs_text := "w1 w1 w2"), ("d000y", docs_text)]
    queries = [(f"q{i}", " ".join(rng.choice(words) for _ in range(5)) + " w1 w1") for i in range(6)]
    parsed = {i: t.split() for i, t in docs}
    n, mean = len(parsed), sum(map(len, parsed.values())) / len(parsed)
    df = {w: sum(w in t for t in parsed.values()) for w in words}
    want = set()
    for q, text in queries:
        scores = []
        for i, t in parsed.items():
            s = sum(max(0.25, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in text.split() if w in t)
            if s > 0:
                scores.append((-round(s, 9), i))
        want |= {(q, i, r) for r, (_, i) in enumerate(sorted(scores)[:7], 1)}
    left, right = tokens(spark, queries), tokens(spark, docs).repartition(5)
    for most in (100_000, 8):
        assert {(r.query_id, r.id, r["rank"]) for r in lexical.bm25_top_k(left, right, 7, most_query_terms=most).collect()} == want
    assert lexical.bm25_top_k(left, right.limit(0)).collect() == [] and lexical.bm25_top_k(left.limit(0), right).collect() == []


def test_index_search_in_segments_and_passes(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    docs = [(f"d{i:03d}", [rng.choice(words[: rng.randint(1, 25)]) for _ in range(rng.randint(0, 30))]) for i in range(120)] + [(f"t{i}", ["w1", "w1", "w2"]) for i in range(20)] + [("empty", []), ("none", None)]
    corpus = spark.createDataFrame(docs, "id string, tokens array<string>").repartition(3)
    queries = spark.createDataFrame([(i, [rng.choice(words) for _ in range(5)] + ["w1", "w1", "nowhere"]) for i in range(7)], "id long, tokens array<string>")
    rows = lambda df: {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in df.collect()}
    want = rows(lexical.bm25_top_k(queries, corpus, 6))
    for i, (documents, most_tokens) in enumerate([(8192, 1_000_000), (1, 1_000_000), (8192, 1)]):
        lexical.write_index(corpus, str(tmp_path / str(i)), documents, most_tokens)
        index = lexical.read_index(spark, str(tmp_path / str(i)))
        assert {(r.id, r.length) for r in index["doc_stats"].collect()} == {(d, None if t is None else len(t)) for d, t in docs}
        for most in (100_000, 8):
            assert rows(lexical.index_top_k(queries, index, 6, most_query_terms=most)) == want
    assert lexical.index_top_k(queries.limit(0), index).collect() == []
    lexical.write_index(corpus.limit(0), str(tmp_path / "bare"))
    assert lexical.index_top_k(queries, lexical.read_index(spark, str(tmp_path / "bare"))).collect() == []


def test_index_counts_documents_without_an_id_but_does_not_find_them(spark, tmp_path):
    corpus = spark.createDataFrame([("a", ["x", "y"]), (None, ["x"]), ("b", ["z"])], "id string, tokens array<string>").coalesce(1)
    lexical.write_index(corpus, str(tmp_path))
    index = lexical.read_index(spark, str(tmp_path))
    queries = spark.createDataFrame([("q", ["x"])], "id string, tokens array<string>")
    assert [r.id for r in lexical.index_top_k(queries, index).collect()] == ["a"] and index["doc_stats"].count() == 3


def most_shuffled(df):
    """Rows of the largest shuffle of a plan that has run."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return max([own, *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_index_search_makes_no_row_of_each_query_and_document(spark, tmp_path):
    chunks = spark.range(800).selectExpr("concat('d', id) AS id", "'fw' AS framework_name", "array('common', concat('w', id)) AS tokens", "CAST(NULL AS array<float>) AS embedding").repartition(2)
    queries = spark.range(60).selectExpr("concat('q', id) AS id", "array('common', concat('w', id)) AS tokens")
    found = SearchIndex.write(chunks, str(tmp_path)).bm25(queries, 2)
    rows = found.collect()
    assert len(rows) == 120 and {r.id for r in rows if r["rank"] == 1} == {f"d{i}" for i in range(60)}
    assert most_shuffled(found) <= 60 * 2 * 4 + 2000  # best of the tasks, postings by segment and term; the pairs are 48,000


def test_index_search_rounds_like_its_sql(spark):
    values = [16.3740565, 16.2208865, 0.0000005, 1.2345675, 2.5, 0.0, 15.988423795]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    assert [r.s for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(six_decimals(F.col("v")).alias("s")).collect()] == want


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(80, 8)).round(2)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(data)] + [(100, None, 0), (101, [0.0] * 8, 0), (102, [1.0], 0), (103, [float("nan")] * 8, 0)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(4)
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = np.round(unit @ unit.T, 9)
    for same in (None, "label"):
        want = set()
        for q in range(0, 80, 20):
            order = sorted((j for j in range(80) if same is None or j % 3 == q % 3), key=lambda j: (-near[q, j], j))[:4]
            want |= {(q, j, r) for r, j in enumerate(order, 1)}
        asked = df.filter("id % 20 = 0 and id < 80")
        for most in (4096, 3):
            assert {(r.query_id, r.id, r["rank"]) for r in vector.nearest(asked, df, 4, same, most).collect()} == want
    assert vector.nearest(df.limit(0), df).collect() == []


def test_fusion(spark):
    semantic = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.4), ("z", "a", 0.0)], "q string, i string, distance double")
    lexical_arm = spark.createDataFrame([("q", "b", 8.0), ("q", "c", 2.0)], "q string, i string, score double")
    get = lambda method: {(r.q, r.i): round(r.score, 6) for r in fusion.fuse(semantic, lexical_arm, "q", "i", method).collect()}
    assert get("rrf") == {("q", "a"): round(1 / 60, 6), ("q", "b"): round(1 / 61 + 1 / 60, 6), ("q", "c"): round(1 / 61, 6), ("z", "a"): round(1 / 60, 6)}
    assert get("weighted") == {("q", "a"): 0.45, ("q", "b"): 0.4, ("q", "c"): 0.1, ("z", "a"): 0.6}
    assert get("max") == {("q", "a"): 0.75, ("q", "b"): 1.0, ("q", "c"): 0.25, ("z", "a"): 1.0}


def run(spark, scores, **options):
    df = spark.createDataFrame([("q", f"d{i:02d}", 1.0 - i / 100, s) for i, s in enumerate(scores)], "q string, i string, first double, score double")
    return rerank.rerank(df, "q", "i", "first", F.col("score"), **options).orderBy("rank").collect()


def test_rerank(spark):
    got = run(spark, [0.2, 0.9, 0.5, None])
    assert [(r.i, r.rerank_score, r.rank_change) for r in got] == [("d01", 0.9, 1), ("d02", 0.5, 1), ("d03", 0.5, 1)]
    got = run(spark, [-5.0, 0.0, 5.0])
    assert [r.i for r in got] == ["d02", "d01"] and got[0].rerank_score == pytest.approx(1.0)
    assert {r.rerank_score for r in run(spark, [7.0, 7.0])} == {0.0}
    assert len(run(spark, [0.1] * 20)) == 10 and len(run(spark, [0.1] * 6)) == 5
    assert len(run(spark, [0.9] * 60)) == 50 and len(run(spark, [0.9] * 60, top_k=3)) == 3
    assert run(spark, [float("nan")])[0].rerank_score == 0.5


def test_ensemble_and_hook(spark):
    df = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 1.5)], "q string, i string, rerank_score double")
    got = rerank.ensemble([(df, 3.0), (df.filter("i = 'a'"), 1.0)], "q", "i").orderBy("rank").collect()
    assert [(r.i, r.rerank_score, r.confidence) for r in got] == [("b", 1.125, 1.0), ("a", 0.5, 0.5)]
    texts = spark.createDataFrame([("x", "xx"), (None, "y")], "a string, b string")
    assert [r.s for r in rerank.scored_by(texts, "a", "b", lambda q, p: [float(len(x)) for x in p], "s").collect()] == [2.0, 1.0]
    assert {r.s for r in rerank.scored_by(texts, "a", "b", lambda q, p: 1 / 0, "s").collect()} == {0.5}


def test_hybrid_search_finds_by_either_arm(spark):
    chunks = vector.embed(spark.createDataFrame([(i, "fw" if i != "doc3" else "other", t) for i, t in DOCS], "id string, framework_name string, text string")).withColumn("tokens", T.tokenize(F.col("text")))
    queries = vector.embed(spark.createDataFrame([("q", "encryption standards")], "id string, text string")).withColumn("tokens", T.tokenize(F.col("text")))
    found = fusion.hybrid_search(queries, chunks, 2).orderBy("rank").collect()
    assert found[0].id == "doc3" and found[0].text == DOCS[2][1]
    assert {r.id for r in fusion.hybrid_search(queries, chunks, 2, frameworks=["fw"]).collect()} == {"doc1", "doc2"}
