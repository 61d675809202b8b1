"""Queries over search: BM25, nearest neighbours, fusion, reranking, query enhancement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import evaluation, fusion, lexical, rerank, vector
from gristmill.plans import sqltext as S
from gristmill.plans.corpus import _HEAD, _TOKENS, chunk_tokens
from gristmill.session import cut_lineage, estimated_bytes, forget_later, one_per_key, shared_folder, spread, table

K = 10


def query_tokens(spark, d):
    """The stated query set: evaluation questions whose number is divisible by 20, each once."""
    number = F.substring_index("question_id", "-", -1).cast("long")
    rows = table(spark, d, "cyber_evals").filter(number % 20 == 0).select("question_id", "input").dropDuplicates(["question_id"])
    return lexical.tokens_of(rows, "question_id", F.col("input"))


def bm25_topk(spark, d):
    out = lexical.bm25_top_k(query_tokens(spark, d), cut_lineage(chunk_tokens(spark, d)), K)
    return out.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d, *more):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", *more)


def _neighbours(out):
    return out.select(F.col("query_id").alias("query_vec"), F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_knn(spark, d):
    rows = _vectors(spark, d)
    return _neighbours(vector.nearest(rows.filter("id % 20 = 0"), rows, 5))


def vector_knn_filtered(spark, d):
    rows = _vectors(spark, d, "label")
    return _neighbours(vector.nearest(rows.filter("id % 20 = 0"), rows, 5, same="label"))


def candidates(spark, d):
    """Each candidate of each search once, NaN scores turned to null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("semantic_score", "bm25_score", "rerank_score", "confidence")]
    return table(spark, d, "search_results").select("search_id", "chunk_id", "framework", "text", "rank", *clean).dropDuplicates(["search_id", "chunk_id"])


def arms(spark, d):
    rows = candidates(spark, d)
    semantic = rows.filter("semantic_score is not null").select("search_id", "chunk_id", (1 - F.col("semantic_score")).alias("distance"))
    lexical_arm = rows.filter("bm25_score is not null").select("search_id", "chunk_id", F.col("bm25_score").alias("score"))
    return semantic, lexical_arm


def _fused(spark, d, method):
    out = fusion.top(fusion.fuse(*arms(spark, d), "search_id", "chunk_id", method), "search_id", "chunk_id", K)
    return out.select("search_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def rrf_fusion(spark, d):
    return _fused(spark, d, "rrf")


def weighted_fusion(spark, d):
    return _fused(spark, d, "weighted")


def max_fusion(spark, d):
    return _fused(spark, d, "max")


def vector_collections(spark, d):
    """Every label searched for itself, then the best of all of them."""
    rows = _vectors(spark, d, "label")
    out = vector.nearest(rows.filter("id % 20 = 0"), rows, 5, collection="label").filter("overall <= 5")
    return out.select(F.col("query_id").alias("query_vec"), F.col("id").alias("vec_id"), F.col("label").cast("int").alias("label"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"), F.col("overall").cast("long").alias("overall"))


def _with_vectors(rows, vectors, chars):
    """No encoder is here, so a text takes the stored vector whose number its length in characters gives; the vectors are far fewer than the texts."""
    n = vectors.count()
    side = F.broadcast(vectors) if estimated_bytes(vectors) <= 32 << 20 else vectors
    return rows.withColumn("_vec", F.pmod(chars, F.lit(max(1, n)))).join(side, F.col("_vec") == F.col("vec_id"), "left").drop("_vec", "vec_id")


def _search_inputs(spark, d):
    """(queries, index rows, chunks): the stated query set, the indexed columns written once without the texts, and the chunks with their texts where they lie."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    chunks = table(spark, d, "chunks").select("chunk_id", "framework_name", "text", "keywords", "section_title", "subsection_title")
    chunks = one_per_key(spread(chunks), "chunk_id").withColumnRenamed("chunk_id", "id")
    text = T.index_text(F.col("text"), F.col("keywords"), F.col("section_title"), F.col("subsection_title"))
    indexed = cut_lineage(chunks.select("id", "framework_name", F.length("text").alias("_chars"), T.tokenize(text).alias("tokens")))
    asked = table(spark, d, "cyber_evals").filter(F.substring_index("question_id", "-", -1).cast("long") % 20 == 0).select("question_id", "input").dropDuplicates(["question_id"])
    queries = _with_vectors(asked.select(F.col("question_id").alias("id"), F.col("input").alias("text"), T.tokenize(F.col("input")).alias("tokens")), vectors, F.length("text"))
    return cut_lineage(queries), _with_vectors(indexed, vectors, F.col("_chars")).drop("_chars"), chunks


def hybrid_search(spark, d):
    queries, indexed, _ = _search_inputs(spark, d)
    return fusion.hybrid_items(queries, indexed, k=5).select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def passage_lengths(asked: list[str], passages: list[str]) -> list[float]:
    """A scorer without a model, for queries whose results can be told in SQL."""
    return [(len(p) % 97) / 96 for p in passages]


def enhanced_search(spark, d):
    """Hybrid search, reranked by a stand-in for a model."""
    queries, indexed, chunks = _search_inputs(spark, d)
    out = fusion.enhanced_search(queries, chunks, 5, reranker=passage_lengths, indexed=indexed)
    columns = [F.round(c, 6).alias(c) for c in ("distance", "rerank_score", "confidence")]
    return out.select("query_id", F.col("id").alias("chunk_id"), "framework_name", F.md5("text").alias("text_md5"), *columns, F.col("rank_change").cast("long").alias("rank_change"), F.col("rank").cast("long").alias("rank"), "retrieval_method")


def six_decimals(score):
    """A score of at least 0 to six decimals as the SQL rounds it: by its double times a million. ``F.round`` goes by its decimal digits, which differs where these end in a five."""
    return F.floor(score * 1_000_000.0 + 0.5) / 1_000_000.0


def bm25_index_search(spark, d):
    """The same search over tables of postings that were written and are read again."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    chunks = one_per_key(spread(table(spark, d, "chunks").select("chunk_id", "text", "keywords", "section_title", "subsection_title")), "chunk_id")
    text = T.index_text(F.col("text"), F.col("keywords"), F.col("section_title"), F.col("subsection_title"))
    lexical.write_index(lexical.tokens_of(chunks, "chunk_id", text), folder)
    forget_later(folder)
    out = lexical.index_top_k(query_tokens(spark, d), lexical.read_index(spark, folder), K)
    return out.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), six_decimals(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def _reranked(spark, d, **options):
    return rerank.rerank(candidates(spark, d), "search_id", "chunk_id", "semantic_score", F.col("rerank_score"), **options)


def reranked(spark, d):
    out = _reranked(spark, d, top_k=K)
    return out.select("search_id", "chunk_id", *(F.col(c).cast("long").alias(c) for c in ("original_rank", "rank", "rank_change")), F.round("rerank_score", 6).alias("rerank_score"), F.round("confidence", 6).alias("confidence"))


def rerank_fallback(spark, d):
    """Without a scorer every candidate scores 0.5 and keeps its place."""
    out = rerank.rerank(candidates(spark, d), "search_id", "chunk_id", "bm25_score", None, top_k=5)
    return out.select("search_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "rerank_score", "confidence")


def rerank_stats(spark, d):
    out = rerank.statistics(_reranked(spark, d), ["search_id"])
    doubles = ("mean_score", "std_score", "min_score", "max_score", "median_score", "mean_change")
    return out.select("search_id", "items", *(F.round(c, 9).alias(c) for c in doubles), "confident", "doubtful", "promoted", "demoted", "unchanged")


def ensemble_rerank(spark, d):
    rows = candidates(spark, d)
    first = rerank.rerank(rows, "search_id", "chunk_id", "semantic_score", F.col("rerank_score"), threshold=float("-inf"))
    second = rerank.rerank(rows, "search_id", "chunk_id", "semantic_score", F.col("confidence"), threshold=float("-inf"))
    out = rerank.ensemble([(first, 0.7), (second, 0.3)], "search_id", "chunk_id").filter(F.col("rank") <= K)
    return out.select("search_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


def search_contexts(spark, d):
    out = evaluation.search_contexts(candidates(spark, d).dropDuplicates(["search_id", "chunk_id"]), "search_id", "rank", "framework", "text", 3)
    return out.select("search_id", "context")


def context_prompts(spark, d):
    """The prompt of each search with the context it found; the name of the query stands for its text."""
    asked = candidates(spark, d).select("search_id").distinct()
    names = table(spark, d, "search_results").groupBy("search_id").agg(F.min("query_id").alias("q"))
    found = evaluation.search_contexts(candidates(spark, d), "search_id", "rank", "framework", "text", 3)
    rows = asked.join(names, "search_id").join(found, "search_id", "left")
    text = evaluation.prompt(F.col("q"), F.col("context"))
    return rows.select("search_id", F.length(text).cast("long").alias("prompt_chars"), F.md5(text).alias("prompt_md5"))


def query_enhancement(spark, d):
    rows = table(spark, d, "cyber_evals").select("question_id", T.enhance_query(F.col("input")).alias("x")).dropDuplicates(["question_id"])
    return rows.select("question_id", F.array_join("x.keywords", "|").alias("keywords"), F.array_join("x.frameworks", "|").alias("frameworks"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_index_search, vector_knn, vector_knn_filtered, vector_collections, rrf_fusion, weighted_fusion, max_fusion, hybrid_search, enhanced_search, reranked, rerank_fallback, rerank_stats, ensemble_rerank, search_contexts, context_prompts, query_enhancement)}

# ---- SQL

_CLEAN = lambda c: f"CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN {c} END AS {c}"
_C = f"c AS (SELECT DISTINCT ON (search_id, chunk_id) search_id, chunk_id, framework, text, rank AS given_rank, {_CLEAN('semantic_score')}, {_CLEAN('bm25_score')}, {_CLEAN('rerank_score')}, {_CLEAN('confidence')} FROM search_results)"
_TOP = f"SELECT search_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f) WHERE rank <= {K}"
_ARMS = """a AS (SELECT search_id, chunk_id, CASE WHEN far > 0 THEN 1 - distance / far ELSE 1.0 END AS x FROM (SELECT *, max(distance) OVER (PARTITION BY search_id) AS far FROM (SELECT search_id, chunk_id, 1 - semantic_score AS distance FROM c WHERE semantic_score IS NOT NULL))),
    b AS (SELECT search_id, chunk_id, CASE WHEN top > 0 THEN bm25_score / top ELSE 0.0 END AS y FROM (SELECT *, max(bm25_score) OVER (PARTITION BY search_id) AS top FROM c WHERE bm25_score IS NOT NULL)),
    j AS (SELECT search_id, chunk_id, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y FROM a FULL JOIN b USING (search_id, chunk_id))"""
_KNN = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query_vec, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q JOIN v ON {on} WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_vec, vec_id, round(1 - s, 6) AS distance, rank FROM r WHERE rank <= 5"""


def _rerank_sql(score: str, threshold: str, original: str = "semantic_score") -> str:
    return f"""p1 AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY {original} DESC NULLS LAST, chunk_id) AS original_rank FROM c),
    p2 AS (SELECT *, coalesce({score}, 0.5) AS raw FROM p1 WHERE original_rank <= 50),
    p3 AS (SELECT *, min(raw) OVER w AS low, max(raw) OVER w AS high, count(*) OVER w AS n FROM p2 WINDOW w AS (PARTITION BY search_id)),
    p4 AS (SELECT *, CASE WHEN low < 0 OR high > 1 THEN (raw - low) / (high - low + 1e-8) ELSE raw END AS s FROM p3),
    p5 AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(s, 9) DESC, original_rank) AS new_rank, count(*) FILTER (s >= {threshold}) OVER (PARTITION BY search_id) AS kept FROM p4),
    p AS (SELECT search_id, chunk_id, original_rank, s AS rerank_score, abs(s - 0.5) * 2 AS confidence, new_rank AS rank, original_rank - new_rank AS rank_change FROM p5
          WHERE CASE WHEN kept < 0.3 * n THEN new_rank <= greatest(5, n // 2) ELSE s >= {threshold} END)"""


_ENHANCED = ", ".join(f"CASE WHEN regexp_matches({S.masked('input')}, {S.quoted(p)}, 'i') THEN {S.quoted(n)} END" for n, p in T.QUERY_FRAMEWORKS.items())
def _bm25_sql(k: int, columns: str = "question_id, chunk_id, round(score, 6) AS score, rank") -> str:
    return f"""{_TOKENS}, stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t), post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM t) GROUP BY ALL),
        idf AS (SELECT term, greatest(0.25, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM post, stats GROUP BY term),
        asked AS (SELECT DISTINCT ON (question_id) question_id, input FROM cyber_evals WHERE CAST(split_part(question_id, '-', 3) AS BIGINT) % 20 = 0),
        q AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({S.tokens('input')}) AS term FROM asked) GROUP BY ALL),
        s AS (SELECT question_id, chunk_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))), 9) AS score FROM q JOIN idf USING (term) JOIN post USING (term) JOIN t USING (chunk_id), stats GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s)""" + (f" SELECT {columns} FROM r WHERE rank <= {k}" if columns else "")


def _hybrid_sql(k: int) -> str:
    """CTEs up to ``h`` (question_id, chunk_id, score, rank), the fused results."""
    return f"""{_bm25_sql(2 * k, '')}, texts AS (SELECT DISTINCT ON (chunk_id) chunk_id, framework_name, text, section_title, subsection_title FROM chunks), many AS (SELECT count(*) AS v FROM embeddings),
        e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), qe AS (SELECT question_id, x AS qx FROM asked, many, e WHERE vec_id = length(input) % v), ce AS (SELECT chunk_id, x AS cx FROM texts, many, e WHERE vec_id = length(text) % v),
        near AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, chunk_id) AS place FROM (SELECT question_id, chunk_id, round(list_cosine_similarity(qx, cx), 9) AS sim FROM qe, ce)),
        parts AS (SELECT question_id, chunk_id, 1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY question_id ORDER BY 1 - sim, chunk_id)) AS part FROM near WHERE place <= {2 * k} UNION ALL SELECT question_id, chunk_id, 1.0::DOUBLE / (59 + rank) FROM r WHERE rank <= {2 * k}),
        h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT question_id, chunk_id, sum(part) AS score FROM parts GROUP BY ALL))"""


_PASSAGE = f"CASE WHEN {_HEAD} <> '' THEN {_HEAD} || chr(10) ELSE '' END || CASE WHEN framework_name <> '' THEN '[' || framework_name || '] ' ELSE '' END || coalesce(text, '')"
_CUT = "CASE WHEN length(p) <= 512 THEN length(p) WHEN contains(substr(p, 1, 512), '.') AND 512 - strpos(reverse(substr(p, 1, 512)), '.') > 512 * 0.7 THEN 513 - strpos(reverse(substr(p, 1, 512)), '.') ELSE 512 END"
SQL = {
    "bm25_topk": _bm25_sql(K),
    "bm25_index_search": _bm25_sql(K),
    "hybrid_search": f"{_hybrid_sql(5)} SELECT question_id AS query_id, chunk_id, round(score, 6) AS score, rank FROM h WHERE rank <= 5",
    "enhanced_search": f"""{_hybrid_sql(10)}, g AS (SELECT question_id AS search_id, h.chunk_id, score, {_PASSAGE} AS p, framework_name, text FROM h JOIN texts USING (chunk_id) WHERE rank <= 10),
        c AS (SELECT search_id, chunk_id, framework_name, text, score AS semantic_score, ({_CUT}) % 97 / 96.0::DOUBLE AS model FROM g), {_rerank_sql('model', '0.3')}
        SELECT search_id AS query_id, chunk_id, framework_name, md5(text) AS text_md5, round(1 - rerank_score, 6) AS distance, round(rerank_score, 6) AS rerank_score, round(confidence, 6) AS confidence, rank_change, rank, 'hybrid+rerank' AS retrieval_method FROM p JOIN c USING (search_id, chunk_id) WHERE rank <= 5""",
    "vector_collections": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_vec, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q, v WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_vec, label ORDER BY s DESC, vec_id) AS rank, row_number() OVER (PARTITION BY query_vec ORDER BY s DESC, vec_id) AS overall FROM p) SELECT query_vec, vec_id, CAST(label AS INTEGER) AS label, round(1 - s, 6) AS distance, rank, overall FROM r WHERE overall <= 5""",
    "context_prompts": f"""WITH {_C}, f AS (SELECT search_id, string_agg('[' || framework || '] ' || text, chr(10) || chr(10) ORDER BY given_rank, '[' || framework || '] ' || text) AS context FROM c WHERE given_rank <= 3 GROUP BY search_id),
        n AS (SELECT search_id, min(query_id) AS q FROM search_results GROUP BY search_id), x AS (SELECT search_id, CASE WHEN context <> '' THEN replace(replace({S.quoted(evaluation.ASK_WITH)}, '{{c}}', context), '{{q}}', q) ELSE replace({S.quoted(evaluation.ASK)}, '{{q}}', q) END AS p FROM n LEFT JOIN f USING (search_id))
        SELECT search_id, CAST(length(p) AS BIGINT) AS prompt_chars, md5(p) AS prompt_md5 FROM x""",
    "vector_knn": _KNN.format(on="TRUE"),
    "vector_knn_filtered": _KNN.format(on="q.label = v.label"),
    "rrf_fusion": f"""WITH {_C}, u AS (SELECT search_id, chunk_id, 1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY search_id ORDER BY 1 - semantic_score, chunk_id)) AS part FROM c WHERE semantic_score IS NOT NULL
        UNION ALL SELECT search_id, chunk_id, 1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY search_id ORDER BY bm25_score DESC, chunk_id)) FROM c WHERE bm25_score IS NOT NULL), f AS (SELECT search_id, chunk_id, sum(part) AS score FROM u GROUP BY ALL) {_TOP}""",
    "weighted_fusion": f"WITH {_C}, {_ARMS}, f AS (SELECT search_id, chunk_id, 0.6::DOUBLE * x + 0.4::DOUBLE * y AS score FROM j) {_TOP}",
    "max_fusion": f"WITH {_C}, {_ARMS}, f AS (SELECT search_id, chunk_id, greatest(x, y) AS score FROM j) {_TOP}",
    "reranked": f"WITH {_C}, {_rerank_sql('rerank_score', '0.3')} SELECT search_id, chunk_id, original_rank, rank, rank_change, round(rerank_score, 6) AS rerank_score, round(confidence, 6) AS confidence FROM p WHERE rank <= {K}",
    "rerank_fallback": f"WITH {_C}, r AS (SELECT search_id, chunk_id, row_number() OVER (PARTITION BY search_id ORDER BY bm25_score DESC NULLS LAST, chunk_id) AS rank FROM c) SELECT search_id, chunk_id, rank, 0.5::DOUBLE AS rerank_score, 0.0::DOUBLE AS confidence FROM r WHERE rank <= 5",
    "rerank_stats": f"""WITH {_C}, {_rerank_sql('rerank_score', '0.3')} SELECT search_id, count(*) AS items, round(avg(rerank_score), 9) AS mean_score, round(stddev_pop(rerank_score), 9) AS std_score, round(min(rerank_score), 9) AS min_score,
        round(max(rerank_score), 9) AS max_score, round(median(rerank_score), 9) AS median_score, count(*) FILTER (confidence > 0.7) AS confident, count(*) FILTER (confidence < 0.3) AS doubtful, round(avg(abs(rank_change)), 9) AS mean_change,
        count(*) FILTER (rank_change > 0) AS promoted, count(*) FILTER (rank_change < 0) AS demoted, count(*) FILTER (rank_change = 0) AS unchanged FROM p GROUP BY search_id""",
    "ensemble_rerank": f"""WITH {_C}, f1 AS (WITH {_rerank_sql('rerank_score', "'-inf'::DOUBLE")} SELECT * FROM p), f2 AS (WITH {_rerank_sql('confidence', "'-inf'::DOUBLE")} SELECT * FROM p),
        u AS (SELECT search_id, chunk_id, rerank_score * 0.7::DOUBLE AS part FROM f1 UNION ALL SELECT search_id, chunk_id, rerank_score * 0.3::DOUBLE FROM f2), s AS (SELECT search_id, chunk_id, sum(part) AS score FROM u GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) SELECT search_id, chunk_id, round(score, 6) AS rerank_score, round(least(1.0, score), 6) AS confidence, rank FROM r WHERE rank <= {K}""",
    "search_contexts": f"WITH {_C} SELECT search_id, string_agg('[' || framework || '] ' || text, chr(10) || chr(10) ORDER BY given_rank, '[' || framework || '] ' || text) AS context FROM c WHERE given_rank <= 3 GROUP BY search_id",
    "query_enhancement": f"""SELECT question_id, array_to_string(list_concat(list_transform({S.find_all(S.masked('input'), T.QUERY_TERMS, 'i')}, lambda k: lower(k)), {S.find_all(S.masked('input'), T.SECTION)}), '|') AS keywords,
        array_to_string(list_filter([{_ENHANCED}], lambda f: f IS NOT NULL), '|') AS frameworks FROM (SELECT DISTINCT ON (question_id) * FROM cyber_evals)""",
}
