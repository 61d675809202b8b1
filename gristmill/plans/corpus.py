"""Queries over documents and chunks: cleaning, chunking, keywords, headers, index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import chunking, evaluation, lexical
from gristmill.operators.reporting import distinct_rows
from gristmill.plans import sqltext as S
from gristmill.session import cut_lineage, one_per_key, spread, table


def chunk_rows(spark, d):
    """Each chunk once. All columns but the time of loading agree, so the shuffle needs only what a query selects."""
    return table(spark, d, "chunks").drop("loaded_at").dropDuplicates(["chunk_id"])


def whitespace_clean(spark, d):
    clean = T.clean_whitespace(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("clean_chars"))


def single_chunk_metadata(spark, d):
    rows = chunking.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "framework", "text")), "framework", "doc_id").filter("char_count <= 4000")
    only = rows.filter("position = 0").join(table(spark, d, "documents").filter(F.length(T.clean_whitespace(F.col("text"))) <= 4000).select(F.col("doc_id").cast("string").alias("document")), "document", "left_semi")
    return only.select("chunk_id", "framework_name", F.col("char_count").cast("long").alias("char_count"), F.col("token_estimate").cast("long").alias("token_estimate"), "chunk_hash", T.size_bucket(F.col("char_count")).alias("bucket"))


def smart_chunks(spark, d):
    return chunking.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "framework", "text")), "framework", "doc_id", most_bytes=12288).withColumn("keywords", F.array_join("keywords", "|"))


def chunks_with_framework(spark, d):
    rows = distinct_rows(table(spark, d, "chunks"), "chunk_id", "framework_name")
    joined = chunking.with_framework(rows, table(spark, d, "frameworks"))
    return joined.groupBy("framework_name", "framework_full_name", "framework_type", "domain", "sector").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_size_stats(spark, d):
    rows = table(spark, d, "documents")
    out = chunking.size_statistics(rows, ["framework"])
    return out.select("framework", "chunks", "small", "medium", "large", "oversized", F.round("estimated_size", 6).alias("estimated_size"), F.round("mean_size", 6).alias("mean_size"))


def extracted_keywords(spark, d):
    keys = spread(table(spark, d, "chunks").select("chunk_id", "text")).select("chunk_id", F.array_join(T.keywords(F.col("text")), "|").alias("keywords"))
    return keys.dropDuplicates(["chunk_id"])


def detected_headers(spark, d):
    found = table(spark, d, "chunks").select("chunk_id", T.headers(F.col("text")).alias("h")).dropDuplicates(["chunk_id"])
    return found.select("chunk_id", F.size("h").cast("long").alias("headers"), F.try_element_at("h", F.lit(1)).alias("section_title"), F.try_element_at("h", F.lit(2)).alias("subsection_title"))


def chunk_tokens(spark, d):
    """(id, tokens) of the text that is indexed; the token arrays are shuffled, not the texts."""
    text = T.index_text(F.col("text"), F.col("keywords"), F.col("section_title"), F.col("subsection_title"))
    return lexical.tokens_of(spread(table(spark, d, "chunks").select("chunk_id", "text", "keywords", "section_title", "subsection_title")), "chunk_id", text).dropDuplicates(["id"])


def term_statistics(spark, d):
    tokens = chunk_tokens(spark, d)
    n = distinct_rows(table(spark, d, "chunks"), "chunk_id").agg(F.count(F.lit(1))).scalar()
    out = lexical.term_statistics(lexical.term_frequencies(tokens), n)
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


def document_lengths(spark, d):
    tokens = chunk_tokens(spark, d)
    return tokens.select(F.col("id").alias("chunk_id"), F.size("tokens").cast("long").alias("length"), F.size(F.array_distinct("tokens")).cast("long").alias("terms"))


def corpus_stats(spark, d):
    return lexical.corpus_statistics(chunk_tokens(spark, d)).select("documents", F.round("mean_length", 6).alias("mean_length"))


def collection_stats(spark, d):
    rows = distinct_rows(table(spark, d, "chunks"), "chunk_id", "framework_name", "document")
    return rows.rollup("framework_name").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document").alias("documents"))


def raw_contexts(spark, d):
    rows = table(spark, d, "chunks").select("chunk_id", "framework_name", "document", "position", "text").dropDuplicates(["chunk_id"])
    return evaluation.context_digests(rows, ["framework_name", "document"], "position")


def raw_context_selection(spark, d):
    """The frameworks whose contexts each question gets, and how long these are together."""
    rows = table(spark, d, "chunks").select("chunk_id", "framework_name", "document", "position", "text").dropDuplicates(["chunk_id"])
    sizes = cut_lineage(evaluation.context_digests(rows, ["framework_name", "document"], "position").groupBy("framework_name").agg((F.sum("context_chars") + 2 * (F.count("context_chars") - 1)).alias("chars")))
    questions = table(spark, d, "cyber_evals").select("question_id", "input").dropDuplicates(["question_id"])
    chosen = evaluation.select_contexts(questions, sizes).join(F.broadcast(sizes), "framework_name")  # as many rows as there are frameworks
    picked = chosen.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "framework_name", "chars"))).alias("x"))  # at most the known frameworks
    chars = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x.chars) + 2 * (F.size("x") - 1)
    return picked.select("question_id", F.array_join(F.transform("x", lambda x: x.framework_name), "|").alias("frameworks"), chars.alias("context_chars"))


def flat_chunks(spark, d):
    own = [c for c in chunking.FLAT if c not in ("framework_full_name", "framework_type", "domain", "sector")]
    rows = one_per_key(table(spark, d, "chunks").select(*own), "chunk_id")
    return chunking.flat_chunks(rows, table(spark, d, "frameworks")).withColumn("text", F.md5("text")).withColumn("keywords", F.array_join("keywords", "|"))


def processing_stats(spark, d):
    """Cleaning of white space as a processing step: characters in and out by framework."""
    out = chunking.processing_statistics(table(spark, d, "documents"), ["framework"], F.col("text"), T.clean_whitespace(F.col("text")))
    return out.select("framework", "processed", "failed", "chars_in", "chars_out", F.round("compression_ratio", 6).alias("compression_ratio"), F.round("error_rate", 6).alias("error_rate"))


def passages(spark, d):
    built = T.passage(F.col("section_title"), F.col("subsection_title"), F.col("framework_name"), F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", built.alias("passage")).dropDuplicates(["chunk_id"])


def declared_documents(spark, d):
    """Documents that frameworks declare, and whether the corpus has chunks of them."""
    declared = table(spark, d, "frameworks").select(F.col("framework.name").alias("framework_name"), F.explode("files.documents").alias("document")).distinct()
    there = table(spark, d, "chunks").select("framework_name", "document").distinct().withColumn("present", F.lit(True))
    return declared.join(there, ["framework_name", "document"], "left").select("framework_name", "document", F.coalesce("present", F.lit(False)).alias("present"))


QUERIES = {f.__name__: f for f in (whitespace_clean, single_chunk_metadata, smart_chunks, chunks_with_framework, chunk_size_stats, extracted_keywords, detected_headers, term_statistics, document_lengths, corpus_stats, collection_stats, raw_contexts, raw_context_selection, flat_chunks, processing_stats, passages, declared_documents)}

_CHUNKS = "SELECT DISTINCT ON (chunk_id) * FROM chunks"
_TOKENS = f"WITH t AS (SELECT chunk_id, {S.tokens(S.index_text())} AS tokens FROM ({_CHUNKS}))"
_HEAD = "CASE WHEN section_title <> '' AND subsection_title <> '' THEN 'Section: ' || section_title || ' | Subsection: ' || subsection_title WHEN section_title <> '' THEN 'Section: ' || section_title WHEN subsection_title <> '' THEN 'Subsection: ' || subsection_title ELSE '' END"
SQL = {
    "whitespace_clean": f"SELECT doc_id, md5({S.clean_whitespace('text')}) AS clean_md5, CAST(length({S.clean_whitespace('text')}) AS BIGINT) AS clean_chars FROM documents",
    "single_chunk_metadata": f"""
        WITH t AS (SELECT framework, doc_id, {S.clean_whitespace('text')} AS c FROM documents)
        SELECT concat_ws('_', framework, CAST(doc_id AS VARCHAR), '0') AS chunk_id, framework AS framework_name, CAST(length(c) AS BIGINT) AS char_count, CAST(length(c) // 4 AS BIGINT) AS token_estimate, md5(c) AS chunk_hash,
               CASE WHEN length(c) < 1000 THEN 'small' WHEN length(c) < 3000 THEN 'medium' ELSE 'large' END AS bucket FROM t WHERE length(c) <= 4000""",
    "chunks_with_framework": f"""
        WITH c AS ({_CHUNKS}), f AS (SELECT DISTINCT framework.name AS n, framework.full_name AS full_name, framework.type AS type, metadata.domain AS domain, metadata.sector AS sector FROM frameworks)
        SELECT c.framework_name, f.full_name AS framework_full_name, f.type AS framework_type, f.domain, f.sector, count(*) AS chunks FROM c LEFT JOIN f ON c.framework_name = f.n GROUP BY ALL""",
    "chunk_size_stats": """
        WITH t AS (SELECT framework, length(text) AS n, strlen(text) AS b FROM documents)
        SELECT framework, count(n) AS chunks, count(*) FILTER (n < 1000) AS small, count(*) FILTER (n >= 1000 AND n < 3000) AS medium, count(*) FILTER (n >= 3000) AS large, count(*) FILTER (b > 12288) AS oversized,
               round(coalesce((count(*) FILTER (n < 1000) * 500 + count(*) FILTER (n >= 1000 AND n < 3000) * 2000 + count(*) FILTER (n >= 3000) * 3500) / nullif(count(n), 0), 0.0), 6) AS estimated_size,
               round(coalesce(avg(n), 0.0), 6) AS mean_size FROM t GROUP BY framework""",
    "extracted_keywords": f"SELECT chunk_id, array_to_string({S.keywords('text')}, '|') AS keywords FROM ({_CHUNKS})",
    "detected_headers": f"SELECT chunk_id, CAST(len(h) AS BIGINT) AS headers, h[1] AS section_title, h[2] AS subsection_title FROM (SELECT chunk_id, {S.titles('text')} AS h FROM ({_CHUNKS}))",
    "term_statistics": f"""{_TOKENS}, p AS (SELECT DISTINCT chunk_id, unnest(tokens) AS term FROM t)
        SELECT term, count(*) AS df, round(greatest(0.25, ln(((SELECT count(*) FROM t) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS idf FROM p GROUP BY term""",
    "document_lengths": f"{_TOKENS} SELECT chunk_id, CAST(len(tokens) AS BIGINT) AS length, CAST(len(list_distinct(tokens)) AS BIGINT) AS terms FROM t",
    "corpus_stats": f"{_TOKENS} SELECT count(*) AS documents, round(avg(len(tokens)), 6) AS mean_length FROM t",
    "collection_stats": f"SELECT framework_name, count(*) AS chunks, count(DISTINCT document) AS documents FROM ({_CHUNKS}) GROUP BY ROLLUP (framework_name)",
    "raw_contexts": f"""
        WITH g AS (SELECT framework_name, document, count(*) AS parts, '## ' || document || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY position, text) AS context FROM ({_CHUNKS}) GROUP BY framework_name, document)
        SELECT framework_name, document, parts, CAST(length(context) AS BIGINT) AS context_chars, md5(context) AS context_md5 FROM g""",
    "raw_context_selection": f"""
        WITH g AS (SELECT framework_name, document, length('## ' || document || chr(10) || string_agg(text, chr(10) || chr(10))) AS n FROM ({_CHUNKS}) GROUP BY framework_name, document), z AS (SELECT framework_name, sum(n) + 2 * (count(n) - 1) AS chars FROM g GROUP BY 1),
        q AS (SELECT question_id, {S.detected('input')} AS found FROM (SELECT DISTINCT ON (question_id) * FROM cyber_evals)), k AS (SELECT list(framework_name) AS known, min(framework_name) AS first FROM z),
        s AS (SELECT question_id, CASE WHEN len(list_filter(found, lambda f: list_contains(known, f))) > 0 THEN list_filter(found, lambda f: list_contains(known, f)) ELSE [first] END AS names FROM q, k),
        u AS (SELECT question_id, unnest(names) AS framework_name FROM s)
        SELECT question_id, array_to_string(any_value(names), '|') AS frameworks, CAST(sum(chars) + 2 * (count(*) - 1) AS BIGINT) AS context_chars FROM u JOIN z USING (framework_name) JOIN s USING (question_id) GROUP BY question_id""",
    "flat_chunks": f"""
        WITH f AS (SELECT DISTINCT ON (framework.name) framework.name AS n, framework.full_name AS full_name, framework.type AS type, metadata.domain AS domain, metadata.sector AS sector FROM frameworks)
        SELECT framework_name, f.full_name AS framework_full_name, f.type AS framework_type, document, chunk_id, md5(text) AS text, f.domain, f.sector, char_count, token_estimate, position, has_headers, section_title, subsection_title,
               CASE WHEN keywords IS NOT NULL THEN array_to_string(list_filter(keywords, lambda k: k IS NOT NULL), '|') END AS keywords, chunk_hash FROM ({_CHUNKS}) c LEFT JOIN f ON c.framework_name = f.n""",
    "processing_stats": f"""
        WITH t AS (SELECT framework, text, {S.clean_whitespace('text')} AS c FROM documents), g AS (SELECT framework, count(*) AS processed, count(*) FILTER (c IS NULL) AS failed, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars_in, CAST(coalesce(sum(length(c)), 0) AS BIGINT) AS chars_out FROM t GROUP BY framework)
        SELECT *, round(coalesce(chars_out / nullif(chars_in, 0), 0.0), 6) AS compression_ratio, round(failed * 100.0::DOUBLE / processed, 6) AS error_rate FROM g""",
    "passages": f"""
        WITH t AS (SELECT chunk_id, CASE WHEN {_HEAD} <> '' THEN {_HEAD} || chr(10) ELSE '' END || CASE WHEN framework_name <> '' THEN '[' || framework_name || '] ' ELSE '' END || coalesce(text, '') AS p FROM ({_CHUNKS})),
        u AS (SELECT *, substr(p, 1, 512) AS h FROM t), v AS (SELECT *, length(h) - strpos(reverse(h), '.') AS stop FROM u)
        SELECT chunk_id, CASE WHEN length(p) <= 512 THEN p WHEN contains(h, '.') AND stop > 512 * 0.7 THEN substr(h, 1, stop + 1) ELSE substr(p, 1, 509) || '...' END AS passage FROM v""",
    "declared_documents": """
        WITH f AS (SELECT DISTINCT framework.name AS framework_name, unnest(files.documents) AS document FROM frameworks), c AS (SELECT DISTINCT framework_name, document FROM chunks)
        SELECT f.framework_name, f.document, c.document IS NOT NULL AS present FROM f LEFT JOIN c ON f.framework_name = c.framework_name AND f.document = c.document""",
}
