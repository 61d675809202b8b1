"""The queries of the training-text operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.llm import defects, distinctive, leakage, markup, mixing, ranking, repeated_lines, splitting, uniform
from gristmill.llm.sqlforms import one_form
from gristmill.session import spread, table


def p1_found(spark, d):
    return defects.defective_responses(spread(table(spark, d, "eval_results").select("response_id", "question", "model_response")))


def p2_found(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks")).select("chunk_id").distinct()


def p2_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"))


def p3_found(spark, d):
    return distinctive.marked_terms(table(spark, d, "chunks")).select("chunk_id", "term")


def p3_weights(spark, d):
    return distinctive.distinctive_terms(table(spark, d, "chunks")).select("chunk_id", "term", "tf", "df", "cf", F.round("weight", 6).alias("weight"))


def p5_found(spark, d):
    cleaned = markup.clean_documents(spread(table(spark, d, "chunks").select("chunk_id", "text")))
    return cleaned.select("chunk_id", F.explode("markup").alias("markup"))


def p5_cleaned(spark, d):
    return markup.clean_documents(spread(table(spark, d, "chunks").select("chunk_id", "text")))


def p6_found(spark, d):
    return repeated_lines.repeated_lines(spread(table(spark, d, "chunks").select("chunk_id", "framework_name", "document", "text")))


def p6_cleaned(spark, d):
    return repeated_lines.without_repeated_lines(table(spark, d, "chunks"))


def p7_found(spark, d):
    return ranking.sole_leaders(ranking.aggregate_rankings(table(spark, d, "search_results")))


def p7_ranking(spark, d):
    ranked = ranking.with_positions(ranking.aggregate_rankings(table(spark, d, "search_results")))
    return ranked.select("search_id", "chunk_id", "position", F.round("rho", 9).alias("rho"))


def p8_found(spark, d):
    return leakage.leaked_items(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "heldout_items"))


def p8_items(spark, d):
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p9_mix(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).selected


def p9_shares(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p10_found(spark, d):
    return uniform.look_alike_pairs(spread(table(spark, d, "documents").select("doc_id", "text")))


def p10_uniform(spark, d):
    return uniform.uniform_column(table(spark, d, "documents"))


def p10_classes(spark, d):
    return uniform.look_alike_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_pieces, p3_found, p3_weights, p5_found, p5_cleaned, p6_found, p6_cleaned, p7_found, p7_ranking, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_uniform, p10_classes)}

_FORM = f"SELECT doc_id, text, {one_form('text')} AS form FROM documents"
_RUNS = "SELECT {id}, array_to_string(w[i : i + 11], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {id}, regexp_extract_all(lower({form}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"
_LEAKS = f"""WITH d AS ({_RUNS.format(id='doc_id', form=one_form('text'), table='documents')}), h AS ({_RUNS.format(id='item_id', form=one_form('text'), table='heldout_items')}),
        p AS (SELECT DISTINCT doc_id, item_id FROM d JOIN h USING (run))"""
SQL: dict[str, str] = {
    "p8_found": f"{_LEAKS} SELECT doc_id, item_id FROM p",
    "p8_items": f"{_LEAKS} SELECT i.item_id, i.item_kind, count(p.doc_id) AS documents FROM heldout_items i LEFT JOIN p USING (item_id) GROUP BY ALL",
    "p10_uniform": f"SELECT doc_id, form AS text FROM ({_FORM})",
    "p10_found": f"WITH f AS ({_FORM}) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b USING (form) WHERE a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": f"""WITH f AS ({_FORM} WHERE text IS NOT NULL), g AS (SELECT form, min(doc_id) AS class_id, count(*) AS members, count(DISTINCT text) AS written_forms FROM f GROUP BY form)
        SELECT doc_id, class_id, members, written_forms FROM f JOIN g USING (form)""",
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 4000",
    "p6_found": """
        WITH t AS (SELECT DISTINCT chunk_id, framework_name, document, text FROM chunks),
        l AS (SELECT chunk_id, framework_name, document, i - 1 AS line_no,
                     lower(regexp_replace(string_split(text, chr(10))[i], '[^\\p{L}]', '', 'g')) AS k
              FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t)),
        n AS (SELECT framework_name, count(DISTINCT document) AS n FROM t GROUP BY 1),
        r AS (SELECT l.framework_name, k FROM l JOIN n USING (framework_name) WHERE length(k) >= 20
              GROUP BY 1, 2, n.n HAVING count(DISTINCT document) >= 4 AND count(DISTINCT document) >= 0.05 * n.n)
        SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN r USING (framework_name, k)""",
    "p7_found": """
        WITH t AS (SELECT search_id, chunk_id, max(CASE WHEN CAST(semantic_score AS VARCHAR) <> 'nan' THEN semantic_score END) AS a, max(CASE WHEN CAST(bm25_score AS VARCHAR) <> 'nan' THEN bm25_score END) AS b,
                          max(CASE WHEN CAST(rerank_score AS VARCHAR) <> 'nan' THEN rerank_score END) AS c FROM search_results GROUP BY ALL),
        r AS (SELECT *, rank() OVER (PARTITION BY search_id ORDER BY a DESC NULLS LAST) AS ra,
                     rank() OVER (PARTITION BY search_id ORDER BY b DESC NULLS LAST) AS rb,
                     rank() OVER (PARTITION BY search_id ORDER BY c DESC NULLS LAST) AS rc FROM t)
        SELECT search_id, min(chunk_id) AS chunk_id FROM r
        WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND ra <= 3 AND rb <= 3 AND rc <= 3
        GROUP BY search_id HAVING count(*) = 1""",
    "p3_weights": """
        WITH t AS (SELECT DISTINCT chunk_id, lower(text) AS text, keywords FROM chunks),
        x AS (SELECT chunk_id, text, len(list_filter(string_split_regex(text, '[\\s\\x{0B}\\x{85}\\p{Z}]+'), lambda w: w <> '')) AS length FROM t),
        w AS (SELECT DISTINCT chunk_id, lower(trim(k, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS term FROM (SELECT chunk_id, unnest(keywords) AS k FROM t)),
        v AS (SELECT term, count(*) AS df FROM w WHERE term <> '' GROUP BY term),
        o AS (SELECT v.term, x.chunk_id, len(list_filter(range(1, len(string_split(text, term))), lambda i: NOT regexp_matches(string_split(text, term)[i], '[\\p{L}\\p{N}]$')
                     AND NOT regexp_matches(string_split(text, term)[i + 1], '^[\\p{L}\\p{N}]'))) AS tf FROM v JOIN x ON contains(x.text, v.term)),
        c AS (SELECT term, sum(tf) AS cf FROM o GROUP BY term), g AS (SELECT count(*) AS n, avg(length) AS mean FROM x),
        j AS (SELECT chunk_id, term, coalesce(tf, 0) AS tf, df, coalesce(cf, 0) AS cf, coalesce(cf, 0) / n AS rate, coalesce(tf, 0) * log2(1 + mean / greatest(length, 1)) AS tfn
              FROM w JOIN v USING (term) JOIN x USING (chunk_id) LEFT JOIN o USING (chunk_id, term) LEFT JOIN c USING (term), g)
        SELECT chunk_id, term, CAST(tf AS INTEGER) AS tf, df, CAST(cf AS BIGINT) AS cf, round(CASE WHEN tf > 0 THEN (log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1) ELSE 0.0 END, 6) AS weight FROM j""",
    "p6_cleaned": """
        WITH t AS (SELECT DISTINCT chunk_id, framework_name, document, text FROM chunks),
        l AS (SELECT chunk_id, framework_name, document, i, string_split(text, chr(10))[i] AS line, lower(regexp_replace(string_split(text, chr(10))[i], '[^\\p{L}]', '', 'g')) AS k
              FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t)),
        n AS (SELECT framework_name, count(DISTINCT document) AS n FROM t GROUP BY 1),
        r AS (SELECT l.framework_name, k FROM l JOIN n USING (framework_name) WHERE length(k) >= 20
              GROUP BY 1, 2, n.n HAVING count(DISTINCT document) >= 4 AND count(DISTINCT document) >= 0.05 * n.n),
        d AS (SELECT DISTINCT l.*, r.k IS NOT NULL AS out FROM l LEFT JOIN r ON l.framework_name = r.framework_name AND l.k = r.k)
        SELECT chunk_id, CASE WHEN count(line) > 0 THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '') END AS text, CAST(count(*) FILTER (out) AS INTEGER) AS removed FROM d GROUP BY chunk_id""",
    "p7_ranking": """
        WITH t AS (SELECT search_id, chunk_id, max(CASE WHEN CAST(semantic_score AS VARCHAR) <> 'nan' THEN semantic_score END) AS a, max(CASE WHEN CAST(bm25_score AS VARCHAR) <> 'nan' THEN bm25_score END) AS b,
                          max(CASE WHEN CAST(rerank_score AS VARCHAR) <> 'nan' THEN rerank_score END) AS c FROM search_results GROUP BY ALL),
        x AS (SELECT *, CASE WHEN a IS NOT NULL THEN (rank() OVER (PARTITION BY search_id ORDER BY a DESC NULLS LAST) + (count(*) OVER (PARTITION BY search_id, a) - 1) / 2) / count(a) OVER (PARTITION BY search_id) END AS ra,
                     CASE WHEN b IS NOT NULL THEN (rank() OVER (PARTITION BY search_id ORDER BY b DESC NULLS LAST) + (count(*) OVER (PARTITION BY search_id, b) - 1) / 2) / count(b) OVER (PARTITION BY search_id) END AS rb,
                     CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY search_id ORDER BY c DESC NULLS LAST) + (count(*) OVER (PARTITION BY search_id, c) - 1) / 2) / count(c) OVER (PARTITION BY search_id) END AS rc FROM t),
        y AS (SELECT search_id, chunk_id, list_sort(list_filter([ra, rb, rc], lambda v: v IS NOT NULL)) AS r FROM x),
        z AS (SELECT search_id, chunk_id, CASE len(r) WHEN 0 THEN 1.0 WHEN 1 THEN least(1.0, r[1]) WHEN 2 THEN least(1.0, 2 * least(2 * r[1] * (1 - r[1]) + r[1] * r[1], r[2] * r[2]))
                     ELSE least(1.0, 3 * least(3 * r[1] * (1 - r[1]) ** 2 + 3 * r[1] ** 2 * (1 - r[1]) + r[1] ** 3, 3 * r[2] ** 2 * (1 - r[2]) + r[2] ** 3, r[3] ** 3)) END AS rho, CASE WHEN len(r) = 0 THEN 1.0 ELSE list_sum(r) / len(r) END AS mean FROM y)
        SELECT search_id, chunk_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY round(rho, 12), round(mean, 12), chunk_id) AS INTEGER) AS position, round(rho, 9) AS rho FROM z""",
    "p3_found": """
        WITH t AS (SELECT DISTINCT chunk_id, lower(text) AS text, keywords FROM chunks),
        w AS (SELECT DISTINCT chunk_id, text, lower(trim(k, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS term FROM (SELECT *, unnest(keywords) AS k FROM t)),
        s AS (SELECT term FROM w WHERE term <> '' GROUP BY term HAVING count(*) BETWEEN 2 AND 8)
        SELECT chunk_id, term FROM w JOIN s USING (term)
        WHERE len(list_filter(range(1, len(string_split(text, term))), lambda i: NOT regexp_matches(string_split(text, term)[i], '[\\p{L}\\p{N}]$')
                                 AND NOT regexp_matches(string_split(text, term)[i + 1], '^[\\p{L}\\p{N}]'))) >= 3""",
}
