"""Queries that score responses with deterministic text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import scoring as C
from gristmill.functions import text as T
from gristmill.operators import reporting
from gristmill.plans import sqltext as S
from gristmill.session import spread, table


def scored(spark, d, *rules, **columns):
    """response_id, the given columns and ``rules``, functions from a staged response to named columns, each response once.

    Scores are computed where the rows lie; only they are shuffled.
    """
    rows = spread(table(spark, d, "eval_results").select("response_id", "model_name", "question", "ideal_answer", "model_response", "scores"))
    staged, x = C.Response.stage(rows, "model_response", "question", "ideal_answer")
    named = {n: c for rule in rules for n, c in rule(x).items()} | columns
    return staged.select("response_id", *(c.alias(n) for n, c in named.items())).dropDuplicates(["response_id"])


def response_validity(spark, d):
    return scored(spark, d, lambda x: {"reason": x.reason}).withColumn("valid", F.col("reason").isNull())


def exact_match(spark, d):
    return scored(spark, d, score=C.exact_match(F.col("model_response"), F.col("ideal_answer")))


def extracted_citations(spark, d):
    return scored(spark, d, lambda x: {"citations": F.array_join(x.mine, "|")})


def control_reference_f1(spark, d):
    return scored(spark, d, lambda x: {"score": F.round(C.control_reference(x), 6)})


def citation_verification(spark, d):
    return scored(spark, d, lambda x: {"score": F.round(C.citation_verification(x), 6), "strict_score": F.round(C.citation_verification(x, strict_compat=True), 6)})


def structural_validation(spark, d):
    return scored(spark, d, lambda x: {"score": F.round(C.structural_validation(x), 6)})


def conciseness(spark, d):
    return scored(spark, d, lambda x: {"score": F.round(C.conciseness(x), 6)})


def contextual_relevance(spark, d):
    return scored(spark, d, lambda x: {"score": F.round(C.contextual_relevance(x), 6)})


def completeness(spark, d):
    return scored(spark, d, lambda x: {"score": F.round(C.completeness(x), 6)})


def judge_score(name: str):
    return F.try_element_at("scores", F.lit(name))["score"]


def composite_score(spark, d):
    """The weighted score, the relevance entry of the stored scores standing in for the judge."""
    parts = scored(
        spark, d, lambda x: {"policy": C.asks_for_policy(x), "valid": x.reason.isNull(), "structure": C.structural_validation(x), "relevance": C.contextual_relevance(x), "complete": C.completeness(x), "concise": C.conciseness(x)},
        judge=judge_score("relevance"),
    )
    score = C.composite(*(F.col(c) for c in ("policy", "valid", "judge", "structure", "relevance", "complete", "concise")))
    return parts.select("response_id", F.round(score, 6).alias("score"))


def scored_methods(spark, d):
    """Each response by each of the default methods, and by an exact match; a row a method."""
    names = (*C.DEFAULT_METHODS, "exact_match")
    wide = scored(spark, d, lambda x: C.score_by(x, judge_score("relevance"), names))
    pairs = F.array(*(F.struct(F.lit(n).alias("method"), F.round(n, 6).alias("score")) for n in names))
    return wide.select("response_id", F.inline(pairs))


def unknown_citations(spark, d):
    return scored(spark, d, lambda x: {"citations": F.array_join(C.first_unknown_citations(x), "|")})


def primary_score(spark, d):
    return scored(spark, d, score=F.round(C.primary_score(judge_score("relevance"), judge_score("citations")), 6))


def judge_merge(spark, d):
    merged = C.merge_judges(judge_score("relevance"), judge_score("structure"), 0.6, 0.4)
    return scored(spark, d, m=merged).select("response_id", F.round("m.score", 6).alias("score"), "m.outcome", "m.flagged")


def judge_statistics(spark, d):
    merged = C.merge_judges(judge_score("relevance"), judge_score("structure"), 0.6, 0.4)
    rows = scored(spark, d, m=merged, model_name=F.col("model_name")).select("model_name", "m.outcome", "m.flagged")
    out = reporting.judge_statistics(rows, ["model_name"])
    return out.select("model_name", "attempts", "first_successes", "first_failures", "second_successes", "second_failures", *(F.round(c, 6).alias(c) for c in ("first_rate", "second_rate", "dual_rate")), "flagged")


def judge_output_parse(spark, d):
    """Scores read back from judge replies, made of the stored scores in three notations."""
    score = judge_score("relevance")
    kind = F.pmod(F.length("response_id") + F.length("model_name"), F.lit(3))
    reply = F.when((kind == 0) & score.isNull(), F.lit('{"explanation": "x"}')).when(kind == 0, F.format_string('{"score": %.3f, "explanation": "x"}', score)).when(kind == 1, F.format_string("The Score: %.3f of 1", score)).otherwise(F.lit("no number"))
    return scored(spark, d, score=F.round(T.parse_score(reply), 6))


def judge_input_truncation(spark, d):
    cut = T.judge_inputs(*(F.coalesce(c, F.lit("")) for c in ("question", "model_response", "ideal_answer")), limit=600, reserve=100)
    return scored(spark, d, question=F.md5(cut["question"]), response=F.md5(cut["response"]), short=T.truncate(F.col("model_response"), 80))


QUERIES = {f.__name__: f for f in (response_validity, exact_match, extracted_citations, control_reference_f1, citation_verification, structural_validation, conciseness, contextual_relevance, completeness, composite_score, scored_methods, unknown_citations, primary_score, judge_merge, judge_statistics, judge_output_parse, judge_input_truncation)}

# ---- SQL

_E = "e AS (SELECT DISTINCT ON (response_id) response_id, model_name, coalesce(model_response, '') AS r, coalesce(question, '') AS q, coalesce(ideal_answer, '') AS i, model_response, scores, accuracy_score FROM eval_results), x AS (SELECT *, lower(r) AS low, lower(q) AS asked FROM e)"
_BARE, _WORDS = S.strip("r"), f"len({S.words('r')})"
_HOLLOW = " OR ".join(f"regexp_matches(lower({_BARE}), {S.quoted(p)})" for p in C.NON_SUBSTANTIVE)
_REASON = f"""CASE WHEN r = '' THEN 'empty' WHEN {_BARE} = '' THEN 'blank' WHEN starts_with(lower({_BARE}), 'error:') OR starts_with({_BARE}, 'MODEL_FAILURE:') THEN 'error message'
    WHEN length({_BARE}) < 10 THEN 'too short' WHEN {_HOLLOW} THEN 'non-substantive' WHEN {S.contains_any('lower(' + _BARE + ')', C.GENERIC)} AND len({S.words('lower(' + _BARE + ')')}) < 50 THEN 'generic template' END"""
_LIST = r"regexp_matches(r, '(?m)^[\s]*[-*•]\s') OR regexp_matches(r, '(?m)^[\s]*\d+[\.\)]\s')"
_SECTIONS = "(" + " + ".join(f"CAST(regexp_matches(r, {S.quoted(p)}, 'i') AS INTEGER)" for p in C.SECTIONS) + ")"
_BASE = f"""(1.0 - CASE WHEN {S.contains_any('asked', ['list', 'enumerate'])} AND NOT ({_LIST}) THEN 0.3 ELSE 0.0 END
    - CASE WHEN {S.contains_any('asked', ['why', 'explain', 'because'])} AND NOT {S.contains_any('low', C.EXPLAINING)} THEN 0.2 ELSE 0.0 END - CASE WHEN length(r) > least(500, length(q) * 3) * 3 THEN 0.1 ELSE 0.0 END)"""
_STRUCTURAL = f"""greatest(0.0, CASE WHEN {S.contains_any('asked', ['policy', 'short_prompt', 'format'])}
    THEN {_BASE} + CASE WHEN {_SECTIONS} >= 5 THEN 0.1 WHEN {_SECTIONS} < 3 THEN -0.3 ELSE 0.0 END + CASE WHEN regexp_matches(r, {S.quoted(C.MAPPING_TABLE)}, 'i') THEN 0.1 ELSE -0.2 END
    WHEN contains(asked, 'requirements') AND NOT regexp_matches(r, '\\n\\n|---|\\*\\*|##|\\d+\\.|[A-Z]\\)') AND length(r) > 200 THEN {_BASE} - 0.2 ELSE {_BASE} END)"""
_SHAPE = S.count_matches("r", C.STRUCTURE, most=3)
_CONCISE = f"""greatest(0.0, least(1.0, 1.0 - CASE WHEN length(r) > 1500 THEN 0.3 WHEN length(r) > 1000 THEN 0.1 ELSE 0.0 END - CASE WHEN {_WORDS} > 250 THEN 0.2 ELSE 0.0 END - {S.count_matches('r', C.VERBOSE, 'i')} * 0.1
    + CASE WHEN NOT {S.contains_any('asked', ['policy', 'format'])} THEN 0.0 WHEN {_SHAPE} >= 8 THEN 0.1 WHEN {_SHAPE} < 4 THEN -0.2 ELSE 0.0 END))"""
_TERMS = S.count_contained("low", C.DOMAIN_TERMS)
_TYPED = " OR ".join(S.contains_any("asked", t) for t in C.QUESTION_TYPES.values())
_MET = " OR ".join(f"({S.contains_any('asked', t)} AND {S.contains_any('low', t)})" for t in C.QUESTION_TYPES.values())
_ALIGNED = " ".join(f"- CASE WHEN {S.contains_any('asked', t)} AND NOT {S.contains_any('low', t)} THEN 0.2 ELSE 0.0 END" for t in C.ALIGNMENT.values())
_RELEVANT = f"""CASE WHEN {_REASON} IS NOT NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN {_TERMS} = 0 THEN 0.8 WHEN {_TERMS} < 3 THEN 0.3 ELSE 0.0 END
    - CASE WHEN ({_TYPED}) AND NOT ({_MET}) THEN 0.4 ELSE 0.0 END {_ALIGNED} - CASE WHEN {_WORDS} < 20 THEN 0.3 WHEN {_WORDS} > 500 THEN 0.1 ELSE 0.0 END
    + CASE WHEN {S.count_contained('low', C.TECHNICAL)} >= 3 THEN 0.1 ELSE 0.0 END)) END"""
_CITED = f"y AS (SELECT *, {S.citations('r')} AS mine, {S.citations('i')} AS theirs FROM x), z AS (SELECT *, CAST(len(list_intersect(mine, theirs)) AS DOUBLE) AS shared FROM y)"
_IMPORTANT = f"list_filter(list_transform(list_filter({S.words('lower(i)')}, lambda w: length(w) > 3 AND w NOT IN {S.names(C.COMMON)}), lambda w: trim(w, '.,!?()[]{{}}')), lambda w: {S.contains_any('w', C.IMPORTANT)})"
_PARTS = f"""v AS (SELECT *, {_IMPORTANT} AS important, string_split(asked, ' and ') AS parts, {S.count_contained('low', C.REASONS)} AS reasons FROM z),
    w AS (SELECT *, len(list_filter(important, lambda t: contains(low, t))) / len(important) AS share,
          len(list_filter(parts, lambda p: len(list_filter({S.words('p')}, lambda k: length(k) > 3 AND contains(low, k))) > 0)) / len(parts) AS part FROM v)"""
_COMPLETE = f"""CASE WHEN {_REASON} IS NOT NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN len(theirs) = 0 THEN 0.0 WHEN shared / len(theirs) < 0.3 THEN 0.4 WHEN shared / len(theirs) < 0.7 THEN 0.2 ELSE 0.0 END
    - CASE WHEN len(important) = 0 THEN 0.0 WHEN share < 0.4 THEN 0.3 WHEN share < 0.8 THEN 0.1 ELSE 0.0 END
    - CASE WHEN NOT contains(asked, ' and ') AND {S.contains_any('asked', ['list', 'identify'])} AND NOT regexp_matches(r, '(?m)^\\s*\\d+[\\.\\)]\\s|\\s*[-*•]\\s') THEN 0.2 ELSE 0.0 END
    - CASE WHEN NOT contains(asked, ' and ') THEN 0.0 WHEN part < 0.5 THEN 0.3 WHEN part < 1.0 THEN 0.1 ELSE 0.0 END
    - CASE WHEN NOT {S.contains_any('asked', ['why', 'explain', 'because'])} THEN 0.0 WHEN reasons = 0 THEN 0.3 WHEN reasons < 2 THEN 0.1 ELSE 0.0 END
    - CASE WHEN {S.contains_any('asked', ['implement', 'how to'])} AND NOT {S.contains_any('low', C.ACTIONS)} THEN 0.2 ELSE 0.0 END)) END"""
_POLICY = f"({S.contains_any('asked', ['short_prompt', 'policy', 'format'])} OR (contains(asked, 'create') AND {S.contains_any('asked', ['compliance', 'compliant'])}))"
_JUDGE = lambda name: f"scores['{name}'].score"


def _known(soc: str) -> str:
    """The catalogue as a predicate on a citation c; ``soc`` is what criteria are looked up by."""
    limits = lambda table, key, number: "(" + " OR ".join(f"({key} = '{k}' AND {number} BETWEEN 1 AND {n})" for k, n in table.items()) + ")"
    number = lambda pattern, group: f"TRY_CAST(regexp_extract(c, {S.quoted(pattern)}, {group}) AS INTEGER)"
    p, f = r"^([A-Z]{1,3})(\d+)\.(\d+)", r"^([A-Z]{2,4})-(\d+)"
    key = f"regexp_extract(c, '{p}', 1)" + (f" || regexp_extract(c, '{p}', 2)" if soc == "full" else "")
    csf = " OR ".join(f"starts_with(c, '{a}.{b}-')" for a, bs in C.CSF_CATEGORIES.items() for b in bs)
    return f"coalesce({limits(C.SOC_CRITERIA, key, number(p, 3))}, FALSE) OR (({csf}) AND regexp_matches(c, '^[A-Z]{{2}}\\.[A-Z]{{2}}-\\d+')) OR coalesce({number('ARTICLE\\s+(\\d+)', 1)} BETWEEN 1 AND 99, FALSE) OR coalesce({limits(C.CONTROL_FAMILIES, f'regexp_extract(c, {S.quoted(f)}, 1)', number(f, 2))}, FALSE)"


_MERGED = f"m AS (SELECT *, {_JUDGE('relevance')} AS a, {_JUDGE('structure')} AS b FROM e), n AS (SELECT *, coalesce(a > 0, FALSE) AS oa, coalesce(b > 0, FALSE) AS ob FROM m), o AS (SELECT *, CASE WHEN oa AND ob THEN a * 0.6 + b * 0.4 WHEN oa THEN a WHEN ob THEN b ELSE 0.0 END AS score, CASE WHEN oa AND ob THEN 'both' WHEN oa THEN 'first' WHEN ob THEN 'second' ELSE 'none' END AS outcome, coalesce(oa AND ob AND abs(a - b) > 0.3, FALSE) AS flagged FROM n)"
_SIDE = lambda c: f"CASE WHEN length(q) + length(r) + length(i) > 600 AND length({c}) > (500 - length(i)) // 2 THEN substr({c}, 1, greatest(0, CAST(floor((500 - length(i)) / 2) AS INTEGER))) || '...[truncated]' ELSE {c} END"
_KIND = "(length(response_id) + length(model_name)) % 3"
SQL = {
    "response_validity": f"WITH {_E} SELECT response_id, {_REASON} AS reason, {_REASON} IS NULL AS valid FROM x",
    "exact_match": f"WITH {_E} SELECT response_id, CASE WHEN lower({S.strip('r')}) = lower({S.strip('i')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM x",
    "extracted_citations": f"WITH {_E} SELECT response_id, array_to_string({S.citations('r')}, '|') AS citations FROM x",
    "control_reference_f1": f"WITH {_E}, {_CITED} SELECT response_id, round(CASE WHEN {_REASON} IS NOT NULL THEN 0.0 WHEN len(theirs) = 0 THEN CASE WHEN len(mine) = 0 THEN 1.0 ELSE 0.5 END WHEN shared = 0 THEN 0.0 ELSE 2 * (shared / len(mine)) * (shared / len(theirs)) / (shared / len(mine) + shared / len(theirs)) END::DOUBLE, 6) AS score FROM z",
    "citation_verification": f"""WITH {_E}, {_CITED} SELECT response_id, round((CASE WHEN len(mine) = 0 THEN 1.0 ELSE len(list_filter(mine, lambda c: {_known('full')})) / len(mine) END)::DOUBLE, 6) AS score,
        round((CASE WHEN len(mine) = 0 THEN 1.0 ELSE len(list_filter(mine, lambda c: {_known('letters')})) / len(mine) END)::DOUBLE, 6) AS strict_score FROM z""",
    "structural_validation": f"WITH {_E} SELECT response_id, round(({_STRUCTURAL})::DOUBLE, 6) AS score FROM x",
    "conciseness": f"WITH {_E} SELECT response_id, round(({_CONCISE})::DOUBLE, 6) AS score FROM x",
    "contextual_relevance": f"WITH {_E} SELECT response_id, round(({_RELEVANT})::DOUBLE, 6) AS score FROM x",
    "completeness": f"WITH {_E}, {_CITED}, {_PARTS} SELECT response_id, round(({_COMPLETE})::DOUBLE, 6) AS score FROM w",
    "composite_score": f"""WITH {_E}, {_CITED}, {_PARTS}, s AS (SELECT response_id, {_REASON} IS NULL AS ok, {_POLICY} AS policy, coalesce({_JUDGE('relevance')}, 0.0) AS j, ({_STRUCTURAL})::DOUBLE AS st, ({_RELEVANT})::DOUBLE AS re, ({_COMPLETE})::DOUBLE AS co, ({_CONCISE})::DOUBLE AS cs FROM w)
        SELECT response_id, round(CASE WHEN NOT ok THEN 0.0 WHEN policy THEN 0.1::DOUBLE + st * 0.25::DOUBLE + j * 0.4::DOUBLE + co * 0.15::DOUBLE + cs * 0.1::DOUBLE ELSE j * 0.5::DOUBLE + re * 0.3::DOUBLE + co * 0.2::DOUBLE END, 6) AS score FROM s""",
    "scored_methods": f"""WITH {_E}, {_CITED}, s AS (SELECT response_id, CASE WHEN {_REASON} IS NOT NULL THEN 0.0 WHEN len(theirs) = 0 THEN CASE WHEN len(mine) = 0 THEN 1.0 ELSE 0.5 END WHEN shared = 0 THEN 0.0 ELSE 2 * (shared / len(mine)) * (shared / len(theirs)) / (shared / len(mine) + shared / len(theirs)) END::DOUBLE AS control_reference,
        CASE WHEN {_REASON} IS NOT NULL THEN 0.0 ELSE coalesce({_JUDGE('relevance')}, 0.0) END::DOUBLE AS llm_judge, ({_STRUCTURAL})::DOUBLE AS structural_validation, (CASE WHEN len(mine) = 0 THEN 1.0 ELSE len(list_filter(mine, lambda c: {_known('full')})) / len(mine) END)::DOUBLE AS citation_verification,
        CASE WHEN lower({S.strip('r')}) = lower({S.strip('i')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM z) SELECT response_id, method, round(score, 6) AS score FROM (UNPIVOT s ON control_reference, llm_judge, structural_validation, citation_verification, exact_match INTO NAME method VALUE score)""",
    "unknown_citations": f"WITH {_E}, {_CITED} SELECT response_id, array_to_string(list_filter(mine, lambda c: NOT ({_known('full')}))[1:3], '|') AS citations FROM z",
    "primary_score": f"WITH {_E} SELECT response_id, round(coalesce({_JUDGE('relevance')}, {_JUDGE('citations')}, 0.0), 6) AS score FROM e",
    "judge_merge": f"WITH {_E}, {_MERGED} SELECT response_id, round(score, 6) AS score, outcome, flagged FROM o",
    "judge_statistics": f"""WITH {_E}, {_MERGED} SELECT model_name, count(*) AS attempts, count(*) FILTER (outcome IN ('both', 'first')) AS first_successes, count(*) FILTER (outcome IN ('second', 'none')) AS first_failures,
        count(*) FILTER (outcome IN ('both', 'second')) AS second_successes, count(*) FILTER (outcome IN ('first', 'none')) AS second_failures, round(count(*) FILTER (outcome IN ('both', 'first')) / count(*), 6) AS first_rate,
        round(count(*) FILTER (outcome IN ('both', 'second')) / count(*), 6) AS second_rate, round(count(*) FILTER (outcome = 'both') / count(*), 6) AS dual_rate, count(*) FILTER (flagged) AS flagged FROM o GROUP BY model_name""",
    "judge_output_parse": f"WITH {_E} SELECT response_id, CASE WHEN {_KIND} = 2 OR {_JUDGE('relevance')} IS NULL THEN CASE WHEN {_KIND} = 0 THEN 0.0::DOUBLE END ELSE round({_JUDGE('relevance')}, 3) END AS score FROM e",
    "judge_input_truncation": f"WITH {_E} SELECT response_id, md5({_SIDE('q')}) AS question, md5({_SIDE('r')}) AS response, CASE WHEN length(model_response) <= 80 THEN model_response ELSE substr(model_response, 1, 77) || '...' END AS short FROM x",
}
