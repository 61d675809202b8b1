"""Queries over single fields."""

from __future__ import annotations

from gristmill.functions import text as T
from gristmill.operators.packed_values import explode_packed
from gristmill.plans import sqltext as S
from gristmill.session import table


def p4_found(spark, d):
    return explode_packed(table(spark, d, "cyber_evals"), "metadata.framework", "question_id", least=2)


def p4_values(spark, d):
    return explode_packed(table(spark, d, "cyber_evals"), "metadata.framework", "question_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_values)}

# ---- SQL: a delimiter with the quoted value after it is one token, so are other delimiters and single characters; a mark stands before each value

_HARD = r"[,，;；|｜•‣◦▪●\t\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_SPLIT = rf"(?:{_HARD}|{T.WS}(?:[/+]{T.WS})+)"
_QUOTED = [(a, b, rf"{a}(?:[^{b}\\]|\\.|{b}{b})*{b}") for a, b in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))]
_TOKEN = S.quoted(rf"(?s)(?:^|{_SPLIT}){T.WS}*(?:{'|'.join(q for _, _, q in _QUOTED)})|{_SPLIT}|.")
_UNQUOTED = "CASE " + " ".join(f"WHEN regexp_full_match(v, {S.quoted('(?s)' + q)}) THEN replace(replace(v[2:-2], {S.quoted(chr(92) + b)}, {S.quoted(b)}), {S.quoted(b + b)}, {S.quoted(b)})" for _, b, q in _QUOTED) + " ELSE v END"
_VALUES = f"""WITH f AS (SELECT DISTINCT ON (question_id) question_id, {S.strip('metadata.framework')} AS f FROM cyber_evals WHERE metadata.framework IS NOT NULL),
    b AS (SELECT question_id, {S.strip("CASE WHEN f LIKE '[%]' THEN f[2:-2] ELSE f END")} AS f FROM f),
    j AS (SELECT question_id, array_to_string(list_transform(regexp_extract_all(f, {_TOKEN}), lambda t: regexp_replace(t, {S.quoted('^' + _SPLIT)}, chr(57344))), '') AS f FROM b),
    v AS (SELECT question_id, list_filter(list_transform(list_transform(string_split(f, chr(57344)), lambda v: {S.strip('v')}), lambda v: {S.strip(_UNQUOTED)}), lambda v: v <> '') AS l FROM j)
    SELECT question_id, CAST(i AS INTEGER) AS pos, l[i] AS val FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM v)"""
SQL = {"p4_found": f"{_VALUES} WHERE len(l) >= 2", "p4_values": _VALUES}
