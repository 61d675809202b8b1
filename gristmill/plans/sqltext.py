"""Pieces of DuckDB SQL for the text functions, from the same fixed values."""

from __future__ import annotations

from gristmill.functions import text as T

# letters and marks beyond ASCII; the other dialect's word boundary does not know them, so words that hold any are masked first
FOREIGN = r"\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{300}-\x{37D}\x{386}\x{388}-\x{52F}\x{FB00}-\x{FB06}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def masked(x: str) -> str:
    return f"regexp_replace({x}, '[0-9A-Za-z_]*[{FOREIGN}][0-9A-Za-z_{FOREIGN}]*', '§', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{T.WS}+'), lambda w: w <> '')"


def find_all(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_extract_all({x}, {quoted(pattern)}, 0{', ' + quoted(flags) if flags else ''})"


def contains_any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in terms) + ")"


def count_contained(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {quoted(t)}) AS INTEGER)" for t in terms) + ")"


def count_matches(x: str, patterns: list[str], flags: str = "", most: int | None = None) -> str:
    one = lambda p: f"len({find_all(x, p, flags)})"
    return "(" + " + ".join(f"least({most}, {one(p)})" if most else one(p) for p in patterns) + ")"


def citations(x: str) -> str:
    found = ", ".join(find_all(x, p, "i") for p in T.CITATIONS)
    return f"list_sort(list_distinct(list_transform(flatten([{found}]), lambda c: {strip('upper(c)')})))"


def keywords(x: str) -> str:
    m = masked(x)
    first = ", ".join(find_all(m, p, "i") for p in T.KEYWORDS)
    return f"list_sort(list_distinct(list_transform(list_concat(list_filter(flatten([{first}]), lambda k: length(k) > 2), {find_all(m, T.PHRASES, 'i')}), lambda k: lower(k))))[1:20]"


def tokens(x: str) -> str:
    padded = f"regexp_replace(lower({masked(x)}), {quoted(T.SECTION)}, ' \\1 ', 'g')"
    return f"list_filter({find_all(padded, T.TOKEN)}, lambda t: t IN {names(T.PRESERVED)} OR (t NOT IN {names(T.STOPWORDS)} AND length(t) > 1) OR t IN {names('0123456789abc')})"


def titles(x: str) -> str:
    a, b, c = (quoted(p) for p in T.HEADERS)
    line = strip("l")
    case = f"CASE WHEN regexp_matches({line}, {a}) THEN regexp_extract({line}, {a}, 1) WHEN regexp_matches({line}, {b}) THEN regexp_extract({line}, {b}, 1) WHEN regexp_matches({line}, {c}) THEN regexp_extract({line}, {c}, 1) END"
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {case}), lambda t: t IS NOT NULL)"


def index_text(prefix: str = "") -> str:
    p = prefix
    return (
        f"coalesce({p}text, '') || CASE WHEN len({p}keywords) > 0 AND array_to_string({p}keywords, ' ') <> '' THEN ' KEYWORDS: ' || array_to_string({p}keywords, ' ') ELSE '' END"
        f" || CASE WHEN {p}section_title <> '' THEN ' SECTION: ' || {p}section_title ELSE '' END || CASE WHEN {p}subsection_title <> '' THEN ' SUBSECTION: ' || {p}subsection_title ELSE '' END"
    )


def clean_whitespace(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\n{T.WS}*\\n{T.WS}*\\n+', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"


def detected(x: str) -> str:
    parts = ", ".join(f"CASE WHEN {contains_any('lower(' + x + ')', t)} THEN {quoted(n)} END" for n, t in T.FRAMEWORK_MENTIONS.items())
    return f"list_filter([{parts}], lambda f: f IS NOT NULL)"
