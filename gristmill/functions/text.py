"""Text functions as Column -> Column expressions; they stay in generated code and need no Python worker.

Null in gives null out unless a docstring says otherwise. Word boundaries and letters are Unicode ones ((?U)); white space
includes the kinds that the plain ``\\s`` of Java leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{0B}\x{85}\p{Z}]"

# fixed values: words not indexed, and words that always are
STOPWORDS = """a an and are as at be been by for from has he in is it its of on that the to was will with this but they have had what said each which their time
would about if up out many then them these so some her only no when my can over think also back after use two how our work first well way even new want because
any give day most us""".split()
PRESERVED = """control security policy access data system audit risk compliance framework standard requirement procedure guidelines assessment monitoring incident
response recovery backup encryption authentication authorization vulnerability threat breach privacy""".split()
TOKEN = r"\b[a-zA-Z0-9][a-zA-Z0-9._-]*[a-zA-Z0-9]\b|\b[a-zA-Z0-9]\b"
SECTION = r"\b(\d+\.\d+(?:\.\d+)*)\b"
# fixed values: the keyword patterns; the first three keep matches of more than two characters
KEYWORDS = [
    r"\b(?:control|requirement|standard|policy|procedure|security|compliance|audit|risk|assessment|framework|guideline|directive)\b",
    r"\b[A-Z]{2,}\b",
    r"\b\d+\.\d+(?:\.\d+)*\b",
]
PHRASES = r"\b(?:shall|must|should|required|mandatory|prohibited|forbidden|compliance|security|risk|assessment|audit|control|monitoring|logging|access|authentication|authorization|encryption|backup|recovery|incident|response|vulnerability|threat|policy|procedure|standard|framework|guideline)\b"
# fixed values: header patterns, tried in this order on each stripped line; group 1 is the title
HEADERS = [r"^#+\s+(.+)$", r"^(\d+\.)+\s+(.+)$", r"^([A-Z][A-Z\s]+):\s*$"]
# fixed values: the citation patterns, all without regard to case
CITATIONS = [
    r"\b[A-Z]{1,2}\d+\.\d+\b",
    r"\b[A-Z]{2,4}\d+\.\d+\b",
    r"\b[A-Z]{2,4}\.L\d+-[a-z]\.\d+\.[a-z]+\b",
    r"\b[A-Z]{2,4}\.L\d+-[a-z]\.\d+\.[ivx]+\b",
    r"\bNIST\.SP\.\d+-\d+r?\d*\b",
    r"\bNIST\s+\d+-\d+\b",
    r"\b[A-Z]{2,4}-\d+\b",
    r"\b[A-Z]{2,4}-\d+\(\d+\)\b",
    r"\bArticle\s+\d+\b",
    r"\bArt\.\s*\d+\b",
    r"\bGDPR\s+Article\s+\d+\b",
    r"\bGDPR\s+Art\.\s*\d+\b",
    r"\b\d+\.\d+\([a-z]\)\(\d+\)\([a-z]+\)\b",
    r"\b\d+\.\d+\([a-z]\)\b",
    r"\bA\.\d+\.\d+\.\d+\b",
    r"\bA-\d+\.\d+\.\d+\b",
    r"\bISO\s+27001\s+A\.\d+\.\d+\.\d+\b",
    r"\b\d+\.\d+\.\d+\b",
    r"\bPCI\s+DSS\s+\d+\.\d+\.\d+\b",
    r"\b[A-Z]{2}\.[A-Z]{2}-\d+\b",
    r"\bNIST\s+CSF\s+[A-Z]{2}\.[A-Z]{2}-\d+\b",
    r"\b[A-Z]{2,4}-\d+\s+\([A-Z]+\)\b",
    r"\b[A-Z]{2,6}-\d+\([A-Z]+\)\b",
]
# a stretch that can hold a citation: a run with a digit, the framework words before it and a bracketed word after it
CITING = r"(?:\b(?:NIST|CSF|GDPR|Article|Art\.|ISO|27001|PCI|DSS)\s*)*[\w.\-()]*\d[\w.\-()]*(?:\s+\([\w.\-()]*)?"
# fixed values: framework names and the wordings that mention them
FRAMEWORK_MENTIONS = {
    "nist_csf": ["nist csf", "nist cybersecurity framework", "csf"],
    "soc_2": ["soc 2", "soc2", "soc-2", "trust services"],
    "cmmc": ["cmmc", "cybersecurity maturity model certification"],
    "nist_800_53": ["nist 800-53", "800-53", "nist sp 800-53"],
    "nist_800_171": ["nist 800-171", "800-171", "nist sp 800-171"],
    "pci_dss": ["pci dss", "pci", "payment card industry"],
    "hipaa": ["hipaa", "health insurance portability"],
    "gdpr": ["gdpr", "general data protection regulation"],
    "fedramp": ["fedramp", "federal risk and authorization"],
    "cjis": ["cjis", "criminal justice information services"],
    "new_jersey_state": ["new jersey", "nj state"],
}
# fixed values: query terms and framework patterns of query enhancement
QUERY_TERMS = r"\b(?:control|requirement|standard|policy|procedure|security|compliance|audit|risk|assessment|framework|guideline|directive|access|authentication|authorization|encryption|backup|recovery|incident|response|vulnerability|threat|monitoring|logging)\b"
QUERY_FRAMEWORKS = {
    "nist": r"\b(?:nist|national institute)\b",
    "soc": r"\bsoc\s*2?\b",
    "pci": r"\b(?:pci|payment card)\b",
    "hipaa": r"\bhipaa\b",
    "gdpr": r"\bgdpr\b",
    "iso": r"\biso\s*\d+\b",
    "cmmc": r"\bcmmc\b",
    "fedramp": r"\bfedramp\b",
}


def find_all(text: Column, pattern: str, flags: str = "U") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """Parts between white space; an empty array for blank text."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def count_contained(text: Column, terms: list[str]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total


def clean_whitespace(text: Column) -> Column:
    """Three or more line ends with nothing between become two, then runs of blanks and tabs one blank."""
    return F.regexp_replace(F.regexp_replace(text, rf"\n{WS}*\n{WS}*\n+", "\n\n"), r"[ \t]+", " ")


def tokenize(text: Column) -> Column:
    """Index terms, in order: identifiers and words in lower case, without stopwords and without single letters but a, b, c."""
    padded = F.regexp_replace(F.lower(text), f"(?U){SECTION}", " $1 ")
    tokens = find_all(padded, TOKEN)
    one = F.lit([*"0123456789abc"])
    return F.filter(tokens, lambda t: t.isin(PRESERVED) | (~t.isin(STOPWORDS) & (F.length(t) > 1)) | F.array_contains(one, t))


def keywords(text: Column, limit: int = 20) -> Column:
    """Distinct keywords in lower case, sorted, the first ``limit``."""
    lowered = F.lower(text)
    long = F.filter(F.array_distinct(F.concat(*(find_all(lowered, p, "iU") for p in KEYWORDS))), lambda k: F.length(k) > 2)
    return F.slice(F.sort_array(F.array_union(long, find_all(lowered, PHRASES, "iU"))), 1, limit)


def headers(text: Column, title_group: str = "first") -> Column:
    """Titles of the header lines in order. The title of a numbered header is its number, or with ``title_group='last'`` its words."""
    lines = F.transform(F.split(text, "\n"), strip)

    def title(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, pattern in reversed(list(enumerate(HEADERS))):
            group = 2 if i == 1 and title_group == "last" else 1
            out = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group)).otherwise(out)
        return out

    return F.filter(F.transform(lines, title), lambda t: t.isNotNull())


def citations(text: Column) -> Column:
    """Distinct control and article references in upper case, sorted; an empty array for null."""
    stretches = F.array(F.array_join(find_all(text, CITING, "iU"), " ¶ "))
    found = F.flatten(F.flatten(F.transform(stretches, lambda s: F.array(*(find_all(s, p, "iU") for p in CITATIONS)))))
    return F.coalesce(F.sort_array(F.array_distinct(F.transform(found, lambda x: strip(F.upper(x))))), F.array().cast("array<string>"))


def detect_frameworks(text: Column) -> Column:
    """Names of the frameworks a text mentions, in fixed order; any substring counts."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*(F.when(contains_any(lowered, terms), F.lit(name)) for name, terms in FRAMEWORK_MENTIONS.items())))


def enhance_query(text: Column) -> Column:
    """keywords (technical terms, then section numbers, repeats kept) and frameworks of a query."""
    terms = F.concat(F.transform(find_all(text, QUERY_TERMS, "iU"), F.lower), find_all(text, SECTION.replace("(", "(?:", 1)))
    named = F.array_compact(F.array(*(F.when(text.rlike(f"(?iU){p}"), F.lit(name)) for name, p in QUERY_FRAMEWORKS.items())))
    return F.struct(terms.alias("keywords"), named.alias("frameworks"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def size_bucket(chars: Column) -> Column:
    return F.when(chars < 1000, "small").when(chars < 3000, "medium").when(chars.isNotNull(), "large")


def truncate(text: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` characters, the suffix included."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, max(0, limit - len(suffix))), F.lit(suffix)))


def truncate_passage(text: Column, limit: int) -> Column:
    """Cut at the last full stop if that lies beyond 70 percent of the limit, else three characters early with an ellipsis."""
    head = F.substring(text, 1, limit)
    stop = F.length(head) - F.locate(".", F.reverse(head))  # 0-based place of the last full stop
    has = F.contains(head, F.lit("."))
    return F.when(F.length(text) <= limit, text).when(has & (stop > limit * 0.7), F.substring(head, F.lit(1), stop + 1)).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def passage(section: Column, subsection: Column, framework: Column, text: Column, limit: int = 512) -> Column:
    """``Section: a | Subsection: b``, then on the next line ``[framework] text``, cut to ``limit``; absent parts left out."""
    filled = lambda c: c.isNotNull() & (c != "")
    head = F.concat_ws(" | ", F.when(filled(section), F.concat(F.lit("Section: "), section)), F.when(filled(subsection), F.concat(F.lit("Subsection: "), subsection)))
    body = F.concat(F.when(filled(framework), F.concat(F.lit("["), framework, F.lit("] "))).otherwise(F.lit("")), F.coalesce(text, F.lit("")))
    return truncate_passage(F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body), limit)


def index_text(text: Column, keys: Column, section: Column, subsection: Column) -> Column:
    """Text with its keywords and titles appended, each only where there are any."""
    labelled = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f" {label}: "), c)).otherwise(F.lit(""))
    joined = F.when(F.size(keys) > 0, F.array_join(keys, " "))
    return F.concat(F.coalesce(text, F.lit("")), labelled("KEYWORDS", joined), labelled("SECTION", section), labelled("SUBSECTION", subsection))


def judge_inputs(question: Column, response: Column, ideal: Column, limit: int = 8000, reserve: int = 100) -> Column:
    """question and response cut so that with the ideal answer they fit ``limit``; a struct of both."""
    mark = "...[truncated]"
    total = F.length(question) + F.length(response) + F.length(ideal)
    half = F.floor((F.lit(limit - reserve) - F.length(ideal)) / 2).cast("int")

    def side(c: Column) -> Column:
        return F.when((total > limit) & (F.length(c) > half), F.concat(F.substring(c, F.lit(1), half), F.lit(mark))).otherwise(c)

    return F.struct(side(question).alias("question"), side(response).alias("response"))


def duration(seconds: Column) -> Column:
    """Seconds under a minute, minutes under an hour, else hours, with one decimal."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def score_class(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.4, "medium").otherwise("low")


def quality_bucket(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score >= 0.4, "medium").when(score.isNotNull(), "low")


def parse_score(reply: Column) -> Column:
    """The score a judge's reply states: of its JSON object, where it is one, 0 without the key; else the first number after ``score:``; else null."""
    parsed = F.get_json_object(reply, "$.score")
    is_json = F.try_parse_json(reply).isNotNull() & strip(reply).startswith("{")
    loose = F.nullif(F.regexp_extract(reply, r"""(?i)score["']?\s*:\s*([0-9.]+)""", 1), F.lit(""))
    return F.when(is_json, F.coalesce(parsed.try_cast("double"), F.lit(0.0))).otherwise(loose.try_cast("double"))
