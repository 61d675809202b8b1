"""Deterministic response scores as Column expressions.

Every score takes columns and returns a double. A response that is not valid scores 0 where the rule says so; null questions and
ideal answers count as empty text. The additions and subtractions run in the stated order, so doubles come out alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

# fixed values: what makes a response invalid
NON_SUBSTANTIVE = [
    r"^(i don't know|don't know|not sure|no idea|can't help|cannot help)[\.\!]?\s*$",
    r"^(n/a|na|none|null|undefined)[\.\!]?\s*$",
    r"^(sorry|apologize).*(cannot|can't|unable).*$",
    r"^(please|try).*contact.*$",
]
GENERIC = ["thank you for your question", "this is an interesting question", "let me help you with that", "here are some general guidelines"]
# fixed values: explanation words, policy sections and tables, verbose phrases
EXPLAINING = ["because", "since", "as", "due to", "requires", "mandates", "specifies"]
SECTIONS = [r"##\s*Purpose\s*&\s*Scope", r"##\s*Policy\s*Statements?", r"##\s*Roles?\s*&\s*Responsibilities", r"##\s*Compliance\s*&\s*Enforcement", r"##\s*Review\s*Cycle", r"##\s*Framework\s*Mappings?"]
MAPPING_TABLE = r"\|\s*Policy\s*\|\s*\w+\s*Control\s*\||\|\s*\w+\s*Control\s*\|\s*\w+"
VERBOSE = ["it is important to note that", "it should be noted that", "please be advised that", "it is worth mentioning", "as previously mentioned", "furthermore, it is essential"]
STRUCTURE = [r"##\s+\w+", r"\d+\.\s+", r"\*\*\w+\*\*", r"\|\s*\w+\s*\|"]
# fixed values: the vocabulary of relevance
DOMAIN_TERMS = "security compliance control framework risk vulnerability threat policy governance audit incident breach encryption access authentication authorization monitoring gdpr hipaa sox pci nist iso soc cmmc fedramp".split()
QUESTION_TYPES = {
    "framework": ["framework", "standard", "regulation", "compliance"],
    "control": ["control", "requirement", "safeguard", "measure"],
    "implementation": ["implement", "deploy", "configure", "setup"],
    "risk": ["risk", "threat", "vulnerability", "assessment"],
    "policy": ["policy", "procedure", "guideline", "document"],
    "technical": ["technical", "system", "technology", "architecture"],
}
ALIGNMENT = {
    "nist": ["nist", "800-53", "800-171", "csf", "cybersecurity framework"],
    "gdpr": ["gdpr", "general data protection", "article"],
    "hipaa": ["hipaa", "health insurance", "164."],
    "sox": ["sox", "sarbanes", "sarbanes-oxley"],
    "pci": ["pci", "payment card", "pci-dss", "pci dss"],
    "iso": ["iso", "27001", "27002"],
    "soc": ["soc", "soc 2", "soc2", "trust services"],
    "cmmc": ["cmmc", "cybersecurity maturity"],
    "fedramp": ["fedramp", "federal risk"],
}
TECHNICAL = ["configuration", "implementation", "architecture", "deployment", "monitoring", "logging", "alerting", "incident response", "backup", "recovery", "encryption", "key management"]
# fixed values: the vocabulary of completeness
COMMON = "the and or but in on at to for of with by a an is are was were will would should must can could may might".split()
IMPORTANT = ["security", "compliance", "control", "policy", "risk", "framework", "audit", "governance"]
REASONS = ["because", "since", "due to", "as a result", "therefore", "consequently", "reason", "purpose"]
ACTIONS = ["configure", "setup", "deploy", "install", "enable", "create", "establish", "develop"]
# fixed values: the catalogue citations are verified against; a family's highest number
SOC_CRITERIA = {"CC1": 5, "CC2": 3, "CC3": 4, "CC4": 2, "CC5": 3, "CC6": 8, "CC7": 5, "CC8": 1, "CC9": 2, "A1": 3, "PI1": 3, "P1": 2, "P2": 2, "P3": 2, "P4": 3, "P5": 2, "P6": 3, "P7": 1, "P8": 1, "C1": 2}
CSF_CATEGORIES = {"ID": ["AM", "BE", "GV", "RA", "RM", "SC"], "PR": ["AC", "AT", "DS", "IP", "MA", "PT"], "DE": ["AE", "CM", "DP"], "RS": ["RP", "CO", "AN", "MI", "IM"], "RC": ["RP", "IM", "CO"]}
CONTROL_FAMILIES = {"AC": 25, "AT": 5, "AU": 16, "CA": 9, "CM": 14, "CP": 13, "IA": 12, "IR": 10, "MA": 7, "MP": 8, "PE": 20, "PL": 11, "PS": 8, "PT": 8, "RA": 10, "SA": 22, "SC": 53, "SI": 23, "SR": 12}
ARTICLES = 99


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


class Response:
    """The columns that the rules share: texts without nulls, their lower-case forms, the citations, the word count and what makes the response invalid.

    Built from expressions it can be used anywhere; ``stage`` writes the parts into columns first, so that conditional rules that use one
    many times do not compute it again.
    """

    PARTS = ("r", "q", "low", "asked", "wanted", "words", "mine", "theirs", "reason")

    def __init__(self, response: Column, question: Column, ideal: Column):
        self.r, self.q = _text(response), _text(question)
        self.low, self.asked, self.wanted = F.lower(self.r), F.lower(self.q), F.lower(_text(ideal))
        self.words = T.word_count(self.r)
        self.mine, self.theirs = T.citations(self.r), T.citations(_text(ideal))
        self.reason = invalid_reason(response)

    @classmethod
    def stage(cls, df: DataFrame, response: str, question: str, ideal: str) -> tuple[DataFrame, Response]:
        parts = cls(F.col(response), F.col(question), F.col(ideal))
        first = df.withColumns({"_r": parts.r, "_q": parts.q, "_i": _text(F.col(ideal)), "_bare": T.strip(parts.r)})
        staged = first.withColumns({
            "_low": F.lower("_r"), "_asked": F.lower("_q"), "_wanted": F.lower("_i"), "_words": T.word_count(F.col("_r")), "_mine": T.citations(F.col("_r")), "_theirs": T.citations(F.col("_i")), "_plain": F.lower("_bare"),
        }).withColumn("_reason", _reason(F.col("_r"), F.col("_bare"), F.col("_plain")))
        for name in cls.PARTS:
            setattr(parts, name, F.col(f"_{name}"))
        return staged, parts


def _reason(text: Column, bare: Column, low: Column) -> Column:
    hollow = F.lit(False)
    for pattern in NON_SUBSTANTIVE:
        hollow = hollow | low.rlike(pattern)
    return (
        F.when(text == "", "empty")
        .when(bare == "", "blank")
        .when(low.startswith("error:") | bare.startswith("MODEL_FAILURE:"), "error message")
        .when(F.length(bare) < 10, "too short")
        .when(hollow, "non-substantive")
        .when(T.contains_any(low, GENERIC) & (T.word_count(low) < 50), "generic template")
    )


def invalid_reason(response: Column) -> Column:
    """The first rule a response breaks, null if it is valid. A null response is empty."""
    bare = T.strip(_text(response))
    return _reason(_text(response), bare, F.lower(bare))


def exact_match(response: Column, ideal: Column) -> Column:
    return F.when(F.lower(T.strip(_text(response))) == F.lower(T.strip(_text(ideal))), 1.0).otherwise(0.0)


def _f1(shared: Column, mine: Column, theirs: Column) -> Column:
    precision = F.when(mine > 0, shared / mine).otherwise(0.0)
    recall = shared / theirs
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def control_reference(x: Response) -> Column:
    """F1 of the cited controls; without any in the ideal answer 1.0 if the response has none either, else 0.5."""
    f1 = _f1(F.size(F.array_intersect(x.mine, x.theirs)).cast("double"), F.size(x.mine), F.size(x.theirs))
    return F.when(x.reason.isNotNull(), 0.0).when(F.size(x.theirs) == 0, F.when(F.size(x.mine) == 0, 1.0).otherwise(0.5)).otherwise(f1)


def _catalogue(table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def is_known_citation(citation: Column, strict_compat: bool = False) -> Column:
    """Whether the catalogue knows a citation. ``strict_compat`` looks criteria up by letters only, which knows none."""
    soc, csf, article, family = r"^([A-Z]{1,3})(\d+)\.(\d+)", r"^([A-Z]{2}\.[A-Z]{2})-\d+", r"ARTICLE\s+(\d+)", r"^([A-Z]{2,4})-(\d+)"
    part = lambda pattern, group: F.regexp_extract(citation, pattern, group)
    number = lambda pattern, group: part(pattern, group).try_cast("int")
    key = part(soc, 1) if strict_compat else F.concat(part(soc, 1), part(soc, 2))
    known = [
        number(soc, 3).between(1, F.try_element_at(_catalogue(SOC_CRITERIA), key)),
        part(csf, 1).isin([f"{f}.{c}" for f, cs in CSF_CATEGORIES.items() for c in cs]),
        number(article, 1).between(1, ARTICLES),
        number(family, 2).between(1, F.try_element_at(_catalogue(CONTROL_FAMILIES), part(family, 1))),
    ]
    found = F.lit(False)
    for test in known:
        found = found | F.coalesce(test, F.lit(False))
    return found


def citation_verification(x: Response, strict_compat: bool = False) -> Column:
    """Share of the cited controls that the catalogue knows; 1.0 without any."""
    known = F.size(F.filter(x.mine, lambda c: is_known_citation(c, strict_compat)))
    return F.when(F.size(x.mine) == 0, 1.0).otherwise(known.cast("double") / F.size(x.mine))


def _penalty(*cases: tuple[Column, float]) -> Column:
    """The amount of the first case that holds, else nothing."""
    out = F.lit(0.0)
    for test, amount in reversed(cases):
        out = F.when(test, amount).otherwise(out)
    return out


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def structural_validation(x: Response) -> Column:
    """How well a response keeps to the form asked for; at least 0, not capped above."""
    listed = x.r.rlike(r"(?m)^[\s]*[-*•]\s") | x.r.rlike(r"(?m)^[\s]*\d+[\.\)]\s")
    score = F.lit(1.0) - _penalty((T.contains_any(x.asked, ["list", "enumerate"]) & ~listed, 0.3))
    score = score - _penalty((T.contains_any(x.asked, ["why", "explain", "because"]) & ~T.contains_any(x.low, EXPLAINING), 0.2))
    score = score - _penalty((F.length(x.r) > F.least(F.lit(500), F.length(x.q) * 3) * 3, 0.1))
    sections = sum((x.r.rlike(f"(?i){p}").cast("int") for p in SECTIONS), F.lit(0))
    form = _penalty((sections >= 5, 0.1), (sections < 3, -0.3)) + F.when(x.r.rlike(f"(?i){MAPPING_TABLE}"), 0.1).otherwise(-0.2)
    loose = F.contains(x.asked, F.lit("requirements")) & ~x.r.rlike(r"\n\n|---|\*\*|##|\d+\.|[A-Z]\)") & (F.length(x.r) > 200)
    score = score + F.when(T.contains_any(x.asked, ["policy", "short_prompt", "format"]), form).when(loose, -0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def conciseness(x: Response) -> Column:
    score = F.lit(1.0) - _penalty((F.length(x.r) > 1500, 0.3), (F.length(x.r) > 1000, 0.1))
    score = score - _penalty((x.words > 250, 0.2))
    score = score - sum((F.regexp_count(x.r, F.lit(f"(?i){p}")) for p in VERBOSE), F.lit(0)) * 0.1
    shape = sum((F.least(F.lit(3), F.regexp_count(x.r, F.lit(p))) for p in STRUCTURE), F.lit(0))
    return _clamp(score + F.when(T.contains_any(x.asked, ["policy", "format"]), _penalty((shape >= 8, 0.1), (shape < 4, -0.2))).otherwise(0.0))


def contextual_relevance(x: Response) -> Column:
    terms = T.count_contained(x.low, DOMAIN_TERMS)
    score = F.lit(1.0) - _penalty((terms == 0, 0.8), (terms < 3, 0.3))
    typed, met = F.lit(False), F.lit(False)
    for words in QUESTION_TYPES.values():
        typed = typed | T.contains_any(x.asked, words)
        met = met | (T.contains_any(x.asked, words) & T.contains_any(x.low, words))
    score = score - _penalty((typed & ~met, 0.4))
    for words in ALIGNMENT.values():
        score = score - _penalty((T.contains_any(x.asked, words) & ~T.contains_any(x.low, words), 0.2))
    score = score - _penalty((x.words < 20, 0.3), (x.words > 500, 0.1))
    score = score + _penalty((T.count_contained(x.low, TECHNICAL) >= 3, 0.1))
    return F.when(x.reason.isNotNull(), 0.0).otherwise(_clamp(score))


def important_terms(wanted: Column) -> Column:
    kept = F.filter(T.words(wanted), lambda w: (F.length(w) > 3) & ~w.isin(COMMON))
    bare = F.transform(kept, lambda w: F.regexp_replace(w, r"^[.,!?()\[\]{}]+|[.,!?()\[\]{}]+$", ""))
    return F.filter(bare, lambda w: T.contains_any(w, IMPORTANT))


def completeness(x: Response) -> Column:
    none = F.lit(0.0)
    recall = F.size(F.array_intersect(x.mine, x.theirs)).cast("double") / F.size(x.theirs)
    score = F.lit(1.0) - F.when(F.size(x.theirs) == 0, none).otherwise(_penalty((recall < 0.3, 0.4), (recall < 0.7, 0.2)))
    share = F.transform(F.array(important_terms(x.wanted)), lambda t: F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.contains(x.low, w))).cast("double") / F.size(t)))[0]
    score = score - F.coalesce(_penalty((share < 0.4, 0.3), (share < 0.8, 0.1)), none)
    joined = F.contains(x.asked, F.lit(" and "))
    listed = x.r.rlike(r"(?m)^\s*\d+[\.\)]\s|\s*[-*•]\s")
    score = score - _penalty((~joined & T.contains_any(x.asked, ["list", "identify"]) & ~listed, 0.2))
    parts = F.split(x.asked, " and ")
    answered = F.filter(parts, lambda p: F.exists(T.words(p), lambda w: (F.length(w) > 3) & F.contains(x.low, w)))
    part = F.size(answered).cast("double") / F.size(parts)
    score = score - F.when(~joined, none).otherwise(_penalty((part < 0.5, 0.3), (part < 1.0, 0.1)))
    reasons = T.count_contained(x.low, REASONS)
    score = score - F.when(~T.contains_any(x.asked, ["why", "explain", "because"]), none).otherwise(_penalty((reasons == 0, 0.3), (reasons < 2, 0.1)))
    score = score - _penalty((T.contains_any(x.asked, ["implement", "how to"]) & ~T.contains_any(x.low, ACTIONS), 0.2))
    return F.when(x.reason.isNotNull(), 0.0).otherwise(_clamp(score))


def asks_for_policy(x: Response) -> Column:
    return T.contains_any(x.asked, ["short_prompt", "policy", "format"]) | (F.contains(x.asked, F.lit("create")) & T.contains_any(x.asked, ["compliance", "compliant"]))


def composite(policy: Column, valid: Column, judge: Column, structure: Column, relevance: Column, complete: Column, concise: Column) -> Column:
    """The weighted score of a response from its parts; a missing judge score counts 0."""
    j = F.coalesce(judge, F.lit(0.0))
    for_policy = F.lit(0.10) + structure * 0.25 + j * 0.40 + complete * 0.15 + concise * 0.10
    return F.when(~valid, 0.0).when(policy, for_policy).otherwise(j * 0.50 + relevance * 0.30 + complete * 0.20)


def primary_score(judge: Column, control: Column) -> Column:
    return F.coalesce(judge, control, F.lit(0.0))


def merge_judges(first: Column, second: Column, weight_first: float = 0.5, weight_second: float = 0.5, most_apart: float = 0.3) -> Column:
    """Struct of score, outcome (both, first, second, none) and flagged. A judge counts only with a score above 0."""
    a, b = F.coalesce(first > 0, F.lit(False)), F.coalesce(second > 0, F.lit(False))
    total = weight_first + weight_second
    share = (weight_first / total, weight_second / total) if total else (0.5, 0.5)
    score = F.when(a & b, first * share[0] + second * share[1]).when(a, first).when(b, second).otherwise(F.lit(0.0))
    outcome = F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("none")
    return F.struct(score.alias("score"), outcome.alias("outcome"), F.coalesce(a & b & (F.abs(first - second) > most_apart), F.lit(False)).alias("flagged"))


# the methods by name; each takes a staged response and the judge's score, null where there is none
METHODS = {
    "exact_match": lambda x, judge: exact_match(x.r, x.wanted),
    "control_reference": lambda x, judge: control_reference(x),
    "llm_judge": lambda x, judge: F.when(x.reason.isNotNull(), 0.0).otherwise(F.coalesce(judge, F.lit(0.0))),
    "structural_validation": lambda x, judge: structural_validation(x),
    "citation_verification": lambda x, judge: citation_verification(x),
    "composite_policy": lambda x, judge: composite(asks_for_policy(x), x.reason.isNull(), judge, structural_validation(x), contextual_relevance(x), completeness(x), conciseness(x)),
    "contextual_relevance": lambda x, judge: contextual_relevance(x),
    "completeness": lambda x, judge: completeness(x),
    "conciseness": lambda x, judge: conciseness(x),
}
DEFAULT_METHODS = ("control_reference", "llm_judge", "structural_validation", "citation_verification")


def score_by(x: Response, judge: Column, methods: tuple[str, ...] = DEFAULT_METHODS) -> dict[str, Column]:
    """The scores of the chosen methods by name, in the order given; an unknown name is an error."""
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown scoring methods {unknown}; known are {list(METHODS)}")
    return {m: METHODS[m](x, judge) for m in methods}


def first_unknown_citations(x: Response, n: int = 3) -> Column:
    """The first ``n`` cited controls that the catalogue does not know."""
    return F.slice(F.filter(x.mine, lambda c: ~is_known_citation(c)), 1, n)
