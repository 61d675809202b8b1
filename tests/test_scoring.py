import pytest
from pyspark.sql import functions as F

from gristmill.functions import scoring as C


def score(spark, rule, response, question="", ideal=""):
    df = spark.createDataFrame([(response, question, ideal)], "r string, q string, i string")
    staged, x = C.Response.stage(df, "r", "q", "i")
    inline = C.Response(F.col("r"), F.col("q"), F.col("i"))
    a, b = staged.select(rule(x).alias("v")).first().v, df.select(rule(inline).alias("v")).first().v
    assert a == b
    return a


@pytest.mark.parametrize("response", ["", "   ", "Error: Model timeout", "MODEL_FAILURE: Connection failed", "I don't know", "N/A", "Sorry, I can't help with that", "Hi!", None])
def test_invalid_responses_score_nothing(spark, response):
    for rule in (C.control_reference, C.contextual_relevance, C.completeness):
        assert score(spark, rule, response, "What does CC6.1 require?", "CC6.1 asks for access control.") == 0.0


@pytest.mark.parametrize("response, reason", [("TASK_FAILURE: x y z", None), ("ERROR: something", "error message"), ("model_failure: something", None), ("123456789", "too short"), ("1234567890", None), ("Thank you for your question " + "w " * 44, "generic template"), ("Thank you for your question " + "w " * 45, None)])
def test_reasons(spark, response, reason):
    assert score(spark, lambda x: x.reason, response) == reason


def test_controls(spark):
    with_controls = "CC6.1 and CC6.2 need logical access control"
    assert score(spark, C.control_reference, "", "", "no controls here") == 0.0
    assert score(spark, C.control_reference, "A substantive response without any", "", "no controls here") == 1.0
    assert score(spark, C.control_reference, "It cites CC6.1 for this", "", "no controls here") == 0.5
    assert score(spark, C.control_reference, "It cites CC6.1 and CC7.1 here", "", with_controls) == 0.5
    assert score(spark, C.control_reference, "It cites CC6.1 and CC6.2 here", "", with_controls) == 1.0
    assert score(spark, C.control_reference, "It cites nothing at all here", "", with_controls) == 0.0


@pytest.mark.parametrize("citation, known, strict", [("AC-25", True, True), ("AC-26", False, False), ("ARTICLE 99", True, True), ("ARTICLE 100", False, False), ("PR.AC-3", True, True), ("PR.ZZ-1", False, False), ("CC6.1", True, False), ("CC6.9", False, False), ("P8.1", True, False), ("COVID-19", False, False), ("AC-99999999999", False, False)])
def test_catalogue(spark, citation, known, strict):
    row = spark.createDataFrame([(citation,)], "c string").select(C.is_known_citation(F.col("c")), C.is_known_citation(F.col("c"), strict_compat=True)).first()
    assert tuple(row) == (known, strict)


def test_structure(spark):
    assert score(spark, C.structural_validation, "plain words", "List the duties") == 0.7
    assert score(spark, C.structural_validation, "- one\n- two", "List the duties") == 1.0
    assert score(spark, C.structural_validation, "x " * 1000, "What?") == pytest.approx(0.9)
    policy = "## Purpose & Scope\n## Policy Statements\n## Roles & Responsibilities\n## Compliance & Enforcement\n## Review Cycle\n## Framework Mappings\n| Policy | NIST Control |\n"
    assert score(spark, C.structural_validation, policy, "Write a policy in a given format, with a lot of room for the text that follows here") == pytest.approx(1.2)
    assert score(spark, C.structural_validation, "none", "Write a policy") == pytest.approx(0.5)


def test_conciseness_and_relevance(spark):
    assert score(spark, C.conciseness, "short") == 1.0
    assert score(spark, C.conciseness, "x" * 1001) == pytest.approx(0.9)
    assert score(spark, C.conciseness, "w " * 800) == pytest.approx(0.5)
    assert score(spark, C.conciseness, "It should be noted that it should be noted that") == pytest.approx(0.8)
    good = "Access control and monitoring support the security policy, and encryption with backup and recovery lowers the risk of a breach for all the staff involved here."
    assert score(spark, C.contextual_relevance, good, "How does the policy lower risk?") == 1.0
    assert score(spark, C.contextual_relevance, "Bananas are yellow fruit.", "Which control lowers risk under GDPR?") == 0.0


def test_completeness(spark):
    ideal = "CC6.1 requires security controls and audit policy"
    assert score(spark, C.completeness, "CC6.1 requires security controls and an audit policy", "What is required?", ideal) == 1.0
    assert score(spark, C.completeness, "Something else entirely", "What is required?", ideal) == pytest.approx(0.3)
    assert score(spark, C.completeness, "Something else entirely", "Why is it so?", "") == pytest.approx(0.7)
    assert score(spark, C.completeness, "The tokens are reviewed", "Describe tokens and badges", "") == pytest.approx(0.9)


def test_judges(spark):
    rows = [(0.8, 0.6), (0.8, 0.0), (None, 0.6), (None, None), (0.9, 0.6), (0.9, 0.59), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(C.merge_judges(F.col("a"), F.col("b")).alias("m"))
    got = [(round(r.m.score, 6), r.m.outcome, r.m.flagged) for r in df.collect()]
    assert got == [(0.7, "both", False), (0.8, "first", False), (0.6, "second", False), (0.0, "none", False), (0.75, "both", True) if 0.9 - 0.6 > 0.3 else (0.75, "both", False), (0.745, "both", True), (0.0, "none", False)]
    half = spark.createDataFrame([(0.2, 0.4)], "a double, b double").select(C.merge_judges(F.col("a"), F.col("b"), 0, 0).alias("m")).first().m
    assert half.score == pytest.approx(0.3)
