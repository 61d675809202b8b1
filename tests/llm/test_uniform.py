import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import uniform as U

ODD = "aeoéёй\u0301\u0308\u0323\u0327ﬁＡ１\u200b\u00ad\xa0\u2009 \tо α각ｶﾞ\u1100\u1161\nß²…—"


def plain(text):
    tables = U.mappings()
    to = {int(k): "".join(map(chr, tables["flat"][s : s + n])) for k, s, n in zip(tables["keys"], tables["starts"], tables["sizes"])}
    return unicodedata.normalize("NFC", "".join(to.get(ord(c), c) for c in text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(min_codepoint=32, max_codepoint=0x2FFF, exclude_categories=("Cs",))), max_size=25), max_size=6))
def test_against_plain_composition(texts):
    assert U.uniform_texts(texts) == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(ODD), max_size=20))
def test_one_form_is_its_own_form(text):
    once = U.uniform_texts([text])[0]
    assert U.uniform_texts([once])[0] == once


def test_what_is_one_and_what_is_not():
    same = ["Access café file", "Аccess cafe\u0301 ﬁle", "Ａccess\u2007café\xa0fi\u200ble", "Acc\u00adess\u202fcafé file\ufeff"]
    assert len(set(U.uniform_texts(same))) == 1
    other = ["Access café file", "access café file", "Access cafe file", "Access café  file", "Access café file.", "Access café filé", "x² …", "x2 ..."]
    assert len(set(U.uniform_texts(other))) == len(other)
    assert U.uniform_texts([None, "", "plain"]) == [None, "", "plain"]


def test_pairs_and_classes(spark):
    rows = [(1, "a file", "x"), (2, "a ﬁle", "x"), (3, "a file", "x"), (4, "а file", "x"), (5, "A file", "x"), (6, None, "x"), (7, "", "x"), (8, "", "x"), (9, "long " * 100_000 + "é", "x"), (10, "long " * 100_000 + "e\u0301", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    assert {tuple(r) for r in U.look_alike_pairs(df).collect()} == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (9, 10)}
    for hot in (U.HOT_ROWS, 2):
        classes = {r.doc_id: (r.class_id, r.members, r.written_forms) for r in U.look_alike_classes(df, hot_rows=hot).collect()}
        assert classes[4] == (1, 4, 3) and classes[5] == (5, 1, 1) and classes[8] == (7, 2, 1) and 6 not in classes
    assert {r.doc_id: r.text for r in U.uniform_column(df).collect()}[6] is None
    assert U.look_alike_pairs(df.limit(0)).collect() == []


def test_pairs_of_large_classes_against_brute_force(spark):
    import random

    rng = random.Random(4)
    written = ["one file", "one ﬁle", "οne file", "one\u2009file", "ｏne file", "two files", "two ﬁles", "three"]
    rows = [(i if i % 50 else None, rng.choice(written) if i < 150 else "one file" if i < 320 else None) for i in range(330)] + [(3, "one file")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    form = dict(zip(written, U.uniform_texts(written)))
    want = {(a, b) for a, s in rows for b, t in rows if a is not None and b is not None and a < b and s and t and s != t and form[s] == form[t]}
    for hot, block in ((U.HOT_ROWS, 2048), (10, 7), (10, 1)):
        got = [tuple(r) for r in U.look_alike_pairs(df, hot_rows=hot, block=block).collect()]
        assert set(got) == want and (3 in [r[0] for r in rows[150:]] or len(got) == len(want))
    assert U.look_alike_pairs(df.limit(0)).collect() == []


def test_letters_of_more_alphabets():
    assert U.uniform_texts(["ꓐꓳꓳꓗ", "ⲞⲢⲤ"]) == ["BOOK", "OPC"]
