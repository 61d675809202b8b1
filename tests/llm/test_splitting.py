import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n!é", max_size=400), st.integers(0, 5))
def test_pieces_cover_the_text(text, overlap):
    pieces = S.cut_points(text, 20, overlap, 8)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(e - s <= 20 for s, e in pieces)
    for (_, end), (start, _) in zip(pieces, pieces[1:]):
        assert 0 <= end - start <= overlap


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
def test_range_maximum_breaks_ties_rightward(values, data):
    index = S.RangeMaximum(np.array(values), 40)
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, min(len(values) - 1, low + 39)))
    best = max(values[low : high + 1])
    assert index.query(low, high) == max(i for i in range(low, high + 1) if values[i] == best)


def test_natural_boundaries():
    text = "a" * 10 + ". Next one\n\nlast words here"
    assert S.cut_points(text, 25, 0, 12)[0][1] == text.index("last")
    assert S.cut_points("x" * 50, 20, 5, 10) == [(0, 20), (15, 35), (30, 50)]
    with pytest.raises(ValueError):
        S.cut_points("x", 10, 10, 10)


def test_table(spark):
    long = "# First part\n\n" + "A sentence of words. " * 250 + "\n\n## Second part\n\n" + "More words follow here. " * 250
    rows = [("a", long, "own", 5), ("a", long, "own", 5), ("b", "x" * 4000, None, 1), ("c", "y" * 4001, "t", 1), ("d", None, None, None), ("e", "", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, section_title string, piece_no int")
    got = S.split_oversized(df).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"a", "c"}
    mine = [r for r in got if r.chunk_id == "a"]
    assert [r.piece_no for r in mine] == list(range(len(mine)))
    assert mine[0].section_title == "First part" and mine[-1].section_title == "Second part"
    assert all(r.char_count == len(r.text) <= 4000 for r in got)
    assert [r.section_title for r in got if r.chunk_id == "c"] == ["t", "t"]
    assert S.split_oversized(df.limit(0)).collect() == []


def test_breaks_before_a_long_run_are_used():
    text = "a" * 6 + ".\n\n" + "x" * 17 + " end of it"
    assert S.cut_points(text, 20, 3, 10)[0] == (0, 9)
    assert any(s <= 9 and e >= 9 + 17 or s == 9 and e >= 26 for s, e in S.cut_points(text, 20, 3, 10))
    wide = "漢" * 12 + "。」" + "字" * 15
    assert S.cut_points(wide, 20, 0, 10) == [(0, 14), (14, 29)]
