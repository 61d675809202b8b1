import random

import pyarrow as pa
import pytest

from gristmill.operators.packed_values import HARD, MARKS, explode_packed, split_packed

DELIMITERS = {chr(c) for c in HARD}
PARTNER = {chr(a): chr(b) for a, b in MARKS.items()}


def plain(field):
    """The same reading, one character after the other, for fields without square brackets."""
    out, i, n = [], 0, len(field or "")

    def ends(j):
        return field[j] in DELIMITERS or (field[j] in "/+" and (j == 0 or field[j - 1].isspace()) and (j == n - 1 or field[j + 1].isspace()))

    while i <= n and field:
        j = i
        while j < n and field[j].isspace() and field[j] not in DELIMITERS:
            j += 1
        inner, close = "", None
        if j < n and field[j] in PARTNER:
            mark, k = PARTNER[field[j]], j + 1
            while k < n:
                if field[k] == "\\" and field[k + 1 : k + 2] in (mark, "\\"):
                    inner += mark if field[k + 1] == mark else "\\\\"
                    k += 2
                elif field[k] == mark and field[k + 1 : k + 2] == mark:
                    inner += mark
                    k += 2
                elif field[k] == mark:
                    close = k
                    break
                else:
                    inner += field[k]
                    k += 1
        e = i if close is None else close + 1
        while e < n and not ends(e):
            e += 1
        whole = close is not None and not field[close + 1 : e].strip()
        value = (inner if whole else field[i:e]).strip()
        if value:
            out.append(value)
        i = e + 1
    return out


def test_against_plain_reading():
    rng = random.Random(11)
    fields = ["".join(rng.choice("ab\"'“”‘’,; /+\\|\n") for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [None, "", "x" * 100_000 + ",y"]
    assert split_packed(pa.array(fields, pa.string())).to_pylist() == [plain(f) for f in fields]


@pytest.mark.parametrize(
    "field, values",
    [
        ('["a", "b, c"]', ["a", "b, c"]), ("[a; b]", ["a", "b"]), ("[a] ; [b]", ["[a]", "[b]"]), ('"a ""b"" c"; d', ['a "b" c', "d"]), ("'it\\'s', x", ["it's", "x"]), ("“a, b” • c", ["a, b", "c"]), ("R&D, Auditors' Base", ["R&D", "Auditors' Base"]), ("a/b / c + d+e", ["a/b", "c", "d+e"]),
        ("a，b\tc\nd", ["a", "b", "c", "d"]), (",, a ;; a |", ["a", "a"]), ("  ", []), ('"", b', ["b"]), ('"open, b', ['"open', "b"]), ("ünï, 漢字", ["ünï", "漢字"]),
    ],
)
def test_cases(field, values):
    assert split_packed(pa.array([None, field, "z"])).to_pylist() == [[], values, ["z"]]
    assert split_packed(pa.array(["q, r", field, "z"]).slice(1, 1)).to_pylist() == [values]


def test_table(spark):
    rows = [("q1", ("a, b",), 5), ("q1", ("a, b",), 5), ("q2", (None,), 1), ("q3", None, 1), ("q4", ("one",), 1), ("q5", ("x;x",), 1), (None, ("m|n",), 1)]
    df = spark.createDataFrame(rows, "question_id string, metadata struct<framework: string>, pos int")
    got = {tuple(r) for r in explode_packed(df, "metadata.framework", "question_id").collect()}
    assert got == {("q1", 1, "a"), ("q1", 2, "b"), ("q4", 1, "one"), ("q5", 1, "x"), ("q5", 2, "x"), (None, 1, "m"), (None, 2, "n")}
    assert {r.question_id for r in explode_packed(df, "metadata.framework", "question_id", least=2).collect()} == {"q1", "q5", None}
    assert explode_packed(df.limit(0), "metadata.framework", "question_id").collect() == []
