import random
from collections import defaultdict

from gristmill.llm import repeated_lines as R


def brute(rows):
    docs, seen = defaultdict(set), defaultdict(set)
    key = lambda line: "".join(filter(str.isalpha, line)).casefold()
    for _, fw, doc, text in rows:
        if fw is not None and doc is not None:
            docs[fw].add(doc)
            for line in (text or "").split("\n"):
                if len(key(line)) >= 20:
                    seen[fw, key(line)].add(doc)
    hot = {k for k, v in seen.items() if len(v) >= 4 and len(v) >= 0.05 * len(docs[k[0]])}
    return {(c, no) for c, fw, _, text in rows for no, line in enumerate((text or "").split("\n")) if (fw, key(line)) in hot}


def rows_of(seed, n=300):
    rng = random.Random(seed)
    lines = ["Printed from the shared library {}", "— THIS copy is for training use only {} —", "ünder the same roof of the grand hall", "short line", "1234567890 1234567890 12345"]
    out = []
    for i in range(n):
        text = "\n".join(rng.choice([rng.choice(lines).format(i), f"A line of its own that nobody repeats {rng.random()}" + "x" * (i % 9), rng.choice(lines).upper().format("(*)")]) for _ in range(rng.randint(0, 6)))
        out.append((f"c{i}", rng.choice(["a", "a", "b", "c", None]), rng.choice([f"d{rng.randint(0, 60)}", None]) if i % 9 == 0 else f"d{rng.randint(0, 60)}", text if i % 17 else None))
    return out + out[:40]


def test_against_brute_force(spark):
    rows = rows_of(3)
    df = spark.createDataFrame([(*r, 7) for r in rows], "chunk_id string, framework_name string, document string, text string, source int").repartition(5)
    want = brute(rows)
    assert want
    assert {tuple(r) for r in R.repeated_lines(df).collect()} == want
    assert {tuple(r) for r in R.repeated_lines(df, most_broadcast=0).collect()} == want  # the shuffle way


def test_rest_of_the_text_stays(spark):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "chunk_id string, framework_name string, document string, text string")
    places = defaultdict(set)
    for key, no in brute(rows):
        places[key].add(no)
    want = {k: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in places[k]) if t is not None else None, len(places[k])) for k, _, _, t in rows}
    for limit in (R.MOST_BROADCAST, 0):
        got = {r.chunk_id: (r.text, r.removed) for r in R.without_repeated_lines(df, most_broadcast=limit).collect()}
        assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "chunk_id string, framework_name string, document string, text string")
    assert R.repeated_lines(df).collect() == [] and R.without_repeated_lines(df).collect() == []
