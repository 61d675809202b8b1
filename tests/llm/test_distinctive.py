import math
import random
import re

from gristmill.llm import distinctive as D


def times(text, term):
    return len(re.findall(rf"(?<![^\W_])(?={re.escape(term)}(?![^\W_]))", text))


def brute(rows):
    seen = {}
    for key, text, terms in rows:
        seen[key] = ((text or "").lower(), {t.strip().lower() for t in terms or () if t and t.strip()})
    df, cf = {}, {}
    for t in {t for _, terms in seen.values() for t in terms}:
        df[t] = sum(t in terms for _, terms in seen.values())
        cf[t] = sum(times(text, t) for text, terms in seen.values() if t in terms or any(map(str.isalnum, t)))
    mean = sum(len(text.split()) for text, _ in seen.values()) / len(seen)
    out = {}
    for key, (text, terms) in seen.items():
        for t in terms:
            n, rate = D.occurrences(text, t), cf[t] / len(seen)
            tfn = n * math.log2(1 + mean / max(1, len(text.split())))
            out[key, t] = (n, df[t], cf[t], (math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1) if n else 0.0)
    return out


def test_weights_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma-x", "delta", "é1", "risk"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary + ["filler", "alphabet", "(Risk)", "risk_2", "C++", "c++x", "(c)", "one two three four five", "***", "İx"]) for _ in range(rng.randint(0, 30)))
        rows.append((f"c{i}", text if i % 7 else None, [rng.choice([" Alpha", "beta ", "Gamma-X", "risk", "RISK", "", None, "é1", "c++", "(C)", "two three four five", "three four", "***", "never", "i̇x"]) for _ in range(rng.randint(0, 5))] if i % 11 else None, i))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "chunk_id string, text string, keywords array<string>, term int")
    want = brute([r[:3] for r in rows])
    for hot in (D.HOT_ROWS, 5):  # also with every frequent term taking the broadcast way
        got = {(r.chunk_id, r.term): r for r in D.distinctive_terms(df, hot_rows=hot).collect()}
        assert got.keys() == want.keys()
        for k, (tf, n, cf, weight) in want.items():
            assert (got[k].tf, got[k].df, got[k].cf) == (tf, n, cf)
            assert abs(got[k].weight - weight) < 1e-9
    assert D.distinctive_terms(df.limit(0)).collect() == []


def test_rare_shared_terms_count_more(spark):
    rows = [(f"c{i}", "common " * 3 + ("rare " * 3 if i < 2 else ""), ["common", "rare"] if i < 2 else ["common"]) for i in range(50)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, keywords array<string>")
    got = {(r.chunk_id, r.term): r.weight for r in D.distinctive_terms(df).collect()}
    assert got["c0", "rare"] > got["c0", "common"]
    assert {(r.chunk_id, r.term) for r in D.marked_terms(df).collect()} == {("c0", "rare"), ("c1", "rare")}


def test_occurrences():
    assert D.occurrences("risk, risk_a riskier (risk) 2risk risk", "risk") == 4


def test_a_word_of_every_text_is_not_rare_however_few_list_it(spark):
    rows = [(f"c{i}", "plain word " + ("rare " if i < 3 else ""), ["plain", "rare"] if i < 3 else []) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, keywords array<string>")
    got = {(r.chunk_id, r.term): r for r in D.distinctive_terms(df).collect()}
    assert got["c0", "plain"].cf == 60 and got["c0", "plain"].weight < got["c0", "rare"].weight


def test_cases_stay_candidates_and_the_plan_holds_the_weight(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(0, 40))), rng.sample(["aa", "bb", "cc", "dd", "ee"], 3) if i < 6 else []) for i in range(12)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, keywords array<string>")
    marked = D.marked_terms(df)
    want = {k for k, (tf, n, _, _) in brute(rows).items() if tf >= 3 and 2 <= n <= 8}
    assert want and {(r.chunk_id, r.term) for r in marked.collect()} == want
    assert "LOG2" in marked.select("chunk_id", "term")._jdf.queryExecution().optimizedPlan().toString().upper()


def test_long_texts_are_read_in_parts_without_losing_or_repeating_a_term(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "a-b", "(c)", "long term here", "x" * 9]) for _ in range(n)) for n in (0, 3, 40, 300)]
    for size in (7, 50, 1 << 20):
        assert ["".join(p[a:z] for p, (a, z) in zip(*(sum(x, []) for x in zip(*D.pieces([t], 20, size)))) if p) for t in texts] == texts
    rows = [(f"c{i}", t, ["aa", "a-b", "(c)", "long term here", "term"]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, keywords array<string>").coalesce(1)
    want = {r.term: r.cf for r in D.distinctive_terms(df).collect()}
    assert want == {t: sum(times(x, t) for x in texts) for t in want}
    own = D.pieces
    import numpy as np

    shapes = D.term_shapes(spark.createDataFrame([(t,) for t in want], "term string"))
    for size in (16, 100):
        lots = [lot for lot in own([t for t in texts if t], 20, size)]
        assert sum(len(lot[0]) for lot in lots) > len(texts)
        found = 0
        for lot, bounds in lots:
            spans = D.Spans(lot)
            inside = (spans.starts >= (spans.text_begins + np.array(bounds)[:, 0])[spans.text_of]) & (spans.starts < (spans.text_begins + np.array(bounds)[:, 1])[spans.text_of])
            found += int(inside.sum())
        assert found == sum(len(re.findall(r"[^\W_]+", t)) for t in texts)
    assert shapes.count() == len(want)
