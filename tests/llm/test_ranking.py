import math
import random

from gristmill.llm import ranking as R

S = ("semantic_score", "bm25_score", "rerank_score")


def brute(rows):
    groups = {}
    for g, item, *scores in rows:
        groups.setdefault(g, {})[item] = [None if x is None or math.isnan(x) else x for x in scores]
    out, leaders = {}, {}
    for g, items in groups.items():
        ranks = {i: [] for i in items}
        lead = []
        for s in range(3):
            values = [v[s] for v in items.values() if v[s] is not None]
            for i, v in items.items():
                if v[s] is not None:
                    above = sum(x > v[s] for x in values)
                    ties = sum(x == v[s] for x in values)
                    ranks[i].append(((above + 1) + (ties - 1) / 2) / len(values))
        for i, r in ranks.items():
            k = len(r)
            p = [sum(math.comb(k, m) * x**m * (1 - x) ** (k - m) for m in range(j, k + 1)) for j, x in enumerate(sorted(r), 1)]
            out[g, i] = min(1.0, k * min(p)) if p else 1.0
        for i, v in items.items():
            if all(x is not None for x in v) and all(sum(w[s] is not None and w[s] > v[s] for w in items.values()) < 3 for s in range(3)):
                lead.append(i)
        if len(lead) == 1:
            leaders[g] = lead[0]
    return out, leaders


def make(seed, groups=25, size=12):
    rng = random.Random(seed)
    score = lambda scale: rng.choice([None, float("nan"), *[round(rng.random(), 1) * scale] * 8])
    rows = [(g if g else None, f"c{i}", score(1), score(100), score(-5)) for g in range(groups) for i in range(rng.randint(1, size))]
    return rows + rows[:50]


def test_against_brute_force_small_and_hot(spark):
    rows = make(1) + [(99, f"h{i}", float(i % 7), float(i % 11), float(i)) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"search_id int, chunk_id string, {', '.join(f'{s} double' for s in S)}, rho string")
    want, leaders = brute(rows)
    for hot in (R.HOT_ROWS, 100):
        ranked = R.aggregate_rankings(df, hot_rows=hot)
        got = {(r.search_id, r.chunk_id): r.rho for r in ranked.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert {r.search_id: r.chunk_id for r in R.sole_leaders(ranked).collect()} == leaders


def test_null_groups_are_ranked_when_hot(spark):
    own = [(None, f"n{i}", float(i % 7), float(i % 11), None if i % 3 else float(i)) for i in range(300)] + [(None, "top", 50.0, 50.0, 1000.0), (None, "a", 49.0, 49.0, 0.5), (None, "b", 48.0, 48.0, 0.5)]
    hot = [(99, f"h{i}", float(i % 7), float(i % 11), float(i)) for i in range(300)] + [(99, "top", 50.0, 50.0, 1000.0), (99, "a", 49.0, 49.0, 0.5), (99, "b", 48.0, 48.0, 0.5)]
    for rows in (own + make(2), own + hot + make(2)):
        rows = [r for r in rows if r[0] is not None or r in own]
        df = spark.createDataFrame(rows, f"search_id int, chunk_id string, {', '.join(f'{s} double' for s in S)}")
        want, leaders = brute(rows)
        assert leaders[None] == "top"
        ranked = R.aggregate_rankings(df, hot_rows=100)
        got = {(r.search_id, r.chunk_id): r.rho for r in ranked.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert {r.search_id: r.chunk_id for r in R.sole_leaders(ranked).collect()} == leaders


def test_positions_and_scale(spark):
    rows = [(1, f"c{i}", i / 10, 1000.0 * i, -i * 1e6) for i in range(10)]
    df = spark.createDataFrame(rows, f"search_id int, chunk_id string, {', '.join(f'{s} double' for s in S)}")
    got = R.with_positions(R.aggregate_rankings(df)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 11))
    assert R.aggregate_rankings(df.limit(0)).collect() == []


def test_positions_of_hot_groups(spark):
    rows = make(5) + [(99, f"h{i}", float(i % 7), float(i % 11), float(i % 3)) for i in range(700)] + [(None, f"n{i}", 1.0, 1.0, None) for i in range(200)]
    df = spark.createDataFrame(rows, f"search_id int, chunk_id string, {', '.join(f'{s} double' for s in S)}")
    ranked = R.aggregate_rankings(df)
    want = {(r.search_id, r.chunk_id): r.position for r in R.with_positions(ranked).collect()}
    got = {(r.search_id, r.chunk_id): r.position for r in R.with_positions(ranked, hot_rows=100).collect()}
    assert got == want


def test_leaders_pass_the_bound_of_rho_and_the_plan_holds_it(spark):
    df = spark.createDataFrame(make(6, groups=60), f"search_id int, chunk_id string, {', '.join(f'{s} double' for s in S)}")
    leaders = R.sole_leaders(R.aggregate_rankings(df))
    assert {r.search_id: r.chunk_id for r in leaders.collect()} == brute([tuple(r) for r in df.collect()])[1]
    assert "POWER" in leaders._jdf.queryExecution().optimizedPlan().toString().upper()
