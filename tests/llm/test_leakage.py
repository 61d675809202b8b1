import random

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import leakage as L
from gristmill.llm.uniform import uniform_texts


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = L.words(uniform_texts([t or ""])[0])
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(uniform_texts([t or ""])[0])
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "and"] * 6
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(5, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "the " * 30)]
    docs = []
    for d in range(200):
        parts = [text(rng.randint(0, 60))]
        if d % 3 == 0:
            words = (items[rng.randrange(60)][1]).split()
            at = rng.randint(0, max(0, len(words) - 12))
            parts.insert(0, rng.choice([" ", ", ", " — "]).join(words[at : at + rng.randint(10, 14)]).upper())
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "the " * 5000), (0, docs[0][1])]
    want = brute(docs, items, 12)
    assert len(want) > 20
    left = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame([(*r, "kind") for r in items], "item_id long, text string, item_kind string")
    assert {tuple(r) for r in L.leaked_items(left, right).collect()} == want
    assert {tuple(r) for r in L.leaked_items(left, right, most_items=17).collect()} == want  # in several passes
    report = {r.item_id: r.documents for r in L.leak_report(left, right).collect()}
    assert report[60] == 0 and sum(report.values()) == len(want)
    assert L.leaked_items(left.limit(0), right).collect() == [] and L.leaked_items(left, right.limit(0)).collect() == []


def test_form_of_writing_does_not_hide_a_leak(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    hidden = item.replace("o", "о").replace(" ", "\u2009").replace("five", "ｆｉｖｅ").replace("six", "s\u200bix")
    docs = spark.createDataFrame([(1, hidden), (2, item.replace("six", "sixx"))], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [tuple(r) for r in L.leaked_items(docs, items).collect()] == [(1, 9)]


def test_retrieval_finds_every_passage_that_reaches_the_threshold():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)] + ["the", "of"] * 4
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(3, 60))) for i in range(80)] + [(80 + i, "the same first lines of a form that all share with one another " + text(30)) for i in range(40)]
    index = L.ItemIndex(items)
    stored = dict(zip(index.cells.tolist(), index.weights.tolist()))
    total = 0
    for _ in range(3):
        words = L.words(text(60)) + L.words(items[80 + rng.randrange(40)][1]) + L.words(text(20))
        coded = np.array([index.vocabulary.get(w, 0) for w in words], np.int32)
        got = {(int(a), int(b)) for a, b in zip(*index.candidates(coded))}
        place = {int(h): t for t, h in enumerate(index.keys)}
        terms = [place.get(int(h), -1) for h in L.shingle_hashes(coded, index.width)]
        want = {(at, k) for at in range(len(coded) - 11) for k in range(len(index.ids)) if sum(stored.get(t * index.count + k, 0.0) for t in terms[at : at + index.terms] if t >= 0) >= 1}
        assert want <= got
        total += len(want)
        assert all(i in index.leaks([words])[0] for i, t in items if t in " ".join(words) and len(t.split()) >= 12)
    assert total


def test_large_sets_are_cut_by_counted_size(spark):
    items = spark.createDataFrame([(i, "x" * (200_000 if i % 50 == 0 else 10)) for i in range(1500)], "item_id long, text string")
    groups = L._passes(items, "item_id", 400)
    assert len(groups) >= 4 and sorted(b for g in groups for b, _ in g) == sorted({b for g in groups for b, _ in g})
    for g in groups:
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(g[0][1])).isin([b for b, _ in g])).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
        assert part.n <= 400 and part.c <= L.MOST_CHARS


def test_place_in_the_batch_does_not_matter():
    item = [f"w{i}" for i in range(12)]
    index = L.ItemIndex([(4, " ".join(item))])
    for before in (0, 300, 500, 700, 1023):
        assert index.leaks([[]] * before + [item[6:], item, item[:6]])[before:] == [set(), {4}, set()]
