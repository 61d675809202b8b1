import random
import re

from pyspark.sql import functions as F

from gristmill.operators import chunking as K


def wanted_cut(text, target):
    low, high = max(0, target - 100), min(len(text), target + 100)
    window = text[low:high]
    gaps = [low + m.start() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z])", window)]
    if gaps:
        return min(gaps, key=lambda g: abs(g - target))
    if m := re.search(r"\n\s*\n", window):
        return low + m.start()
    return next((i for i in range(target, min(target + 50, len(text))) if text[i].isspace()), target)


def test_cuts_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "Word", ". ", ".  ", "! ", "\n\n", "\n \n", "x" * rng.randint(1, 90), "É"]) for _ in range(rng.randint(1, 60)))
        finder = K.CutFinder(text)
        for target in range(0, len(text), 7):
            assert finder.near(target) == wanted_cut(text, target), (text, target)


def test_pieces():
    assert K.chunk_texts("") == [""] and K.chunk_texts("x" * 4000) == ["x" * 4000]
    long = K.chunk_texts("x" * 20_000)
    assert [len(p) for p in long] == [4000] * 5 + [1000] and all(len(p) <= 4100 for p in K.chunk_texts("Some words. And more " * 2000))
    assert K.chunk_texts(" " * 9000) == []


def test_table(spark):
    rows = [("fw", 1, "# A\n\n\n\nB shall  comply"), ("fw", 2, None), ("fw", 3, ""), (None, 4, "text"), ("fw", 5, "Sentence one is here. " * 1000), ("fw", 6, "é" * 7000)]
    df = spark.createDataFrame(rows, "framework string, doc_id int, text string")
    got = K.chunk_documents(df, "framework", "doc_id").collect()
    by = {(r.document, r.position): r for r in got}
    first = by["1", 0]
    assert first.chunk_id == "fw_1_0" and first.text == "# A\n\nB shall comply" and first.has_headers and first.section_title == "A" and first.keywords == ["comply", "shall"]
    assert by["3", 0].char_count == 0 and ("2", 0) not in by and max(p for d, p in by if d == "5") >= 5
    assert K.chunk_documents(df, "framework", "doc_id", most_bytes=7000).filter(F.col("document") == "6").count() == 1
    assert K.chunk_documents(df.limit(0), "framework", "doc_id").collect() == []
    stats = K.size_statistics(df, [], "text").first()
    assert stats.chunks == 5 and stats.large == 2 and stats.oversized == 2
