"""The queries that SQL cannot express, compared with plain Python over whole tables."""

import base64

import numpy as np
import pytest

from gristmill.llm import defects, markup, mixing, queries, splitting


@pytest.fixture(scope="module")
def rows(spark, small):
    return lambda name, *columns: spark.read.parquet(f"{small}/{name}.parquet").select(*columns).distinct().collect()


def test_p1(spark, small, rows):
    want = {r.response_id: kind for r in rows("eval_results", "response_id", "question", "model_response") if (kind := defects.defect(r.question, r.model_response))}
    assert {r.response_id: r.defect for r in queries.p1_found(spark, small).collect()} == want
    assert set(want.values()) == {"empty", "refusal", "copied", "truncated", "other_language"}


def test_p2(spark, small, rows):
    texts = {r.chunk_id: r.text for r in rows("chunks", "chunk_id", "text") if r.text is not None and len(r.text) > 4000}
    pieces = {}
    for r in queries.p2_pieces(spark, small).orderBy("chunk_id", "piece_no").collect():
        pieces.setdefault(r.chunk_id, []).append(r)
    assert set(pieces) == set(texts)
    for key, parts in pieces.items():
        text = texts[key]
        strengths = splitting.boundary_strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert [p.piece_no for p in parts] == list(range(len(parts))) and parts[0].start_pos == 0
        for p, after in zip(parts, [*parts[1:], None]):
            end = p.start_pos + p.char_count
            assert p.text == text[p.start_pos : end] and p.char_count == len(p.text) <= 4000
            if after is None:
                assert end == len(text)
                continue
            assert 0 <= end - after.start_pos <= 200
            window = strengths[p.start_pos + 2000 : p.start_pos + 4001]
            if window.any():  # the strongest boundary, the last of equals
                assert end == p.start_pos + 2000 + len(window) - 1 - int(np.argmax(window[::-1]))


def test_p5(spark, small, rows):
    want = {(r.chunk_id, kind) for r in rows("chunks", "chunk_id", "text") if r.text for kind in markup.clean_markup(r.text)[0]}
    assert {tuple(r) for r in queries.p5_found(spark, small).collect()} == want
    for r in queries.p5_cleaned(spark, small).collect():
        found = markup.Parser(r.text)
        markup.score_tree(found.root)
        assert not found.root.kinds, (r.chunk_id, found.root.kinds)


def test_p9(spark, small, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(mixing.VOCABULARY, "rb") if line.strip())}
    encoding = tiktoken.Encoding("x", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    label = lambda s: s.strip().lower().replace("-", "_") if s is not None else None
    sizes, have = {}, {}
    for r in rows("documents", "doc_id", "source", "text"):
        sizes[r.doc_id] = (label(r.source), len(encoding.encode_ordinary(r.text)) if r.text else 0)
    for source, n in sizes.values():
        have[source] = have.get(source, 0) + n
    targets = {label(r.source): r for r in rows("mix_targets", "source", "target_share", "max_repeats")}
    total = sum(have.get(s, 0) for s in targets)
    taken, largest = dict.fromkeys(targets, 0), {s: max((n for x, n in sizes.values() if x == s), default=0) for s in targets}
    for r in queries.p9_mix(spark, small).collect():
        assert (r.source, r.tokens) == sizes[r.doc_id] and 1 <= r.copies <= targets[r.source].max_repeats
        taken[r.source] += r.tokens * r.copies
    shares = {r.source: r for r in queries.p9_shares(spark, small).collect()}
    assert set(shares) == set(targets)
    for s, t in targets.items():
        goal = min(int(t.target_share * total), t.max_repeats * have.get(s, 0))
        assert abs(taken[s] - goal) <= largest[s] and shares[s].taken == taken[s]
        assert abs(shares[s].reached_share - taken[s] / sum(taken.values())) < 1e-6
        assert shares[s].out_of_reach == (int(t.target_share * total) > t.max_repeats * have.get(s, 0))
