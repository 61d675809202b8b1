"""Problem 8: held-out items that stand in training text, found with a BM25 index of the items and block-max WAND."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import batches
from gristmill.llm.uniform import shared_tables, uniform_texts

RUN = 12  # consecutive words that make a leak
SHINGLE = 5  # words of an index term
K1, B = 1.2, 0.75
BLOCK = 8  # passages of items whose largest weights share one bound
PAIRS = 1_000_000  # of windows and passages that a task looks at at once
MOST_ITEMS, MOST_CHARS = 20_000, 8_000_000  # of one broadcast index; more items are queried in several passes
_WORDS = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits of a text already in its one form, without regard to case."""
    return _WORDS.findall(text.casefold())


def shingle_hashes(coded: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every ``width`` consecutive word numbers."""
    n = len(coded) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out ^ coded[k : k + n].astype(np.uint64)) * _ODD
        out ^= out >> np.uint64(29)
    return out


class ItemIndex:
    """Inverted index of item passages over shingles of five words, with BM25 weights and block maxima, searched by WAND.

    An item is indexed as passages of 2 * run - 1 words that begin every ``run`` words, so each of its runs lies whole in one. The
    weights of a passage are scaled by its least score over its runs, so a run of a text that stands in it scores at least 1: retrieving all
    at 1 and above loses nothing. All lists are arrays; memory is some 100 bytes a word of the items, and looking a window up costs a binary search a
    shingle however many items there are.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run, self.width = run, min(SHINGLE, run)
        self.terms = self.run - self.width + 1  # shingles of a run
        self.vocabulary: dict[str, int] = {}
        self.ids: list = []  # the item of each passage
        parts, lengths = [], []
        number = self.vocabulary.setdefault
        for i, text in items:
            coded = [number(w, len(self.vocabulary) + 1) for w in words(text)]  # 0: no word of an item
            for at in range(0, len(coded) - run + 1, run):
                part = coded[at : at + 2 * run - 1]
                self.ids.append(i)
                parts.append(np.array(part, np.int32))
                lengths.append(len(part))
        n = len(self.ids)
        self.passages = np.full((n, 2 * run - 1), -2, np.int32)
        size = np.array(lengths, np.int64)
        for k, part in enumerate(parts):
            self.passages[k, : len(part)] = part
        if not n:
            return
        # (passage, shingle) occurrences
        hashes = shingle_hashes(self.passages.ravel(), self.width)
        hashes = np.concatenate((hashes, np.zeros(self.width - 1, np.uint64))).reshape(n, -1)
        inside = np.arange(2 * run - 1)[None, :] <= size[:, None] - self.width
        owner = np.repeat(np.arange(n), inside.sum(axis=1))
        self.keys, term = np.unique(hashes[inside], return_inverse=True)
        cells, place, tf = np.unique(term.astype(np.int64) * n + owner, return_inverse=True, return_counts=True)
        posted, passage = cells // n, cells % n
        df = np.bincount(posted, minlength=len(self.keys))
        many = size - self.width + 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[posted] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * many[passage] / many.mean()))
        # the scale of a passage: its least score over its runs, repeated shingles counting once
        grid = np.full(inside.shape, -1, np.int64)
        grid[inside] = place
        scale = np.full(n, np.inf)
        for at in range(run):
            whole = at + run <= size
            window = np.sort(grid[whole, at : at + self.terms], axis=1)
            first = np.ones(window.shape, bool)
            first[:, 1:] = window[:, 1:] != window[:, :-1]
            scale[whole] = np.minimum(scale[whole], np.where(first, weight[window], 0.0).sum(axis=1))
        self.cells, self.weights = cells, weight / scale[passage]
        self.count, self.blocks = n, -(-n // BLOCK)
        self.starts = np.searchsorted(posted, np.arange(len(self.keys) + 1))
        self.members = passage.astype(np.int32)
        self.bounds = np.maximum.reduceat(self.weights, self.starts[:-1])
        self.block_keys, at = np.unique(posted * self.blocks + passage // BLOCK, return_inverse=True)
        self.block_max = np.zeros(len(self.block_keys))
        np.maximum.at(self.block_max, at, self.weights)

    def _sums(self, keys: np.ndarray, values: np.ndarray, terms: np.ndarray, stride: int, column: np.ndarray) -> np.ndarray:
        """For each row of terms, the sum of the values stored under (term, column)."""
        out = np.zeros(len(terms))
        for k in range(terms.shape[1]):
            wanted = terms[:, k] * stride + column
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out += np.where(keys[place] == wanted, values[place], 0.0)
        return out

    def candidates(self, coded: np.ndarray, slack: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        """(starts, passages): runs of words and the passages against which their score reaches 1.

        ``coded`` holds word numbers, 0 for words of no item, -1 between texts. A window is dropped when its terms' upper bounds do not
        reach 1. Of the others, the terms with the longest lists whose bounds together stay under 1 need not be read: a passage that reaches 1
        has one of the rest, the pivots. Passages from the pivots' lists are bounded by their block's maxima, then scored.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(coded) < self.run or not self.ids:
            return none
        known = coded > 0
        run_of = np.concatenate(([0], np.cumsum(known)))
        whole = np.nonzero(run_of[self.width :] - run_of[: -self.width] == self.width)[0]
        if not len(whole):
            return none
        hashes = shingle_hashes(coded, self.width)[whole]
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[place] == hashes
        term = np.full(len(coded) - self.width + 1, -1, np.int64)
        term[whole[hit]] = place[hit]
        bound = np.where(term >= 0, self.bounds[np.maximum(term, 0)], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(bound)))
        between = np.concatenate(([0], np.cumsum(coded < 0)))
        live = (sums[self.terms :] - sums[: -self.terms] >= 1 - slack) & (between[self.run :] == between[: -self.run])
        starts = np.nonzero(live)[0]
        if not len(starts):
            return none
        window = term[starts[:, None] + np.arange(self.terms)]
        lists = np.where(window >= 0, self.starts[window + 1] - self.starts[window], 0)
        upper = np.where(window >= 0, self.bounds[np.maximum(window, 0)], 0.0)
        order = np.argsort(lists, axis=1, kind="stable")
        rest = np.cumsum(np.take_along_axis(upper, order, 1)[:, ::-1], axis=1)[:, ::-1]  # of this term and all with longer lists
        pivot = (rest >= 1 - slack) & (np.take_along_axis(lists, order, 1) > 0)
        row, column = np.nonzero(pivot)
        pivots = np.take_along_axis(window, order, 1)[row, column]
        length = self.starts[pivots + 1] - self.starts[pivots]
        out_rows, out_passages = [], []
        edges = np.searchsorted(np.cumsum(length), np.arange(0, length.sum(), PAIRS), side="left")
        for a, z in zip(edges, [*edges[1:], len(pivots)]):
            if a == z:
                continue
            some = length[a:z]
            spans = np.repeat(self.starts[pivots[a:z]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            pairs = np.unique(np.repeat(row[a:z], some).astype(np.int64) * self.count + self.members[spans])
            r, p = pairs // self.count, pairs % self.count
            good = self._sums(self.block_keys, self.block_max, window[r], self.blocks, p // BLOCK) >= 1 - slack
            r, p = r[good], p[good]
            good = self._sums(self.cells, self.weights, window[r], self.count, p) >= 1 - slack
            out_rows.append(r[good])
            out_passages.append(p[good])
        if not out_rows:
            return none
        return starts[np.concatenate(out_rows)], np.concatenate(out_passages)

    def leaks(self, texts: list[list[str]]) -> list[set]:
        """Of each text's words, the items it shares a run with: candidates by score, then word-for-word verification."""
        found: list[set] = [set() for _ in texts]
        if not texts or not self.ids:
            return found
        get = self.vocabulary.get
        coded = np.full(sum(map(len, texts)) + len(texts), -1, np.int32)
        begins = np.cumsum([0, *(len(w) + 1 for w in texts)])
        for w, at in zip(texts, begins):
            coded[at : at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
        starts, passages = self.candidates(coded)
        for at in range(0, len(starts), PAIRS // self.run):
            s, p = starts[at : at + PAIRS // self.run], passages[at : at + PAIRS // self.run]
            run, stored = coded[s[:, None] + np.arange(self.run)], self.passages[p]
            same = np.zeros(len(s), bool)
            for offset in range(self.run):
                same |= (stored[:, offset : offset + self.run] == run).all(axis=1)
            text = np.searchsorted(begins, s[same], side="right") - 1
            for t, k in set(zip(text.tolist(), p[same].tolist())):
                found[t].add(self.ids[k])
        return found


def _passes(items: DataFrame, item_key: str, most_items: int) -> list[list[int]]:
    """Hash buckets of items, grouped so that no group exceeds the bounds of one index; a single item always fits one."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    least = max(1, -(-total.n // most_items), -(-total.chars // MOST_CHARS))
    if least == 1:
        return [[(0, 1)]]
    buckets = 16 * least  # a few numbers a bucket reach the driver
    sizes = items.groupBy(F.pmod(F.xxhash64(item_key), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).orderBy("b").collect()
    groups, n, chars = [], most_items + 1, 0
    for r in sizes:
        if n + r.n > most_items or chars + r.chars > MOST_CHARS:
            groups.append([])
            n = chars = 0
        groups[-1].append((r.b, buckets))
        n, chars = n + r.n, chars + r.chars
    return groups


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", run: int = RUN, most_items: int = MOST_ITEMS) -> DataFrame:
    """(key, item_key) of every document that holds ``run`` consecutive words of an item; each pair once.

    The items are the query set: they are counted first, and beyond ``most_items`` or MOST_CHARS the corpus is read once for
    every group of hash buckets within those bounds, so a broadcast index is bounded. Items shorter than ``run`` words, null and empty texts give no rows.
    """
    spark = docs.sparkSession
    forms = shared_tables(docs)
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    result = None
    groups = _passes(items, item_key, most_items)
    for group in groups:
        block = items if len(groups) == 1 else items.filter(F.pmod(F.xxhash64(item_key), F.lit(group[0][1])).isin([b for b, _ in group]))
        rows = [(r[0], r[1] or "") for r in block.select(item_key, "text").collect()]
        index = spark.sparkContext.broadcast(ItemIndex(list(zip([r[0] for r in rows], uniform_texts([r[1] for r in rows]))), run))

        def work(stream: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches(stream):
                keys, texts = (c.to_pylist() for c in batch.columns)
                coded = [words(t) if t else [] for t in uniform_texts(texts, forms.value)]
                pairs = [(k, i) for k, found in zip(keys, index.value.leaks(coded)) for i in sorted(found)]
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b)], names=["k", "i"])

        one = docs.select(F.col(key).alias("_k"), F.col("text").alias("_t")).mapInArrow(work, f"k {kinds[0]}, i {kinds[1]}")
        result = one if result is None else result.unionByName(one)
    return result.select(F.col("k").alias(key), F.col("i").alias(item_key)).distinct()


def leak_report(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per item: its kind and the number of documents it leaked into, 0 included."""
    counts = leaked_items(docs, items, key, item_key).groupBy(item_key).agg(F.count(F.lit(1)).alias("documents"))
    return items.select(item_key, "item_kind").join(counts, item_key, "left").fillna(0, ["documents"])
