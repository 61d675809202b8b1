"""Problem 3: how much a term marks out its record, by divergence from randomness."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import batches, map_rows
from gristmill.operators.skew import split_join
from gristmill.session import cut_lineage, one_per_key

HOT_ROWS = 200_000
FILTER_BITS = 26  # of the broadcast filter of term hashes: 8 MB, however many terms there are
PIECE = 1 << 20  # characters whose spans are held at once
PREFIX = 3  # runs of letters and digits by which a longer term is looked for first
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd multipliers of the two hashes


def occurrences(lowered: str, term: str) -> int:
    """Times ``term`` stands in the text with neither a letter nor a digit directly before or after it."""
    count, at, n, width = 0, lowered.find(term), len(lowered), len(term)
    while at >= 0:
        end = at + width
        if (at == 0 or not lowered[at - 1].isalnum()) and (end == n or not lowered[end].isalnum()):
            count += 1
            at = lowered.find(term, end)
        else:
            at = lowered.find(term, at + 1)
    return count


def term_frequencies(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per record and distinct keyword: key, term, tf (occurrences in the text), length (words of the text); and one a record with a null term.

    Terms are keywords trimmed and in lower case, blank and null ones dropped; any case counts as an occurrence. Null or empty
    texts give tf 0. Rows loaded twice give their terms once, rows without a key count as
    one record. Only the key and the counts are shuffled, never a text.
    """
    rows = df.select(F.col(key).alias("_key"), F.col("text").alias("_text"), F.col("keywords").alias("_terms"))
    kinds = pa.schema([("k", pa.string()), ("term", pa.string()), ("tf", pa.int32()), ("length", pa.int32())])

    def work(k, text, terms):
        lowered = (text or "").lower()
        length = len(lowered.split())
        yield k, None, 0, length
        for term in {t.strip().lower() for t in terms or () if t}:
            if term:
                yield k, term, occurrences(lowered, term), length

    counted = map_rows(rows, "k string, term string, tf int, length int", kinds, work)
    # both counts are functions of the key and the term, so max keeps the aggregation on fixed-width buffers
    return counted.groupBy(F.col("k").alias(key), "term").agg(F.max("tf").alias("tf"), F.max("length").alias("length"))


# ---- occurrences in all texts


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Spans:
    """Runs of letters and digits of several texts laid end to end, and hashes of any span of characters in constant time."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("\n\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        self.text_ends = np.cumsum(lengths)
        self.text_begins = np.concatenate(([2], self.text_ends[:-1] + 2)).astype(np.int64)
        self.inside = _alnum()[self.points]
        edge = np.diff(self.inside.astype(np.int8))
        self.starts, self.ends = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
        self.text_of = np.searchsorted(self.text_ends, self.starts, side="right")
        n = len(self.points)
        self.sums, self.inverse = [], []
        with np.errstate(over="ignore"):
            for base in BASES:
                powers = np.cumprod(np.full(n, base, np.uint64))
                self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * powers))))
                self.inverse.append(np.cumprod(np.full(n, pow(int(base), -1, 1 << 64), np.uint64)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """The same for the same characters, wherever they stand."""
        with np.errstate(over="ignore"):
            value = (self.sums[which][ends] - self.sums[which][starts]) * self.inverse[which][starts]
            value ^= value >> np.uint64(31)
            value *= BASES[1 - which]
            return value ^ (value >> np.uint64(29))


def pieces(texts: Iterable[str], longest: int, size: int | None = None) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """Texts, and where in each a term may begin, in lots of at most about ``size`` characters. A longer text comes in parts that share enough for any term and one character on both sides."""
    size = size or PIECE
    lot: list[str] = []
    own: list[tuple[int, int]] = []
    held = 0
    for text in texts:
        for at in range(0, max(1, len(text)), size):
            before = min(1, at)
            part = text[at - before : at + size + longest + 1]
            lot.append(part)
            own.append((before, before + min(size, len(text) - at)))
            held += len(part)
            if held >= size:
                yield lot, own
                lot, own, held = [], [], 0
    if lot:
        yield lot, own


def term_shapes(terms: DataFrame) -> DataFrame:
    """(term, a, b, lead, runs, trail, prefix) of terms with a letter or digit: two hashes of the term, its characters before the first and after the last, its runs of them, and the hash of its first ``PREFIX`` runs."""
    kinds = pa.schema([("term", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("lead", pa.int32()), ("runs", pa.int32()), ("trail", pa.int32()), ("prefix", pa.int64())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            names = [t for t in batch.column(0).to_pylist() if any(map(str.isalnum, t))]
            if not names:
                continue
            spans = Spans(names)
            begins, ends = spans.text_begins, spans.text_ends
            first = np.searchsorted(spans.text_of, np.arange(len(names)))
            runs = np.bincount(spans.text_of, minlength=len(names))
            prefix_end = spans.ends[first + np.minimum(runs, PREFIX) - 1]
            columns = [spans.hashes(begins, ends, w).view(np.int64) for w in (0, 1)]
            lead, trail = spans.starts[first] - begins, ends - spans.ends[first + runs - 1]
            prefix = spans.hashes(spans.starts[first], prefix_end, 0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((names, *columns, lead, runs, trail, prefix), kinds.types)], schema=kinds)

    return terms.select("term").mapInArrow(run, "term string, a long, b long, lead int, runs int, trail int, prefix long")


def collection_frequencies(df: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(a, b, cf): occurrences of every term in all texts, by its hashes; records loaded twice count once.

    A task meets a filter of the hashes of all terms, of fixed size, and hands on counts of the spans of its texts that pass it; what passes without being
    a term falls away in the join by both hashes. Spans that could be a term of many runs are looked at only where its first ones pass. So the
    work is linear in the texts, and no list of terms is sent to anyone, however long it grows.
    """
    spark = df.sparkSession
    longest = shapes.agg(F.max(F.length("term"))).first()[0] or 0
    kinds = [tuple(r) for r in shapes.select("lead", "runs", "trail").distinct().collect()]  # shapes of keywords, not keywords
    places = shapes.select(F.explode(F.array("a", "prefix")).alias("h")).select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("p"))
    bits = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) as int)))").alias("bits")).collect()  # at most 2 ** (FILTER_BITS - 6) words
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    filled[[r.word for r in bits]] = [r.bits for r in bits]
    shared = spark.sparkContext.broadcast((filled.tobytes(), sorted(kinds)))
    out_kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cf", pa.int64())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_words, shapes_of = np.frombuffer(shared.value[0], np.uint64), shared.value[1]

        def passes(hashes: np.ndarray) -> np.ndarray:
            place = hashes >> np.uint64(64 - FILTER_BITS)
            return (filter_words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def counted(spans: Spans, own: np.ndarray):
            n = len(spans.starts)
            low, high = (spans.text_begins + own[:, 0])[spans.text_of], (spans.text_begins + own[:, 1])[spans.text_of]
            hopeful = {}
            for runs in range(1, PREFIX + 1):
                at = np.arange(max(0, n - runs + 1))
                at = at[spans.text_of[at] == spans.text_of[at + runs - 1]]
                hopeful[runs] = at[passes(spans.hashes(spans.starts[at], spans.ends[at + runs - 1], 0))]
            for lead, runs, trail in shapes_of:
                at = hopeful[min(runs, PREFIX)]
                at = at[at + runs <= n]
                at = at[spans.text_of[at] == spans.text_of[at + runs - 1]]
                begin, end = spans.starts[at] - lead, spans.ends[at + runs - 1] + trail
                fits = (begin >= low[at]) & (begin < high[at]) & (end <= spans.text_ends[spans.text_of[at]])
                begin, end = begin[fits], end[fits]
                if lead or trail:
                    ok = ~spans.inside[begin - 1] & ~spans.inside[end]
                    begin, end = begin[ok], end[ok]
                a = spans.hashes(begin, end, 0)
                ok = passes(a)
                if ok.any():
                    yield a[ok].view(np.int64), spans.hashes(begin[ok], end[ok], 1).view(np.int64), np.ones(int(ok.sum()), np.int64)

        def merged():
            a, b, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            first = np.nonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[0]
            return a[first], b[first], np.add.reduceat(n, first)

        for batch in batches(stream):
            for texts, own in pieces((t.lower() for t in batch.column(0).to_pylist() if t), longest):
                held.extend(counted(Spans(texts), np.array(own)))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held[0], out_kinds.types)], schema=out_kinds)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(merged(), out_kinds.types)], schema=out_kinds)

    return one_per_key(df.select(key, "text"), key).select("text").mapInArrow(run, "a long, b long, cf long").groupBy("a", "b").agg(F.sum("cf").alias("cf"))


def _weight(tf: Column, mean: Column, length: Column, rate: Column, c: float) -> Column:
    tfn = tf * F.log2(1 + c * mean / F.greatest(length, F.lit(1)))
    return (F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)) / (tfn + 1)


def distinctive_terms(df: DataFrame, key: str = "chunk_id", c: float = 1.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Weight of every keyword of every record: key, term, tf, length, df, cf, records, mean_length, weight.

    With lambda = cf / N (cf the term's occurrences over all texts, also of records that do not list it, N the number of records) and
    tfn = tf * log2(1 + c * mean length / length), the weight is the information content of tfn under a geometric
    distribution, log2(1 + lambda) + tfn * log2((1 + lambda) / lambda), times Laplace's gain 1 / (tfn + 1). A keyword
    that does not occur in the text has tf 0 and weight 0. A keyword without any letter or digit is counted in the records that list it. An empty table
    gives no rows.
    """
    terms = cut_lineage(term_frequencies(df, key))
    listed = terms.filter("term is not null")
    own = cut_lineage(listed.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_listed")))
    shapes = cut_lineage(term_shapes(own))
    found = shapes.join(collection_frequencies(df, shapes, key), ["a", "b"]).select("term", "cf")
    stats = cut_lineage(own.join(found, "term", "left").select("term", "df", F.coalesce("cf", "_listed").alias("cf")))
    joined = split_join(listed, stats, ["term"], own.select("term", F.col("df").alias("n")), hot_rows)
    whole = terms.filter("term is null").agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).alias("x")).scalar()
    joined = joined.withColumn("_whole", whole).withColumn("records", F.col("_whole.n")).withColumn("mean_length", F.col("_whole.mean")).drop("_whole")
    weight = _weight(F.col("tf"), F.col("mean_length"), F.col("length"), F.col("cf") / F.col("records"), c)
    return joined.withColumn("weight", F.when(F.col("tf") > 0, weight).otherwise(F.lit(0.0)))


def marked_terms(df: DataFrame, key: str = "chunk_id", least_tf: int = 3, df_range: tuple[int, int] = (2, 8), c: float = 1.0) -> DataFrame:
    """The terms that are shared by few records and stand often in this one's text.

    Candidates are taken by weight. With lambda under 1 the weight rises with tf, so a term that stands ``least_tf`` times or more weighs at least as
    much as one that stands that often; from 1 on it falls towards log2((1 + lambda) / lambda) and never below. What passes is counted exactly.
    """
    low, high = df_range
    rate = F.col("cf") / F.col("records")
    floor = F.when(rate < 1, _weight(F.lit(least_tf), F.col("mean_length"), F.col("length"), rate, c)).otherwise(F.log2((1 + rate) / rate))
    likely = distinctive_terms(df, key, c).filter(F.col("weight") >= floor - 1e-9)
    return likely.filter(F.col("df").between(low, high) & (F.col("tf") >= least_tf))
