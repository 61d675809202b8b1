"""Problem 4: several values packed in one field, split on Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the delimiters, the quotation marks and their partners
HARD = [ord(c) for c in ",，;；|｜•‣◦▪●\t\n\r\v\f\x1c\x1d\x1e\x85  "]
SOFT = [ord(c) for c in "/+"]
MARKS = {ord('"'): ord('"'), ord("'"): ord("'"), ord("“"): ord("”"), ord("‘"): ord("’")}
WHITE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BACKSLASH, OPEN, CLOSE = ord("\\"), ord("["), ord("]")


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values in a row, and the offsets of the values among them; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    text = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().decode() if data is not None and len(column) else ""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.concatenate(([0], np.cumsum(lengths)))


def _member(points: np.ndarray, values: list[int]) -> np.ndarray:
    return np.isin(points, np.array(values, dtype=np.uint32))


def _last_before(flags: np.ndarray) -> np.ndarray:
    """Index of the last flagged position strictly before each position, -1 where there is none."""
    at = np.where(flags, np.arange(len(flags)), -1)
    return np.concatenate(([-1], np.maximum.accumulate(at)[:-1])) if len(at) else at


class _Marks:
    """Closing positions of one quotation mark: the last of every run of odd length, doubled and escaped marks being text."""

    def __init__(self, points: np.ndarray, escaped: np.ndarray, row: np.ndarray, mark: int):
        at = np.nonzero((points == mark) & ~escaped)[0]
        breaks = np.nonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0))[0] + 1 if len(at) else np.array([], dtype=np.int64)
        first, last = np.concatenate(([0], breaks)).astype(np.int64), np.concatenate((breaks, [len(at)])).astype(np.int64) - 1
        if not len(at):
            first = last = np.array([], dtype=np.int64)
        self.starts, self.ends = at[first], at[last]
        odd = (self.ends - self.starts) % 2 == 0
        self.closers = self.ends[odd]

    def own_close(self, opener: np.ndarray) -> np.ndarray:
        """Where the run that begins with the opener itself closes it, else -1."""
        run = np.searchsorted(self.starts, opener, side="right") - 1
        even = (self.ends[run] - self.starts[run]) % 2 == 1
        return np.where(even & (self.starts[run] == opener), self.ends[run], -1)

    def next_close(self, after: np.ndarray, own_run: bool) -> np.ndarray:
        """The first closing mark past ``after`` and, for marks that open and close alike, past the run it begins."""
        if own_run:
            after = self.ends[np.searchsorted(self.starts, after, side="right") - 1]
        at = np.searchsorted(self.closers, after, side="right")
        return np.where(at < len(self.closers), np.append(self.closers, -1)[np.minimum(at, len(self.closers))], -1)


def _quoted(points: np.ndarray, row: np.ndarray, offsets: np.ndarray, candidate: np.ndarray, escaped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Openers and closers of the quoted values, found for all rows at once, one value of each row a round."""
    marks = {m: _Marks(points, escaped, row, partner) for m, partner in MARKS.items()}
    openers, closers = [], []
    at = np.nonzero(candidate)[0]
    rows = np.unique(row[at])
    here = offsets[rows]
    while len(rows):
        index = np.searchsorted(at, here)
        live = (index < len(at)) & (np.append(at, -1)[np.minimum(index, len(at))] < offsets[rows + 1]) & (np.append(at, -1)[np.minimum(index, len(at))] >= 0)
        rows, index = rows[live], index[live]
        if not len(rows):
            break
        start = at[index]
        close = np.full(len(start), -1, dtype=np.int64)
        for m, partner in MARKS.items():
            mine = np.nonzero(points[start] == m)[0]
            if len(mine):
                s = start[mine]
                found = marks[m].next_close(s, m == partner)
                if m == partner:
                    own = marks[m].own_close(s)
                    found = np.where(own >= 0, own, found)
                close[mine] = found
        good = (close > start) & (close < offsets[rows + 1])
        openers.append(start[good])
        closers.append(close[good])
        here = np.where(good, close, start) + 1
    if not openers:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    o, c = np.concatenate(openers), np.concatenate(closers)
    order = np.argsort(o)
    return o[order], c[order]


def split_packed(column: pa.Array) -> pa.ListArray:
    """The values packed in each string, in order: quote parity and delimiter masks over the whole buffer, then child offsets.

    A value that starts with a quotation mark runs to the matching mark; without one the mark is text. Null, blank and
    delimiter-only strings give empty lists.
    """
    points, offsets = _code_points(column)
    n, count = len(points), len(column)
    row = np.repeat(np.arange(count), np.diff(offsets))
    white = _member(points, WHITE)
    hard = _member(points, HARD)
    lo, hi = offsets[row], offsets[row + 1] - 1
    at = np.arange(n)
    blank_before = np.where(at > lo, white[np.maximum(at - 1, 0)] if n else white, True)
    blank_after = np.where(at < hi, white[np.minimum(at + 1, max(n - 1, 0))] if n else white, True)
    delimiter = hard | (_member(points, SOFT) & blank_before & blank_after)

    # square brackets around the whole field
    solid = ~white
    first, last = np.full(count, -1, dtype=np.int64), np.full(count, -1, dtype=np.int64)
    where = np.nonzero(solid)[0]
    first[row[where][::-1]] = where[::-1]
    last[row[where]] = where
    around = np.nonzero((first >= 0) & (last > first))[0]
    around = around[(points[first[around]] == OPEN) & (points[last[around]] == CLOSE)]
    bracket = np.zeros(n, dtype=bool)
    bracket[first[around]] = bracket[last[around]] = True

    def quotes(delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = _last_before(delimiter | solid)
        fresh = (before < lo) | (delimiter[np.maximum(before, 0)] if n else delimiter)
        backslash = points == BACKSLASH
        run = at - np.maximum(_last_before(~backslash), lo - 1) - 1  # backslashes directly before
        escaped = run % 2 == 1
        o, c = _quoted(points, row, offsets, _member(points, list(MARKS)) & fresh, escaped)
        inside = np.zeros(n + 1, dtype=np.int32)
        inside[o] += 1
        inside[c + 1] -= 1
        return o, c, np.cumsum(inside[:n]).astype(bool)

    o, c, inside = quotes(delimiter | bracket)
    # brackets that close before the end are not around the whole field
    step = np.where(inside, 0, (points == OPEN).astype(np.int32) - (points == CLOSE).astype(np.int32))
    depth = np.cumsum(step) if n else step
    early = np.zeros(count, dtype=bool)
    if len(around):
        base = np.where(offsets[:-1] > 0, np.append(depth, 0)[np.maximum(offsets[:-1] - 1, 0)], 0) if n else np.zeros(count)
        level = depth - base[row]
        early[row[(level <= 0) & (at >= np.maximum(first[row], 0)) & (at < last[row]) & np.isin(row, around)]] = True
        if early.any():
            bracket &= ~early[row]
            o, c, inside = quotes(delimiter | bracket)
    delimiter = (delimiter | bracket) & ~inside

    # values lie between delimiters and row ends, trimmed of white space
    body = ~delimiter & (~white | inside)
    body[o] = body[c] = True
    segment = np.cumsum(delimiter) + row  # changes at every delimiter and at every row
    where = np.nonzero(body)[0]
    if not len(where):
        return pa.ListArray.from_arrays(pa.array(np.zeros(count + 1, dtype=np.int32)), pa.array([], pa.string()))
    starts = where[np.concatenate(([True], segment[where][1:] != segment[where][:-1]))]
    ends = where[np.concatenate((segment[where][1:] != segment[where][:-1], [True]))] + 1

    # outer marks go if they enclose the whole value, and of a doubled or escaped inner mark one stays
    close_of = np.full(n + 1, -1, dtype=np.int64)
    close_of[o] = c
    whole = close_of[starts] == ends - 1
    drop = np.zeros(n, dtype=bool)
    if whole.any():
        partner = np.zeros(n, dtype=np.uint32)
        for m, p in MARKS.items():
            chosen = np.nonzero(whole & (points[starts] == m))[0]
            size = ends[chosen] - starts[chosen] - 2
            spans = np.repeat(starts[chosen] + 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(chosen) else np.array([], dtype=np.int64)
            partner[spans] = p
        inner = (points == partner) & (partner > 0)
        backslash = points == BACKSLASH
        run = at - np.maximum(_last_before(~backslash), lo - 1) - 1
        escaped = inner & (run % 2 == 1)
        drop[np.nonzero(escaped)[0] - 1] = True
        plain = inner & ~escaped
        place = at - _last_before(~plain)  # 1, 2, ... within a run of marks
        drop |= plain & (place % 2 == 0)
    starts, ends = starts + whole, ends - whole
    length = ends - starts
    child = np.repeat(np.arange(len(starts)), length)
    spans = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    kept = ~drop[spans]
    spans, child = spans[kept], child[kept]
    taken = points[spans]
    width = 1 + (taken >= 0x80).astype(np.int64) + (taken >= 0x800) + (taken >= 0x10000)
    sizes = np.bincount(child, weights=width, minlength=len(starts)).astype(np.int64)
    text = taken.astype("<u4").tobytes().decode("utf-32-le").encode()
    values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32).tobytes()), pa.py_buffer(text))
    values = pc.utf8_trim_whitespace(values)
    filled = pc.not_equal(pc.utf8_length(values), 0).to_numpy(zero_copy_only=False)
    parents = row[starts - whole][filled]
    offsets32 = np.concatenate(([0], np.cumsum(np.bincount(parents, minlength=count)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets32), values.filter(pa.array(filled)))


def explode_packed(df: DataFrame, value, key: str, least: int = 1) -> DataFrame:
    """(key, pos, val): one row per value packed in the column ``value``, pos counting from 1, of fields that pack at least ``least``.

    Null and blank fields give no rows; repeated values are kept; rows that share a key count once. Other columns are not read.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("_key", kind), T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = split_packed(batch.column(1))
            counts = np.diff(np.asarray(lists.offsets))
            parents = np.asarray(pc.list_parent_indices(lists))
            pos = np.arange(len(parents)) - np.asarray(lists.offsets)[parents] + 1
            keep = pa.array(counts[parents] >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parents)).filter(keep), pa.array(pos, pa.int32()).filter(keep), pc.list_flatten(lists).filter(keep)], names=["_key", "pos", "val"])

    rows = df.select(F.col(key).alias("_key"), F.col(value).alias("_value")).filter(F.col("_value").isNotNull())
    return rows.mapInArrow(run, out).withColumnRenamed("_key", key).dropDuplicates([key, "pos"])
