"""Problem 2: cutting oversized texts at natural boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import map_rows
from gristmill.session import one_per_key

SLAB = 1 << 16
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+(?P<md>\S.*?)[ \t#]*|(?P<eq>={2,6})[ \t]*(?P<wiki>\S.*?)[ \t]*(?P=eq)|\\(?:(?:sub)*section|paragraph|chapter)\*?\{(?P<tex>[^}\n]+)\}|<[hH][1-6][^>\n]*>(?P<html>.*?)</[hH][1-6]>)[ \t]*$", re.M)
_TAGS = re.compile(r"<[^>\n]*>")


def _wide_strengths(points: np.ndarray) -> np.ndarray:
    """Strengths after ideographic full stops and commas, which no white space follows: 3 and 2, behind closing marks."""
    n = len(points)
    out = np.zeros(n + 1, dtype=np.int8)
    stop = np.isin(points, [0x3002, 0xFF01, 0xFF1F, 0xFF61])
    comma = np.isin(points, [0x3001, 0xFF0C, 0xFF1B, 0xFF1A])
    closing = np.isin(points, [0x300D, 0x300F, 0xFF09, 0x201D, 0x2019])
    space = np.isin(points, [0x0A, 0x20, 0x09, 0x0D, 0xA0, 0x3000])
    at = np.nonzero(stop | comma)[0]
    strength = np.where(stop[at], 3, 2)
    at = at + 1
    for _ in range(2):
        at = at + ((at < n) & closing[np.minimum(at, n - 1)])
    next_ = np.minimum(at, n - 1)
    free = (at < n) & ~(stop | comma | closing | space)[next_]  # not between two marks; before white space the cut comes after it
    out[at[free]] = strength[free]
    return out


def boundary_strengths(points: np.ndarray) -> np.ndarray:
    """Strength of a cut before each code point, and after the last: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word, 0 none."""
    n = len(points)
    if n < 2:
        return np.zeros(n + 1, dtype=np.int8)
    out = _wide_strengths(points)
    newline = points == 10
    space = newline | (points == 32) | (points == 9) | (points == 13) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x200A)) | (points == 0x3000)
    here = np.nonzero(space[:-1] & ~space[1:])[0]  # the last white space of a run; the cut comes after it
    if not len(here):
        return out
    begins = np.zeros(n, dtype=bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[0] = space[0]
    firsts = np.nonzero(begins)[0]
    first = firsts[np.searchsorted(firsts, here, side="right") - 1]
    lines = np.concatenate(([0], np.cumsum(newline)))
    breaks = lines[here + 1] - lines[first]
    before = points[np.maximum(first - 1, 0)]
    closing = np.isin(before, [0x22, 0x27, 0x29, 0x5D, 0x201D, 0x2019, 0xBB])
    before = np.where(closing, points[np.maximum(first - 2, 0)], before)
    out[here + 1] = np.select([breaks >= 2, breaks == 1, np.isin(before, [0x2E, 0x21, 0x3F, 0x2026, 0x3002, 0xFF01, 0xFF1F]), np.isin(before, [0x2C, 0x3B, 0x3A])], [5, 4, 3, 2], 1)
    return out


class RangeMaximum:
    """Sparse table of positions of maxima over windows up to ``longest``; ties go to the right."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= min(longest, len(values)):
            low = self.levels[-1]
            left, right = low[: len(values) - 2 * width + 1], low[width : len(values) - width + 1]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def query(self, low: int, high: int) -> int:
        """Position of the rightmost maximum in [low, high]."""
        level = (high - low + 1).bit_length() - 1
        left, right = int(self.levels[level][low]), int(self.levels[level][high - (1 << level) + 1])
        return right if self.values[right] >= self.values[left] else left


def cut_points(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces. Each end is the strongest boundary between ``least`` and ``limit`` characters on, if there is none the
    strongest before, and only without any a cut at ``limit``. A piece shares less with the last one if that lets it reach a boundary.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("needs 0 <= overlap < least <= limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    strengths = boundary_strengths(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    pieces, start, last, base, index = [], 0, 0, 0, None
    while n - start > limit:
        if index is None or start + limit >= base + len(index.values):
            base = start
            index = RangeMaximum(strengths[base : base + max(SLAB, 4 * limit)], limit)
        end = base + index.query(start + least - base, start + limit - base)
        if not strengths[end]:
            near = np.nonzero(strengths[start + 1 : last + 1])[0]
            later = start + 1 + int(near[-1]) if len(near) else start
            if overlap + 1 < least and strengths[early := base + index.query(start + overlap + 1 - base, start + least - 1 - base)]:
                end = early
            elif later > start and (n - later <= limit or strengths[start + limit + 1 : later + limit + 1].any()):
                start = later
                continue
        last = end
        pieces.append((start, end))
        back = end - overlap
        if overlap:  # a piece begins at the first boundary of the stretch it may share, if that has one
            near = np.nonzero(strengths[back:end])[0]
            back += int(near[0]) if len(near) and not strengths[back] else 0
        start = back
    pieces.append((start, n))
    return pieces


def headings(text: str) -> list[tuple[int, str]]:
    """Position and title of each marked heading line."""
    found = []
    for m in _HEADING.finditer(text):
        title = _TAGS.sub("", m["md"] or m["wiki"] or m["tex"] or m["html"] or "").strip()
        if title:
            found.append((m.start(), title))
    return found


def split_oversized(df: DataFrame, limit: int = 4000, overlap: int = 200, least: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Pieces of every row whose text exceeds ``limit`` code points, whatever its char_count says.

    Returns key, piece_no (from 0), start_pos, text, char_count and section_title: the last heading that begins
    at or before the piece does, else the title of the row itself. Texts at or under the limit, empty and null texts give no rows. Rows
    loaded twice give their pieces once, rows without a key counting as one record. Other columns of ``df`` are not read.
    """
    if least is None:
        least = max(overlap + 1, limit // 2)
    once = one_per_key(df.filter(F.length("text") > limit).select(key, "text", "section_title"), key)
    rows = once.select(F.col(key).alias("_key"), F.col("text").alias("_text"), F.col("section_title").alias("_title"))
    kinds = pa.schema([("k", pa.string()), ("piece_no", pa.int32()), ("start_pos", pa.int64()), ("text", pa.string()), ("char_count", pa.int32()), ("section_title", pa.string())])

    def work(k, text, title):
        marks, at, own = headings(text), 0, title
        for no, (start, end) in enumerate(cut_points(text, limit, overlap, least)):
            while at < len(marks) and marks[at][0] <= start:
                own, at = marks[at][1], at + 1
            yield k, no, start, text[start:end], end - start, own

    return map_rows(rows, "k string, piece_no int, start_pos long, text string, char_count int, section_title string", kinds, work).withColumnRenamed("k", key)
