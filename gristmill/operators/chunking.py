"""Chunking of documents with metadata: sequential within a document, parallel across documents."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

NEAR, WORD_REACH = 100, 50
_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_SECTION = re.compile(r"^(#{1,6})[ \t]+(\S.*)$", re.M)
_BREAK = re.compile(r"\n\s*\n")


class CutFinder:
    """Where a document may be cut near a wanted place; all sentence gaps are found once."""

    def __init__(self, text: str):
        self.text = text
        self.gaps = [(m.start(), m.end()) for m in _GAP.finditer(text)]
        self.starts = [g[0] for g in self.gaps]

    def near(self, wanted: int) -> int:
        """The closest sentence gap within NEAR characters (the earlier of two), else the first paragraph break there, else the first blank of the next WORD_REACH, else ``wanted``."""
        low, high = max(0, wanted - NEAR), min(len(self.text), wanted + NEAR)
        first = bisect_left(self.starts, low + 1)  # the mark before the gap has to be in sight too
        inside = [s for s, e in self.gaps[first : bisect_left(self.starts, high)] if e < high]
        if inside:
            return min(inside, key=lambda s: (abs(s - wanted), s))
        if found := _BREAK.search(self.text[low:high]):
            return low + found.start()
        reach = self.text[wanted : wanted + WORD_REACH]
        return wanted + next((i for i, c in enumerate(reach) if c.isspace()), 0)


def chunk_texts(text: str, limit: int = 4000, overlap: int = 200, compat: bool = False) -> list[str]:
    """Consecutive pieces, stripped, each starting ``overlap`` characters before the end of the last; a text within the limit stays as it is. A blank piece is passed over; with ``compat`` it ends the document."""
    if len(text) <= limit:
        return [text]
    cuts, pieces, start = CutFinder(text), [], 0
    while start < len(text):
        end = start + limit
        end = cuts.near(end) if end < len(text) else len(text)
        piece = text[start:end].strip()
        if not piece and compat:
            break
        if piece:
            pieces.append(piece)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return pieces


def section_texts(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[list[str], str]]:
    """(titles on the way to the section, its text) of a Markdown document, one for each header and for what stands before the first; longer sections are cut as any text is."""
    out: list[tuple[list[str], str]] = []
    path: list[tuple[int, str]] = []
    starts = [m for m in _SECTION.finditer(text)]
    bounds = [(None, 0), *((m, m.start()) for m in starts)]
    for (m, at), end in zip(bounds, [*(m.start() for m in starts), len(text)]):
        if m is not None:
            level = len(m[1])
            path = [p for p in path if p[0] < level] + [(level, m[2].strip())]
        if text[at:end].strip():
            out.extend(([t for _, t in path], piece) for piece in chunk_texts(text[at:end].strip(), limit, overlap))
    return out


def section_chunks(df: DataFrame, framework: str, document: str, text: str = "text", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(framework_name, document, chunk_id, position, path, text): chunks that follow the headers of a document, numbered from 1. Null and blank texts give no rows."""
    docs = df.select(F.col(framework).cast("string").alias("framework_name"), F.col(document).cast("string").alias("document"), F.col(text).alias("text")).filter("text is not null")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [(f, d, i, titles, piece) for f, d, t in zip(*(c.to_pylist() for c in batch.columns)) for i, (titles, piece) in enumerate(section_texts(t, limit, overlap), 1)]
            if rows:
                f, d, i, titles, pieces = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(d, pa.string()), pa.array(i, pa.int32()), pa.array(titles, pa.list_(pa.string())), pa.array(pieces, pa.string())], names=["framework_name", "document", "position", "path", "text"])

    found = docs.mapInArrow(run, "framework_name string, document string, position int, path array<string>, text string")
    return found.select("framework_name", "document", F.concat_ws("_", "framework_name", "document", F.col("position").cast("string")).alias("chunk_id"), "position", "path", "text")


def chunk_documents(df: DataFrame, framework: str, document: str, text: str = "text", limit: int = 4000, overlap: int = 200, most_bytes: int | None = None, first_position: int = 0) -> DataFrame:
    """One row per chunk: framework_name, document, chunk_id, position, text, char_count, token_estimate, has_headers, section_title, subsection_title, keywords, chunk_hash.

    White space is cleaned first. Documents within the limit never leave the JVM. Null texts give no rows; an empty text is one empty chunk.
    ``most_bytes`` drops chunks of more UTF-8 bytes; ``first_position=1`` numbers from one.
    """
    docs = df.select(F.col(framework).cast("string").alias("framework_name"), F.col(document).cast("string").alias("document"), T.clean_whitespace(F.col(text)).alias("text")).filter("text is not null")
    short = docs.filter(F.length("text") <= limit).withColumn("position", F.lit(0))

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [(f, d, piece, i) for f, d, t in zip(*(c.to_pylist() for c in batch.columns)) for i, piece in enumerate(chunk_texts(t, limit, overlap))]
            if rows:
                f, d, t, i = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(d, pa.string()), pa.array(t, pa.string()), pa.array(i, pa.int32())], names=["framework_name", "document", "text", "position"])

    long = docs.filter(F.length("text") > limit).mapInArrow(run, "framework_name string, document string, text string, position int")
    return with_chunk_metadata(short.unionByName(long), most_bytes, first_position)


def with_chunk_metadata(chunks: DataFrame, most_bytes: int | None = None, first_position: int = 0) -> DataFrame:
    if most_bytes is not None:
        chunks = chunks.filter(F.octet_length("text") <= most_bytes)
    titles = chunks.withColumn("position", F.col("position") + first_position).withColumn("_titles", T.headers(F.col("text")))
    return titles.select(
        "framework_name",
        "document",
        F.concat_ws("_", "framework_name", "document", F.col("position").cast("string")).alias("chunk_id"),
        "position",
        "text",
        F.length("text").alias("char_count"),
        T.token_estimate(F.col("text")).alias("token_estimate"),
        (F.size("_titles") > 0).alias("has_headers"),
        F.try_element_at("_titles", F.lit(1)).alias("section_title"),
        F.try_element_at("_titles", F.lit(2)).alias("subsection_title"),
        T.keywords(F.col("text")).alias("keywords"),
        F.md5("text").alias("chunk_hash"),
    )


def with_framework(chunks: DataFrame, frameworks: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Chunks with the full name, type, domain and sector of their framework; chunks of unknown frameworks keep nulls."""
    from gristmill.session import estimated_bytes

    side = frameworks.select(F.col("framework.name").alias("framework_name"), F.col("framework.full_name").alias("framework_full_name"), F.col("framework.type").alias("framework_type"), F.col("metadata.domain").alias("domain"), F.col("metadata.sector").alias("sector")).dropDuplicates(["framework_name"])
    return chunks.join(F.broadcast(side) if estimated_bytes(frameworks) <= most_bytes else side, "framework_name", "left")


# fixed value: the columns of the flat form of a chunk
FLAT = "framework_name framework_full_name framework_type document chunk_id text domain sector char_count token_estimate position has_headers section_title subsection_title keywords chunk_hash".split()


def flat_chunks(chunks: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Chunks in their flat form: their own columns and those of their framework, in fixed order."""
    own = [c for c in FLAT if c not in ("framework_full_name", "framework_type", "domain", "sector")]
    return with_framework(chunks.select(*own), frameworks).select(*FLAT)


def processing_statistics(df: DataFrame, by: list[str], source: Column, result: Column) -> DataFrame:
    """Processed and failed rows (those without a result), characters in and out, their ratio and the error rate in percent."""
    size_in, size_out = F.coalesce(F.sum(F.length(source)), F.lit(0)), F.coalesce(F.sum(F.length(result)), F.lit(0))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("processed"), F.count_if(result.isNull()).alias("failed"), size_in.alias("chars_in"), size_out.alias("chars_out"))
    return rows.withColumn("compression_ratio", F.coalesce(F.try_divide(F.col("chars_out"), F.col("chars_in")), F.lit(0.0))).withColumn("error_rate", F.col("failed") * 100.0 / F.greatest("processed", F.lit(1)))


def size_statistics(df: DataFrame, by: list[str], text: str = "text", most_bytes: int = 12288) -> DataFrame:
    """Counts by size bucket and oversized texts, the bucket estimate of the mean size and the exact one."""
    bucket = T.size_bucket(F.length(text))
    n = lambda name: F.count_if(bucket == name)
    estimate = F.coalesce(F.try_divide(n("small") * 500 + n("medium") * 2000 + n("large") * 3500, F.count(text)), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(text).alias("chunks"), n("small").alias("small"), n("medium").alias("medium"), n("large").alias("large"), F.count_if(F.octet_length(text) > most_bytes).alias("oversized"), estimate.alias("estimated_size"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("mean_size"))
