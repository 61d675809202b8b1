"""Problem 6: lines repeated across the documents of one source, found through template trees and removed."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import batches
from gristmill.operators.skew import split_join
from gristmill.session import cut_lineage, one_per_key

LEAST_LETTERS = 20
TOKEN = 4  # letters of a token
FIXED = (0, 1, 2, -1)  # the tokens a tree branches on; all between are wildcard slots
MOST_TEMPLATES = 50_000  # of a tree held in memory; a full tree is handed on and a new one begun
MOST_BROADCAST = 200_000  # templates or lines sent to every task; beyond it they are met in a shuffle join
HOT_ROWS = 200_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(line: str) -> str:
    """The letters of a line, as they are written."""
    kept = _NOT_LETTERS.sub("", line)
    return kept if kept.isalpha() else "".join(filter(str.isalpha, kept))  # \\w also holds marks and letter-like numbers


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def line_letters(text: str | None, least: int = LEAST_LETTERS) -> Iterator[tuple[int, str]]:
    """(line_no, letters without regard to case) of the lines of at least ``least`` letters, counted as they are written."""
    for no, line in enumerate((text or "").split("\n")):
        if len(line) >= least and len(kept := letters(line)) >= least:
            yield no, kept.casefold()


class TemplateTree:
    """Fixed-depth tree over the tokens of lines: number of letters, then the tokens of ``FIXED``, the others being wildcard slots.

    Two lines are the same when their letters agree, wherever spaces stand, so tokens are cut from the letters alone. The template of a line
    follows from the line by itself: same lines have the same template in every partition, and trees are merged by adding up what stands at
    equal paths. A leaf counts documents, a document that comes back after another one again; so a merged count is never below the number of
    documents that hold any one line of the template.
    """

    def __init__(self):
        self.leaves: dict[tuple, list] = {}

    @staticmethod
    def path(kept: str) -> tuple:
        return (len(kept), *(kept[t * TOKEN : (t + 1) * TOKEN] if t >= 0 else kept[t * TOKEN :] for t in FIXED))

    @staticmethod
    def template(kept: str) -> str:
        """The template as it reads, with a star for every wildcard slot."""
        tokens = [kept[i : i + TOKEN] for i in range(0, len(kept), TOKEN)]
        fixed = {t if t >= 0 else len(tokens) + t for t in FIXED}
        return f"{len(kept)}: " + " ".join(x if i in fixed else "*" for i, x in enumerate(tokens))

    def add(self, source: str, kept: str, document: str) -> None:
        leaf = self.leaves.get(key := (source, self.path(kept)))
        if leaf is None:
            self.leaves[key] = [1, document]
        elif leaf[1] != document:
            leaf[0] += 1
            leaf[1] = document

    def rows(self) -> Iterator[tuple[str, int, int]]:
        return ((source, path_hash(path), n) for (source, path), (n, _) in self.leaves.items())


def path_hash(path: tuple) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, path)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _named(df: DataFrame, source: str, document: str) -> DataFrame:
    return df.filter(F.col(source).isNotNull() & F.col(document).isNotNull())


def template_counts(df: DataFrame, source: str, document: str, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(source, template, documents): merged trees of all partitions, with an upper bound of the documents a line of the template stands in."""
    kinds = pa.schema([("source", pa.string()), ("template", pa.int64()), ("documents", pa.int64())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tree.rows()), kinds.types)], schema=kinds)

        for batch in batches(stream):
            for name, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for _, kept in line_letters(text, least_letters):
                    tree.add(name, kept, doc)
            if len(tree.leaves) > MOST_TEMPLATES:
                yield out()
                tree = TemplateTree()
        if tree.leaves:
            yield out()

    rows = _named(df, source, document).select(F.col(source).alias("_s"), F.col(document).alias("_d"), F.col("text").alias("_t"))
    return rows.mapInArrow(run, "source string, template long, documents long").groupBy("source", "template").agg(F.sum("documents").alias("documents"))


def _frequent(counted: DataFrame, whole: DataFrame, least_documents: int, least_share: float, hot_rows: int) -> DataFrame:
    """The counted rows that reach both thresholds of their source; a source may own most of the rows."""
    counted = counted.filter(F.col("documents") >= least_documents)
    per = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return split_join(counted, whole, ["source"], per, hot_rows).filter(F.col("documents") >= least_share * F.col("source_documents"))


def _members(df: DataFrame, templates: DataFrame, source: str, document: str, key: str, least_letters: int, most_broadcast: int) -> DataFrame:
    """(key, source, document, line_no, line) of the lines of the given templates, ``line`` being the digest of their letters."""
    head = templates.select("source", "template").limit(most_broadcast + 1).collect()
    chosen = df.sparkSession.sparkContext.broadcast({(r.source, r.template) for r in head} if len(head) <= most_broadcast else None)
    kinds = pa.schema([("k", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("line_no", pa.int32()), ("template", pa.int64()), ("line", pa.binary())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chosen.value
        for batch in batches(stream):
            rows = []
            for k, name, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                place = xxhash.xxh3_64_intdigest(doc.encode("utf-8", "surrogatepass")) - (1 << 63) if doc is not None else None
                for no, kept in line_letters(text, least_letters):
                    at = path_hash(TemplateTree.path(kept))
                    if wanted is None or (name, at) in wanted:
                        rows.append((k, name, place, no, at, digest(kept)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    rows = df.filter(F.col(source).isNotNull()).select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(document).alias("_d"), F.col("text").alias("_t"))
    found = rows.mapInArrow(run, "k string, source string, document long, line_no int, template long, line binary")
    if len(head) > most_broadcast:
        found = found.join(templates.select("source", "template"), ["source", "template"], "left_semi")
    return found.withColumnRenamed("k", key).drop("template")


def _repeated(df: DataFrame, source: str, document: str, key: str, least_documents: int = 4, least_share: float = 0.05, least_letters: int = LEAST_LETTERS, most_broadcast: int = MOST_BROADCAST, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, repeated): the lines of frequent templates, and the (source, line) among them that are repeated."""
    whole = cut_lineage(_named(df, source, document).select(F.col(source).alias("source"), F.col(document).alias("_d")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("source_documents")))
    counted = cut_lineage(template_counts(df, source, document, least_letters).filter(F.col("documents") >= least_documents))
    templates = cut_lineage(_frequent(counted, whole, least_documents, least_share, hot_rows))
    members = cut_lineage(_members(df, templates, source, document, key, least_letters, most_broadcast))
    seen = members.filter("document is not null").select("source", "line", "document").distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("documents"))
    return members, _frequent(seen, whole, least_documents, least_share, hot_rows).select("source", "line")


def repeated_lines(df: DataFrame, source: str = "framework_name", document: str = "document", key: str = "chunk_id", **limits) -> DataFrame:
    """(key, line_no) of every line to be removed; line_no counts from 0 after splitting at line feeds.

    Trees of templates are merged over all partitions first; only templates whose count of documents reaches ``least_documents`` and ``least_share``
    of their source's are looked into, and no repeated line is outside them. Their lines are written once, and those whose letters agree
    are counted by distinct documents. Rows whose document is null count nowhere but lose their repeated lines; those without a source have none.
    One source, document or line may hold any share of the rows: all counts are partial sums, and joins split hot keys. Rows loaded twice give
    their places once. Null and empty texts and empty tables give no rows.
    """
    members, repeated = _repeated(df, source, document, key, **limits)
    counts = members.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    return split_join(members, repeated, ["source", "line"], counts, limits.get("hot_rows", HOT_ROWS)).select(key, "line_no").distinct()


def without_repeated_lines(df: DataFrame, source: str = "framework_name", document: str = "document", key: str = "chunk_id", **limits) -> DataFrame:
    """(key, text, removed) of every row, repeated lines taken out and the rest left as it was; one row a key, null texts stay null.

    Up to ``most_broadcast`` repeated lines are sent to every task and the texts stay where they are; more are met by their places in a join.
    """
    least_letters, most_broadcast = limits.get("least_letters", LEAST_LETTERS), limits.get("most_broadcast", MOST_BROADCAST)
    members, repeated = _repeated(df, source, document, key, **limits)
    repeated = cut_lineage(repeated)
    once = one_per_key(df.select(key, source, "text"), key)
    head = repeated.limit(most_broadcast + 1).collect()
    if len(head) > most_broadcast:
        counts = members.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
        found = split_join(members, repeated, ["source", "line"], counts, limits.get("hot_rows", HOT_ROWS))
        places = found.groupBy(key).agg(F.collect_set("line_no").alias("_drop"))  # at most the lines of one text
        kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains("_drop", i), x)), lambda x: x.isNotNull())
        text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
        return once.join(places, key, "left").select(key, text.alias("text"), F.coalesce(F.size("_drop"), F.lit(0)).alias("removed"))
    chosen = df.sparkSession.sparkContext.broadcast({(r.source, bytes(r.line)) for r in head})
    kinds = pa.schema([("k", pa.string()), ("text", pa.string()), ("removed", pa.int32())])

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chosen.value
        for batch in batches(stream):
            rows = []
            for k, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                drop = {no for no, kept in line_letters(text, least_letters) if (name, digest(kept)) in wanted}
                rows.append((k, "\n".join(x for no, x in enumerate(text.split("\n")) if no not in drop) if drop else text, len(drop)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return once.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("text").alias("_t")).mapInArrow(run, "k string, text string, removed int").withColumnRenamed("k", key)
