"""Problem 9: mixing sources to target weights with nested hash thresholds."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.arrow import batches
from gristmill.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern of the public byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BITS, LEVELS = 12, 3


def source_label(source: Column) -> Column:
    """Labels that differ only in case, outer spaces or ``-`` for ``_`` are one source."""
    return F.replace(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit("-"), F.lit("_"))


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) with the tokens of the whole text; null texts count 0. The vocabulary is read by the driver and broadcast."""
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches(stream):
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return df.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, tokens long")


def _targets(targets: DataFrame) -> DataFrame:
    """One row per source label; shares of labels that are one source add up."""
    return targets.withColumn("source", source_label(F.col("source"))).filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


class Mixture:
    """A planned mix: ``selected`` documents with their copies, and ``shares`` per target source.

    The total to fill is ``total_tokens``, by default the tokens of all documents of the target sources. A source's goal is its
    share of that, at most max_repeats times what it has. It takes every document goal // available times, and once more those
    documents whose hash lies under a threshold: hash buckets are summed, the bucket in which the budget ends is refined on the next
    bits, and after three levels the documents under the threshold come as close to the budget as the last bucket, 2**-36 of the
    source and so hardly ever more than one document, allows. Nothing is sorted and no document is gathered; the driver sees one row per target source and level.

    Null sources and null target labels take no part; a document without tokens is never selected; an absent source has share 0.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY):
        self.targets = _targets(targets)
        named = docs.select("doc_id", source_label(F.col("source")).alias("source"), "text").join(self.targets.select("source"), "source", "left_semi")
        counts = token_counts(named, vocabulary).filter("tokens > 0").withColumn("_hash", F.xxhash64("doc_id"))
        self.counts = cut_lineage(counts)
        have = self.counts.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
        rows = self.targets.join(have, "source", "left").fillna(0, ["available", "documents"]).collect()
        total = total_tokens if total_tokens is not None else sum(r.available for r in rows)
        self.plan = []
        for r in sorted(rows, key=lambda r: r.source):
            wanted = int((r.target_share or 0) * total)
            goal = min(wanted, (r.max_repeats or 0) * r.available)
            full, rest = divmod(goal, r.available) if r.available else (0, 0)
            self.plan.append({"source": r.source, "target_share": float(r.target_share or 0), "max_repeats": int(r.max_repeats or 0), "available": int(r.available), "goal": wanted, "full": int(full), "rest": int(rest), "prefix": 0})
        for level in range(LEVELS):
            self._refine(level)
        plan = docs.sparkSession.createDataFrame([(p["source"], p["full"], p["prefix"]) for p in self.plan] or [], "source string, full int, prefix long")
        bucket = F.shiftrightunsigned("_hash", 64 - BITS * LEVELS)
        copies = F.col("full") + F.when(bucket < F.col("prefix"), 1).otherwise(0)
        self.selected = self.counts.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).filter("copies > 0")

    def _refine(self, level: int) -> None:
        """Descends one level: of each source, the bucket in which the rest of its budget ends."""
        spark = self.counts.sparkSession
        state = spark.createDataFrame([(p["source"], p["rest"], p["prefix"]) for p in self.plan] or [], "source string, rest long, prefix long")
        whole = F.shiftrightunsigned("_hash", 64 - BITS * (level + 1))
        inside = self.counts.join(F.broadcast(state), "source").filter(F.shiftrightunsigned(whole, BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "rest", whole.alias("bucket")).agg(F.sum("tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2**BITS rows a source
        ends = sums.withColumn("upto", upto).filter("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n")).alias("end"))
        found = {r.source: r.end for r in ends.collect()}
        for p in self.plan:
            if p["source"] in found:
                end = found[p["source"]]
                p["prefix"], p["rest"] = end.bucket, p["rest"] - end.before
                if level == LEVELS - 1 and end.n - p["rest"] < p["rest"]:
                    p["prefix"] += 1  # with the last bucket the mix comes closer to its goal than without
            else:  # nothing to add from this prefix on
                p["prefix"] = p["prefix"] << BITS

    @property
    def shares(self) -> DataFrame:
        """Per target source: target_share, available and taken tokens, documents, copies, reached_share of all taken tokens, and whether its goal was out of reach."""
        taken = self.selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
        plan = self.counts.sparkSession.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], p["available"], p["goal"]) for p in self.plan] or [], "source string, target_share double, max_repeats int, available long, goal long")
        whole = taken.agg(F.sum("taken").alias("n")).select("n").scalar()
        rows = plan.join(taken, "source", "left").fillna(0, ["taken", "documents", "copies"])
        reached = F.coalesce(F.try_divide(F.col("taken").cast("double"), whole), F.lit(0.0))
        return rows.withColumn("reached_share", F.round(reached, 6)).withColumn("out_of_reach", F.col("goal") > F.col("max_repeats") * F.col("available"))
