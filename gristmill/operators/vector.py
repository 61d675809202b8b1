"""Exact nearest neighbours by cosine distance, and an embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.topk import TopK, best_of_tasks

MOST_QUERIES = 4096  # of one pass; a larger query set takes several
CELLS = 4_000_000  # scores of rows by queries that a task holds at once


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows from the buffer of a list column, and which of them are usable: present, of the right length, finite and not all zero."""
    fits = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == width
    out = np.zeros((len(column), width))
    if width and fits.any():
        out[fits] = pc.list_flatten(column.filter(pa.array(fits))).to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.linalg.norm(out, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    out[~good] = 0
    return out / np.where(good, norms, 1)[:, None], good


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 5, same: str | None = None, most_queries: int = MOST_QUERIES, collection: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` rows of the corpus closest to every query by 1 - cosine.

    Both sides are (id, embedding[, same]); with ``same`` only rows with an equal value of that column are neighbours. With ``collection``, a column of
    the corpus, each of its values is searched for itself: the result has that column, ``rank`` counts within it, and ``overall`` counts over all of them.
    Queries are taken in blocks of about ``most_queries`` that alone reach the driver and are broadcast, one pass over the corpus a
    block; each task keeps its best k of every query. Vectors that are null, of another length, not finite or zero have no neighbours and are none. Ties go to the
    smaller id.
    """
    extra = [F.col(same).alias("_same")] if same else []
    grouped = [F.col(collection).cast("string").alias("_collection")] if collection else []
    kind, spark = corpus.schema["id"].dataType.simpleString(), corpus.sparkSession
    query_kind = queries.schema["id"].dataType.simpleString()
    asked = queries.select("id", "embedding", *extra)
    head = asked.limit(most_queries + 1).toArrow()
    passes = 1 if head.num_rows <= most_queries else -(-queries.count() // most_queries)
    columns = f"query_id {query_kind}, id {kind}, score double" + (", _collection string" if collection else "")
    out = None
    for number in range(passes):
        part = head if passes == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == number).toArrow()
        if not part.num_rows:
            continue
        vectors = part.column("embedding").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        width = pc.max(pc.list_value_length(vectors)).as_py() or 0
        unit, good = _matrix(vectors, width)
        names = part.column("id").to_pylist()
        labels = np.array(part.column("_same").to_pylist(), dtype=object) if same else None
        shared = spark.sparkContext.broadcast((unit, good, labels, names, width))

        def run(stream: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            unit, good, labels, names, width = shared.value
            best: dict[str | None, TopK] = {}
            step = max(1, min(1024, CELLS // len(names)))
            for whole in stream:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    mine, usable = _matrix(batch.column(1), width)
                    scores = np.round(mine @ unit.T, 9)
                    excluded = ~usable[:, None] | ~good[None, :]
                    if labels is not None:
                        own = np.array(batch.column(2).to_pylist(), dtype=object)
                        excluded |= own[:, None] != labels[None, :]
                    ids = batch.column(0).to_pylist()
                    if not collection:
                        best.setdefault(None, TopK(len(names), k)).add(ids, scores, excluded=excluded)
                        continue
                    of = batch.column(batch.num_columns - 1).to_pylist()
                    for value in dict.fromkeys(of):
                        rows = [i for i, x in enumerate(of) if x == value]
                        best.setdefault(value, TopK(len(names), k)).add([ids[i] for i in rows], scores[rows], excluded=excluded[rows])
            for value, kept in best.items():
                for found in kept.batches(names):
                    yield found.append_column("_collection", pa.array([value] * found.num_rows, pa.string())) if collection else found

        found = corpus.select("id", "embedding", *extra, *grouped).mapInArrow(run, columns)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], columns)
    ranked = best_of_tasks(out, k, ["query_id", *(["_collection"] if collection else [])])
    distance = (1 - F.col("score")).alias("distance")
    if not collection:
        return ranked.select("query_id", "id", distance, "rank")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.select("query_id", F.col("_collection").alias(collection), "id", distance, "rank", F.row_number().over(over).alias("overall"))


def hashed_embedding(texts: list[str], width: int = 64) -> np.ndarray:
    """A model-free stand-in for an encoder: words hashed with sign into ``width`` cells."""
    import xxhash

    out = np.zeros((len(texts), width), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            out[i, h % width] += 1.0 if h >> 63 else -1.0
    return out


def embed(df: DataFrame, text: str = "text", into: str = "embedding", encode: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """Adds the vectors of ``encode``, called on batches of texts; null texts get null."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        found = encode(texts.fillna("").tolist())
        return pd.Series([None if t is None else v for t, v in zip(texts.where(texts.notna(), None), found.tolist())])

    return df.withColumn(into, vectors(F.col(text)))
