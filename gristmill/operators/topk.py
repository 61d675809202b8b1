"""Best k of each query, kept task by task and then merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class TopK:
    """The k best (score, id) of every query over the batches of one task; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.best = k, [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)  # the worst score that is still held, once k are

    def add(self, ids: list, scores: np.ndarray, above: float | None = None, excluded: np.ndarray | None = None) -> None:
        """``scores`` is rows by queries; rows at or under ``above`` and excluded cells take no part."""
        out = np.zeros(scores.shape, bool) if above is None else scores <= above
        if excluded is not None:
            out |= excluded
        scores = np.where(out, -np.inf, scores)
        least = self.least
        if len(scores) > self.k:  # of one batch, no more than its own best k can stay, and their ties
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        queries, rows = np.nonzero(((scores >= least) & (scores > -np.inf)).T)
        starts = np.nonzero(np.diff(queries, prepend=-1))[0]
        for a, z in zip(starts, [*starts[1:], len(queries)]):
            q, held = queries[a], self.best[queries[a]]
            held.extend(zip(scores[rows[a:z], q].tolist(), (ids[r] for r in rows[a:z])))
            held.sort(key=lambda x: (-x[0], x[1]))
            del held[self.k :]
            if len(held) == self.k:
                self.least[q] = held[-1][0]

    def add_one(self, query: int, ids: pa.Array, scores: np.ndarray) -> None:
        """As ``add`` for the scores above 0 of one query, rounded to nine decimals; ``ids`` are in ascending order."""
        rows = np.flatnonzero(scores > max(0.0, self.least[query] - 1e-9))
        if len(rows) > self.k:
            found = scores[rows]
            rows = rows[found >= np.partition(found, len(found) - self.k)[len(found) - self.k] - 1e-9]
        rounded = np.round(scores[rows], 9)
        order = np.lexsort((rows, -rounded))[: self.k]
        held = self.best[query]
        held.extend(zip(rounded[order].tolist(), ids.take(pa.array(rows[order])).to_pylist()))
        held.sort(key=lambda x: (-x[0], x[1]))
        del held[self.k :]
        if len(held) == self.k:
            self.least[query] = held[-1][0]

    def batches(self, names: list) -> Iterator[pa.RecordBatch]:
        rows = [(name, i, s) for name, held in zip(names, self.best) for s, i in held]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s, pa.float64())], names=["query_id", "id", "score"])


def best_of_tasks(found: DataFrame, k: int, by: list[str] = ["query_id"]) -> DataFrame:
    """(query_id, id, score, rank), rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
