"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 1024


def batches(source: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The incoming batches in slices of at most ``rows``, so that work space does not grow with the batch size."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, schema: str, arrow_schema: pa.Schema, work: Callable[..., Iterable[tuple]], setup: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` over rows: ``work(*values)`` yields output tuples; ``setup()`` runs once a task and is passed first."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches(source):
            columns = [c.to_pylist() for c in batch.columns]
            out = [row for values in zip(*columns) for row in work(*state, *values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow_schema.types)], schema=arrow_schema)

    return df.mapInArrow(run, schema)
