"""Joins and ranks that hold up when one key carries a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import cut_lineage, estimated_bytes

HOT_ROWS = 1_000_000
SMALL_BYTES, SMALL_HOT = 16 << 20, 100_000  # of an input of which one task can hold any group, where hot begins at that many rows or later


def _small(df: DataFrame, hot_rows: int) -> bool:
    """Whether looking for hot keys would cost more than they could: all of ``df`` would be work for a task."""
    return hot_rows >= SMALL_HOT and estimated_bytes(df) <= SMALL_BYTES


MOST_HOT = 50_000  # keys that may be treated as hot, and so be broadcast


def hot_from(counts: DataFrame, hot_rows: int, most_hot: int = MOST_HOT) -> DataFrame:
    """The rows of ``counts`` (a key and its number of rows ``n``) of hot keys: at least ``hot_rows`` rows, or more where the whole holds over ``hot_rows * most_hot``.

    The limit rises with the whole, so there are never more than ``most_hot`` hot keys, whatever the data.
    """
    limit = F.greatest(F.lit(hot_rows), F.ceil(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar() / most_hot))
    return counts.filter(F.col("n") >= limit)


def split_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, hot_rows: int, how: str = "inner", null_safe: list[str] | None = None) -> DataFrame:
    """Join a large ``left`` with a ``right`` of one row per key, sending hot keys round the shuffle.

    ``counts`` holds ``on`` and ``n``, the number of left rows of each key. The right rows of hot keys, at most ``MOST_HOT`` many (see ``hot_from``),
    are broadcast; every other key goes through an ordinary shuffle join in which none is hot. A null key matches nothing, unless its column is named in ``null_safe``; with
    ``how='left'`` it keeps its row.
    """
    def meet(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        if not null_safe:
            return a.join(b, on, kind)
        b = b.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in b.columns))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) if c in null_safe else F.col(c) == F.col(f"_on_{c}") for c in on))
        return a.join(b, same, kind).drop(*(f"_on_{c}" for c in on))

    if _small(left, hot_rows):
        return meet(left, right, how)
    hot_keys = hot_from(counts, hot_rows).select(*on)
    hot_right = meet(right, F.broadcast(hot_keys), "left_semi")
    marked = meet(left, F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), "left")
    hot = marked.filter(F.col("_hot")).drop("_hot")
    hot = meet(hot, F.broadcast(hot_right), how)
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot")
    cold = meet(cold, right, how)
    return hot.unionByName(cold)


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` with a broadcast ``right`` of bounded size, where a null key meets a null key."""
    renamed = right.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return left.join(F.broadcast(renamed), same, how).drop(*(f"_on_{c}" for c in on))


def split_hot(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the other groups, rows of the hot ones or None). Hot groups are few, see ``hot_from``, so they are broadcast as a table."""
    if _small(df, hot_rows):
        return df, None
    hot = cut_lineage(hot_from(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), hot_rows).select(*by))
    if hot.isEmpty():
        return df, None
    return meet(df, hot, by, "left_anti"), meet(df, hot, by, "left_semi")


def numbered(df: DataFrame, by: list[str], order: list[Column | str], into: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the number of each row within its group, from 1, in an ``order`` that leaves no ties.

    Groups up to ``hot_rows`` rows are numbered by a window. Larger ones are laid out in ranges of that order over all tasks and written once; a row's
    number is its place in its range after the rows of the group's earlier ranges, of which only counts meet.
    """
    cold, large = split_hot(df, by, hot_rows)
    small = cold.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if large is None:
        return small
    laid = cut_lineage(large.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = laid.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_in"))  # a row a range and group
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).drop("_in")
    inside = laid.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    placed = meet(inside, before, [*by, "_range"]).withColumn(into, (F.col("_before") + F.col("_place")).cast("int"))
    return small.unionByName(placed.select(*small.columns))
