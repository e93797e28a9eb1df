"""Ordered scans that do not put a whole group into one task.

A window over ``PARTITION BY plan`` hands every row of a plan to one task. Here
each ordered table carries a ``block`` column (position // BLOCK_ROWS), windows
run per (key, block), and what a block needs from the ones before or after it
travels in a side table with one row per block. Only groups longer than one
block enter that side table (the ``n`` column tells, row by row), so ordinary
data pays for a filter and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def with_blocks(
    df: DataFrame, keys: Sequence[str], pos: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``block`` and ``n_points`` to a table that lacks them (``pos`` counts from 0 or 1)."""
    spans = df.groupBy(*keys).agg((F.max(pos) + 1).alias("n_points"))
    return df.withColumn("block", F.floor(F.col(pos) / block_rows).cast("int")).join(
        spans, list(keys)
    )


def block_of(pos: Column, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(pos / block_rows).cast("int")


def long_groups(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of groups that span several blocks."""
    return df.where(F.col("n_points") > block_rows)


def in_block(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys, "block").orderBy(*order)


def over_blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("block")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: str = "block",
) -> DataFrame:
    """Inclusive running sum of ``value`` per key, in ``order``; ``block`` must be
    non-decreasing in that order."""
    per_block = (
        df.groupBy(*keys, block)
        .agg(F.sum(value).alias("_in_block"))
        .withColumn(
            "_before",
            F.sum("_in_block").over(
                Window.partitionBy(*keys)
                .orderBy(block)
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*keys, block, F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    w = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_run", F.sum(value).over(w))
        .join(per_block, [*keys, block], "left")
        .withColumn(out, F.col("_run") + F.col("_before"))
        .drop("_run", "_before")
    )
