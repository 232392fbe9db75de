"""Ordered scans (lag, lead, running sum, last known value) that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(position)`` sends all rows of one recording to one task.
That is right while every recording is short, so callers first check the longest one
(:func:`block_width`, one pruned maximum). Beyond the bound the same scan runs in two levels:

* recordings are cut into blocks of consecutive rows; rows shuffle on (keys, block), so one
  recording spreads over many tasks;
* a carry table with one row per block brings each block what came before it; only that table is
  scanned per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmark.session import cut

#: Rows of one recording that one task may scan.
BLOCK_ROWS = 1 << 16

_BLOCK = "__block"


def block_width(df: DataFrame, pos: str, width: int = BLOCK_ROWS) -> int | None:
    """None when every dense position stays below ``width`` (plain windows will do), else ``width``."""
    longest = df.agg(F.max(pos).alias("m")).first()["m"]
    return width if longest is not None and longest >= width else None


def position_block(pos: str, width: int | None = BLOCK_ROWS) -> Column | None:
    """Block number of a dense, zero-based position column (None: no blocks needed)."""
    return None if width is None else F.floor(F.col(pos) / F.lit(width)).cast("long")


def _stage(df: DataFrame, block: Column, named: Sequence[Column], write: bool) -> DataFrame:
    # The carry branch and the row branch read the same input: write it once unless it is a plain scan.
    staged = df.select("*", block.alias(_BLOCK), *named)
    return cut(staged, "scan") if write else staged


def _windows(keys: Sequence[str], order: Sequence[str]):
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return inside, before


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    sums: Mapping[str, Column],
    write: bool = True,
) -> DataFrame:
    """Inclusive running sums per key. ``block`` must grow with ``order``."""
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(e.cast("long")).over(w).alias(n) for n, e in sums.items()])
    same = [*keys, _BLOCK]
    inside, before = _windows(keys, order)
    staged = _stage(df, block, [e.cast("long").alias(f"__x_{n}") for n, e in sums.items()], write)
    totals = staged.groupBy(*same).agg(*[F.sum(f"__x_{n}").alias(f"__t_{n}") for n in sums])
    carry = totals.select(
        *same, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums]
    )
    scanned = staged.select(
        *df.columns, _BLOCK, *[F.sum(f"__x_{n}").over(inside).alias(f"__s_{n}") for n in sums]
    )
    return scanned.join(carry, same, "left").select(
        *df.columns, *[(F.col(f"__s_{n}") + F.col(f"__c_{n}")).alias(n) for n in sums]
    )


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    name: str = "pos",
    write: bool = True,
) -> DataFrame:
    """Dense zero-based position of every row inside its key (or over all rows when no keys)."""
    out = with_running_sum(df, keys, order, block, {name: F.lit(1)}, write)
    return out.withColumn(name, F.col(name) - 1)


def longest_key(df: DataFrame, *keys: str) -> int:
    """Rows of the most frequent key (counts combine before the shuffle)."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    longest: int,
    name: str = "pos",
    limit: int = BLOCK_ROWS,
) -> DataFrame:
    """Dense zero-based rank of rows by ``order`` when nothing but the order is known.

    ``longest`` is the size of the largest key. Up to ``limit`` one window does it. Beyond, rows are
    range-partitioned by (keys, order), which splits a hot key wherever its rows fall; inside a sorted
    partition the row id already is the rank, and a table of (key, partition) counts adds what lies in
    earlier partitions.
    """
    if longest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long") - 1)
    # Written once: a second evaluation could draw other range bounds.
    placed = cut(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")),
        "rank",
    )
    same = [*keys, "__part"]
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*same).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    starts = starts.select(*same, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return placed.join(starts, same).select(
        *df.columns, (F.col("__id") - F.col("__first") + F.col("__base")).alias(name)
    )


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    values: Mapping[str, Column],
) -> DataFrame:
    """Latest non-null value at or before each row, per key."""
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.last(e, ignorenulls=True).over(w).alias(n) for n, e in values.items()])
    same = [*keys, _BLOCK]
    inside, before = _windows(keys, order)
    staged = _stage(df, block, [e.alias(f"__x_{n}") for n, e in values.items()], True)
    rank = F.struct(*order)
    ends = staged.groupBy(*same).agg(
        *[
            F.max_by(f"__x_{n}", F.when(F.col(f"__x_{n}").isNotNull(), rank)).alias(f"__t_{n}")
            for n in values
        ]
    )
    carry = ends.select(
        *same, *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values]
    )
    scanned = staged.select(
        *df.columns,
        _BLOCK,
        *[F.last(f"__x_{n}", ignorenulls=True).over(inside).alias(f"__s_{n}") for n in values],
    )
    return scanned.join(carry, same, "left").select(
        *df.columns, *[F.coalesce(f"__s_{n}", f"__c_{n}").alias(n) for n in values]
    )


def _neighbour(
    df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, str], width: int | None, step: int
) -> DataFrame:
    move = F.lag if step < 0 else F.lead
    if width is None:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.select("*", *[move(c).over(w).alias(n) for n, c in values.items()])
    same = [*keys, _BLOCK]
    staged = _stage(df, position_block(pos, width), [], True)
    # One row for each block that has rows; positions may have gaps, whole blocks may be missing.
    held = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    pick = F.max_by if step < 0 else F.min_by
    ends = staged.groupBy(*same).agg(pick(held, pos).alias("__e"))
    between = Window.partitionBy(*keys).orderBy(_BLOCK)
    carry = ends.select(*same, move("__e").over(between).alias("__c"))
    w = Window.partitionBy(*same).orderBy(pos)
    edge = move(F.lit(True)).over(w).isNull()
    scanned = staged.select("*", edge.alias("__edge"), *[move(c).over(w).alias(f"__s_{n}") for n, c in values.items()])
    return scanned.join(carry, same, "left").select(
        *df.columns,
        *[F.when(F.col("__edge"), F.col("__c")[n]).otherwise(F.col(f"__s_{n}")).alias(n) for n in values],
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, str], width: int | None
) -> DataFrame:
    """Value of the row before in the order of ``pos`` (NULL at the first row)."""
    return _neighbour(df, keys, pos, values, width, -1)


def with_next(
    df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, str], width: int | None
) -> DataFrame:
    """Value of the row after in the order of ``pos`` (NULL at the last row)."""
    return _neighbour(df, keys, pos, values, width, 1)
