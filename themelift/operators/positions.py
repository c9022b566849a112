"""Ranks within groups: top-k, and positions over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelift.sizing import SALTS, lookup_join, stage

# Spark limits the rows of a rank window before its shuffle only up to this rank.
LIMITED_RANK = 1000
# Groups up to this size are numbered by one window task each.
WINDOW_ROWS = 2_000_000


def topk_per(df: DataFrame, keys: list[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in a total order.

    Up to ``LIMITED_RANK`` Spark cuts every map partition to k rows per group before the shuffle.
    For larger k the same cut is made here per salt, so a hot group never meets one task whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if k > LIMITED_RANK:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
        by_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(by_salt))
            .where(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def with_position(
    df: DataFrame,
    group: list[str],
    order: Sequence[Column],
    name: str = "pos",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row within its group; ``order`` must be total.

    The table is staged and its largest group counted. Small groups take a window. A larger group
    is range-partitioned on the order over many tasks instead; a row's position is then its place
    in its partition plus the group's rows in the partitions before.
    """
    rows = stage(df, "positions")
    top = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    if (top["n"] or 0) <= window_rows:
        number = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
        return rows.withColumn(name, number.cast("bigint"))
    keys = [F.col(f"`{g}`") for g in group]
    # Staged after the range partitioning, so that both reads below see the same partitions.
    spread = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    spread = stage(
        spread.sortWithinPartitions(*keys, *order).withColumn("_seq", F.monotonically_increasing_id()),
        "ranges",
    )
    parts = spread.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = parts.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    placed = lookup_join(spread, shifts, [*group, "_part"])
    return placed.withColumn(name, F.col("_seq") + F.col("_shift")).select(*df.columns, name)
