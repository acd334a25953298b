"""Ranks that don't need a whole group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.session import settle


def ranked(
    df: DataFrame, group: list[str], order: list[str | Column], name: str = "rank"
) -> DataFrame:
    """1-based rank of every row inside its group, exact for groups of any size.

    Rows are range-partitioned on (group, order), so a hot group spans many
    partitions. Each partition ranks its own slice; the slices of a group
    then get the number of rows before them. The slice counts hold at most
    one row per group and partition. ``order`` must be total in a group.
    """
    placed = settle(
        df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()),
        "ranked",
    )
    counts = placed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        # One row per partition of the job: small whatever the data size.
        earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    local = placed.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    )
    return (
        local.join(offsets, [*group, "_slice"])
        .withColumn(name, (F.col("_pos") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_pos", "_before")
    )
