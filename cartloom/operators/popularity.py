"""Item popularity and the baskets that hold popular items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.operators.ranking import ranked


def popularity(*sources: DataFrame, item: str = "goods_id", quantity: str = "quantity") -> DataFrame:
    """Whole units per item over all sources; an item of any source appears."""
    both = None
    for src in sources:
        part = src.select(F.col(item).alias("goods_id"), F.col(quantity).cast("bigint").alias("_q"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("goods_id").agg(F.sum("_q").alias("qty"))


def top_items(popular: DataFrame, k: int) -> DataFrame:
    """The k most popular items with their rank; only these k rows are ranked."""
    head = popular.orderBy(F.desc("qty"), "goods_id").limit(k)
    return head.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("qty"), "goods_id")))


def distinct_products(lines: DataFrame, item: str = "goods_id", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return lines.agg(count(item).alias("n"))


def popular_baskets(
    lines: DataFrame,
    popular: DataFrame,
    basket: str = "basket_id",
    item: str = "goods_id",
    more_than: int = 2,
    distinct: bool = True,
) -> DataFrame:
    """All lines of baskets with more than ``more_than`` popular items.

    ``distinct`` counts different items, otherwise lines. ``popular`` is a
    top-k table, so Spark broadcasts it by its measured size.
    """
    hits = lines.select(basket, item).join(popular.select(F.col("goods_id").alias(item)), item, "left_semi")
    measure = F.count_distinct(item) if distinct else F.count(F.lit(1))
    kept = hits.groupBy(basket).agg(measure.alias("_n")).where(F.col("_n") > more_than)
    return lines.join(kept.select(basket), basket, "left_semi")


def numbered_receipts(lines: DataFrame, basket: str = "basket_id") -> DataFrame:
    """Replace basket keys by -1, -2, ... in key order."""
    numbers = ranked(lines.select(basket).distinct(), [], [basket], "_no").select(
        basket, (-F.col("_no")).alias("receipt_number")
    )
    return lines.join(numbers, basket).drop(basket)


def dataset_counts(lines: DataFrame, basket: str) -> DataFrame:
    return lines.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(basket).alias("n_receipts")
    )
