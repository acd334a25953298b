"""Order documents: JSON, paged feeds with markers, and basket tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom import schemas


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders from JSON: one object per line, or a one-line array per file line."""
    return spark.read.schema(schemas.ORDER).json(path)


def read_order_feed(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Orders from arrays that also hold bare numbers (page markers).

    Each line is one array, so a file splits over tasks. ``whole_file`` is for
    a legacy array spread over several lines: then one file is one task.
    """
    raw = spark.read.text(path, wholetext=whole_file)
    return parse_order_feed(raw, "value")


def parse_order_feed(raw: DataFrame, column: str) -> DataFrame:
    elements = raw.select(F.explode(F.from_json(F.col(column), "array<string>")).alias("element"))
    return (
        elements.select(F.from_json("element", schemas.ORDER).alias("o"))
        .where(F.col("o.id").isNotNull())
        .select("o.*")
    )


def write_orders(orders: DataFrame, path: str, mode: str = "overwrite") -> None:
    orders.write.mode(mode).json(path)


def write_order_feed(orders: DataFrame, page: str, path: str) -> None:
    """One array per page, led by the page number; pages are small by definition."""
    bodies = orders.select(
        F.col(page).alias("page"), F.to_json(F.struct("id", "clientTel", "basket")).alias("body")
    )
    text = bodies.groupBy("page").agg(F.array_sort(F.collect_list("body")).alias("bodies")).select(
        F.concat(
            F.lit("["), F.col("page").cast("string"), F.lit(","),
            F.array_join("bodies", ","), F.lit("]"),
        ).alias("value")
    )
    text.write.text(path)


def write_baskets(baskets: DataFrame, path: str) -> None:
    baskets.write.mode("overwrite").parquet(path)


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
