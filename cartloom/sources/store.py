"""Lookup stores: a table bucketed by a key, of which a lookup reads the key's buckets only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions import phones

BUCKETS = 64


def write_store(df: DataFrame, table: str, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Save ``df`` under ``path`` as the table ``table``, bucketed and sorted by ``key``.

    Rows are dealt by the key first, so a bucket is one file and not one for each task.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def open_store(spark: SparkSession, table: str, path: str, schema: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A store that another session has written: the table is declared again over its files."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def lookup(store: DataFrame, key: str, values: Iterable) -> DataFrame:
    """The rows of a few keys. Only their buckets are read, and in those the row groups that may hold them."""
    return store.where(F.col(key).isin(list(values)))


def lookup_phones(store: DataFrame, raw: Iterable[str], key: str = "tel_hashed") -> DataFrame:
    """The rows of a few phone numbers as they were typed, with ``phone``."""
    spark = store.sparkSession
    asked = spark.createDataFrame([(p,) for p in raw], "phone string").distinct()
    keyed = asked.withColumn(key, phones.hash_user(phones.clean_phone(F.col("phone")))).where(F.col(key).isNotNull())
    wanted = {row[key] for row in keyed.select(key).collect()}
    return lookup(store, key, sorted(wanted)).join(F.broadcast(keyed), key)
