"""Flat files: catalogues, till sales, rule exports, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom import schemas
from cartloom.functions import text


def read_csv(spark: SparkSession, path: str, schema: str, index: bool = False) -> DataFrame:
    """CSV with a header. ``index`` drops an unnamed leading row-number column."""
    if index:
        return spark.read.schema("`_index` BIGINT, " + schema).csv(
            path, header=True, enforceSchema=True
        ).drop("_index")
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs become JSON text first."""
    def flat(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        return (F.to_json(field.name) if nested else F.col(field.name)).alias(field.name)

    df.select(*[flat(f) for f in df.schema.fields]).write.mode("overwrite").csv(path, header=True)


def read_till_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TILL_SALES).csv(path, sep="\t")


def write_till_sales(sales: DataFrame, path: str) -> None:
    sales.write.mode("overwrite").csv(path, sep="\t", header=False)


def parse_lookup(raw: DataFrame, column: str, value_type: str, key: str, value: str) -> DataFrame:
    """JSON objects as text to a two-column table; array values become one row each."""
    pairs = raw.select(
        F.explode(F.from_json(F.col(column), f"map<string,{value_type}>")).alias(key, "_v")
    )
    if value_type.startswith("array"):
        return pairs.select(key, F.explode("_v").alias(value))
    return pairs.select(key, F.col("_v").alias(value))


def read_lookup(
    spark: SparkSession, path: str, value_type: str, key: str = "key", value: str = "value"
) -> DataFrame:
    """A lookup file holding one JSON object (its size is one file by nature)."""
    return parse_lookup(spark.read.text(path, wholetext=True), "value", value_type, key, value)


def write_rules_text(rules: DataFrame, path: str) -> None:
    """Rules with both sides in set text form."""
    write_csv(
        rules.select(
            text.set_text(F.col("antecedent")).alias("antecedents"),
            text.set_text(F.col("consequent")).alias("consequents"),
            "confidence", "lift", "support",
        ),
        path,
    )


def read_rules_text(spark: SparkSession, path: str) -> DataFrame:
    rules = read_csv(spark, path, schemas.RULES_TEXT)
    return rules.select(
        text.parse_set_text(F.col("antecedents")).alias("antecedent"),
        text.parse_set_text(F.col("consequents")).alias("consequent"),
        "confidence", "lift", "support",
    )


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row; NULL fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def json_array(df: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """One JSON array of documents per key, for answering a table of requests."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.collect_list(F.struct(*rest))).alias(name))


def write_popular(popular: DataFrame, path: str) -> None:
    """The popular list ``item, rank``, best first in one file: it is a short top list."""
    popular.orderBy("rank").coalesce(1).write.mode("overwrite").parquet(path)


def read_popular(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POPULAR).parquet(path)


def profile(spark: SparkSession, df: DataFrame, view: str, sql: str) -> DataFrame:
    """Run SQL text against ``df`` under a temporary view name."""
    df.createOrReplaceTempView(view)
    return spark.sql(sql)


def preview(df: DataFrame, n: int = 5):
    """A few rows as pandas, for looking at a result."""
    return df.limit(n).toPandas()
