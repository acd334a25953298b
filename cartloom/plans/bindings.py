"""The given tables seen as orders, lines, catalogue, categories and request log.

Every attribute the model needs and the tables lack is derived from a column
of theirs; whole tables are used throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.sources import tables

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]

# Baskets from this day on are held out of training.
HOLD_OUT_FROM = "2000-01-01"

FORMS = '{"ECONOMY": ["ECONOMY", "PROMO"], "PROMO": ["PROMO", "ECONOMY"], ' \
    '"SMALL": ["MEDIUM"], "MEDIUM": ["SMALL"], "LARGE": ["LARGE"]}'


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def phone() -> Column:
    """A phone per customer, spelled differently by order priority."""
    n = F.lpad(F.col("o_custkey").cast("string"), 12, "0")
    part = lambda a, b: F.substring(n, a, b)
    first = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(first == "1", F.concat(F.lit("+7 (9"), part(1, 2), F.lit(") "), part(3, 4), F.lit("-"), part(7, 6)))
        .when(first == "2", F.concat(F.lit("8-9"), part(1, 2), F.lit("-"), part(3, 4), F.lit("-"), part(7, 6)))
        .otherwise(F.concat(F.lit("79"), n))
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """id, clientTel, customer, day"""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        phone().alias("clientTel"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("day"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """basket_id, goods_id, item, quantity, signed quantity and the line order columns"""
    li = table(spark, folder, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return li.select(
        F.col("l_orderkey").alias("basket_id"),
        F.col("l_partkey").alias("goods_id"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("quantity"),
        (sign * F.col("l_quantity")).alias("signed"),
        "l_returnflag",
        *LINE_ORDER,
    )


def customer_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lines with the customer and phone of their order"""
    return lines(spark, folder).join(
        orders(spark, folder).withColumnRenamed("id", "basket_id"), "basket_id"
    )


def brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lines whose item is the brand of the product"""
    brands = table(spark, folder, "part").select(
        F.col("p_partkey").alias("goods_id"), F.col("p_brand").alias("brand")
    )
    return lines(spark, folder).drop("item").join(brands, "goods_id")


def nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order documents; an order without lines has a NULL basket."""
    li = table(spark, folder, "lineitem")
    goods = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("l_partkey").alias("goodsId"), F.col("l_quantity").alias("quantity")))
        ).alias("basket")
    )
    return orders(spark, folder).select("id", "clientTel").join(goods, "id", "left")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    code = F.concat(F.substring("p_type", 1, 1), F.lpad(size.cast("string"), 2, "0"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_name").alias("normalized_name"),
        F.when(size <= 37, F.col("p_name")).alias("tradeName"),
        F.col("p_type").alias("medForm"),
        F.col("p_brand").alias("company_name"),
        F.when(size > 10, code).alias("atx"),
    )


def form_map(spark: SparkSession) -> DataFrame:
    """The form equivalences, a JSON object by nature."""
    raw = spark.range(1).select(F.lit(FORMS).alias("value"))
    return tables.parse_lookup(raw, "value", "array<string>", "form", "equal_form")


def code_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Plural product names with the least code of the product name."""
    coded = catalogue(spark, folder).where(F.col("atx").isNotNull())
    return coded.groupBy("name").agg(F.min("atx").alias("atx")).select(
        F.concat("name", F.lit("s")).alias("name"), "atx"
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """nation -> region -> one root; the region AFRICA has no parent"""
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("R"), "n_regionkey").alias("parentId"),
    )
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("R"), "r_regionkey").alias("id"),
        F.col("r_name").alias("name"),
        F.when(F.col("r_name") != "AFRICA", F.lit("ROOT")).alias("parentId"),
    )
    root = table(spark, folder, "region").select(
        F.lit("ROOT").alias("id"), F.lit("WORLD").alias("name"), F.lit(None).cast("string").alias("parentId")
    ).distinct()
    return nations.unionByName(regions).unionByName(root)


def goods(spark: SparkSession, folder: str) -> DataFrame:
    """customers as goods; those in debt have no category"""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("manufacturer"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("N"), "c_nationkey")).alias("siteCatId"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("api_key"), "ts", "event_id"
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A quota per customer; those of one market segment have no key"""
    return table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").cast("string").alias("api_key"),
        (50 + F.col("c_nationkey")).cast("bigint").alias("quota"),
        (F.col("c_nationkey") / 2).cast("bigint").alias("requests_done"),
    )


def history_and_holdout(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """lines before and from the hold-out day; disjoint baskets by construction"""
    dated = customer_lines(spark, folder)
    day = F.to_date(F.lit(HOLD_OUT_FROM))
    return dated.where(F.col("day") < day), dated.where(F.col("day") >= day)
