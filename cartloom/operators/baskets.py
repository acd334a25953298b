"""Orders to lines, transactions, ratings and padded baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions import phones


def clean_orders(orders: DataFrame, phone: str = "clientTel") -> DataFrame:
    """Add the digits of the phone and the integer user key."""
    return orders.withColumn("digits", phones.clean_phone(F.col(phone))).withColumn(
        "tel_hashed", phones.hash_user(F.col("digits"))
    )


def dedupe_orders(
    orders: DataFrame, key: str = "id", prefer: list[str] | None = None
) -> DataFrame:
    """One row per key. With ``prefer`` the least row by these columns, else any.

    An aggregate, not a ranking: copies of a hot key collapse before the shuffle.
    """
    if prefer is None:
        return orders.dropDuplicates([key])
    rest = [c for c in orders.columns if c != key]
    picked = orders.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*prefer)).alias("_row")
    )
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in orders.columns])


def basket_lines(orders: DataFrame, *keep: str) -> DataFrame:
    """One row per basket entry; empty and NULL baskets give no row."""
    return orders.select("id", *keep, F.explode("basket").alias("p")).select(
        "id", *keep, F.col("p.goodsId").alias("goods_id"), F.col("p.quantity").alias("quantity")
    )


def baskets(lines: DataFrame, basket: str = "id", item: str = "goods_id") -> DataFrame:
    """Distinct items per basket as a sorted array (transactions for mining)."""
    return lines.groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("items"))


def net_items(lines: DataFrame, basket: str, item: str, quantity: str) -> DataFrame:
    """(basket, item) pairs whose summed quantity is at least one unit."""
    return (
        lines.groupBy(basket, item)
        .agg(F.sum(quantity).alias("_net"))
        .where(F.col("_net") >= 1)
        .drop("_net")
    )


def baskets_net(lines: DataFrame, basket: str, item: str, quantity: str) -> DataFrame:
    """Transactions of the items not cancelled by returns."""
    return baskets(net_items(lines, basket, item, quantity), basket, item)


def encode_units(net: Column) -> Column:
    """0 for nothing or less, 1 for a unit or more, NULL strictly between."""
    return F.when(net <= 0, F.lit(0)).when(net >= 1, F.lit(1))


def one_hot(
    lines: DataFrame, basket: str, item: str, quantity: str, values: list[str]
) -> DataFrame:
    """Basket x item matrix of 0/1 for a small, listed item domain."""
    wide = lines.groupBy(basket).pivot(item, values).agg(F.sum(quantity)).na.fill(0.0, subset=values)
    return wide.select(basket, *[encode_units(F.col(f"`{v}`")).alias(v) for v in values])


def implicit_ratings(
    lines: DataFrame, user: str = "tel_hashed", item: str = "goods_id", quantity: str = "quantity"
) -> DataFrame:
    """Total quantity per (user, item)."""
    return lines.groupBy(user, item).agg(F.sum(quantity).alias("purchases"))


def basket_item_counts(lines: DataFrame, basket: str, item: str, quantity: str) -> DataFrame:
    """Whole units per (basket, item) and the presence flag used for training."""
    units = F.sum(F.col(quantity).cast("bigint")).alias("purchase_count")
    return lines.groupBy(basket, item).agg(units).withColumn("purchase_dummy", F.lit(1))


def ordered_items(lines: DataFrame, basket: str, item: str, order: list[str]) -> DataFrame:
    """Items of each basket in line order, repeats kept."""
    return lines.groupBy(basket).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))),
            lambda e: e["_item"],
        ).alias("items")
    )


def padded(ordered: DataFrame, pad: int = -1) -> DataFrame:
    """Arrays of one width, that of the longest basket."""
    width = ordered.agg(F.max(F.size("items"))).scalar()
    return ordered.withColumn(
        "items", F.concat("items", F.array_repeat(F.lit(pad).cast("bigint"), width - F.size("items")))
    )


def padded_wide(padded_baskets: DataFrame, basket: str, width: int) -> DataFrame:
    """Columns ``prod0 ... prodN-1`` for export."""
    return padded_baskets.select(
        basket, *[F.get("items", F.lit(i)).alias(f"prod{i}") for i in range(width)]
    )


def returning_ratio(orders: DataFrame, user: str) -> DataFrame:
    """Distinct users over orders; orders without a user count as one more user."""
    has_null = F.max(F.when(F.col(user).isNull(), 1).otherwise(0))
    return orders.agg(
        ((F.count_distinct(user) + has_null) / F.count(F.lit(1))).alias("ratio")
    )
