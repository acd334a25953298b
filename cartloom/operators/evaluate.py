"""Hold-out measures of the recommenders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.cosine import target_ranks
from cartloom.operators.nearest import nearest_basket, recommend_for_baskets
from cartloom.session import settle


def _ends(lines: DataFrame, order: list[str]) -> DataFrame:
    """Per basket with two lines or more: its first and last line position and item."""
    place = F.struct(*order)
    return (
        lines.groupBy("basket_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(place).alias("first_place"),
            F.max(place).alias("last_place"),
            F.min_by("item", place).alias("first_item"),
            F.max_by("item", place).alias("last_item"),
        )
    )


def hit_rate(
    held_out: DataFrame, stored: DataFrame, similarity: DataFrame, order: list[str], k: int = 10
) -> DataFrame:
    """``n, hits, hit_rate``: is the last item among k recommendations for the others?

    ``held_out`` and ``stored`` (lines ``basket_id, item`` with the order
    columns) must not share baskets, and ``similarity`` must stem from
    ``stored`` only.
    """
    ends = _ends(held_out, order).where(F.col("n") >= 2)
    known = (
        held_out.join(ends.select("basket_id", "last_place"), "basket_id")
        .where(F.struct(*order) < F.col("last_place"))
        .select(F.col("basket_id").alias("query_id"), "item")
    )
    offered = recommend_for_baskets(known, stored, similarity, k).select(
        F.col("query_id").alias("basket_id"), F.col("item").alias("last_item"), F.lit(1).alias("hit")
    )
    tried = ends.select("basket_id", "last_item").join(offered, ["basket_id", "last_item"], "left")
    return tried.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("hit").alias("hits"),
        F.avg(F.coalesce(F.col("hit"), F.lit(0)).cast("double")).alias("hit_rate"),
    )


def rank_positions(
    held_out: DataFrame, stored: DataFrame, similarity: DataFrame, order: list[str]
) -> DataFrame:
    """``basket_id, target, pos``: 0-based places of the other items when asked by the first.

    A target listed several times in its basket is there as often.
    """
    ends = _ends(held_out, order).where(F.col("n") >= 2)
    first = ends.select(F.col("basket_id").alias("query_id"), F.col("first_item").alias("item"))
    targets = (
        held_out.join(ends.select("basket_id", "first_place"), "basket_id")
        .where(F.struct(*order) > F.col("first_place"))
        .select("basket_id", F.col("item").alias("target"))
    )
    near = settle(nearest_basket(first, stored).select(F.col("query_id").alias("basket_id"), F.col("basket_id").alias("u")), "nearest")
    wanted = settle(targets.join(near, "basket_id").withColumnRenamed("target", "i"), "wanted")
    # Many queries share a nearest basket and a target: each such pair is placed once.
    asked = wanted.select("u", "i").distinct()
    served = stored.select(F.col("basket_id").alias("u"), F.col("item").alias("i")).join(asked, "u", "left_semi").distinct()
    places = target_ranks(settle(served, "served"), settle(asked, "asked"), similarity)
    return wanted.join(places, ["u", "i"]).select("basket_id", F.col("i").alias("target"), (F.col("rnk") - 1).cast("int").alias("pos"))


def rule_hits(baskets: DataFrame, rules: DataFrame, order: list[str]) -> DataFrame:
    """``basket_id, hit``: does a rule of the first item lead to another item of the basket?

    Rules shrink to distinct (left item, right item) edges, and each basket
    line looks up one edge, so no rule list is built per basket.
    """
    edges = (
        rules.select(F.explode("antecedent").alias("first_item"), "consequent")
        .select("first_item", F.explode("consequent").alias("item"))
        .distinct()
    )
    ends = _ends(baskets, order)
    others = baskets.join(ends.select("basket_id", "first_place", "first_item"), "basket_id").where(
        F.struct(*order) > F.col("first_place")
    )
    hits = others.join(edges, ["first_item", "item"], "left_semi").select("basket_id").distinct()
    return ends.select("basket_id").join(hits.withColumn("hit", F.lit(1)), "basket_id", "left").select(
        "basket_id", F.coalesce("hit", F.lit(0)).alias("hit")
    )
