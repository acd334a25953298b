"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ranking import ranked

# Splits of an itemset are numbered in steps of two to this.
SPLIT_BITS = 12


def transactions(
    lines: DataFrame, basket: str, item: str, min_support: float
) -> DataFrame:
    """Baskets for mining, without the items too rare to be in any itemset.

    For large catalogues: pruning comes before the arrays are built, so an
    array holds at most the frequent items, whose number is bounded by
    ``average basket / min_support`` and not by the catalogue. Baskets left
    empty stay, since support is relative to the number of all baskets.
    """
    n = lines.agg(F.count_distinct(basket)).scalar()
    counted = lines.groupBy(item).agg(F.count_distinct(basket).alias("_n"))
    frequent = counted.where(F.col("_n") >= F.ceil(F.lit(float(min_support)) * n)).select(
        item, F.col(item).alias("_frequent")
    )
    return (
        lines.select(basket, item)
        .join(frequent, item, "left")
        .groupBy(basket)
        .agg(F.array_sort(F.collect_set("_frequent")).alias("items"))
    )


def mine(
    baskets: DataFrame,
    min_support: float = 0.0005,
    min_confidence: float = 0.0,
    num_partitions: int | None = None,
) -> FPGrowthModel:
    """FP-Growth over a table with an ``items`` array of distinct items."""
    growth = FPGrowth(minSupport=min_support, minConfidence=min_confidence, itemsCol="items")
    if num_partitions:
        growth = growth.setNumPartitions(num_partitions)
    return growth.fit(baskets.select("items"))


def frequent_itemsets(model: FPGrowthModel) -> DataFrame:
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")


def single_rules(model: FPGrowthModel) -> DataFrame:
    """Rules with one consequent: antecedent, consequent, confidence, lift, support."""
    return model.associationRules.withColumn("antecedent", F.array_sort("antecedent"))


def _splits(itemsets: DataFrame) -> DataFrame:
    """Every way to cut an itemset into two non-empty sides.

    An itemset of k items has ``2**k - 2`` splits. The high and low bits of
    their numbers are exploded one after the other, the high ones dealt out in
    between, so that a long itemset never becomes one long array.
    """
    size = F.size("items")
    one = F.lit(1).cast("bigint")
    power = lambda bits: F.call_function("shiftleft", one, bits)
    low = F.least(size, F.lit(SPLIT_BITS))
    high = itemsets.where(size >= 2).select(
        "items", "freq", F.explode(F.sequence(one - 1, power(size - low) - 1)).alias("_high")
    )
    if itemsets.where(size > SPLIT_BITS).limit(1).count():
        high = high.repartition("items", "_high")
    numbers = F.sequence(one - 1, power(low) - 1)
    cut = high.select("items", "freq", "_high", F.explode(numbers).alias("_low")).select(
        "items", "freq", (F.col("_high") * power(low) + F.col("_low")).alias("_way")
    ).where((F.col("_way") > 0) & (F.col("_way") < power(size) - 1))

    def chosen(bit: int):
        return F.filter(
            F.col("items"),
            lambda x, i: F.call_function("shiftright", F.col("_way"), i).bitwiseAND(
                F.lit(1).cast("bigint")
            ) == bit,
        )

    return cut.select(
        "freq", size.alias("_k"), chosen(1).alias("antecedent"), chosen(0).alias("consequent")
    )


def all_split_rules(itemsets: DataFrame, n_baskets: int, min_confidence: float = 0.1) -> DataFrame:
    """Rules with any split of a frequent itemset.

    The confidence filter runs after the first lookup, so only surviving rules
    take part in the second one.
    """
    n = F.lit(float(n_baskets))
    known = itemsets.select(F.col("items").alias("_key"), F.col("freq").alias("_freq"))
    with_antecedent = (
        _splits(itemsets)
        .join(known, F.col("antecedent") == F.col("_key"))
        .withColumn("confidence", F.col("freq") / F.col("_freq"))
        .where(F.col("confidence") >= min_confidence)
        .withColumnRenamed("_freq", "_freq_a")
        .drop("_key")
    )
    with_both = with_antecedent.join(known, F.col("consequent") == F.col("_key"))
    support = F.col("freq") / n
    support_a = F.col("_freq_a") / n
    support_c = F.col("_freq") / n
    return with_both.select(
        "antecedent",
        "consequent",
        "confidence",
        (F.col("confidence") / support_c).alias("lift"),
        support.alias("support"),
        (support - support_a * support_c).alias("leverage"),
        F.when(F.col("freq") != F.col("_freq_a"), (1 - support_c) / (1 - F.col("confidence"))).alias(
            "conviction"
        ),
    )


def strict_rules(
    rules: DataFrame,
    min_support: float = 0.1,
    min_confidence: float = 0.2,
    min_lift: float = 3.0,
    min_length: int = 2,
) -> DataFrame:
    """Rules above all four limits."""
    return rules.where(
        (F.col("support") >= min_support)
        & (F.col("confidence") >= min_confidence)
        & (F.col("lift") >= min_lift)
        & (F.size("antecedent") + F.size("consequent") >= min_length)
    )


def rules_for_products(rules: DataFrame, products: DataFrame, product: str = "product") -> DataFrame:
    """For a table of products, the rules that have the product on the left, by falling confidence.

    ``rule_rank`` orders the rules of a product; ties go by antecedent, then consequent.
    """
    by_item = rules.select("*", F.explode("antecedent").alias(product))
    found = by_item.join(products.select(product).distinct(), product)
    return ranked(found, [product], [F.desc("confidence"), F.asc("antecedent"), F.asc("consequent")], "rule_rank")


def rules_for_baskets(
    rules: DataFrame, queries: DataFrame, threshold: float, query: str = "query", items: str = "items"
) -> DataFrame:
    """Rules whose left side holds all items of the query basket.

    Equal queries are answered once. Each looks rules up by its rarest item
    only, then checks full containment. A query without items matches every
    rule; it is spread over the salts of the rules instead of one key.
    """
    salts = 32
    strong = rules.where(F.col("confidence") >= threshold).select(
        "antecedent", "consequent", "confidence"
    )
    by_item = strong.select("*", F.explode("antecedent").alias("_key"))
    weight = by_item.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))

    asked = queries.select(query, F.array_sort(F.array_distinct(items)).alias("_wanted"))
    wanted = asked.select("_wanted").distinct()
    probes = wanted.select("_wanted", F.explode("_wanted").alias("_key"))
    # An item in no rule rules the query out: it gets weight 0 and joins nothing.
    rarest = (
        probes.join(weight, "_key", "left")
        .groupBy("_wanted")
        .agg(F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), F.col("_key"))).alias("_key"))
    )
    found = rarest.join(by_item, "_key").where(
        F.size(F.array_except("_wanted", "antecedent")) == 0
    ).select("_wanted", "antecedent", "consequent", "confidence")

    empty = wanted.where(F.size("_wanted") == 0).select(
        "_wanted", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    salted = strong.withColumn("_salt", F.pmod(F.hash("antecedent", "consequent"), F.lit(salts)))
    everything = empty.join(salted, "_salt").select("_wanted", "antecedent", "consequent", "confidence")

    # An item may be in a third of all rules: rank without a task per query.
    order = [F.desc("confidence"), F.asc("antecedent"), F.asc("consequent")]
    placed = ranked(found.unionByName(everything), ["_wanted"], order, "rule_rank")
    return asked.join(placed, "_wanted").select(
        query, F.col("consequent").alias("products"), "confidence", "rule_rank"
    )


def name_rules(rules: DataFrame, names: DataFrame, item: str = "id", name: str = "name") -> DataFrame:
    """Add the product names of both sides, in the order of the items."""
    keyed = rules.withColumn("_rule", F.struct("antecedent", "consequent"))

    def side(column: str, out: str) -> DataFrame:
        rows = keyed.select("_rule", F.posexplode(column).alias("_pos", "_item"))
        named = rows.join(names.select(F.col(item).alias("_item"), F.col(name).alias("_name")), "_item", "left")
        return named.groupBy("_rule").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_pos", "_name"))), lambda e: e["_name"]
            ).alias(out)
        )

    return (
        keyed.join(side("antecedent", "antecedent_names"), "_rule")
        .join(side("consequent", "consequent_names"), "_rule")
        .drop("_rule")
    )
