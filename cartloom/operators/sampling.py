"""Random samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.operators.ranking import ranked
from cartloom.session import settle

# Up to so many rows, each task keeps its least ones in a heap and the driver merges them.
HEAP_ROWS = 100_000

# Two multipliers and a prime that spread the draws.
FIRST, SECOND, PRIME = 48_271, 69_621, (1 << 31) - 1


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` random rows without replacement (a top-k by a seeded random number)."""
    return df.withColumn("_u", F.rand(seed)).orderBy("_u").limit(n).drop("_u")


def sample_with_replacement(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def draw(df: DataFrame, order: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` draws with replacement: the rows, and ``draw`` from 0 to n - 1.

    Draw j takes the row whose place by ``order`` is a hash of j and the seed
    modulo the number of rows, so the same draws come out anywhere. An empty
    table gives no draws.
    """
    placed = settle(ranked(df, [], list(order), "_place"), "placed")
    total = placed.count()
    if not total:
        return df.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    # The square between two congruences breaks up their even steps.
    spread = (F.col("draw") + seed + 1) * FIRST % PRIME
    number = spread * spread % PRIME * SECOND % PRIME % total
    wanted = df.sparkSession.range(n).select(F.col("id").alias("draw"), (number + 1).cast("bigint").alias("_place"))
    return wanted.join(placed, "_place").drop("_place")


def exact_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` different rows (all, if there are fewer), the same however the table is partitioned.

    Rows are ordered by a hash of the seed and their key, then by the key; the
    least ``n`` are taken in one pass. A larger sample counts the rows by the first
    digits of the hash, keeps all rows of lower digits, and orders only those of the digits
    where the n-th row lies. Keys should tell rows apart; of rows with equal keys any may be taken.
    """
    parts = [F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)]
    drawn = df.withColumn("_hash", F.md5(F.concat_ws("|", *parts)))
    order = ["_hash", *key]
    if n <= HEAP_ROWS:
        return drawn.orderBy(*order).limit(n).drop("_hash")
    head = F.substring("_hash", 1, 4)
    counted = drawn.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    # 65,536 rows at most.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = counted.select("_head", "_n", before.alias("_before")).where(F.col("_before") < n)
    cut = place.orderBy(F.desc("_head")).first()
    if cut is None:
        return df.limit(0)
    whole = drawn.where(head < cut["_head"])
    last = ranked(drawn.where(head == cut["_head"]), [], order, "_place").where(F.col("_place") <= n - cut["_before"])
    return whole.unionByName(last.drop("_place")).drop("_hash")
