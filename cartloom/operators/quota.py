"""Admission of logged requests against a quota per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ranking import ranked

# Response codes.
ALLOWED, UNKNOWN_KEY, OVER_QUOTA = 200, 401, 403


def admit_requests(log: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """The log with a ``status``: 200 within the quota, 403 beyond, 401 for unknown keys.

    A refused request doesn't count, so the place of a request among its key's
    requests decides. Keys whose whole log fits need no ranking; the others
    are ranked without gathering a key in one task.
    """
    left = ledger.select("api_key", (F.col("quota") - F.col("requests_done")).alias("_left"))
    totals = log.groupBy("api_key").agg(F.count(F.lit(1)).alias("_n"))
    plan = totals.join(left, "api_key", "left").select(
        "api_key",
        "_left",
        F.when(F.col("_left").isNull(), UNKNOWN_KEY)
        .when(F.col("_n") <= F.col("_left"), ALLOWED)
        .when(F.col("_left") <= 0, OVER_QUOTA)
        .alias("_all"),
    )
    decided = plan.where(F.col("_all").isNotNull())
    open_ = plan.where(F.col("_all").isNull())
    whole = log.join(decided, "api_key").withColumn("status", F.col("_all"))
    placed = ranked(log.join(open_, "api_key"), ["api_key"], order, "_place").withColumn(
        "status", F.when(F.col("_place") <= F.col("_left"), ALLOWED).otherwise(OVER_QUOTA)
    )
    return whole.select(*log.columns, "status").unionByName(placed.select(*log.columns, "status"))


def settle_ledger(ledger: DataFrame, admitted: DataFrame) -> DataFrame:
    """The ledger after a batch: served requests are added, refused ones aren't."""
    served = admitted.where(F.col("status") == ALLOWED).groupBy("api_key").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return ledger.join(served, "api_key", "left").select(
        "api_key", "quota", (F.col("requests_done") + F.coalesce("_n", F.lit(0))).alias("requests_done")
    )
