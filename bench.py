"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each
query runs once into a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from cartloom.operators import baskets, mining
from cartloom.plans import bindings
from cartloom.plans.queries import REGISTRY
from cartloom.session import build_session

HEADLINE = [
    "popularity_topk", "baskets", "implicit_ratings", "phone_hash", "quota_admission",
    "popular_baskets_distinct", "frequent_itemsets", "rules_single", "rules_all_splits",
    "rules_for_basket", "item_cosine", "item_cosine_recommend", "nearest_basket",
    "recommend_with_fallback", "als_topn", "similar_by_code", "similar_fuzzy",
    "fuzzy_token_set_pairs", "code_enrichment", "eval_leave_last_out", "eval_rank_positions", "similar_products", "similar_count_stats", "category_path_export",
    "page_links", "orders_stream_ingest",
]


def itemsets_low_support(spark, folder):
    """FP-Growth and single rules at the low support the models were trained with."""
    lines = bindings.brand_lines(spark, folder)
    made = baskets.baskets(lines, "basket_id", "brand")
    return mining.single_rules(mining.mine(made, 0.0005, 0.1))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        # The tables are far below a useful partition size; keep all cores busy.
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    todo = {name: REGISTRY[name] for name in HEADLINE}
    todo["itemsets_low_support"] = itemsets_low_support
    seconds: dict[str, float] = {}
    for name, run in todo.items():
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
