import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cartloom.plans.checks import CHECKS
from cartloom.plans.queries import REGISTRY

ROOT = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import rows_of  # noqa: E402

# Each stands for one family; tools/compare.py runs all of them at a larger scale.
SAMPLE = [
    "orders_feed_clean", "sales_tsv_roundtrip", "phone_hash", "baskets_net", "popularity_topk",
    "rules_single", "item_cosine", "nearest_basket", "similar_by_code", "similar_diversified",
    "category_path_export", "page_links", "quota_admission", "rules_strict", "rules_for_product",
    "eval_rank_positions", "similar_products_requests", "code_enrichment_weighted", "sample_products",
    "recommend_last_trial", "recommend_with_substitutes", "ratings_by_phone", "wide_baskets_csv", "siblings_as_json",
    "page_panel_fields", "sample_orders", "ledger_after_batch", "popular_list_roundtrip",
]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) == set(CHECKS)


@pytest.mark.skipif(not ROOT.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in ROOT.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = entry.queries()[name](spark, str(ROOT))
    cur = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall()) != Counter()
