"""The registered queries. Each takes (spark, folder) and reads the given tables whole."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom import schemas
from cartloom.functions import phones, text
from cartloom.operators import (
    als, baskets, catalog, cosine, evaluate, fuzzy, mining, nearest, pages, popularity, quota,
    sampling, similar,
)
from cartloom.plans import bindings as b
from cartloom.session import keep, scratch_path, settle
from cartloom.sources import models, orders, store, tables
from cartloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SUPPORT, CONFIDENCE = 0.005, 0.1
PART_SUPPORT = 0.00015


def registered(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def text_of(items: str | Column) -> Column:
    col = F.col(items) if isinstance(items, str) else items
    return F.array_join(col.cast("array<string>"), ",")


def six(name: str) -> Column:
    return F.round(name, 6).alias(name)


# --- sources and sinks -------------------------------------------------------------------


@registered
def orders_json_roundtrip(spark, d):
    path = scratch_path(spark, "orders-json")
    orders.write_orders(b.nested_orders(spark, d), path)
    lines = baskets.basket_lines(orders.read_orders(spark, path))
    return lines.withColumnRenamed("goods_id", "goodsId")


@registered
def orders_feed_clean(spark, d):
    path = scratch_path(spark, "orders-feed")
    paged = b.nested_orders(spark, d).withColumn("page", F.floor(F.col("id") / 100))
    orders.write_order_feed(paged, "page", path)
    found = orders.read_order_feed(spark, path)
    return found.where(F.col("basket").isNotNull()).select(
        "id", F.size("basket").cast("bigint").alias("n_lines")
    )


@registered
def catalog_csv_roundtrip(spark, d):
    path = scratch_path(spark, "catalogue")
    tables.write_csv(b.catalogue(spark, d), path)
    return tables.read_csv(spark, path, schemas.CATALOGUE).select(
        "id", "normalized_name", "medForm", "atx"
    )


@registered
def sales_tsv_roundtrip(spark, d):
    path = scratch_path(spark, "sales")
    sales = b.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("Date"), "l_orderkey", "l_suppkey",
        "l_quantity", "l_partkey", "l_extendedprice",
    )
    tables.write_till_sales(sales, path)
    return tables.read_till_sales(spark, path).select("receipt_number", "goodsId", "quantity")


@registered
def rules_csv_roundtrip(spark, d):
    path = scratch_path(spark, "rules")
    number = F.regexp_extract("brand", "([0-9]+)", 1).cast("bigint").alias("item")
    numbered = b.brand_lines(spark, d).select("basket_id", number)
    tables.write_rules_text(_rules(numbered, "item"), path)
    return tables.read_rules_text(spark, path).select(
        text_of("antecedent").alias("antecedent"), text_of("consequent").alias("consequent"),
        six("confidence"),
    )


@registered
def rules_as_json(spark, d):
    doc = tables.as_json(mining.single_rules(_brand_model(spark, d)))
    value = lambda p: F.get_json_object("json", p)
    return doc.select(
        F.array_join(F.from_json(value("$.antecedent"), "array<string>"), ",").alias("antecedent"),
        value("$.consequent[0]").alias("consequent"),
        F.round(value("$.confidence").cast("double") * 1e6).cast("bigint").alias("confidence_x1e6"),
    )


@registered
def model_roundtrip(spark, d):
    path = scratch_path(spark, "itemset-model")
    models.save_model(_brand_model(spark, d), path)
    return mining.single_rules(models.load_itemset_model(path)).agg(
        F.count(F.lit(1)).alias("n_rules")
    )


@registered
def orders_stream_ingest(spark, d):
    base = scratch_path(spark, "stream")
    source, sink = f"{base}/in", f"{base}/out"
    found = b.nested_orders(spark, d)
    orders.write_orders(found, source)
    ingest.ingest_orders(spark, source, sink, f"{base}/progress").awaitTermination()
    orders.write_orders(found, source, mode="append")  # delivered again
    ingest.ingest_orders(spark, source, sink, f"{base}/progress").awaitTermination()
    return spark.read.schema(schemas.ORDER).parquet(sink).select(
        "id", "clientTel", F.coalesce(F.size("basket"), F.lit(0)).cast("bigint").alias("n_lines")
    )


@registered
def popular_list_roundtrip(spark, d):
    path = scratch_path(spark, "popular")
    tables.write_popular(_popular(spark, d, 100).select(F.col("goods_id").alias("item"), F.col("rnk").alias("rank")), path)
    return tables.read_popular(spark, path)


@registered
def stored_baskets_roundtrip(spark, d):
    path = scratch_path(spark, "baskets")
    orders.write_baskets(baskets.baskets(b.brand_lines(spark, d), "basket_id", "brand"), path)
    return orders.read_baskets(spark, path).select(F.col("basket_id").alias("id"), text_of("items").alias("items"))


@registered
def wide_baskets_csv(spark, d):
    """Padded baskets as a CSV file with a column for each place, read back."""
    path = scratch_path(spark, "wide-baskets")
    made = settle(baskets.padded(baskets.ordered_items(b.lines(spark, d), "basket_id", "item", b.LINE_ORDER)), "padded")
    width = made.agg(F.max(F.size("items"))).first()[0] or 0
    tables.write_csv(baskets.padded_wide(made, "basket_id", width), path)
    places = [f"prod{i}" for i in range(width)]
    wide = tables.read_csv(spark, path, ", ".join(["basket_id BIGINT", *(f"{c} BIGINT" for c in places)]))
    return wide.select(F.col("basket_id").alias("id"), text_of(F.array(*places)).alias("items"))


@registered
def siblings_as_json(spark, d):
    """One JSON array of substitutes for each product, as a service would answer."""
    shelf = b.catalogue(spark, d)
    answers = tables.json_array(similar.similar_by_code(shelf.select("id"), shelf, 5).select("id", "similar_id"), ["id"])
    ids = F.transform(F.from_json("json", "array<struct<similar_id: bigint>>"), lambda x: x["similar_id"])
    return answers.select("id", text_of(F.array_sort(ids)).alias("similar_ids"))


@registered
def ratings_by_phone(spark, d):
    """Purchases of the clients of twenty sampled orders, looked up by phone in a bucketed store."""
    path = scratch_path(spark, "ratings")
    name = "ratings_" + path.rpartition("-")[2]
    store.write_store(_ratings(spark, d), name, path, "tel_hashed")
    asked = sampling.exact_sample(b.orders(spark, d), ["id"], 20).select("clientTel").collect()
    found = store.lookup_phones(spark.table(name), [row.clientTel for row in asked])
    return found.select("phone", "goods_id", "purchases")


# --- cleaning ----------------------------------------------------------------------------


@registered
def phone_length_profile(spark, d):
    return tables.profile(
        spark, b.orders(spark, d), "bound_orders",
        "SELECT length(clientTel) AS len, count(*) AS n, min(clientTel) AS example "
        "FROM bound_orders GROUP BY length(clientTel)",
    )


@registered
def phone_digits(spark, d):
    return baskets.clean_orders(b.orders(spark, d)).select("id", "digits")


@registered
def phone_hash(spark, d):
    return baskets.clean_orders(b.orders(spark, d)).select("id", "tel_hashed")


@registered
def dedupe_orders(spark, d):
    first = b.orders(spark, d).select("id", F.col("clientTel").alias("client"))
    again = first.select("id", phones.clean_phone(F.col("client")).alias("client"))
    return baskets.dedupe_orders(first.unionByName(again), "id", ["client"])


@registered
def returning_customer_ratio(spark, d):
    cleaned = baskets.clean_orders(baskets.dedupe_orders(b.orders(spark, d)))
    return baskets.returning_ratio(cleaned, "digits").select(six("ratio"))


# --- baskets and aggregates --------------------------------------------------------------


@registered
def basket_lines(spark, d):
    return baskets.basket_lines(b.nested_orders(spark, d)).withColumnRenamed("goods_id", "goodsId")


def _baskets(spark, d):
    made = baskets.baskets(b.brand_lines(spark, d), "basket_id", "brand")
    return made.select(F.col("basket_id").alias("id"), text_of("items").alias("items"))


REGISTRY["baskets"] = _baskets


@registered
def baskets_net(spark, d):
    made = baskets.baskets_net(b.lines(spark, d), "basket_id", "item", "signed")
    return made.select(F.col("basket_id").alias("id"), text_of("items").alias("items"))


def _ratings(spark, d) -> DataFrame:
    return baskets.implicit_ratings(baskets.clean_orders(b.customer_lines(spark, d)))


@registered
def implicit_ratings(spark, d):
    return _ratings(spark, d)


@registered
def basket_item_counts(spark, d):
    counted = baskets.basket_item_counts(b.lines(spark, d), "basket_id", "goods_id", "quantity")
    return counted.select("basket_id", "goods_id", "purchase_count")


@registered
def basket_padded(spark, d):
    ordered = baskets.ordered_items(b.lines(spark, d), "basket_id", "item", b.LINE_ORDER)
    return baskets.padded(ordered).select(
        F.col("basket_id").alias("id"), text_of("items").alias("padded")
    )


@registered
def one_hot_basket(spark, d):
    kinds = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("goods_id"), F.lower("p_type").alias("kind")
    )
    values = ["economy", "large", "medium", "promo", "small", "standard"]
    wide = baskets.one_hot(
        b.lines(spark, d).join(kinds, "goods_id"), "basket_id", "kind", "signed", values
    )
    return wide.withColumnRenamed("basket_id", "id")


@registered
def popularity_topk(spark, d):
    return popularity.top_items(popularity.popularity(b.lines(spark, d)), 100)


@registered
def popularity_two_sources(spark, d):
    lines = b.lines(spark, d)
    till = lines.where("l_returnflag = 'R'")
    online = lines.where("l_returnflag <> 'R'")
    return popularity.popularity(online, till)


@registered
def distinct_products(spark, d):
    return popularity.distinct_products(b.lines(spark, d))


def _popular(spark, d, k) -> DataFrame:
    return popularity.top_items(popularity.popularity(b.lines(spark, d)), k)


@registered
def popular_baskets_distinct(spark, d):
    kept = popularity.popular_baskets(b.lines(spark, d), _popular(spark, d, 1000))
    return popularity.numbered_receipts(kept.select("basket_id", "goods_id"))


@registered
def popular_baskets_lines(spark, d):
    kept = popularity.popular_baskets(b.lines(spark, d), _popular(spark, d, 500), distinct=False)
    return kept.select(F.col("basket_id").alias("receipt_number"), "goods_id")


@registered
def dataset_counts(spark, d):
    kept = popularity.popular_baskets(b.lines(spark, d), _popular(spark, d, 1000))
    return popularity.dataset_counts(kept, "basket_id")


# --- itemsets and rules ------------------------------------------------------------------


def _model(lines: DataFrame, item: str, support: float = SUPPORT):
    return mining.mine(baskets.baskets(lines, "basket_id", item), support, CONFIDENCE)


def _brand_model(spark, d, support: float = SUPPORT):
    return _model(b.brand_lines(spark, d), "brand", support)


def _rules(lines: DataFrame, item: str, support: float = SUPPORT) -> DataFrame:
    n = lines.agg(F.count_distinct("basket_id")).first()[0]
    itemsets = keep(mining.frequent_itemsets(_model(lines, item, support)))
    return mining.all_split_rules(itemsets, n, CONFIDENCE)


def _sides(df: DataFrame, *measures: str) -> DataFrame:
    return df.select(
        text_of("antecedent").alias("antecedent"), text_of("consequent").alias("consequent"),
        *[six(m) for m in measures],
    )


@registered
def frequent_itemsets(spark, d):
    found = mining.frequent_itemsets(_brand_model(spark, d))
    return found.select(text_of("items").alias("items"), "freq")


@registered
def rules_single(spark, d):
    return _sides(mining.single_rules(_brand_model(spark, d)), "confidence", "lift", "support")


@registered
def rules_all_splits(spark, d):
    rules = _rules(b.brand_lines(spark, d), "brand")
    return _sides(rules, "confidence", "lift", "support", "leverage", "conviction")


@registered
def rules_strict(spark, d):
    rules = _rules(b.brand_lines(spark, d), "brand")
    return _sides(mining.strict_rules(rules, 0.01, 0.15, 1.0, 2), "confidence", "lift")


@registered
def rules_for_product(spark, d):
    brands = b.table(spark, d, "part").select(F.col("p_brand").alias("product"))
    found = mining.rules_for_products(mining.single_rules(_brand_model(spark, d)), brands)
    return found.select(
        "product", text_of("consequent").alias("consequent"),
        text_of("antecedent").alias("antecedent"), six("confidence"), "rule_rank",
    )


@registered
def rules_for_basket(spark, d):
    lines = b.brand_lines(spark, d)
    n = lines.agg(F.count_distinct("basket_id")).first()[0]
    itemsets = keep(mining.frequent_itemsets(_model(lines, "brand")))
    rules = mining.all_split_rules(itemsets, n, CONFIDENCE)
    asked = itemsets.select(text_of("items").alias("query"), "items")
    return mining.rules_for_baskets(rules, asked, CONFIDENCE).select(
        "query", text_of("products").alias("products"), six("confidence"), "rule_rank"
    )


@registered
def rules_with_names(spark, d):
    model = mining.mine(
        mining.transactions(b.lines(spark, d), "basket_id", "item", PART_SUPPORT), PART_SUPPORT, 0.0
    )
    names = b.catalogue(spark, d).select("id", "name")
    return mining.name_rules(mining.single_rules(model), names).select(
        text_of("antecedent_names").alias("antecedent_names"),
        text_of("consequent_names").alias("consequent_names"),
        six("confidence"),
    )


# --- item similarity and baskets ---------------------------------------------------------


@registered
def item_cosine(spark, d):
    sims = cosine.item_cosine(b.customer_lines(spark, d), "customer", "item")
    return sims.select("item_a", "item_b", six("cosine"))


@registered
def item_cosine_recommend(spark, d):
    lines = b.customer_lines(spark, d)
    sims = cosine.item_cosine(lines, "customer", "item")
    found = cosine.recommend_items(lines, sims, "customer", "item", 10)
    return found.select(F.col("customer").alias("user"), "item", six("score"), "rnk")


@registered
def nearest_basket(spark, d):
    lines = b.lines(spark, d).select("basket_id", "item")
    asked = lines.withColumnRenamed("basket_id", "query_id")
    return nearest.nearest_basket(asked, lines, max_postings=40, same_ids=True)


def _trained_on_history(spark, d):
    """History lines, held-out lines, and the similarity of the history only."""
    history, held_out = b.history_and_holdout(spark, d)
    return history, held_out, cosine.item_cosine(history, "basket_id", "item")


def _recommended(spark, d, item: Column, last_trial: bool) -> DataFrame:
    history, held_out, sims = _trained_on_history(spark, d)
    asked = held_out.select(F.col("basket_id").alias("query_id"), item.alias("item"))
    day = F.to_date(F.lit(b.HOLD_OUT_FROM))
    requests = b.orders(spark, d).where(F.col("day") >= day).select(F.col("id").alias("query_id"))
    popular = popularity.top_items(popularity.popularity(history), 5).select(
        F.col("goods_id").alias("item"), "rnk"
    )
    found = nearest.recommend_with_fallback(
        requests, asked, history.select("basket_id", "item"), sims, popular, 10, last_trial
    )
    return found.select("query_id", "item", six("score"), "source", "rnk")


@registered
def recommend_with_fallback(spark, d):
    return _recommended(spark, d, F.col("item"), False)


@registered
def recommend_last_trial(spark, d):
    """Every seventh basket asks for items that nobody sells."""
    unknown = F.when(F.col("basket_id") % 7 == 0, -F.col("item")).otherwise(F.col("item"))
    return _recommended(spark, d, unknown, True)


@registered
def recommend_with_substitutes(spark, d):
    """Three in four items are stocked; each held-out basket asks by its first item, then by that item's substitute."""
    history, held_out = b.history_and_holdout(spark, d)
    stocked = history.where("item % 4 <> 0").select("basket_id", "item")
    sims = cosine.item_cosine(stocked, "basket_id", "item")
    first = held_out.groupBy(F.col("basket_id").alias("query_id")).agg(F.min_by("item", F.struct(*b.LINE_ORDER)).alias("item"))
    popular = popularity.top_items(popularity.popularity(history), 5).select(F.col("goods_id").alias("item"), "rnk")
    found = nearest.recommend_with_substitutes(
        first.select("query_id"), first, stocked, sims, popular, b.catalogue(spark, d), b.form_map(spark), 10
    )
    return found.select("query_id", "item", six("score"), "source", "rnk")


# --- matrix factorisation ----------------------------------------------------------------


@registered
def als_topn(spark, d):
    model = als.train_als(_ratings(spark, d))
    return als.als_topn(model, 3).select(
        F.col("tel_hashed").alias("user"), F.size("recommendations").cast("bigint").alias("n_recs")
    )


@registered
def factor_model_roundtrip(spark, d):
    path = scratch_path(spark, "factor-model")
    models.save_model(als.train_als(_ratings(spark, d)), path)
    return als.als_topn(models.load_factor_model(path), 2).select(
        F.col("tel_hashed").alias("user"), F.size("recommendations").cast("bigint").alias("n_recs")
    )


@registered
def als_user_lookup(spark, d):
    top = settle(als.als_topn(als.train_als(_ratings(spark, d)), 3), "recommendations")
    asked = b.orders(spark, d).select(F.col("clientTel").alias("phone")).distinct()
    found = als.lookup_by_phone(top, asked)
    return found.groupBy("phone").agg(F.count(F.lit(1)).alias("n_recs"))


@registered
def als_rmse(spark, d):
    parts = als.split_by_key(_ratings(spark, d), "tel_hashed", "goods_id")
    model = als.train_als(parts.where("part = 'train'"))
    predicted = model.transform(parts.where("part = 'test'"))
    finite = ~F.isnan("rmse") & (F.col("rmse") < float("inf"))
    return als.rmse(predicted, "purchases", "prediction").select("n_test", finite.cast("bigint").alias("rmse_is_finite"))


@registered
def rmse_item_mean(spark, d):
    parts = als.split_by_key(_ratings(spark, d), "tel_hashed", "goods_id")
    predicted = als.item_mean_predictions(
        parts.where("part = 'train'"), parts.where("part = 'test'"), "goods_id", "purchases"
    )
    return als.rmse(predicted, "purchases", "prediction").select(six("rmse"))


@registered
def train_test_split(spark, d):
    parts = als.split_by_key(_ratings(spark, d), "tel_hashed", "goods_id")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# --- similar products --------------------------------------------------------------------


@registered
def similar_by_code(spark, d):
    shelf = b.catalogue(spark, d)
    return similar.similar_by_code(shelf.select("id"), shelf, 5)


@registered
def dosage_form_expand(spark, d):
    shelf = b.catalogue(spark, d)
    return similar.dosage_forms(shelf.select("id"), shelf, b.form_map(spark))


@registered
def fuzzy_token_set_pairs(spark, d):
    names = b.catalogue(spark, d).select("name").distinct()
    pairs = fuzzy.token_set_pairs(
        names.withColumnRenamed("name", "left_name"), names.withColumnRenamed("name", "right_name"), 75
    )
    return pairs.where("left_name < right_name").select(
        F.col("left_name").alias("name_a"), F.col("right_name").alias("name_b"), "score"
    )


@registered
def similar_fuzzy(spark, d):
    shelf = b.catalogue(spark, d)
    return similar.similar_fuzzy(shelf.select("id"), shelf, b.form_map(spark), 80).select(
        "id", "similar_id", "score"
    )


@registered
def similar_diversified(spark, d):
    shelf = b.catalogue(spark, d)
    return similar.similar_fuzzy(shelf.select("id"), shelf, b.form_map(spark), 60, 5)


@registered
def similar_products(spark, d):
    shelf = b.catalogue(spark, d)
    unknown = spark.range(1).select((F.col("id") - 2).alias("id"))
    asked = shelf.select("id").unionByName(unknown)
    found = similar.similar_products(asked, shelf, b.form_map(spark), 80, 5)
    return found.select("id", "similar_id", "name", six("score"))


@registered
def similar_products_requests(spark, d):
    """Two requests for each product, with limits 2 and 4."""
    shelf = b.catalogue(spark, d)
    asked = shelf.select("id", F.explode(F.array(F.lit(2), F.lit(4))).alias("most")).withColumn(
        "request", F.col("id") * 10 + F.col("most")
    )
    found = similar.similar_products(asked, shelf, b.form_map(spark), 80, "most", "request")
    return found.select("request", "id", "similar_id", "name", six("score"))


@registered
def similar_count_stats(spark, d):
    return similar.similar_counts(b.catalogue(spark, d), b.form_map(spark), 75)


# --- catalogue ---------------------------------------------------------------------------


def _uncoded(spark, d) -> DataFrame:
    return b.catalogue(spark, d).where("atx IS NULL")


FORMS_WITH_CODES = ["ECONOMY", "SMALL", "LARGE", "PROM"]


@registered
def code_enrichment(spark, d):
    done = catalog.enrich_codes(
        _uncoded(spark, d), b.code_dictionary(spark, d), FORMS_WITH_CODES, 90, "ratio"
    )
    return done.select("id", "atx")


@registered
def code_enrichment_weighted(spark, d):
    done = catalog.enrich_codes(
        _uncoded(spark, d), b.code_dictionary(spark, d), FORMS_WITH_CODES, 90, "auto"
    )
    return done.select("id", "atx")


@registered
def category_path_export(spark, d):
    return catalog.category_path(b.goods(spark, d), b.categories(spark, d))


@registered
def page_links(spark, d):
    return pages.links(b.table(spark, d, "pages"))


@registered
def page_field(spark, d):
    return pages.field(b.table(spark, d, "pages"), "title")


@registered
def page_first_quoted(spark, d):
    return b.table(spark, d, "pages").select("page_id", text.first_quoted(F.col("html")).alias("quoted"))


def _price_list(spark, d) -> DataFrame:
    """A page per product: a menu, and a panel with its brand and a row that leads to its maker."""
    html = (
        '<div id="menu"><a href="/">Home</a><div><a>Other</a></div></div>'
        '<div id="offers"><div><a href="/b">{p_brand}</a></div><table><tr class="head"><td>name</td></tr>'
        '<tr class="offer" onclick="go(\'/maker/{p_type}\')"><td> <b>{p_name}</b> &amp; more</td><td>{p_brand}</td></tr></table></div>'
    )
    pieces = [F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(re.split("[{}]", html))]
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat(*pieces).alias("html"))


@registered
def page_panel_fields(spark, d):
    shown = _price_list(spark, d)
    return shown.select(
        "page_id", pages.row_link(F.col("html"), "offer").alias("link"), pages.cell_text(F.col("html"), "offers", "offer").alias("name")
    )


@registered
def page_panel_links(spark, d):
    return pages.links(_price_list(spark, d), ("div", "offers"))


@registered
def sample_orders(spark, d):
    return sampling.exact_sample(b.orders(spark, d).select("id"), ["id"], 500)


@registered
def sample_products(spark, d):
    return sampling.draw(b.catalogue(spark, d).select("id"), ["id"], 200)


# --- evaluation and quota ----------------------------------------------------------------


@registered
def eval_leave_last_out(spark, d):
    history, held_out, sims = _trained_on_history(spark, d)
    return evaluate.hit_rate(held_out, history, sims, b.LINE_ORDER).select(
        "n", "hits", six("hit_rate")
    )


@registered
def eval_rank_positions(spark, d):
    history, held_out, sims = _trained_on_history(spark, d)
    return evaluate.rank_positions(held_out, history, sims, b.LINE_ORDER)


@registered
def eval_rule_hit(spark, d):
    lines = b.brand_lines(spark, d).withColumnRenamed("brand", "item")
    return evaluate.rule_hits(lines, _rules(lines, "item"), b.LINE_ORDER)


@registered
def quota_admission(spark, d):
    found = quota.admit_requests(b.request_log(spark, d), b.ledger(spark, d), ["ts", "event_id"])
    return found.select("event_id", "status")


@registered
def ledger_after_batch(spark, d):
    before = b.ledger(spark, d)
    admitted = quota.admit_requests(b.request_log(spark, d), before, ["ts", "event_id"])
    return quota.settle_ledger(before, admitted)
