import pytest
from pyspark.sql import functions as F

from cartloom import schemas
from cartloom.operators import catalog, pages, quota, sampling, similar
from cartloom.sources import models, orders, tables
from cartloom.streaming import ingest

SHELF = [
    # id, normalized name, trade name, form, company, code
    (1, "alpha one", None, "tab", "c1", "AB12"),
    (2, "alpha two", None, "tab", "c1", "AB13"),
    (3, "beta", None, "tab", "c2", "AB1"),
    (4, "gamma", None, "tab", "c2", "AB17"),
    (5, "delta forte", "delta forte", "tab", "c1", None),
    (6, "delta forte", None, "syrup", "c2", ""),
    (7, "delta forta", None, "caps", "c3", "ZZ"),
    (8, "delta fortes", None, "caps", "c3", "Q1"),
    (9, "delta forte x", None, "caps", "c4", "Q2"),
    (10, "lonely", None, "gel", "c5", None),
]


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(i, n, n, t, f, c, a) for i, n, t, f, c, a in SHELF]
    return spark.createDataFrame(rows, schemas.CATALOGUE).cache()


@pytest.fixture(scope="module")
def forms(spark):
    return spark.createDataFrame([("tab", "caps"), ("caps", "tab"), ("syrup", "syrup")], "form string, equal_form string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def answers(df):
    out = {}
    for r in df.orderBy("similar_id").collect():
        out.setdefault(r.id, []).append(r.similar_id)
    return out


def test_similar_by_code(spark, shelf):
    asked = ids(spark, 1, 4, 3, -2)
    assert answers(similar.similar_by_code(asked, shelf)) == {1: [2, 4], 4: [1, 2]}
    assert answers(similar.similar_by_code(asked, shelf, 0)) == {1: [2, 4], 4: [1, 2]}
    assert answers(similar.similar_by_code(asked, shelf, 1)) == {1: [2], 4: [1]}
    assert answers(similar.similar_by_code(asked, shelf, 9)) == {1: [2, 4], 4: [1, 2]}


def test_similar_fuzzy(spark, shelf, forms):
    reach = similar.dosage_forms(ids(spark, 5, 6, 10), shelf, forms)
    assert sorted(tuple(r) for r in reach.collect()) == [(5, "caps"), (5, "syrup"), (6, "caps"), (6, "syrup")]
    found = similar.similar_fuzzy(ids(spark, 5, 6, 10), shelf, forms, 80)
    # "delta forte" is on the syrup shelf; its first row is product 5, so only 6 gets it.
    assert answers(found) == {5: [7, 8, 9], 6: [5, 7, 8, 9]}
    both = similar.similar_products(ids(spark, 1, 5, -2), shelf, forms, 80, 2)
    assert {(r.id, r.score) for r in both.collect()} >= {(1, 1.0), (5, 1.0)}
    assert both.where("id = 5").count() == 2
    counts = dict(similar.similar_counts(shelf, forms, 80).collect())
    assert counts == {1: 2, 2: 2, 3: 0, 4: 2, 5: 3, 6: 4, 7: 0, 8: 1, 9: 1, 10: 0}


def test_diversify(spark):
    rows = [(1, 10, 99, "a"), (1, 11, 98, "a"), (1, 12, 97, "a"), (1, 13, 90, "b"), (1, 14, 80, None)]
    df = spark.createDataFrame(rows, "id long, similar_id long, score int, company string")

    def order(limit):
        return [r.similar_id for r in similar.diversify(df, limit).orderBy("rnk").collect()]

    assert order(None) == [10, 11, 12, 13, 14]
    assert order(3) == [10, 11, 12]  # share of one: plain best
    assert order(4) == [10, 11, 13, 14]  # share of two per company
    assert order(9) == [10, 11, 12, 13, 14]


def test_limits_per_request(spark, shelf, forms):
    asked = spark.createDataFrame([(1, 1), (2, None), (4, 0), (5, 2), (6, None), (7, 3)], "id long, n int")
    got = answers(similar.similar_products(asked, shelf, forms, 80, "n"))
    assert got == {1: [2], 2: [1, 4], 4: [1, 2], 5: [8, 9], 6: [5, 7, 8, 9]}


def test_category_path(spark):
    cats = spark.createDataFrame([("l", "Leaf", "m"), ("m", "Mid", "t"), ("t", "Top", None)], "id string, name string, parentId string")
    goods = spark.createDataFrame(
        [(1, "a", "M", "l"), (2, "b", None, "m"), (3, "c", "M", None), (4, "d", "M", "t")],
        "id long, name string, manufacturer string, siteCatId string",
    )
    got = {r.sku: (r.brand, r.path) for r in catalog.category_path(goods, cats).collect()}
    assert got == {1: ("M", "Leaf/Mid/Top"), 2: ("-", "Mid/Top"), 4: ("M", "Top")}
    assert catalog.export_header(catalog.category_path(goods, cats)).columns == catalog.EXPORT_HEADER


PAGE = """<html><title> A &amp; B </title><div id="p"><div><a href="/x"> one </a></div><A HREF='y'><b>two</b> &lt;3</a></div>
<a>out</a><tr class="hi_sys poi" onclick="go('first', 'second')"><td>x</td></tr>
<div id="g"><table><tr class="hi_sys"><td> N02BE
</td></tr></table></div></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>")], "page_id long, html string")
    assert [tuple(r) for r in pages.links(df).orderBy("pos").collect()] == [(1, 0, "one"), (1, 1, "two <3"), (1, 2, "out")]
    assert [r.anchor_text for r in pages.links(df, ("div", "p")).orderBy("pos").collect()] == ["one", "two <3"]
    assert dict(pages.field(df).collect()) == {1: "A & B", 2: None}
    row = df.select(
        pages.row_link(F.col("html"), "hi_sys poi").alias("link"), pages.cell_text(F.col("html"), "g", "hi_sys").alias("cell")
    ).collect()
    assert [tuple(r) for r in row] == [("first", "N02BE"), (None, None)]


def test_quota(spark):
    log = spark.createDataFrame(
        [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4), ("c", 1, 5), ("d", 1, 6)], "api_key string, ts long, event_id long"
    )
    ledger = spark.createDataFrame([("a", 3, 1), ("b", 0, 0), ("c", 1, 7), ("d", 5, 0)], schemas.QUOTA)
    admitted = quota.admit_requests(log, ledger, ["ts", "event_id"])
    assert {r.event_id: r.status for r in admitted.collect()} == {1: 200, 2: 200, 3: 403, 4: 403, 5: 403, 6: 200}
    unknown = quota.admit_requests(log, ledger.where("api_key <> 'b'"), ["ts", "event_id"])
    assert unknown.where("event_id = 4").first().status == 401
    after = {r.api_key: r.requests_done for r in quota.settle_ledger(ledger, admitted).collect()}
    assert after == {"a": 3, "b": 0, "c": 7, "d": 1}


def test_order_files(spark, tmp_path):
    made = spark.createDataFrame([(1, "p", [(5, 1.0)]), (2, None, [])], schemas.ORDER)
    orders.write_orders(made, str(tmp_path / "json"))
    assert sorted(orders.read_orders(spark, str(tmp_path / "json")).collect()) == sorted(made.collect())
    feed = '[1, {"id": 7, "clientTel": "x", "basket": [{"goodsId": 3, "quantity": 2}]}, 2,\n {"id": 8, "basket": []}, 3]'
    (tmp_path / "feed.json").write_text(feed)
    got = orders.read_order_feed(spark, str(tmp_path / "feed.json"), whole_file=True).collect()
    assert [(r.id, len(r.basket)) for r in got] == [(7, 1), (8, 0)]
    (tmp_path / "array.json").write_text('[{"id": 7, "clientTel": "x", "basket": []}, {"id": 9}]\n')
    assert [r.id for r in orders.read_orders(spark, str(tmp_path / "array.json")).collect()] == [7, 9]
    orders.write_baskets(made, str(tmp_path / "baskets"))
    assert orders.read_baskets(spark, str(tmp_path / "baskets")).count() == 2


def test_flat_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text(",id,name\n0,4,x\n1,5,\n")
    got = tables.read_csv(spark, str(tmp_path / "i.csv"), "id BIGINT, name STRING", index=True).collect()
    assert [tuple(r) for r in got] == [(4, "x"), (5, None)]
    (tmp_path / "map.json").write_text('{"tab": ["caps", "tab"],\n "gel": []}')
    pairs = tables.read_lookup(spark, str(tmp_path / "map.json"), "array<string>", "form", "equal_form")
    assert sorted(tuple(r) for r in pairs.collect()) == [("tab", "caps"), ("tab", "tab")]
    (tmp_path / "codes.json").write_text('{"a": "N1"}')
    assert [tuple(r) for r in tables.read_lookup(spark, str(tmp_path / "codes.json"), "string").collect()] == [("a", "N1")]
    nested = spark.createDataFrame([(1, [2, 3], None)], "k long, xs array<long>, n string")
    tables.write_csv(nested, str(tmp_path / "nested"))
    assert spark.read.csv(str(tmp_path / "nested"), header=True).first().xs == "[2,3]"
    assert tables.as_json(nested).first().json == '{"k":1,"xs":[2,3]}'
    assert tables.json_array(nested.select("k", "xs"), ["k"]).first().json == '[{"xs":[2,3]}]'
    sims = spark.createDataFrame([(1, 2, 0.5)], "item_a long, item_b long, cosine double")
    models.save_similarity(sims, str(tmp_path / "sims"))
    assert models.load_similarity(spark, str(tmp_path / "sims")).count() == 1


def test_stream_drops_redelivered_orders(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first = spark.createDataFrame([(1, "a", []), (1, "a", []), (2, "b", [])], schemas.ORDER)
    orders.write_orders(first.repartition(3), src)
    ingest.ingest_orders(spark, src, out, mark).awaitTermination()
    orders.write_orders(spark.createDataFrame([(2, "b", []), (3, "c", [])], schemas.ORDER), src, mode="append")
    ingest.ingest_orders(spark, src, out, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_samples(spark):
    df = spark.range(100)
    assert sampling.sample_rows(df, 10).distinct().count() == 10
    assert sampling.sample_with_replacement(df, 2.0).count() > 100
