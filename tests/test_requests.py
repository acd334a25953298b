import random
import re

from cartloom import session
from cartloom.functions import text
from cartloom.operators import catalog, fuzzy, mining, sampling, similar

SHELF = "id long, normalized_name string, tradeName string, medForm string, company_name string, atx string"


def test_an_id_asked_twice(spark):
    shelf = spark.createDataFrame([(i, f"n{i}", None, "f", "c", "A10") for i in range(1, 7)], SHELF)
    asked = spark.createDataFrame([(10, 1, 2), (11, 1, 4), (12, 9, 3)], "request long, id long, most int")
    forms = spark.createDataFrame([("f", "f")], "form string, equal_form string")
    found = similar.similar_products(asked, shelf, forms, 80, "most", "request")
    got = sorted((r.request, r.similar_id) for r in found.collect())
    assert got == [(10, 2), (10, 3), (11, 2), (11, 3), (11, 4), (11, 5)]
    # Without a request column an id is one request, with the largest limit.
    got = sorted((r.id, r.similar_id) for r in similar.similar_by_code(asked.drop("request"), shelf, "most").collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5)]
    named = spark.createDataFrame([(i, f"aspirin forte {i}", None, "f", "c", None) for i in range(1, 7)], SHELF)
    found = similar.similar_fuzzy(asked, named, forms, 80, "most", "request").collect()
    assert sorted((r.request, r.rnk) for r in found) == [(10, 1), (10, 2), (11, 1), (11, 2), (11, 3), (11, 4)]


def test_no_table_of_products_or_requests_is_broadcast(spark, tmp_path):
    """Files of repeated words look small, however many rows they hold."""
    names = ["aspirin forte", "aspirin fort", "iodine"]
    rows = [(i, names[i % 3], names[i % 3], "f", f"c{i % 4}", "A10" if i % 2 else None) for i in range(400)]
    spark.createDataFrame(rows, SHELF).write.parquet(f"{tmp_path}/shelf")
    shelf = spark.read.parquet(f"{tmp_path}/shelf")
    asked = shelf.selectExpr("id", "id * 10 as request", "if(id % 4 < 2, 2, 0) as most")
    forms = spark.createDataFrame([("f", "f")], "form string, equal_form string")
    found = similar.similar_products(asked, shelf, forms, 80, "most", "request")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [similar_id#" in plan and not re.search(r"BroadcastHashJoin \[(id|similar_id|_req|request)#", plan)
    listed = {}
    for r in found.collect():
        listed.setdefault(r.id, set()).add(r.similar_id)
    assert listed[3] == set(range(1, 400, 2)) - {3} and listed[1] == {3, 5} and listed[5] == {1, 3}
    # By name, each name's lowest id stands for it; the third name is far from the others.
    assert listed[6] == listed[100] == {0, 1} and listed[8] == {2} and 2 not in listed


def test_missing_companies_are_one_company(spark):
    rows = [(1, i, 90 - i, None if i % 2 else "") for i in range(6)] + [(1, 9, 10, "x")]
    matches = spark.createDataFrame(rows, "id long, similar_id long, score int, company string")
    got = [r.similar_id for r in similar.diversify(matches, 4).orderBy("rnk").collect()]
    assert got == [0, 1, 9, 2]  # two companies, so two places each before others fill up


def test_one_code_per_name(spark):
    goods = spark.createDataFrame([(1, "aspirin forte", None, "T")], "id long, name string, tradeName string, medForm string")
    codes = spark.createDataFrame([("aspirin forte", "B2"), ("aspirin forte", "B1")], "name string, atx string")
    none = codes.limit(0)
    assert [r.atx for r in catalog.enrich_codes(goods, codes, ["T"]).collect()] == ["B1"]
    assert [r.atx for r in catalog.enrich_codes(goods, none, ["T"], registry=codes).collect()] == ["B1"]


def test_long_names_that_round_up(spark):
    rng = random.Random(4)
    for size in (150, 199, 200, 250, 400):
        a = "".join(rng.choice("abcdefgh") for _ in range(size))
        b = a[:70] + "z" + a[71:] + "".join(rng.choice("abcdefgh") for _ in range(int(size * 0.8)))
        left, right = (spark.createDataFrame([(x,)], f"{n}_name string") for n, x in (("left", a), ("right", b)))
        got = [r.score for r in fuzzy.weighted_pairs(left, right, 90).collect()]
        assert got == ([text.weighted_of(a, b)] if text.weighted_of(a, b) >= 90 else []), size


def test_candidates_never_exceed_one_per_pair(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    names = sorted({" ".join(rng.sample(stems, rng.randint(1, 4))) for _ in range(700)})
    side = spark.createDataFrame([(n,) for n in names], "left_name string")
    keys = fuzzy._prepare(side, "left_name", True)
    for cutoff in (60, 75, 80):
        pairs = fuzzy._close_candidates(keys, keys, fuzzy._floor_of(cutoff))
        n, distinct = pairs.count(), pairs.select("l_key", "r_key").distinct().count()
        assert n == distinct <= len(names) ** 2


def test_rules_of_a_product_in_order(spark):
    rules = spark.createDataFrame([(["a"], ["b"], 0.5), (["a", "c"], ["b"], 0.9), (["a"], ["c"], 0.5)],
                                  "antecedent array<string>, consequent array<string>, confidence double")
    got = mining.rules_for_products(rules, spark.createDataFrame([("a",)], "product string")).orderBy("rule_rank").collect()
    assert [(r.antecedent, r.consequent) for r in got] == [(["a", "c"], ["b"]), (["a"], ["b"]), (["a"], ["c"])]


def test_splits_of_a_long_itemset(spark, monkeypatch):
    monkeypatch.setattr(mining, "SPLIT_BITS", 2)
    sets = spark.createDataFrame([(list("abcde"), 3), (["a"], 4)], "items array<string>, freq long")
    got = {(tuple(r.antecedent), tuple(r.consequent)) for r in mining._splits(sets).collect()}
    assert len(got) == 30 and (("a",), ("b", "c", "d", "e")) in got


def test_draws_with_replacement(spark):
    rows = spark.createDataFrame([(i * 3,) for i in range(40)], "id long")
    first, again = (sorted((r.draw, r.id) for r in sampling.draw(rows, ["id"], 200).collect()) for _ in range(2))
    assert first == again and [d for d, _ in first] == list(range(200))
    assert len({i for _, i in first}) > 30
    assert sampling.draw(rows.limit(0), ["id"], 5).count() == 0


def test_clear_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_base_dir", lambda _: str(tmp_path))
    kept = session.keep(spark.range(3))
    assert session.settle(spark.range(5), "x").count() == 5 and kept.count() == 3
    session.clear(spark)
    assert not any(p.is_file() for p in tmp_path.rglob("*")) and not kept.is_cached
