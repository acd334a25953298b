import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cartloom import schemas, session
from cartloom.functions import phones, text
from cartloom.operators import als, baskets, mining, popularity
from cartloom.operators.ranking import ranked


def test_phones(spark):
    long_ = "12345678901234567890" * 3
    raw = ["+7 (912) 345-67-89", "8-912-345-67-89", "none", None, "", "1" * 20, long_]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(raw)], "id long, clientTel string")
    got = {r.id: (r.digits, r.tel_hashed) for r in baskets.clean_orders(df).collect()}
    for i, p in enumerate(raw):
        digits = None if p is None else "".join(c for c in p if c.isdigit())
        assert got[i] == (digits, int(digits) * 67853 % 2**31 if digits else None)
    assert got[0] != got[1]  # spellings with different prefixes stay different users


def test_lines_dedupe_and_baskets(spark):
    orders = spark.createDataFrame(
        [
            (1, "b", [(10, 1.0), (10, 2.0), (11, 1.0)]),
            (1, "a", [(10, 1.0), (10, 2.0), (11, 1.0)]),
            (2, None, []),
            (3, "c", None),
        ],
        schemas.ORDER,
    )
    once = baskets.dedupe_orders(orders, "id", ["clientTel"])
    assert {(r.id, r.clientTel) for r in once.collect()} == {(1, "a"), (2, None), (3, "c")}
    assert baskets.dedupe_orders(orders).count() == 3
    lines = baskets.basket_lines(once)
    assert sorted(lines.collect()) == [(1, 10, 1.0), (1, 10, 2.0), (1, 11, 1.0)]
    assert baskets.baskets(lines).first().items == [10, 11]
    assert dict(baskets.basket_item_counts(lines, "id", "goods_id", "quantity").select("goods_id", "purchase_count").collect()) == {10: 3, 11: 1}
    assert baskets.returning_ratio(orders, "clientTel").first()[0] == 1.0


def test_net_and_one_hot(spark):
    rows = [(1, "x", 2.0), (1, "x", -2.0), (1, "y", 1.0), (2, "x", 0.5), (2, "y", -3.0), (3, "z", 4.0)]
    df = spark.createDataFrame(rows, "b long, i string, q double")
    assert {r.b: r.items for r in baskets.baskets_net(df, "b", "i", "q").collect()} == {1: ["y"], 3: ["z"]}
    wide = {r.b: (r.x, r.y) for r in baskets.one_hot(df, "b", "i", "q", ["x", "y"]).collect()}
    assert wide == {1: (0, 1), 2: (None, 0), 3: (0, 0)}


def test_padding(spark):
    df = spark.createDataFrame([(1, 2, 8), (1, 1, 9), (2, 1, 7)], "b long, n long, i long")
    made = baskets.padded(baskets.ordered_items(df, "b", "i", ["n"]))
    assert {r.b: r.items for r in made.collect()} == {1: [9, 8], 2: [7, -1]}
    assert baskets.padded_wide(made, "b", 2).columns == ["b", "prod0", "prod1"]


def test_popular_baskets_count_items_or_lines(spark):
    rows = [(1, 5), (1, 5), (1, 6), (2, 5), (2, 6), (2, 7), (2, 99)]
    lines = spark.createDataFrame([(b, i, 1.9) for b, i in rows], "basket_id long, goods_id long, quantity double")
    top = popularity.top_items(popularity.popularity(lines), 3)
    assert [tuple(r) for r in top.orderBy("rnk").collect()] == [(5, 3, 1), (6, 2, 2), (7, 1, 3)]
    by_item = popularity.popular_baskets(lines, top)
    assert {r.basket_id for r in by_item.collect()} == {2} and by_item.count() == 4
    by_line = popularity.popular_baskets(lines, top, distinct=False)
    assert {r.basket_id for r in by_line.collect()} == {1, 2}
    assert {r.receipt_number for r in popularity.numbered_receipts(by_line).collect()} == {-1, -2}


def test_ranked_equals_row_number(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.randint(0, 50), n) for n in range(400)]
    df = spark.createDataFrame(rows, "g long, t long, n long").repartition(6)
    got = {r.n: r.place for r in ranked(df, ["g"], ["t", "n"], "place").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = k + 1
    assert got == want
    overall = ranked(df, [], ["n"], "place").collect()
    assert all(r.place == r.n + 1 for r in overall)


def brute_rules(sets, min_support, min_confidence):
    n = len(sets)
    least = -(-min_support * n // 1)
    items = sorted(set().union(*sets))
    freq = {}
    for k in range(1, 5):
        for combo in itertools.combinations(items, k):
            f = sum(set(combo) <= s for s in sets)
            if f >= least:
                freq[combo] = f
    out = {}
    for combo, f in freq.items():
        for k in range(1, len(combo)):
            for left in itertools.combinations(combo, k):
                right = tuple(x for x in combo if x not in left)
                if f / freq[left] >= min_confidence:
                    out[left, right] = (f / freq[left], f / freq[left] / (freq[right] / n), f / n)
    return freq, out


def test_all_split_rules_equal_brute_force(spark):
    rng = random.Random(9)
    sets = [frozenset(rng.sample(range(7), rng.randint(1, 4))) for _ in range(60)]
    lines = spark.createDataFrame([(b, i) for b, s in enumerate(sets) for i in s], "basket_id long, item long")
    support = 0.05
    model = mining.mine(mining.transactions(lines, "basket_id", "item", support), support, 0.1)
    itemsets = mining.frequent_itemsets(model)
    freq, want = brute_rules(sets, support, 0.1)
    assert {tuple(r.items): r.freq for r in itemsets.collect()} == freq
    rules = mining.all_split_rules(itemsets, len(sets), 0.1)
    got = {(tuple(r.antecedent), tuple(r.consequent)): (r.confidence, r.lift, r.support) for r in rules.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values)
    sure = [r for r in rules.collect() if r.confidence == 1.0]
    assert all(r.conviction is None for r in sure)
    single = {(tuple(r.antecedent), tuple(r.consequent)) for r in mining.single_rules(model).collect()}
    assert single == {k for k in want if len(k[1]) == 1}
    strict = mining.strict_rules(rules, 0.1, 0.2, 1.1, 3).collect()
    assert len(strict) == sum(v[2] >= 0.1 and v[0] >= 0.2 and v[1] >= 1.1 and len(k[0] + k[1]) >= 3 for k, v in want.items())


RULES = [([12], [1], 0.5), ([123], [2], 0.9), ([12, 13], [3], 0.3), ([12, 13], [4], 0.3), ([7], [12], 0.2)]


def test_rules_for_baskets(spark):
    rules = spark.createDataFrame(RULES, "antecedent array<long>, consequent array<long>, confidence double")
    asked = spark.createDataFrame(
        [("one", [12]), ("two", [13, 12]), ("none", [12, 55]), ("empty", [])], "query string, items array<long>"
    )
    got = mining.rules_for_baskets(rules, asked, 0.3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rule_rank):
        by.setdefault(r.query, []).append((r.products[0], r.confidence))
    assert by == {
        "one": [(1, 0.5), (3, 0.3), (4, 0.3)],  # item 123 is not item 12
        "two": [(3, 0.3), (4, 0.3)],
        "empty": [(2, 0.9), (1, 0.5), (3, 0.3), (4, 0.3)],
    }
    products = spark.createDataFrame([(13,), (999,)], "product long")
    assert mining.rules_for_products(rules, products).count() == 2


def test_name_rules(spark):
    rules = spark.createDataFrame(RULES[2:3], "antecedent array<long>, consequent array<long>, confidence double")
    names = spark.createDataFrame([(12, "z"), (13, "a"), (3, "c")], "id long, name string")
    row = mining.name_rules(rules, names).first()
    assert (row.antecedent_names, row.consequent_names) == (["z", "a"], ["c"])


def test_set_text(spark):
    df = spark.createDataFrame([([1, 23],)], "xs array<long>")
    out = df.select(text.set_text(F.col("xs")).alias("t")).select("t", text.parse_set_text(F.col("t")).alias("xs")).first()
    assert (out.t, out.xs) == ("frozenset({1, 23})", [1, 23])


def test_als(spark):
    rng = random.Random(2)
    rows = [(phones.KEY_RANGE - 1 - u, i, float(rng.randint(1, 5))) for u in range(20) for i in rng.sample(range(12), 5)]
    ratings = spark.createDataFrame(rows, "tel_hashed int, goods_id long, purchases double")
    recs = als.als_topn(als.train_als(ratings), 3).collect()
    assert len(recs) == 20
    for r in recs:
        values = [x.rating for x in r.recommendations]
        assert len(values) == 3 and values == sorted(values, reverse=True) and all(v == v for v in values)
    train, test = als.split_random(ratings)
    assert train.count() + test.count() == len(rows)


@pytest.mark.parametrize("side,leaf", [(400_000, 256), (7, 3)])
def test_als_lists_equal_spark_s_own(spark, monkeypatch, side, leaf):
    """In one tile and in many, with leaves passed over; only tiles meet, never all users and items in one plan row."""
    monkeypatch.setattr(als, "SIDE", side)
    monkeypatch.setattr(als, "LEAF", leaf)
    monkeypatch.setattr(als, "BATCH", leaf)
    rng = random.Random(3)
    rows = [(phones.KEY_RANGE - 1 - u, i, float(rng.randint(1, 5))) for u in range(40) for i in rng.sample(range(30), 6)]
    model = als.train_als(spark.createDataFrame(rows, "tel_hashed int, goods_id long, purchases double"))
    found, want = als.als_topn(model, 4), model.recommendForAllUsers(4)
    assert found.dtypes == want.dtypes and "CartesianProduct" not in found._jdf.queryExecution().toString()
    value = lambda df: {r.tel_hashed: [x.rating for x in r.recommendations] for r in df.collect()}
    got, own = value(found), value(want)
    assert got.keys() == own.keys() and all(got[u] == pytest.approx(own[u], rel=1e-4, abs=1e-6) for u in own)
    assert all(len({x.goods_id for x in r.recommendations}) == 4 for r in found.collect())
    many = als.als_topn(model, 50).collect()
    assert all(len(r.recommendations) == 30 for r in many)


def test_training_blocks_are_bounded(spark, monkeypatch):
    """More ratings are trained in more blocks; a table of few keeps the library's ten."""
    rows = [(u, i, float((u + i) % 4 + 1)) for u in range(40) for i in range(u % 7, 30, 4)]
    ratings = spark.createDataFrame(rows, "tel_hashed int, goods_id long, purchases double")
    few = als.train_als(ratings)
    monkeypatch.setattr(als, "BLOCK_RATINGS", 20, raising=False)
    model = als.train_als(ratings)
    parts = [m.userFactors.rdd.getNumPartitions() for m in (few, model)]
    assert parts == [10, -(-len(rows) // 20)]
    assert model.itemFactors.rdd.getNumPartitions() == parts[1] and model.userFactors.count() == 40
    assert als.train_als(ratings, blocks=3).userFactors.rdd.getNumPartitions() == 3


def test_settled_tables_leave_no_shuffle(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", found))

    before, was = files(), spark.conf.get(session.SHUFFLE_CLEANUP)
    made = session.settle(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 900).alias("k")).count(), "sums")
    assert files() <= before and spark.conf.get(session.SHUFFLE_CLEANUP) == was
    assert made.count() == 900 and made.selectExpr("sum(count)").first()[0] == 5000
