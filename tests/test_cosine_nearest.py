import random
from math import sqrt

import pytest

from pyspark.sql import functions as F

from cartloom import schemas
from cartloom.operators import cosine, evaluate, nearest


def skewed(seed, users=30, items=25):
    rng = random.Random(seed)
    rows = set()
    for u in range(users):
        many = rng.choice([2, 3, 4, 18, 22]) if u % 3 == 0 else rng.randint(1, 4)
        for i in rng.sample(range(items), many):
            rows.add((u, i))
    return sorted(rows)


def brute_cosine(rows, top=None):
    by = {}
    for u, i in rows:
        by.setdefault(i, set()).add(u)
    out = {}
    for a in by:
        near = [(b, len(by[a] & by[b]) / sqrt(len(by[a]) * len(by[b]))) for b in by if b != a and by[a] & by[b]]
        near.sort(key=lambda x: (-round(x[1], 12), x[0]))
        for b, c in near[:top]:
            out[a, b] = round(c, 9)
    return out


@pytest.mark.parametrize("degree,top", [(1000, 5), (8, 5), (3, 4), (8, None), (1, 3)])
def test_item_cosine(spark, degree, top):
    rows = skewed(degree)
    df = spark.createDataFrame(rows + rows[:5], "user long, item long")
    got = {
        (r.item_a, r.item_b): round(r.cosine, 9)
        for r in cosine.item_cosine(df, "user", "item", top, degree).collect()
    }
    assert got == brute_cosine(rows, top)


@pytest.mark.parametrize("top", [4, None])
def test_item_cosine_with_many_hot_users(spark, monkeypatch, top):
    """Eighty hot users: bitmaps of two words, compared in several tiles."""
    monkeypatch.setattr(cosine, "TILE", 16)
    rng = random.Random(80)
    rows = {(u, i) for u in range(80) for i in rng.sample(range(50), rng.randint(8, 40))}
    rows |= {(u, i) for u in range(80, 140) for i in rng.sample(range(55), rng.randint(1, 5))}
    df = spark.createDataFrame(sorted(rows), "user long, item long")
    got = {(r.item_a, r.item_b): round(r.cosine, 9) for r in cosine.item_cosine(df, "user", "item", top, 5).collect()}
    assert got == brute_cosine(sorted(rows), top)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("heavy", [4_000_000, 60, 0])
def test_item_cosine_from_lists(spark, monkeypatch, kind, heavy):
    """Many small groups, items too heavy for one, missing users and items; no pair of items is shuffled without need."""
    monkeypatch.setattr(cosine, "GROUP_ENTRIES", 40)
    monkeypatch.setattr(cosine, "ITEM_ENTRIES", heavy)
    rows = skewed(7)
    df = spark.createDataFrame([*rows, *rows[:9], (None, 3), (None, 4), (5, None)], "user long, item long")
    counted = {(u, i) for u, i in rows} | {(-1, 3), (-2, 4)}  # a missing user counts as a buyer, but links nothing
    text = lambda i: i if kind == "long" else f"{i:03}"
    shaped = df if kind == "long" else df.withColumn("item", F.lpad(F.col("item").cast("string"), 3, "0"))
    found = cosine.item_cosine(shaped, "user", "item", 6)
    assert found.columns == ["item_a", "item_b", "cosine"]
    want = {(text(a), text(b)): c for (a, b), c in brute_cosine(sorted(counted), 6).items()}
    assert {(r.item_a, r.item_b): round(r.cosine, 9) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert heavy < 4_000_000 or "SortMergeJoin" not in plan and "Join Inner, (u" not in plan


def test_recommend_items(spark):
    rows = skewed(5)
    df = spark.createDataFrame(rows, "user long, item long")
    sims = brute_cosine(rows, 6)
    table = spark.createDataFrame([(a, b, c) for (a, b), c in sims.items()], "item_a long, item_b long, cosine double")
    got = {(r.user, r.rnk): (r.item, round(r.score, 6)) for r in cosine.recommend_items(df, table, "user", "item", 4).collect()}
    want = {}
    for user in {u for u, _ in rows}:
        mine = {i for u, i in rows if u == user}
        score = {}
        for (a, b), c in sims.items():
            if a in mine and b not in mine:
                score[b] = score.get(b, 0) + round(c * 1e9)
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:4]
        for k, (item, s) in enumerate(best):
            want[user, k + 1] = (item, round(s / 1e9 / len(mine), 6))
    assert got == want


@pytest.mark.parametrize("postings,same", [(1000, True), (6, True), (6, False), (1, True)])
def test_nearest_basket(spark, postings, same):
    rng = random.Random(postings)
    lines = [(b, min(rng.randint(0, 30), rng.randint(0, 30))) for b in range(40) for _ in range(rng.randint(1, 6))]
    lines += [(100, 0), (101, 0), (102, 0)]
    lines += [(b, i) for b in range(200, 212) for i in range(9)] + [(205, 3)]  # copies
    stored = spark.createDataFrame(lines, "basket_id long, item long")
    asked = lines if same else [(q, i) for q, i in lines if q % 2] + [(500, 999)]
    queries = spark.createDataFrame(asked, "query_id long, item long")
    got = {
        r.query_id: (r.basket_id, r.overlap, r.size)
        for r in nearest.nearest_basket(queries, stored, postings, same).collect()
    }
    want = {}
    for q in {q for q, _ in asked}:
        mine = {i for x, i in asked if x == q}
        options = []
        for b in {b for b, _ in lines}:
            held = [i for x, i in lines if x == b]
            if mine & set(held) and not (same and q == b):
                options.append((-len(mine & set(held)), len(held), b))
        if options:
            o, s, b = min(options)
            want[q] = (b, -o, s)
    assert got == want


def brute_nearest(asked, lines, same):
    """The best stored basket of each query, by looking at all."""
    sets, out = {}, {}
    for b, i in lines:
        sets.setdefault(b, []).append(i)
    mine = {}
    for q, i in asked:
        mine.setdefault(q, set()).add(i)
    for q, own in mine.items():
        options = [(-len(own & set(held)), len(held), b) for b, held in sets.items() if own & set(held) and not (same and q == b)]
        if options:
            o, s, b = min(options)
            out[q] = (b, -o, s)
    return out


def hot_baskets(rng, n, hot=30, cold=400):
    """Baskets of which most hold several of 30 items that a fifth to a half of all baskets hold."""
    chance = {i: rng.uniform(0.2, 0.5) for i in range(hot)}
    lines = []
    for b in range(n):
        items = [i for i in range(hot) if rng.random() < chance[i] * (rng.random() < 0.5)]
        items += [hot + rng.randrange(cold) for _ in range(rng.randrange(3))]
        lines += [(b, i) for i in items + items[:rng.randrange(2)]]
    return lines


@pytest.mark.parametrize("same", [True, False])
def test_nearest_basket_with_thirty_hot_items(spark, same):
    rng = random.Random(30)
    lines = hot_baskets(rng, 500)
    asked = lines if same else [(1000 + q, i) for q, i in hot_baskets(rng, 200)]
    got = nearest.nearest_basket(
        spark.createDataFrame(asked, "query_id long, item long"), spark.createDataFrame(lines, "basket_id long, item long"), 50, same
    )
    assert {r.query_id: (r.basket_id, r.overlap, r.size) for r in got.collect()} == brute_nearest(asked, lines, same)


def test_nearest_basket_with_long_sets(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LONG_SET", 12)
    rng = random.Random(3)
    lines = [(b, i) for b in range(80) for i in rng.sample(range(60), rng.choice([1, 3, 12, 13, 30]))]
    for same in (True, False):
        asked = lines if same else [(q + 500, i) for q, i in lines if q % 3]
        got = nearest.nearest_basket(
            spark.createDataFrame(asked, "query_id long, item long"), spark.createDataFrame(lines, "basket_id long, item long"), 10, same
        )
        assert {r.query_id: (r.basket_id, r.overlap, r.size) for r in got.collect()} == brute_nearest(asked, lines, same)


def test_a_posting_holds_remainders_not_baskets(spark):
    """The most frequent item has one remainder, however many baskets hold it."""
    lines = [(b, i) for b in range(3000) for i in ([0] if b % 2 else [0, 1]) + [10 + b % 500]]
    stored = spark.createDataFrame(lines, "basket_id long, item long")
    sets = nearest._item_sets(stored, "basket_id").withColumnRenamed("basket_id", "sid")
    frequency = stored.groupBy("item").agg(F.count("*").alias("n"))
    held = nearest._rarest_first(sets, frequency, "sid", "size")
    postings, dealt = nearest._postings(held, held.limit(0), 1000)
    assert dealt.count() == 0
    entries = {r.item: r.n for r in postings.groupBy("item").agg(F.sum(F.size("entries")).alias("n")).collect()}
    assert entries[0] == 1 and entries[1] == 1 and max(entries.values()) <= 2


@pytest.mark.parametrize("many", [10_000, 5])
def test_places_by_counting_equal_places_by_ranking(spark, monkeypatch, many):
    monkeypatch.setattr(cosine, "MANY_ITEMS", many)
    rows = skewed(9, 60, 40)
    df = spark.createDataFrame(rows, "user long, item long")
    sims = cosine.item_cosine(df, "user", "item", 12)
    ranked = cosine.recommend_items(df, sims, "user", "item", None)
    want = {(r.user, r.item): r.rnk for r in ranked.collect()}
    users = sorted({u for u, _ in rows})
    targets = [(u, i) for u in users for i in range(45)]
    have = df.select(F.col("user").alias("u"), F.col("item").alias("i"))
    got = cosine.target_ranks(have, spark.createDataFrame(targets, "u long, i long"), sims)
    assert {(r.u, r.i): r.rnk for r in got.collect()} == want


@pytest.mark.parametrize("entries", [4_000_000, 0])
def test_sums_of_neighbours_are_not_shuffled(spark, monkeypatch, entries):
    """Lists are added up and ranked where a user's group is, with lists broadcast or dealt, in many groups."""
    monkeypatch.setattr(cosine, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(cosine, "GROUP_ENTRIES", 50)
    rows = skewed(9, 40, 40)
    df = spark.createDataFrame([*rows, (3, None), (None, 5)], "user long, item long")
    sims = cosine.item_cosine(spark.createDataFrame(rows, df.schema), "user", "item", 12)
    found = cosine.recommend_items(df, sims, "user", "item", 4)
    assert "HashAggregate(keys=[u" not in found._jdf.queryExecution().toString()
    near, owned = {}, {}
    for (a, b), c in brute_cosine(rows, 12).items():
        near.setdefault(a, []).append((b, round(c * cosine.UNITS)))
    for u, i in [*rows, (3, None)]:
        owned.setdefault(u, set()).add(i)
    want = set()
    for u, items in owned.items():
        sums = {}
        for i in items:
            for j, w in near.get(i, []):
                sums[j] = sums.get(j, 0) + w
        best = sorted(((-w, j) for j, w in sums.items() if j not in items))[:4]
        want |= {(u, j, round(-w / cosine.UNITS / len(items), 7), at) for at, (w, j) in enumerate(best, 1)}
    assert {(r.user, r.item, round(r.score, 7), r.rnk) for r in found.collect()} == want


def test_fallback_chain(spark):
    stored = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 10)], "basket_id long, item long")
    sims = cosine.item_cosine(stored, "basket_id", "item")
    requests = spark.createDataFrame([(7,), (8,), (9,)], "query_id long")
    queries = spark.createDataFrame([(7, 11), (8, 99)], "query_id long, item long")
    popular = spark.createDataFrame([(10, 1), (12, 2)], "item long, rnk int")

    def run(last):
        rows = nearest.recommend_with_fallback(requests, queries, stored, sims, popular, 10, last).collect()
        return {(r.query_id, r.item, r.source) for r in rows}

    empty = {(9, 10, "popular"), (9, 12, "popular")}
    assert run(False) == {(7, 12, "basket")} | empty
    assert run(True) == {(7, 12, "basket"), (8, 10, "popular"), (8, 12, "popular")} | empty


def test_substitutes_get_a_second_trial(spark):
    stored = spark.createDataFrame([(1, 11), (1, 12), (2, 12), (2, 10)], "basket_id long, item long")
    sims = cosine.item_cosine(stored, "basket_id", "item")
    requests = spark.createDataFrame([(7,), (8,), (9,)], "query_id long")
    queries = spark.createDataFrame([(7, 11), (8, 50), (9, 99)], "query_id long, item long")
    popular = spark.createDataFrame([(77, 1)], "item long, rnk int")
    shelf = spark.createDataFrame(
        [(50, "a", "a", None, "t", "c", "X1"), (11, "b", "b", None, "t", "c", "X2"), (99, "z", "z", None, "t", "c", "Q1")],
        schemas.CATALOGUE,
    )
    forms = spark.createDataFrame([("t", "t")], "form string, equal_form string")
    got = nearest.recommend_with_substitutes(requests, queries, stored, sims, popular, shelf, forms)
    assert {(r.query_id, r.item, r.source) for r in got.collect()} == {
        (7, 10, "basket"), (8, 10, "basket"), (9, 77, "popular")
    }


def test_evaluation(spark):
    stored = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "basket_id long, item long")
    sims = cosine.item_cosine(stored, "basket_id", "item")
    held = spark.createDataFrame(
        [(5, 1, 11), (5, 2, 12), (6, 1, 11), (7, 2, 10), (7, 1, 99)], "basket_id long, n long, item long"
    )
    row = evaluate.hit_rate(held, stored, sims, ["n"]).first()
    assert (row.n, row.hits, row.hit_rate) == (2, 1, 0.5)  # the single-line basket doesn't count
    got = evaluate.rank_positions(held, stored, sims, ["n"]).collect()
    assert [(r.basket_id, r.target, r.pos) for r in got] == [(5, 12, 0)]
    rules = spark.createDataFrame([([11], [12]), ([10], [99])], "antecedent array<long>, consequent array<long>")
    hits = dict(evaluate.rule_hits(held, rules, ["n"]).collect())
    assert hits == {5: 1, 6: 0, 7: 0}


@pytest.mark.parametrize("kind,light", [("long", 256), ("string", 9)])
def test_nearest_basket_in_many_groups(spark, monkeypatch, kind, light):
    """Light items meet in many small groups, the others in rounds; a missing basket or query is a basket like others."""
    monkeypatch.setattr(nearest, "LIGHT", light)
    monkeypatch.setattr(nearest, "GROUP_ENTRIES", 50)
    monkeypatch.setattr(nearest, "PAIRS", 20)
    rng = random.Random(light)
    lines = [(b, i) for b in range(60) for i in rng.sample(range(25), rng.randrange(1, 9))] + [(b, 90 + b % 2) for b in range(70, 76)]
    lines += [(b, i) for b in range(80, 84) for i in (1, 2, 3)] + [(59, 1), (59, 1)]
    name = {b: b if kind == "long" else f"{b:05}" for b in range(2000)}
    for same in (True, False):
        asked = lines if same else [(1000 + q, i) for q, i in lines if q % 3] + [(1999, 777)]
        want = {name[q]: (name[b], o, s) for q, (b, o, s) in brute_nearest(asked, lines, same).items()}
        stored = spark.createDataFrame([(name[b], name[i]) for b, i in lines], f"basket_id {kind}, item {kind}")
        queries = spark.createDataFrame([(name[q], name[i]) for q, i in asked], f"query_id {kind}, item {kind}")
        got = nearest.nearest_basket(queries, stored, 10_000, same)
        assert {r.query_id: (r.basket_id, r.overlap, r.size) for r in got.collect()} == want
        # A basket without an id comes first among equals, and is nobody's own.
        missing = stored.unionByName(spark.createDataFrame([(None, i) for i in map(name.get, (1, 2, 3))] + [(name[999], None)], stored.schema))
        found = nearest.nearest_basket(queries, missing, 10_000, same).where(F.col("query_id").isin(name[82], name[1082]))
        assert [(r.basket_id, r.overlap, r.size) for r in found.collect()] == [(None, 3, 3)]


@pytest.mark.parametrize("postings", [10_000, 10])
def test_light_items_write_no_postings(spark, monkeypatch, postings):
    """Remainders of light items are shuffled once to where they meet, and not written."""
    labels = []
    settled = nearest.settle
    monkeypatch.setattr(nearest, "settle", lambda df, label: labels.append(label) or settled(df, label))
    lines = [(b, i) for b in range(50) for i in (b % 10, 20 + b % 9)]
    stored = spark.createDataFrame(lines, "basket_id long, item long")
    queries = stored.withColumnRenamed("basket_id", "query_id")
    got = {r.query_id: (r.basket_id, r.overlap, r.size) for r in nearest.nearest_basket(queries, stored, postings, True).collect()}
    assert got == brute_nearest(lines, lines, True)
    assert not {"remainders", "postings", "probed"} & set(labels)


def test_small_postings_leave_light_items_out_of_rounds(spark, monkeypatch):
    """Items of more sets than a posting's part may hold are light as long as ``LIGHT`` says so; sets are made once."""
    labels = []
    settled = nearest.settle
    monkeypatch.setattr(nearest, "settle", lambda df, label: labels.append(label) or settled(df, label))
    lines = [(b, i) for b in range(120) for i in (b % 2, 20 + b % 7, 40 + b % 11)]
    stored = spark.createDataFrame(lines, "basket_id long, item long")
    queries = stored.withColumnRenamed("basket_id", "query_id")

    def found(postings):
        labels.clear()
        return {r.query_id: (r.basket_id, r.overlap, r.size) for r in nearest.nearest_basket(queries, stored, postings, True).collect()}

    want = brute_nearest(lines, lines, True)
    assert found(5) == want
    assert "asked-sets" in labels and not {"remainders", "postings", "probed"} & set(labels)
    monkeypatch.setattr(nearest, "LIGHT", 12)
    assert found(5) == want
    assert {"remainders", "postings", "probed"} <= set(labels)


def test_both_trials_use_the_same_sets(spark, monkeypatch):
    """The stored sets and the neighbours are made once for both trials."""
    labels = []
    settled = nearest.settle
    monkeypatch.setattr(nearest, "settle", lambda df, label: labels.append(label) or settled(df, label))
    stored = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 10)], "basket_id long, item long")
    requests = spark.createDataFrame([(7,), (8,)], "query_id long")
    queries = spark.createDataFrame([(7, 11), (8, 99)], "query_id long, item long")
    popular = spark.createDataFrame([(10, 1)], "item long, rnk int")
    monkeypatch.setattr(nearest, "similar_products", lambda asked, *rest, **limit: asked.select("id", F.lit(12).cast("bigint").alias("similar_id")))
    sims = cosine.item_cosine(stored, "basket_id", "item")
    got = nearest.recommend_with_substitutes(requests, queries, stored, sims, popular, stored, stored)
    rows = {(r.query_id, r.item, r.source) for r in got.collect()}
    assert {q for q, _, _ in rows} == {7, 8} and (8, 11, "basket") in rows
    assert labels.count("basket-sets") == labels.count("similarity") == 1
