"""Nearest stored basket, and the recommendation chain built on it."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.operators.cosine import recommend_items
from cartloom.operators.similar import similar_products
from cartloom.session import settle, shuffled

# Ship the helpers of this module inside the task, so that executors don't need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Items of more stored sets than this are probed in rounds; all others at once.
LIGHT = 256
# Items of remainders in a group, and pairs of remainders looked at together.
GROUP_ENTRIES = 500_000
PAIRS = 4_000_000
# Items probed in the first round; each further round probes twice as many.
FIRST_PROBES = 4
# Pairs of items up to which two remainders are compared item by item.
FEW = 64
# Sets of more distinct items are met by counting common items: their remainders
# from each item on would take the square of their size.
LONG_SET = 256


def nearest_basket(
    queries: DataFrame,
    stored: DataFrame,
    max_postings: int = 10_000,
    same_ids: bool = False,
    shelf: DataFrame | None = None,
) -> DataFrame:
    """``query_id, basket_id, overlap, size`` of the best stored basket per query.

    ``queries`` is (query_id, item) and ``stored`` (basket_id, item), one row
    per line. Most distinct common items wins, then fewest lines, then the
    lowest id; no common item, no row. ``same_ids`` says that queries are
    stored baskets themselves, and leaves out each query's own basket.

    Baskets of the same items collapse first on both sides: only the best of
    them can be an answer (the second best if the best asks itself), so any
    number of copies costs as much as one.

    Only items on both sides are looked at, rarest first. A pair of sets is
    found at its first common item, where what both have in common is in their
    remainders: the items from there on. Light items (of ``LIGHT`` stored sets
    and the larger of ``LIGHT`` and ``max_postings`` queries at most) come first
    and are dealt to groups of bounded size, where the remainders meet.

    The others are probed in rounds. A posting holds, for each different remainder,
    its two best sets. However many sets hold the most frequent item, it has one
    remainder; the next has two at most, and so on. A query leaves as soon as
    its best overlap exceeds the number of items it hasn't probed. Postings of
    more than ``max_postings`` remainders, and the queries that probe one, are
    dealt to as many tasks as that takes.

    ``shelf`` is what :func:`basket_sets` makes of ``stored``, if asked more than once.
    """
    shelf = basket_sets(stored) if shelf is None else shelf
    asked = settle(_item_sets(queries, "query_id").select("query_id", "items"), "asked-sets")
    own = shelf if same_ids else shelf.limit(0)
    kinds = settle(
        asked.groupBy("items").agg(F.min("query_id").alias("kid")).join(own, "items", "left"),
        "query-sets",
    )
    held_by = shelf.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    asked_by = kinds.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("asked"))
    heavy = (F.col("n") > LIGHT) | (F.col("asked") > max(LIGHT, max_postings))
    frequency = settle(held_by.join(asked_by, "item").select("item", "n", heavy.alias("heavy")), "item-frequency")
    held = settle(_rarest_first(shelf, frequency, "sid", "size"), "ordered-sets")
    probing = _rarest_first(kinds.withColumnRenamed("sid", "own"), frequency, "kid", "own")
    best = _best(settle(probing, "open-queries"), held, max_postings, not frequency.where("heavy").isEmpty())

    full = (-F.size("items").cast("bigint")).alias("o")
    among_copies = F.when(
        F.col("sid") != F.col("query_id"), F.struct(full, F.col("size"), F.col("sid"))
    ).when(
        F.col("next_sid").isNotNull(),
        F.struct(full, F.col("next_size").alias("size"), F.col("next_sid").alias("sid")),
    )
    return (
        asked.join(kinds, "items")
        .join(best, "kid", "left")
        .select("query_id", F.least("b", among_copies).alias("b"))
        .where(F.col("b").isNotNull())
        .select(
            "query_id", F.col("b.sid").alias("basket_id"), (-F.col("b.o")).alias("overlap"), "b.size"
        )
    )


def basket_sets(stored: DataFrame) -> DataFrame:
    """``items, sid, size, next_sid, next_size``: each set of items with its two best baskets."""
    place = Window.partitionBy("items").orderBy("size", "basket_id")
    first, second = F.col("_r") == 1, F.col("_r") == 2
    return settle(
        _item_sets(stored, "basket_id")
        .withColumn("_r", F.row_number().over(place))
        .where(F.col("_r") <= 2)
        .groupBy("items")
        .agg(
            F.min(F.when(first, F.col("basket_id"))).alias("sid"),
            F.min(F.when(first, F.col("size"))).alias("size"),
            F.min(F.when(second, F.col("basket_id"))).alias("next_sid"),
            F.min(F.when(second, F.col("size"))).alias("next_size"),
        ),
        "basket-sets",
    )


def _item_sets(lines: DataFrame, key: str) -> DataFrame:
    """``key, items, size``: distinct items (sorted) and number of lines per basket."""
    return lines.groupBy(key).agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.count(F.lit(1)).alias("size")
    )


def _rarest_first(sets: DataFrame, frequency: DataFrame, *keys: str) -> DataFrame:
    """``keys, items, light``: the items in ``frequency``, rarest first, and how many of them are light.

    All light items come before the others; without a column ``heavy`` none is light.
    """
    frequency = frequency if "heavy" in frequency.columns else frequency.withColumn("heavy", F.lit(True))
    ranked = sets.select(*keys, F.explode("items").alias("item")).join(frequency, "item")
    return ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("heavy", "n", "item"))).getField("item").alias("items"),
        F.count(F.when(~F.col("heavy"), 1)).cast("int").alias("light"),
    )


def _remainders(sets: DataFrame, *keys: str) -> DataFrame:
    """``keys, at, item, rest``: each item with the items from it on."""
    return sets.select(*keys, F.posexplode("items").alias("at", "item"), "items").select(
        *keys, "at", "item", F.expr("slice(items, at + 1, size(items))").alias("rest")
    )


def _postings(held: DataFrame, asking: DataFrame, max_postings: int) -> tuple[DataFrame, DataFrame]:
    """Per item its remainders, each with its two best sets, and how the larger postings are dealt.

    ``item, slice, part, entries``, and ``item, slices, parts`` for items of more
    than one slice or part: a slice holds so many remainders, a part is for so
    many of the queries ``asking``.
    """
    in_rest = Window.partitionBy("item", "rest").orderBy("size", "sid")
    champion = F.struct("size", "sid")
    distinct = settle(
        _remainders(held, "sid", "size")
        .withColumn("_r", F.row_number().over(in_rest))
        .where(F.col("_r") <= 2)
        .groupBy("item", "rest")
        .agg(
            F.min(champion).alias("first"),
            F.min(F.when(F.col("_r") == 2, champion)).alias("second"),
        ),
        "remainders",
    )
    share = F.ceil(F.count(F.lit(1)) / max_postings).cast("int")
    slices = distinct.groupBy("item").agg(share.alias("slices"))
    parts = asking.select(F.explode("items").alias("item")).groupBy("item").agg(share.alias("parts"))
    dealt = settle(slices.join(parts, "item").where("slices > 1 OR parts > 1"), "dealt")
    whole = _dealt(distinct, dealt).withColumn("slice", F.pmod(F.xxhash64("rest"), F.col("slices")).cast("int"))
    postings = whole.groupBy("item", "slice", "parts").agg(F.collect_list(F.struct("rest", "first", "second")).alias("entries"))
    copies = postings.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return settle(copies, "postings"), dealt


def _dealt(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Adds ``slices`` and ``parts``, 1 for all but the larger postings."""
    joined = rows.join(dealt, "item", "left")
    return joined.withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("parts", F.coalesce("parts", F.lit(1)))


def _probed(probes: DataFrame, postings: DataFrame, dealt: DataFrame) -> DataFrame:
    """``kid, b``: the best set that each query finds through the items it probes."""
    spread = (
        _dealt(probes, dealt)
        .withColumn("part", F.pmod(F.xxhash64("kid"), F.col("parts")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .drop("slices", "parts")
    )

    def candidate(entry: Column) -> Column:
        mine = entry["first"]["sid"] == F.col("own")
        chosen = F.when(F.coalesce(mine, F.lit(False)), entry["second"]).otherwise(entry["first"])
        # Looking each item up costs less than a hash set where few are compared with few.
        looked_up = F.size(F.filter("rest", lambda item: F.array_contains(entry["rest"], item)))
        few = F.size("rest") * F.size(entry["rest"]) <= FEW
        common = F.when(few, looked_up).otherwise(F.size(F.array_intersect(entry["rest"], F.col("rest"))))
        found = F.struct((-common).cast("bigint").alias("o"), chosen["size"].alias("size"), chosen["sid"].alias("sid"))
        return F.when(chosen.isNotNull(), found)

    met = spread.join(shuffled(postings), ["item", "slice", "part"])
    return met.select("kid", F.array_min(F.transform("entries", candidate)).alias("b")).groupBy("kid").agg(F.min("b").alias("b"))


def _best(open_: DataFrame, held: DataFrame, max_postings: int, heavy: bool) -> DataFrame:
    """``kid, b`` with b (o: minus the overlap, size, sid) for each query that has a common item with a set.

    ``heavy`` tells whether there are items that aren't light.
    """
    short, long_ = F.size("items") <= LONG_SET, F.size("items") > LONG_SET
    counted = None
    if not (held.where(long_).isEmpty() and open_.where(long_).isEmpty()):
        counted = _through(open_, held.where(long_)).unionByName(_through(open_.where(long_), held.where(short)))
        counted = counted.groupBy("kid").agg(F.min("b").alias("b"))
    answered = _through_light(open_.where(short), held.where(short))
    if heavy:
        answered = _in_rounds(open_.where(short), answered, held.where(short), max_postings)
    if counted is None:
        return answered
    return answered.unionByName(counted).groupBy("kid").agg(F.min("b").alias("b"))


def _in_rounds(open_: DataFrame, found: DataFrame, held: DataFrame, max_postings: int) -> DataFrame:
    """``kid, b`` of all queries that find a set, after ``found`` through light items."""
    others = F.expr("slice(items, light + 1, size(items))")
    held, open_ = held.withColumn("items", others), open_.withColumn("items", others)
    postings, dealt = _postings(held, open_, max_postings)
    open_ = open_.withColumn("b", F.lit(None).cast(found.schema["b"].dataType))
    answered, done, upto = None, 0, 0
    while True:
        if upto:
            turn = _remainders(open_, "kid", "own").where(F.col("at").between(done, upto - 1)).drop("at")
            found = _probed(turn, postings, dealt)
        new = found.withColumnRenamed("b", "new")
        seen = settle(
            open_.join(new, "kid", "left").select("kid", "own", "items", F.least("b", "new").alias("b")), "probed"
        )
        left = F.size("items") - upto
        leaves = (left <= 0) | F.coalesce(-F.col("b.o") > left, F.lit(False))
        gone = seen.where(leaves & F.col("b").isNotNull()).select("kid", "b")
        answered = gone if answered is None else answered.unionByName(gone)
        open_, done, upto = seen.where(~leaves), upto, upto * 2 + FIRST_PROBES
        if open_.isEmpty():
            return answered


def _through_light(probing: DataFrame, held: DataFrame) -> DataFrame:
    """``kid, b``: the best set that each query finds through light items."""
    entries = F.sum(F.col("light") * F.size("items"))
    total = sum(side.agg(entries).first()[0] or 0 for side in (probing, held))
    group = F.pmod(F.xxhash64("item"), F.lit(-(-total // GROUP_ENTRIES) or 1)).cast("int").alias("g")
    kid, sid = probing.schema["kid"].dataType.simpleString(), held.schema["sid"].dataType.simpleString()

    def dealt(side: DataFrame, *keys: str) -> DataFrame:
        # What follows the item is enough: both sides have the item itself.
        after = F.expr("slice(items, at + 2, size(items))").alias("rest")
        placed = side.select(*keys, "items", F.posexplode(F.expr("slice(items, 1, light)")).alias("at", "item"))
        return placed.select(*keys, "item", after, group).groupBy("g")

    met = dealt(probing, "kid", "own").cogroup(dealt(held, "sid", "size")).applyInArrow(
        _meet_remainders, f"kid {kid}, o bigint, size bigint, sid {sid}"
    )
    return met.groupBy("kid").agg(F.min(F.struct("o", "size", "sid")).alias("b"))


def _meet_remainders(asked: pa.Table, held: pa.Table) -> pa.Table:
    """``kid, o, size, sid``: the best set that each remainder of a query meets at its item.

    Sets that have more than the item in common are found through the next
    common items. Without such a set, the best of all sets with the item is the answer.
    """
    asked, held = asked.combine_chunks(), held.combine_chunks()
    if not asked.num_rows or not held.num_rows:
        return pa.table({"kid": asked.column("kid")[:0], "o": pa.array([], pa.int64()), "size": held.column("size")[:0], "sid": held.column("sid")[:0]})
    one = lambda table, name: pa.concat_arrays(table.column(name).chunks)
    rests = [one(asked, "rest"), one(held, "rest")]
    parts = [one(asked, "item"), one(held, "item"), *(r.flatten() for r in rests)]
    coded = pa.concat_arrays(parts).dictionary_encode()
    a_item, h_item, a_next, h_next = np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(p) for p in parts])[:-1])
    a_row, h_row = (np.repeat(np.arange(len(r)), pc.list_value_length(r).to_numpy()) for r in rests)
    sid, size = one(held, "sid"), one(held, "size").to_numpy()
    place = pc.rank(sid, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    # A null is no query's own set.
    own = pc.fill_null(pc.index_in(one(asked, "own"), value_set=sid, skip_nulls=True), -1).to_numpy()
    own = np.where(own >= 0, place[own], -1)

    # Without a second common item: the best set of the item, or the next best if that is one's own.
    best_first = np.lexsort((place, size, h_item))
    heads = h_item[best_first]
    at, end = np.searchsorted(heads, a_item, "left"), np.searchsorted(heads, a_item, "right")
    at += (at < end) & (place[best_first[np.minimum(at, len(heads) - 1)]] == own)
    found = at < end
    best = np.zeros(len(a_item), dtype=np.int64)
    best[found] = best_first[at[found]]
    common = np.ones(len(a_item), dtype=np.int64)

    known = len(coded.dictionary)
    key = h_item[h_row] * known + h_next
    order = np.argsort(key, kind="stable")
    key, wanted = key[order], a_item[a_row] * known + a_next
    low = np.searchsorted(key, wanted, "left")
    times = np.searchsorted(key, wanted, "right") - low
    hit = np.flatnonzero(times)
    a_row, low, times = a_row[hit], low[hit], times[hit]
    # All items of one remainder are looked at together.
    turn = np.cumsum(times)[np.searchsorted(a_row, a_row, "left")] // PAIRS
    for cut in np.split(np.arange(len(a_row)), np.flatnonzero(np.diff(turn)) + 1):
        n = times[cut]
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[cut], n)
        pairs, more = np.unique(np.repeat(a_row[cut], n) * len(sid) + h_row[order[spot]], return_counts=True)
        q, s = np.divmod(pairs, len(sid))
        other = place[s] != own[q]
        q, s, more = q[other], s[other], more[other]
        ranked = np.lexsort((place[s], size[s], -more, q))
        first = ranked[np.flatnonzero(np.diff(q[ranked], prepend=-1))]
        best[q[first]], common[q[first]] = s[first], 1 + more[first]
    chosen = pa.array(best[found])
    return pa.table({"kid": one(asked, "kid").filter(pa.array(found)), "o": pa.array(-common[found]),
                     "size": one(held, "size").take(chosen), "sid": sid.take(chosen)})


def _through(probing: DataFrame, held: DataFrame) -> DataFrame:
    """``kid, b`` of all pairs of different sets that share an item, by counting such items."""
    probes = probing.select("kid", "own", F.explode("items").alias("item"))
    return (
        probes.join(shuffled(held.select("sid", "size", F.explode("items").alias("item"))), "item")
        .where(F.col("own").isNull() | (F.col("own") != F.col("sid")))
        .groupBy("kid", "sid", "size")
        .agg((-F.count(F.lit(1))).alias("o"))
        .select("kid", F.struct("o", "size", "sid").alias("b"))
    )


def nearest_and_served(
    queries: DataFrame, stored: DataFrame, similarity: DataFrame, k: int | None = 10,
    same_ids: bool = False, max_postings: int = 10_000, shelf: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``query_id, basket_id`` of the nearest baskets, and what each of these gets recommended.

    Many queries share a nearest basket, so each such basket is served once.
    """
    near = settle(
        nearest_basket(queries, stored, max_postings, same_ids, shelf).select("query_id", "basket_id"),
        "nearest",
    )
    chosen = near.select("basket_id").distinct()
    return near, recommend_items(
        stored.join(chosen, "basket_id", "left_semi"), similarity, "basket_id", "item", k
    )


def recommend_for_baskets(
    queries: DataFrame, stored: DataFrame, similarity: DataFrame, k: int | None = 10,
    same_ids: bool = False, max_postings: int = 10_000,
) -> DataFrame:
    """``query_id, item, score, rnk``: what the nearest stored basket gets recommended."""
    near, served = nearest_and_served(queries, stored, similarity, k, same_ids, max_postings)
    return near.join(served, "basket_id").drop("basket_id")


def recommend_with_fallback(
    requests: DataFrame,
    queries: DataFrame,
    stored: DataFrame,
    similarity: DataFrame,
    popular: DataFrame,
    k: int = 10,
    last_trial: bool = False,
    max_postings: int = 10_000,
    shelf: DataFrame | None = None,
) -> DataFrame:
    """``query_id, item, score, source, rnk`` for every request.

    ``requests`` lists all query ids, ``queries`` their items. An empty basket
    gets the popular items with score 0. A basket without any stored
    neighbour gets nothing, or the popular items on the last trial.
    ``popular`` is a short top list (item, rnk).
    """
    near, served = nearest_and_served(queries, stored, similarity, k, max_postings=max_postings, shelf=shelf)
    answered = near.join(served, "basket_id").select(
        "query_id", "item", "score", F.lit("basket").alias("source"), F.col("rnk").cast("bigint").alias("rnk")
    )
    if last_trial:
        left_over = requests.join(near, "query_id", "left_anti")
    else:
        left_over = requests.join(queries.select("query_id"), "query_id", "left_anti")
    short_list = popular.agg(F.array_sort(F.collect_list(F.struct(F.col("rnk").cast("bigint").alias("rnk"), "item")))).scalar()
    general = left_over.select("query_id", F.explode(short_list).alias("p")).select(
        "query_id", "p.item", F.lit(0.0).alias("score"), F.lit("popular").alias("source"), "p.rnk"
    )
    return answered.unionByName(general)


def recommend_with_substitutes(
    requests: DataFrame,
    queries: DataFrame,
    stored: DataFrame,
    similarity: DataFrame,
    popular: DataFrame,
    catalogue: DataFrame,
    form_map: DataFrame,
    k: int = 10,
    per_item: int = 1,
    max_postings: int = 10_000,
) -> DataFrame:
    """Like :func:`recommend_with_fallback`; baskets left without an answer try once more.

    The second trial asks with the substitutes of their items, and falls back
    to the popular items. Both trials use the same sets and neighbours, made once.
    """
    shelf, similarity = basket_sets(stored), settle(similarity, "similarity")
    first = settle(
        recommend_with_fallback(requests, queries, stored, similarity, popular, k, False, max_postings, shelf),
        "first-trial",
    )
    again = requests.join(first.select("query_id").distinct(), "query_id", "left_anti")
    open_items = queries.join(again, "query_id", "left_semi")
    swaps = similar_products(
        open_items.select(F.col("item").alias("id")).distinct(), catalogue, form_map, limit=per_item
    )
    swapped = settle(
        open_items.join(swaps.select(F.col("id").alias("item"), "similar_id"), "item").select(
            "query_id", F.col("similar_id").alias("item")
        ),
        "substitutes",
    )
    second = recommend_with_fallback(
        again, swapped, stored, similarity, popular, k, True, max_postings, shelf
    )
    return first.unionByName(second)
