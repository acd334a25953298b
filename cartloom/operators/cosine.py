"""Item-item cosine on binary purchases, and recommending from it.

Users fall into three kinds by their number of distinct items:

* up to ``max_degree``: their item pairs come from a join whose groups are
  bounded by that number, and are summed map-side before the shuffle;
* hot ones, who bought more than one in ``HOT_SHARE`` of all items (a walk-in
  account may hold a third of all rows): no pair is enumerated. Each item gets a
  bitmap of the hot users that bought it, and the shared part of a pair is the
  bit count of both bitmaps' AND, for any number of hot users. Items with equal
  bitmaps form one class, and inside a class only the ``top + 1`` least bought
  items can be anyone's best neighbour that is shared through hot users alone.
  Classes are compared in tiles, of which only the best few of each row leave;
* the rest: their items are cut into blocks of about ``max_degree`` and the
  block pairs are spread over tasks by their own key.

Without any big user only the first part is planned, and with a limit per item
its pairs aren't shuffled one by one: every item gets the lists of its users, items
are dealt to groups of bounded size, and an item's neighbours are counted
and chosen where its lists meet. Items whose lists may be too long for a group are counted
as pairs. Lists of whole numbers travel in packs, and many of them in several
rounds, each written before the next, so that the disk holds the shuffle of one round.

Nothing is dropped: all parts add up to the exact counts. Pairs travel as
two items and a count; item counts and bitmaps are attached to the sums.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.operators import packs
from cartloom.session import settle, shuffled, small_side

# Ship the helpers of this module inside the task, so that executors don't need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Adding a bit to all pairs of items costs about as much as enumerating the pairs of so small a part of them.
HOT_SHARE = 32
# Rows of a tile of bitmaps.
TILE = 2048
# Entries of users' lists in a group of items, and the most that one item may add to them.
GROUP_ENTRIES = 2_000_000
ITEM_ENTRIES = 4_000_000
# Entries of lists that are shuffled in one round.
ROUND_ENTRIES = 4_000_000_000
# Neighbours (all lists together) that are broadcast; users with more items are spread.
BROADCAST_ENTRIES = 4_000_000
MANY_ITEMS = 10_000

# Sums of whole units don't depend on the order in which tasks deliver them.
UNITS = 1_000_000_000


def _no_bits() -> Column:
    return F.array().cast("array<bigint>")


def _bitmaps(pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """``i, m``: per item the words of its bitmap over the hot users (up to the last word that has a bit)."""
    numbered = settle(hot.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("d"), "u")) - 1), "hot-users")
    words = (
        pairs.join(numbered.select("u", "bit"), "u")
        .groupBy("i", F.expr("bit div 64").cast("int").alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % 64)).alias("word"))
    )
    held = F.map_from_entries(F.collect_list(F.struct("at", "word")))
    word = lambda at: F.coalesce(F.try_element_at("held", at), F.lit(0).cast("bigint"))
    sparse = words.groupBy("i").agg(held.alias("held"), F.max("at").alias("last"))
    return sparse.select("i", F.transform(F.sequence(F.lit(0), "last"), word).alias("m"))


def _in_common(x: str, y: str) -> Column:
    """The number of hot users in both bitmaps; words that one side lacks are empty."""
    both = F.zip_with(x, y, lambda p, q: F.bit_count(F.coalesce(p, F.lit(0).cast("bigint")).bitwiseAND(F.coalesce(q, F.lit(0).cast("bigint")))))
    return F.aggregate(both, F.lit(0).cast("bigint"), lambda total, n: total + n)


def item_cosine(
    interactions: DataFrame,
    user: str,
    item: str,
    top: int | None = 64,
    max_degree: int = 1000,
) -> DataFrame:
    """``item_a, item_b, cosine`` with the ``top`` best neighbours per item.

    Cosine of binary purchase vectors: common users over the root of the
    product of both users' counts. Ties at 12 decimals go to the lower item.
    """
    pairs = settle(
        interactions.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct(), "purchases"
    )
    degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    items = settle(pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "items")
    n_items = items.count()
    big = degree.where(F.col("d") > max_degree)
    if big.isEmpty():
        if top is not None:
            return _best_from_lists(pairs, items, n_items, degree, top)
        counted, marked = _meet(pairs, pairs, ["u"]), None
    else:
        big = settle(big, "big-users")
        hot, rest = (big.where(F.col("d") * HOT_SHARE > n_items), big.where(F.col("d") * HOT_SHARE <= n_items))
        marked = settle(_bitmaps(pairs, hot).join(items, "i"), "bitmaps")
        small = pairs.join(big.select("u"), "u", "left_anti")
        through_hot = _hot_pairs(marked) if top is None else _hot_candidates(marked, top)
        counted = (
            _meet(small, small, ["u"])
            .unionByName(_meet(*_blocks(pairs, rest, max_degree), ["u", "lo", "hi"]))
            .unionByName(through_hot)
        )
    scored = _cosines(counted, items, n_items, marked)
    if top is None:
        return _both_ways(scored)
    return _best_per_item(_both_ways(settle(scored, "item-pairs")), top, n_items)


def _best_from_lists(pairs: DataFrame, items: DataFrame, n_items: int, degree: DataFrame, top: int) -> DataFrame:
    """The best neighbours, from the lists that an item's users have; for users of few items."""
    entries, longest = degree.where("u IS NOT NULL").agg(F.sum(F.col("d") * F.col("d")), F.max("d")).first()
    heavy = F.col("n") * (longest or 0) > ITEM_ENTRIES
    few = items.where(heavy).count()
    known = pairs.where("u IS NOT NULL AND i IS NOT NULL")
    counted_lists = _counted_packs if items.schema["i"].dataType.simpleString() in packs.WHOLE else _counted_lists
    met = counted_lists(known, items, n_items, entries or 0, heavy, top)
    if not few:
        return met
    # Groups of these are as large as their lists, so their pairs are summed map-side and shuffled.
    own = small_side(items.where(heavy).select(F.col("i").alias("x")), few)
    asked = known.withColumnRenamed("i", "x").join(own, "x", "left_semi")
    counted = asked.join(shuffled(known.withColumnRenamed("i", "y")), "u").where("x <> y").select("x", "y", F.lit(1).alias("c"))
    return met.unionByName(_best_per_item(settle(_cosines(counted, items, n_items, None), "item-pairs"), top, n_items))


def _groups(entries: int) -> int:
    return -(-entries // GROUP_ENTRIES) or 1


def _in_rounds(rows: DataFrame, groups: int, entries: int, work: Callable[[pa.Table], pa.Table], schema: str, label: str) -> DataFrame:
    """What ``work`` makes of the packs of each group, in as many rounds as the entries of all lists need."""
    rounds = min(-(-entries // ROUND_ENTRIES) or 1, groups)
    if rounds > 1:
        rows = settle(rows, f"{label}-lists")
    done = []
    for k in range(rounds):
        sent = packs.sent(rows, groups * k // rounds, groups * (k + 1) // rounds)
        made = sent.groupBy("g").applyInArrow(work, schema)
        done.append(made if rounds == 1 else settle(made, f"{label}-round"))
    return functools.reduce(DataFrame.unionByName, done)


def _counted_packs(pairs: DataFrame, items: DataFrame, n_items: int, entries: int, heavy: Column, top: int) -> DataFrame:
    kind = items.schema["i"].dataType.simpleString()
    groups = _groups(entries)
    # Heavy items are in others' lists, and get none.
    group = F.when(heavy, -1).otherwise(F.pmod(F.xxhash64("i"), F.lit(groups))).cast("int")
    entry = F.struct("i", "n", group.alias("g"))
    lists = pairs.join(small_side(items, n_items), "i").groupBy("u").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    rows = lists.where(F.size("l") > 1).select(
        F.col("l.i").alias("to"), F.col("l.g").alias("g"), F.lit(None).cast("bigint").alias("own"), F.lit(False).alias("mark"),
        F.col("l.i").alias("ids"), F.col("l.n").alias("vals"),
    )
    schema = f"item_a {kind}, item_b {kind}, cosine double"
    return _in_rounds(rows, groups, entries, lambda table: _best_of_packs(table, top, kind), schema, "users")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


def _best_of_packs(table: pa.Table, top: int, kind: str) -> pa.Table:
    """``item_a, item_b, cosine`` of each receiver of the packs, from all lists that it got."""
    lists = packs.received(table.column("pack"))
    named, own = np.unique(lists.to, return_inverse=True)
    y, span, base = packs.narrow(lists.ids, len(named))
    keys = np.repeat(own, lists.size) * span + y
    order = packs.order_of(keys)
    keys, bought = keys[order], lists.values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    common = np.diff(np.append(first, len(keys)))
    x, y = np.divmod(keys[first], span)
    y, bought = packs.widened(y, base), bought[first]
    # An item is in its own lists, so its number is there.
    itself = named[x] == y
    times = np.zeros(len(named), dtype=np.float64)
    times[x[itself]] = bought[itself]
    x, y, common, bought = x[~itself], y[~itself], common[~itself], bought[~itself]
    cosine = common / np.sqrt(times[x] * bought)
    # rint: equal cosines that differ in the last bit count as ties.
    score = np.rint(cosine * 1e12)
    some = packs.likely(score, x, top)
    x, y, cosine, score = x[some], y[some], cosine[some], score[some]
    # Stable, so lower items come first.
    order = np.lexsort((-score, x))
    x, y, cosine = x[order], y[order], cosine[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    best = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < top
    ends = [pa.array(end[best]).cast(_arrow(kind)) for end in (named[x], y)]
    return pa.table({"item_a": ends[0], "item_b": ends[1], "cosine": pa.array(cosine[best])})


def _counted_lists(pairs: DataFrame, items: DataFrame, n_items: int, entries: int, heavy: Column, top: int) -> DataFrame:
    """As ``_counted_packs``, for items that aren't whole numbers."""
    kind, groups = items.schema["i"].dataType.simpleString(), _groups(entries)
    entry = F.struct("i", "n", heavy.alias("h"))
    lists = pairs.join(small_side(items, n_items), "i").groupBy("u").agg(F.collect_list(entry).alias("l"))
    light = F.filter("l", lambda e: ~e["h"])["i"]
    sent = lists.where(F.size("l") > 1).select(F.explode(light).alias("x"), F.col("l.i").alias("i"), F.col("l.n").cast("array<int>").alias("n"))
    dealt = sent.withColumn("g", F.pmod(F.xxhash64("x"), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInArrow(
        lambda table: _count_and_choose(table, top), f"item_a {kind}, item_b {kind}, cosine double"
    )


def _ordered_codes(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values in order, and each value's place among them."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _count_and_choose(table: pa.Table, top: int) -> pa.Table:
    """``item_a, item_b, cosine`` of each x of the table, from all lists that hold it."""
    table = table.combine_chunks()
    x, lists, numbers = (table.column(c).combine_chunks() for c in ("x", "i", "n"))
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    values, y = _ordered_codes(lists.flatten())
    bought = np.zeros(len(values), dtype=np.float64)
    bought[y] = numbers.flatten().to_numpy()
    # An item is in its own lists, so it has a place there.
    own = pc.index_in(x, value_set=values).to_numpy().astype(np.int64)
    met, common = np.unique(np.repeat(own, sizes) * len(values) + y, return_counts=True)
    x, y = np.divmod(met, len(values))
    apart = x != y
    x, y, common = x[apart], y[apart], common[apart]
    cosine = common / np.sqrt(bought[x] * bought[y])
    # rint: equal cosines that differ in the last bit count as ties. Stable, so lower items come first.
    order = np.lexsort((-np.rint(cosine * 1e12), x))
    x, y, cosine = x[order], y[order], cosine[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    best = rank < top
    return pa.table({"item_a": values.take(pa.array(x[best])), "item_b": values.take(pa.array(y[best])), "cosine": pa.array(cosine[best])})


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Item pairs within a group that is bounded by construction, lower item first."""
    met = left.select(*keys, F.col("i").alias("x")).join(shuffled(right.select(*keys, F.col("i").alias("y"))), keys)
    one = F.lit(1).alias("c")
    if "lo" not in keys:
        return met.where("x < y").select("x", "y", one)
    # Blocks: inside one block each pair once, across blocks both orders occur.
    return _lower_first(met.where("lo <> hi OR x < y").select("x", "y", one))


def _lower_first(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "c")


def _blocks(pairs: DataFrame, users: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Items of big users in hashed blocks, once per block pair and role.

    The join key (user, low block, high block) spreads one user over
    as many groups as it has block pairs.
    """
    cut = (
        pairs.join(users, "u")
        .withColumn("nb", F.ceil(F.col("d") / F.lit(size)).cast("int"))
        .withColumn("k", F.pmod(F.hash("i"), F.col("nb")))
    )
    low = cut.withColumn("hi", F.explode(F.sequence(F.col("k"), F.col("nb") - 1))).withColumn("lo", F.col("k"))
    high = cut.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("hi", F.col("k"))
    return low, high


def _cosines(counted: DataFrame, items: DataFrame, n_items: int, marked: DataFrame | None) -> DataFrame:
    """Sum the parts of each pair, add what hot users share, and normalise."""
    total = counted.groupBy("x", "y").agg(F.sum("c").alias("c"))
    for end in "xy":
        own = items.select(F.col("i").alias(end), F.col("n").alias(f"{end}_n"))
        total = total.join(small_side(own, n_items), end)
        if marked is not None:
            # A bitmap has a word for each 64 hot users.
            bits = marked.select(F.col("i").alias(end), F.col("m").alias(f"{end}_m"))
            total = total.join(bits, end, "left").withColumn(f"{end}_m", F.coalesce(f"{end}_m", _no_bits()))
    common = F.col("c") if marked is None else F.col("c") + _in_common("x_m", "y_m")
    norm = F.sqrt(F.col("x_n").cast("double") * F.col("y_n").cast("double"))
    return total.select(F.col("x").alias("item_a"), F.col("y").alias("item_b"), (common / norm).alias("cosine"))


def _both_ways(scored: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("item_a").alias("a"), F.col("item_b").alias("b")),
        F.struct(F.col("item_b").alias("a"), F.col("item_a").alias("b")),
    )
    return scored.select(F.explode(ends).alias("e"), "cosine").select(
        F.col("e.a").alias("item_a"), F.col("e.b").alias("item_b"), "cosine"
    )


def _best_per_item(directed: DataFrame, top: int, n_items: int) -> DataFrame:
    """The ``top`` highest neighbours of each ``item_a``.

    A histogram of the cosines per item (16 steps per octave, summed map-side)
    tells from which step on a neighbour can be among the best. Only rows above
    it are shuffled and sorted, a little more than ``top`` per item.
    """
    # The shift keeps powers of two, and equal values a bit apart, off the step edges.
    directed = directed.withColumn("step", F.floor(F.log2("cosine") * 16 + 1e-7).cast("int"))
    steps = directed.groupBy("item_a", "step").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("item_a").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    lowest = (
        steps.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .where(F.col("above") < top)
        .groupBy("item_a")
        .agg(F.min("step").alias("lowest"))
    )
    likely = directed.join(small_side(lowest, n_items), "item_a").where("step >= lowest")
    # rint: equal cosines that differ in the last bit count as ties.
    best = Window.partitionBy("item_a").orderBy(F.desc(F.rint(F.col("cosine") * 1e12)), "item_b")
    return (
        likely.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= top)
        .select("item_a", "item_b", "cosine")
    )


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Bitmaps of different lengths as one matrix."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), dtype=np.int64)
    for row, words in zip(out, lists, strict=True):
        row[:len(words)] = words
    return out.view(np.uint64)


def _tiles(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides in even tiles, copied to each pair of tiles: ``l_tile, r_tile``."""
    counts = [max(1, -(-side.count() // TILE)) for side in (left, right)]
    dealt = []
    for side, own, other, n, m in ((left, "l_tile", "r_tile", *counts), (right, "r_tile", "l_tile", *counts[::-1])):
        tile = F.pmod(F.xxhash64(*side.columns), F.lit(n)).cast("int")
        dealt.append(side.withColumn(own, tile).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))
    return dealt[0], dealt[1]


def _hot_candidates(marked: DataFrame, top: int) -> DataFrame:
    """Pairs worth scoring because hot users share them; their count starts at 0."""
    in_class = Window.partitionBy("m").orderBy("n", "i")
    heads = (
        marked.withColumn("_r", F.row_number().over(in_class))
        .where(F.col("_r") <= top + 1)
        .select(F.col("i").alias("y"), "n", "m")
    )
    asked = marked.select("m").distinct()
    kind = marked.schema["i"].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ``top + 1`` best items of this tile for each bitmap of the other, the lower item first on ties."""
        right = right.sort_by("y")
        a, b = _words(left.column("m")), _words(right.column("m"))
        width = min(a.shape[1], b.shape[1])
        root = np.sqrt(right.column("n").to_numpy().astype(np.float64))
        none = np.zeros(0, dtype=np.int64)
        rows, chosen, values = [none], [none], [none.astype(np.float64)]
        for at in range(len(a)):
            shared = np.bitwise_count(a[at, :width] & b[:, :width]).sum(axis=1)
            value = np.rint(shared / root * 1e12)
            some = np.flatnonzero(shared)
            if len(some) > top + 1:
                least = -np.partition(-value[some], top)[top]
                some = some[value[some] >= least]
            some = some[np.argsort(-value[some], kind="stable")][:top + 1]
            rows.append(np.full(len(some), at))
            chosen.append(some)
            values.append(value[some])
        return pa.table({"m": left.column("m").take(pa.array(np.concatenate(rows))),
                         "y": right.column("y").take(pa.array(np.concatenate(chosen))), "value": pa.array(np.concatenate(values))})

    left, right = _tiles(asked, heads)
    keys = ["l_tile", "r_tile"]
    options = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"m array<bigint>, y {kind}, value double")
    in_mask = Window.partitionBy("m").orderBy(F.desc("value"), "y")
    chosen = options.withColumn("_r", F.row_number().over(in_mask)).where(F.col("_r") <= top + 1).select("m", "y")
    pairs = marked.select(F.col("i").alias("x"), "m").join(shuffled(chosen), "m").where("x <> y")
    return _lower_first(pairs.select("x", "y", F.lit(0).alias("c"))).distinct()


def _hot_pairs(marked: DataFrame) -> DataFrame:
    """Without a limit per item every pair shared through a hot user is output."""
    kind = marked.schema["i"].dataType.simpleString()

    def shared(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _words(left.column("m")), _words(right.column("m"))
        width = min(a.shape[1], b.shape[1])
        met = [np.flatnonzero((a[at, :width] & b[:, :width]).any(axis=1)) for at in range(len(a))]
        rows = np.repeat(np.arange(len(a)), np.array([len(m) for m in met], dtype=np.int64))
        cols = np.concatenate([*met, np.zeros(0, dtype=np.int64)])
        return pa.table({"x": left.column("i").take(pa.array(rows)), "y": right.column("i").take(pa.array(cols))})

    left, right = _tiles(marked.select("i", "m"), marked.select("i", "m"))
    keys = ["l_tile", "r_tile"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(shared, f"x {kind}, y {kind}")
    return met.where("x < y").select("x", "y", F.lit(0).alias("c"))


def _neighbours(similarity: DataFrame) -> DataFrame:
    """``i, near``: each item with its neighbours and their weights in whole units."""
    weight = F.round(F.col("cosine") * UNITS).cast("bigint")
    return similarity.groupBy(F.col("item_a").alias("i")).agg(
        F.collect_list(F.struct(F.col("item_b").alias("j"), weight.alias("w"))).alias("near")
    )


def summed_neighbours(have: DataFrame, similarity: DataFrame, *also: DataFrame) -> DataFrame:
    """``u, i, w, known`` and the marks of ``also``: the neighbours of a user's items, their weights added up.

    ``have`` is (u, i), distinct. Each of ``also`` has (u, i) and one more
    column, a mark of 1 for pairs to be recognised among the sums.
    Most users are dealt to tasks once, items meet a broadcast table of neighbours (if
    counted small) there, and sums are local; those with more than
    ``MANY_ITEMS`` items are dealt by (user, neighbour), so that no task holds one.
    """
    near = settle(_neighbours(similarity), "neighbours")
    entries = near.agg(F.sum(F.size("near"))).first()[0] or 0
    many = have.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_ITEMS).select("u")
    marks = [have.withColumn("known", F.lit(1)), *also]
    names = [frame.columns[-1] for frame in marks]

    def rows(frame: DataFrame, mark: str | None) -> DataFrame:
        weight = [] if "w" in frame.columns else [F.lit(0).cast("bigint").alias("w")]
        marked = [(F.lit(1) if n == mark else F.lit(0)).alias(n) for n in names]
        return frame.select("u", "i", *(weight or ["w"]), *marked)

    def summed(own: DataFrame, extra: list[DataFrame]) -> DataFrame:
        met = own.join(small_side(near, entries, BROADCAST_ENTRIES), "i").select("u", F.explode("near").alias("e"))
        every = rows(met.select("u", F.col("e.j").alias("i"), F.col("e.w").alias("w")), None)
        for frame, mark in zip(extra, names, strict=True):
            every = every.unionByName(rows(frame, mark))
        return every.groupBy("u", "i").agg(F.sum("w").alias("w"), *(F.max(n).alias(n) for n in names))

    if many.isEmpty():
        return summed(have.repartition("u"), [m.repartition("u") for m in marks])
    many = settle(many, "many-items")
    few = [m.join(many, "u", "left_anti").repartition("u") for m in (have, *marks)]
    rest = [m.join(many, "u", "left_semi") for m in (have, *marks)]
    return summed(few[0], few[1:]).unionByName(summed(rest[0], rest[1:]))


def _few_and_many(have: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Users (u, i) whose lists fit a group, and those with more than ``MANY_ITEMS`` items, if any."""
    many = have.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_ITEMS).select("u")
    if many.isEmpty():
        return have, None
    many = settle(many, "many-items")
    return have.join(many, "u", "left_anti"), have.join(many, "u", "left_semi")


def _served(have: DataFrame, similarity: DataFrame, k: int | None, targets: DataFrame | None = None) -> DataFrame:
    """``u, i, w, n, rnk``: the first k sums of each user (all if None), or the places of ``targets`` (u, i).

    The lists of neighbours go to groups of users of bounded size, where
    they are added up and ranked, so that no sum is shuffled.
    """
    near = settle(_neighbours(similarity), "neighbours")
    entries, longest = near.agg(F.sum(F.size("near")), F.max(F.size("near"))).first()
    met = have.count() * (longest or 0)
    groups = _groups(met)
    rows = have.select("u", "i", F.lit(False).alias("target"))
    if targets is not None:
        rows = rows.unionByName(targets.select("u", "i", F.lit(True).alias("target")))
    kinds = [frame.schema[c].dataType.simpleString() for frame, c in ((have, "u"), (have, "i"), (near, "i"))]
    if all(kind in packs.WHOLE for kind in kinds):
        return _served_packs(rows, near, longest or 1, groups, met, k, targets is not None, kinds)
    dealt = rows.where("u IS NOT NULL").withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int"))
    if (entries or 0) <= BROADCAST_ENTRIES:
        # The lists are here already: dealing first leaves them out of the shuffle.
        dealt = dealt.repartition("g")
    lists = near.select("i", F.col("near.j").alias("j"), F.col("near.w").alias("w"))
    met = dealt.join(small_side(lists, entries or 0, BROADCAST_ENTRIES), "i", "left")
    own = lambda c: F.when(~F.col("target"), F.col(c)).alias(c)
    places = targets is not None
    users, items = (have.schema[c].dataType.simpleString() for c in "ui")
    return met.select("g", "u", "i", "target", own("j"), own("w")).groupBy("g").applyInArrow(
        lambda table: _sum_and_rank(table, k, places),
        f"u {users}, i {items}, w bigint, n bigint, rnk int",
    )


def _served_packs(
    rows: DataFrame, near: DataFrame, longest: int, groups: int, entries: int, k: int | None, places: bool, kinds: list[str]
) -> DataFrame:
    """The lists of neighbours go to the groups of the users in packs; an item's users are dealt to several rows if there are many."""
    most = max(packs.CHUNK_ENTRIES // longest, 1)
    cut = F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / most)).cast("int")
    often = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    part = F.lit(0)
    if not often.isEmpty():
        # Fewer than one in ``most`` rows.
        rows = rows.join(small_side(often := settle(often, "often"), often.count()), "i", "left")
        part = F.coalesce(cut, F.lit(0))
    # A missing item meets nothing, but counts among its users' items.
    part = F.when(F.col("i").isNull(), F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int")).otherwise(part)
    dealt = F.struct("u", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int").alias("g"))
    users = rows.where("u IS NOT NULL").groupBy("i", "target", part.alias("part")).agg(F.collect_list(dealt).alias("l"))
    lists = near.select("i", F.sort_array("near").alias("near"))
    none = F.array().cast("array<bigint>")
    own = lambda c: F.when(~F.col("target"), F.coalesce(F.col(f"near.{c}").cast("array<bigint>"), none)).otherwise(none)
    asked = users.join(lists, "i", "left").select(
        F.col("l.u").alias("to"), F.col("l.g").alias("g"), F.col("i").alias("own"), F.col("target").alias("mark"), own("j").alias("ids"), own("w").alias("vals")
    )
    schema = f"u {kinds[0]}, i {kinds[1]}, w bigint, n bigint, rnk int"
    return _in_rounds(asked, groups, entries, lambda table: _rank_packs(table, k, places, kinds), schema, "items")


def _rank_packs(table: pa.Table, k: int | None, places: bool, kinds: list[str]) -> pa.Table:
    """As ``_sum_and_rank``, for the users of the packs."""
    lists = packs.received(table.column("pack"))
    named, u = np.unique(lists.to, return_inverse=True)
    held = ~lists.mark
    size = np.bincount(u[held], minlength=len(named))
    items, span, base = packs.narrow(np.concatenate([lists.ids, lists.own[lists.known]]), len(named))
    at = u[lists.known] * span + items[len(lists.ids):]
    keys = np.repeat(u, lists.size) * span + items[:len(lists.ids)]
    order = packs.order_of(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    # Whole units, exact in any order.
    sums = np.add.reduceat(lists.values[order], first) if len(keys) else keys
    keys = keys[first]
    new = (sums > 0) & ~np.isin(keys, at[held[lists.known]])
    keys, sums = keys[new], sums[new]
    owner = keys // span
    if k is not None and not places:
        some = packs.likely(sums, owner, k)
        keys, sums, owner = keys[some], sums[some], owner[some]
    # Stable: lower items first.
    order = np.lexsort((-sums, owner))
    keys, sums, owner = keys[order], sums[order], owner[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys)))) + 1
    chosen = np.isin(keys, at[lists.mark[lists.known]]) if places else np.full(len(keys), True) if k is None else rank <= k
    keys, sums, owner, rank = keys[chosen], sums[chosen], owner[chosen], rank[chosen]
    return pa.table({
        "u": pa.array(named[owner]).cast(_arrow(kinds[0])), "i": pa.array(packs.widened(keys - owner * span, base)).cast(_arrow(kinds[1])),
        "w": pa.array(sums), "n": pa.array(size[owner].astype(np.int64)), "rnk": pa.array(rank.astype(np.int32)),
    })


def _sum_and_rank(table: pa.Table, k: int | None, places: bool) -> pa.Table:
    """The users of one group: their neighbours' weights added up, known items left out, ranked."""
    users, items, target, j, w = (table.column(c).combine_chunks() for c in ("u", "i", "target", "j", "w"))
    named, u = _ordered_codes(users)
    target = target.to_numpy(zero_copy_only=False)
    size = np.bincount(u[~target], minlength=len(named))
    known = items.is_valid().to_numpy(zero_copy_only=False)
    listed = items.drop_null()
    values, codes = _ordered_codes(pa.concat_arrays([listed, j.flatten().cast(listed.type)]))
    at = u[known] * len(values) + codes[:len(listed)]
    lengths = pc.fill_null(pc.list_value_length(j), 0).to_numpy().astype(np.int64)
    keys, place = np.unique(np.repeat(u, lengths) * len(values) + codes[len(listed):], return_inverse=True)
    # Whole units of at most 10,000 items: exact in doubles.
    sums = np.bincount(place, w.flatten().to_numpy(), minlength=len(keys)).astype(np.int64)
    new = (sums > 0) & ~np.isin(keys, at[~target[known]])
    keys, sums = keys[new], sums[new]
    owner = keys // max(len(values), 1)
    # Stable: lower items first.
    order = np.lexsort((-sums, owner))
    keys, sums, owner = keys[order], sums[order], owner[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys)))) + 1
    chosen = np.isin(keys, at[target[known]]) if places else np.full(len(keys), True) if k is None else rank <= k
    keys, sums, owner, rank = keys[chosen], sums[chosen], owner[chosen], rank[chosen]
    return pa.table({
        "u": named.take(pa.array(owner)), "i": values.take(pa.array(keys - owner * len(values))),
        "w": pa.array(sums), "n": pa.array(size[owner].astype(np.int64)), "rnk": pa.array(rank.astype(np.int32)),
    })


def recommend_items(
    owned: DataFrame,
    similarity: DataFrame,
    user: str,
    item: str,
    k: int | None = 10,
) -> DataFrame:
    """``user, item, score, rnk``: mean similarity to the user's items, known ones left out.

    Each item meets one row holding its neighbours (a bounded array). Sums and
    ranks are local to groups of users; those with very many items are spread.
    """
    have = settle(owned.select(F.col(user).alias("u"), F.col(item).alias("i")).distinct(), "owned")
    few, many = _few_and_many(have)
    ranked = _served(few, similarity, k)
    if many is not None:
        sums = summed_neighbours(many, similarity).where((F.col("known") == 0) & (F.col("w") > 0))
        best = Window.partitionBy("u").orderBy(F.desc("w"), "i")
        spread = sums.withColumn("rnk", F.row_number().over(best))
        if k is not None:
            spread = spread.where(F.col("rnk") <= k)
        sizes = many.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        ranked = ranked.unionByName(spread.join(sizes, "u").select("u", "i", "w", "n", "rnk"))
    return ranked.select(
        F.col("u").alias(user),
        F.col("i").alias(item),
        (F.col("w") / F.lit(float(UNITS)) / F.col("n")).alias("score"),
        "rnk",
    )


def target_ranks(owned: DataFrame, targets: DataFrame, similarity: DataFrame) -> DataFrame:
    """``u, i, rnk`` of the wanted items (u, i) that are recommended at all.

    Where a user's sums are local, so are the places of the targets; users with very many items are counted.
    """
    few, many = _few_and_many(owned)
    if many is None:
        return _served(few, similarity, None, targets).select("u", "i", F.col("rnk").cast("bigint").alias("rnk"))
    big = settle(many.select("u").distinct(), "big-targets")
    placed = _served(few, similarity, None, targets.join(big, "u", "left_anti"))
    counted = _counted_ranks(many, targets.join(big, "u", "left_semi"), similarity)
    return placed.select("u", "i", F.col("rnk").cast("bigint").alias("rnk")).unionByName(counted)


def _counted_ranks(owned: DataFrame, targets: DataFrame, similarity: DataFrame) -> DataFrame:
    """``u, i, rnk`` of the wanted items of users with very many, without ranking the others.

    The place of an item is one more than the number of better ones: those in
    higher bins, from a histogram of the user's scores (eight bins to a doubling), and the
    better ones of its own bin. So a user's scores are added up and counted, never sorted.
    """
    sums = summed_neighbours(owned, similarity, targets.withColumn("wanted", F.lit(1)))
    # The bits before and after the leading one; whole numbers, so bins ascend exactly as scores do.
    places = F.length(F.bin("w"))
    low = F.call_function("shiftright", F.col("w"), F.greatest(places - 4, F.lit(0))) % 8
    scored = settle(
        sums.where("known = 0 AND w > 0").select("u", "i", "w", "wanted", (places * 8 + low).cast("int").alias("bin")), "scored"
    )
    wanted = scored.where("wanted = 1").drop("wanted")
    histogram = scored.groupBy("u", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("u").agg(
        F.collect_list(F.struct("bin", "n")).alias("bins")
    )
    higher = F.aggregate(
        F.filter("bins", lambda x: x["bin"] > F.col("bin")), F.lit(0).cast("bigint"), lambda total, x: total + x["n"]
    )
    above = wanted.join(histogram, "u").select("u", "i", higher.alias("above"))
    others = scored.select("u", "bin", F.col("i").alias("j"), F.col("w").alias("v"))
    better = (
        others.join(wanted.hint("shuffle_hash"), ["u", "bin"])
        .where("v > w OR (v = w AND j < i)")
        .groupBy("u", "i").agg(F.count(F.lit(1)).alias("beside"))
    )
    rank = (F.col("above") + F.coalesce("beside", F.lit(0)) + 1).alias("rnk")
    return above.join(better, ["u", "i"], "left").select("u", "i", rank)
