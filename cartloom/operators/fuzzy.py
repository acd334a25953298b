"""Fuzzy name joins that are exact.

For a score of ``100 * 2 * LCS / (len_a + len_b)`` at or above a cutoff, at
most ``(1 - c)(len_a + len_b)`` single-character edits separate both strings.
Cut the words of the longer string into one piece more than that: at least
one piece survives untouched, so it is a substring of a word of the shorter
string. At high cutoffs candidates therefore come from an equi-join on pieces;
lengths and 64-bit character masks filter inside the join, before a row is
emitted. The argument doesn't depend on the order of words, which is what the
token-based scores need.

At lower cutoffs the pieces would be one or two letters long, which nearly all
names share. There the names of a block are cut into even tiles by length band
and hash; tiles whose lengths can match meet once, under the same filter. So a
pair is looked at once at most, but the work grows with the square of a block.

The token-set score has a second way to be high: the common words alone cover
most of one side. Such pairs share a word of the part of that side that the
remaining (most frequent) words can't make up for, found by an equi-join on
these words; a frequent word like a dosage form is hardly ever among them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.functions import text
from cartloom.session import settle

NO_BLOCK = "_all"
# Below this cutoff (as a ratio) pieces are too short to tell names apart.
TILES_BELOW = 0.85
TILE_NAMES = 2000
# From this length on, a window with one character less still rounds up to a score of 100.
ROUNDS_UP_FROM = 200
KEYED = ["block", "key", "words", "len", "mask"]
PAIR = ["l_key", "l_words", "r_key", "r_words"]


def _floor_of(cutoff: int) -> float:
    """The least unrounded ratio that can round to the cutoff."""
    if not 50 < cutoff <= 100:
        raise ValueError("cutoff must be over 50 and at most 100")
    return (cutoff - 0.5) / 100 - 1e-9


def _longest_piece(c: float) -> int:
    return math.ceil(1 / (2 * (1 - c))) + 1


def _pieces(side: DataFrame, c: float) -> DataFrame:
    """One row per piece: every word cut into about equal parts.

    The piece length is the largest that gives enough pieces, one more than
    the edits allowed. (With single characters it may be fewer; two strings
    above the cutoff always share a character.)
    """
    cuts = "aggregate(words, 0L, (acc, w) -> acc + greatest(1L, length(w) div n))"
    enough = f"filter(sequence({_longest_piece(c)}, 1, -1), n -> {cuts} > floor({2 * (1 - c)}D * len))"
    return (
        side.selectExpr("*", f"coalesce(get({enough}, 0), 1) AS size", "explode(words) AS word")
        .selectExpr("*", "cast(greatest(1, length(word) div size) AS int) AS parts")
        .selectExpr("*", "explode(sequence(0, parts - 1)) AS part")
        .selectExpr(
            *KEYED,
            "substring(word, cast(part * length(word) div parts AS int) + 1, "
            "cast((part + 1) * length(word) div parts - part * length(word) div parts AS int)) AS piece",
        )
    )


def _substrings(side: DataFrame, longest: int | None) -> DataFrame:
    """One row per substring of a word, up to ``longest`` characters."""
    room = "length(word) - start + 1"
    most = room if longest is None else f"least({longest}, {room})"
    return (
        side.selectExpr("*", "explode(words) AS word")
        .selectExpr("*", "explode(sequence(1, length(word))) AS start")
        .selectExpr("*", f"explode(sequence(1, {most})) AS size")
        .selectExpr(*KEYED, "substring(word, start, size) AS piece")
    )


def _prepare(names: DataFrame, column: str, by_words: bool) -> DataFrame:
    """``block, key, words, len, mask`` of the distinct keys of a name column.

    The key is the processed name, or its sorted distinct words.
    """
    block = "block" if "block" in names.columns else f"'{NO_BLOCK}' AS block"
    words = text.tokens("p") if by_words else text.words("p")
    key = "array_join(words, ' ')" if by_words else "p"
    return (
        names.selectExpr(block, f"{text.process(column)} AS p")
        .selectExpr("block", "p", f"{words} AS words")
        .selectExpr("block", f"{key} AS key", "words")
        .where("size(words) > 0")
        .distinct()
        .selectExpr(*KEYED[:3], "length(key) AS len", f"{text.character_mask('key')} AS mask")
    )


def _with_prefix(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
    return df.selectExpr("block", *[f"{c} AS {prefix}{c}" for c in KEYED[1:]], *extra)


def _tiled(left: DataFrame, right: DataFrame, condition: str, width: float | None, names: int = TILE_NAMES) -> DataFrame:
    """Pairs of one block under a condition, each looked at once at most.

    ``width`` is the largest difference of the logarithms of both lengths; it
    makes length bands, of which only neighbours meet. Tiles of about
    ``names`` names spread a band evenly on both sides.
    """
    band = "0" if width is None else f"cast(floor(ln(len) / {width + 1e-9}D) AS int)"
    near = "array({0})" if width is None else "array({0} - 1, {0}, {0} + 1)"
    banded = [side.selectExpr("*", f"{band} AS band") for side in (left, right)]
    tiles = [
        side.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / names).cast("int").alias("tiles"))
        for side in banded
    ]

    def spread(n: int, own: str, other: str) -> DataFrame:
        here = tiles[n].selectExpr("block", f"band AS {own}band", "tiles AS own_tiles")
        there = tiles[1 - n].selectExpr("block", f"band AS {other}band", "tiles AS other_tiles")
        return (
            _with_prefix(banded[n], own, f"band AS {own}band")
            .join(here, ["block", f"{own}band"])
            .selectExpr("*", f"pmod(xxhash64({own}key), own_tiles) AS {own}tile", f"explode({near.format(own + 'band')}) AS {other}band")
            .join(there, ["block", f"{other}band"])
            .selectExpr("*", f"explode(sequence(0L, other_tiles - 1L)) AS {other}tile")
            .drop("own_tiles", "other_tiles")
        )

    keys = ["block", "l_band", "r_band", "l_tile", "r_tile"]
    return spread(0, "l_", "r_").join(spread(1, "r_", "l_").hint("merge"), keys).where(condition).select(*PAIR)


def _close_candidates(left: DataFrame, right: DataFrame, c: float) -> DataFrame:
    """Pairs of keys that can reach the ratio: ``l_key, r_key`` (and their words)."""
    if c < TILES_BELOW:
        most = text.common_at_most("l_len", "l_mask", "r_len", "r_mask")
        return _tiled(left, right, f"2 * {most} >= {c}D * (l_len + r_len)", math.log((2 - c) / c))
    longest = 2 * _longest_piece(c) - 1

    def one_way(longer: DataFrame, lp: str, shorter: DataFrame, sp: str, compare: str) -> DataFrame:
        cut = _with_prefix(_pieces(longer, c), lp, "piece")
        part = _with_prefix(_substrings(shorter, longest), sp, "piece")
        most = text.common_at_most(f"{sp}len", f"{sp}mask", f"{lp}len", f"{lp}mask")
        return (
            cut.join(part, ["block", "piece"])
            .where(f"{sp}len {compare} {lp}len AND 2 * {most} >= {c}D * (l_len + r_len)")
            .select(*PAIR)
        )

    return one_way(right, "r_", left, "l_", "<=").unionByName(one_way(left, "l_", right, "r_", "<"))


def _covering_candidates(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    """Pairs whose common words alone reach the cutoff against one of both sides.

    Of that side, ordered by how rare its words are, only the words count from
    which on the rest is still long enough.
    """
    c = _floor_of(cutoff)
    seen = (
        left.selectExpr("explode(words) AS word")
        .unionAll(right.selectExpr("explode(words) AS word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rest = "(PARTITION BY block, {0}key ORDER BY n, word ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    def one_way(covered: DataFrame, cp: str, other: DataFrame, op: str) -> DataFrame:
        rows = _with_prefix(covered.selectExpr("*", "explode(words) AS word"), cp, "word").join(seen, "word")
        needed = rows.selectExpr(
            "*", f"sum(length(word) + 1) OVER {rest.format(cp)} - 1 AS reach"
        ).where(f"reach >= {c / (2 - c)}D * {cp}len")
        every = _with_prefix(other.selectExpr("*", "explode(words) AS word"), op, "word")
        common = "length(array_join(array_intersect(l_words, r_words), ' '))"
        return (
            needed.join(every, ["block", "word"])
            .where(f"2 * {common} >= {c}D * ({common} + {cp}len)")
            .select(*PAIR)
        )

    return one_way(left, "l_", right, "r_").unionByName(one_way(right, "r_", left, "l_"))


def _back_to_names(scored: DataFrame, left: DataFrame, right: DataFrame, by_words: bool) -> DataFrame:
    def named(names: DataFrame, column: str) -> DataFrame:
        p = text.process(column)
        key = f"array_join({text.tokens(p)}, ' ')" if by_words else p
        return names.selectExpr(column, f"{key} AS {column[0]}_key").distinct()

    return (
        scored.join(named(left, "left_name"), "l_key")
        .join(named(right, "right_name"), "r_key")
        .select("left_name", "right_name", "score")
    )


def _token_set_keys(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    lk = settle(_prepare(left, "left_name", True), "left-keys")
    rk = settle(_prepare(right, "right_name", True), "right-keys")
    return (
        _close_candidates(lk, rk, _floor_of(cutoff))
        .unionByName(_covering_candidates(lk, rk, cutoff))
        .dropDuplicates(["l_key", "r_key"])
    )


def token_set_pairs(left: DataFrame, right: DataFrame, cutoff: int = 80) -> DataFrame:
    """``left_name, right_name, score`` with the token-set score at or above the cutoff.

    With a ``block`` column on both sides only names of one block are paired;
    the score is computed once per distinct pair, whatever the blocks.
    """
    pairs = _token_set_keys(left, right, cutoff)
    known = f"greatest({text.prefix_ratio('t0', 't1')}, {text.prefix_ratio('t0', 't2')}) AS covered"
    scored = (
        pairs.selectExpr("l_key", "r_key", *text.set_parts("l_words", "r_words"))
        .selectExpr("l_key", "r_key", "t1", "t2", known)
        .select("l_key", "r_key", F.greatest("covered", text.ratio("t1", "t2")).alias("score"))
        .where(f"score >= {int(cutoff)}")
    )
    return _back_to_names(scored, left, right, True)


def ratio_pairs(left: DataFrame, right: DataFrame, cutoff: int = 90) -> DataFrame:
    """``left_name, right_name, score`` with the plain ratio at or above the cutoff."""
    lk, rk = _prepare(left, "left_name", False), _prepare(right, "right_name", False)
    pairs = _close_candidates(lk, rk, _floor_of(cutoff)).select("l_key", "r_key").distinct()
    scored = pairs.withColumn("score", text.ratio("l_key", "r_key")).where(F.col("score") >= cutoff)
    return _back_to_names(scored, left, right, False)


def weighted_pairs(left: DataFrame, right: DataFrame, cutoff: int = 90) -> DataFrame:
    """``left_name, right_name, score`` with the weighted score at or above the cutoff.

    The score comes from the plain ratio, from a token score of at least
    ``cutoff / 0.95``, or, for names of unequal length, from the best window of
    the longer one; each has its own candidates. At a cutoff of 90 a window must
    contain the whole shorter name. Below, it may lack some characters, and
    up to 86 a word in common is enough, since it fills a window by itself.
    """
    lk, rk = _prepare(left, "left_name", False), _prepare(right, "right_name", False)
    if cutoff < 90:
        # Read by each route below.
        lk, rk = settle(lk, "left-keys"), settle(rk, "right-keys")
    close = _close_candidates(lk, rk, _floor_of(cutoff)).select("l_key", "r_key")

    token_cutoff = math.ceil((cutoff - 0.5) / text.TOKEN_WEIGHT)
    found = close
    if token_cutoff <= 100:
        by_set = _token_set_keys(left, right, token_cutoff).select(
            F.col("l_key").alias("l_set"), F.col("r_key").alias("r_set")
        )
        as_set = "array_join(array_sort(array_distinct(words)), ' ')"
        l_map = lk.selectExpr("key AS l_key", f"{as_set} AS l_set").distinct()
        r_map = rk.selectExpr("key AS r_key", f"{as_set} AS r_set").distinct()
        found = found.unionByName(
            by_set.join(l_map, "l_set").join(r_map, "r_set").select("l_key", "r_key")
        )
    if cutoff == 90:
        found = found.unionByName(_contained(lk, "l_", rk, "r_")).unionByName(_contained(rk, "r_", lk, "l_"))
        found = found.unionByName(_nearly_contained(lk, rk))
    elif cutoff < 90:
        found = found.unionByName(_by_window(lk, rk, cutoff))
    scored = (
        found.distinct()
        .withColumn("score", text.weighted_ratio("l_key", "r_key"))
        .where(F.col("score") >= cutoff)
    )
    return _back_to_names(scored, left, right, False)


def _by_window(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    """Pairs of unequal length that may reach a cutoff below 90 through a window of the longer name.

    The strings compared are the names, their words sorted, or their distinct
    words sorted, so none is shorter than the latter; and whatever the order, a
    subsequence has no more characters than both have in common.
    """
    shorter, longer = "least(l_len, r_len)", "greatest(l_len, r_len)"
    least_words = "least(length(array_join(array_distinct(l_words), ' ')), length(array_join(array_distinct(r_words), ' ')))"
    most = text.common_at_most("l_len", "l_mask", "r_len", "r_mask")
    sizes = {
        text.PARTIAL_WEIGHT: f"{longer} >= {text.PARTIAL_FROM}D * {shorter} AND {longer} <= {text.LONG_FROM} * {shorter}",
        text.LONG_PARTIAL_WEIGHT: f"{longer} > {text.LONG_FROM} * {shorter}",
    }
    routes, shared = [], []
    for weight, sized in sizes.items():
        # Scores are rounded twice: to a whole number, and after weighting.
        needed = ((cutoff - 0.5) / weight - 0.5) / 100 - 1e-9
        if needed <= 1:
            routes.append(f"({sized} AND {most} >= {needed}D * {least_words})")
        if round(100 * text.TOKEN_WEIGHT * weight) >= cutoff:
            shared.append(f"({sized})")
    found = _tiled(left, right, " OR ".join(routes), None).select("l_key", "r_key")
    if shared:
        each = [_with_prefix(side.selectExpr("*", "explode(array_distinct(words)) AS word"), p, "word") for side, p in ((left, "l_"), (right, "r_"))]
        found = found.unionByName(each[0].join(each[1], ["block", "word"]).where(" OR ".join(shared)).select("l_key", "r_key"))
    return found


def _nearly_contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Long pairs whose partial score may round up to 100 without containment.

    That takes a window missing at most one character in 200.
    """
    long_ = [side.where(f"len >= {ROUNDS_UP_FROM}") for side in (left, right)]
    most = text.common_at_most("l_len", "l_mask", "r_len", "r_mask")
    shorter, longer = "least(l_len, r_len)", "greatest(l_len, r_len)"
    ratio = f"{longer} >= {text.PARTIAL_FROM}D * {shorter} AND {longer} <= {text.LONG_FROM} * {shorter}"
    return _tiled(*long_, f"{ratio} AND {most} >= 0.995D * {shorter} - 1e-6D", None).select("l_key", "r_key")


def _contained(short: DataFrame, sp: str, long_: DataFrame, lp: str) -> DataFrame:
    """Pairs where one key is a substring of the other: its first word then lies in a word."""
    heads = short.selectExpr("block", "get(words, 0) AS piece", f"key AS {sp}key")
    parts = _substrings(long_, None).selectExpr("block", "piece", f"key AS {lp}key")
    s, t = f"length({sp}key)", f"length({lp}key)"
    return (
        heads.join(parts, ["block", "piece"])
        .where(f"{t} >= {text.PARTIAL_FROM}D * {s} AND {t} <= {text.LONG_FROM} * {s}")
        .where(f"contains({lp}key, {sp}key)")
        .select("l_key", "r_key")
    )
