"""Name normalisation and the similarity scores used for fuzzy matching.

Scores are whole numbers 0-100. The building block is
``ratio = 100 * 2 * LCS / (len(a) + len(b))`` with half-to-even rounding.
Builders taking and returning ``str`` work on SQL text: one parsed expression
instead of hundreds of calls to build the same tree from Python.
Everything that doesn't need an LCS stays a built-in expression. The LCS
itself is one Arrow-batched helper: written as nested higher-order functions
it costs about 2 ms per pair, the bit-parallel form about 5 microseconds.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Ship the helpers of this module inside the task, so that executors don't
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def process(name: str) -> str:
    """Lower case, every non-word character to a space, trimmed."""
    return rf"trim(regexp_replace(lower({name}), r'[^\p{{L}}\p{{N}}_]', ' '))"


def words(processed: str) -> str:
    """The words of a processed name in order, repeats kept."""
    return rf"filter(split({processed}, r'\s+'), w -> w <> '')"


def tokens(processed: str) -> str:
    """Sorted distinct words of a processed name; empty array for ''."""
    return f"array_sort(array_distinct({words(processed)}))"


def percent(twice_common: str, total: str) -> str:
    """Half-to-even percentage of two integers, 0 for empty input."""
    return f"if({total} = 0, 0, cast(bround(100D * ({twice_common} / greatest({total}, 1)), 0) AS int))"


def prefix_ratio(prefix: str, whole: str) -> str:
    """``ratio`` where the first string is a prefix of the second (no LCS needed)."""
    score = percent(f"(2 * length({prefix}))", f"(length({prefix}) + length({whole}))")
    return f"if(length({prefix}) = 0, 0, {score})"


def set_parts(left_tokens: str, right_tokens: str) -> list[str]:
    """The strings t0, t1, t2 compared by the token-set score."""
    common = f"array_sort(array_intersect({left_tokens}, {right_tokens}))"
    only = "array_sort(array_except({0}, {1}))"
    return [
        f"array_join({common}, ' ') AS t0",
        f"array_join(concat({common}, {only.format(left_tokens, right_tokens)}), ' ') AS t1",
        f"array_join(concat({common}, {only.format(right_tokens, left_tokens)}), ' ') AS t2",
    ]


def character_mask(string: str) -> str:
    """64-bit sketch of the character occurrences of a string.

    The n-th occurrence of a character sets one bit, so bits set in one
    string and not in the other never exceed the characters it has in excess.
    In the sorted characters, the n-th occurrence is the one whose place is
    n - 1 after the first.
    """
    chars = f"array_sort(split({string}, ''))"
    bits = f"transform({chars}, (c, i) -> pmod(hash(c, i - cast(array_position({chars}, c) AS int)), 64))"
    return f"aggregate({bits}, 0L, (acc, bit) -> acc | shiftleft(1L, bit))"


def common_at_most(len_a: str, mask_a: str, len_b: str, mask_b: str) -> str:
    """Upper bound of the LCS from lengths and masks, inside codegen."""
    return (
        f"least({len_a} - bit_count({mask_a} & ~{mask_b}), {len_b} - bit_count({mask_b} & ~{mask_a}))"
    )


def word_count(name: str) -> str:
    return f"size({words(name)})"


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one big-integer row per character."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> int:
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(100 * (2 * lcs_length(a, b) / (len(a) + len(b))))


@F.pandas_udf(IntegerType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio_of`` over a batch of already filtered candidate pairs."""
    return pd.Series([ratio_of(x, y) for x, y in zip(a, b)], dtype="int32")


def best_window(short: str, long_: str) -> int:
    """The largest LCS of ``short`` with any equally long window of ``long_``.

    All windows are compared in one pass: each has its own lane in one big
    integer, ``len(short)`` bits and a spare one that stops its carry. The
    matches of all characters of ``long_``, one per lane, are laid out once;
    each step shifts them on by a lane, so every window reads its next character.
    """
    n = len(short)
    where: dict[str, int] = {}
    for i, ch in enumerate(short):
        where[ch] = where.get(ch, 0) | (1 << i)
    lane = n + 1
    matches = 0
    for j, ch in enumerate(long_):
        if ch in where:
            matches |= where[ch] << (j * lane)
    windows = len(long_) - n + 1
    ones = ((1 << (windows * lane)) - 1) // ((1 << lane) - 1)
    full = ((1 << n) - 1) * ones
    row = full
    for _ in range(n):
        hit = row & matches
        row = ((row + hit) | (row - hit)) & full
        matches >>= lane
    lanes = (1 << lane) - 1
    return n - min(((row >> (i * lane)) & lanes).bit_count() for i in range(windows))


def partial_ratio_of(a: str, b: str) -> int:
    """Best ``ratio`` of the shorter string with an equally long window."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    if short in long_:
        return 100
    return round(100 * (2 * best_window(short, long_) / (2 * len(short))))


def token_set_of(a: str, b: str, score=ratio_of) -> int:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0
    common = " ".join(sorted(left & right))
    with_left = " ".join([common, *sorted(left - right)]).strip()
    with_right = " ".join([common, *sorted(right - left)]).strip()
    return max(
        score(common, with_left) if common else 0,
        score(common, with_right) if common else 0,
        score(with_left, with_right),
    )


def token_sort_of(a: str, b: str, score=ratio_of) -> int:
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


# Weights and length limits of the weighted score.
TOKEN_WEIGHT = 0.95
PARTIAL_WEIGHT = 0.9
LONG_PARTIAL_WEIGHT = 0.6
PARTIAL_FROM = 1.5
LONG_FROM = 8


def weighted_of(a: str, b: str) -> int:
    """Best of the plain, token and (for unequal lengths) partial scores."""
    if not a or not b:
        return 0
    gap = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio_of(a, b)
    if gap < PARTIAL_FROM:
        return round(
            max(plain, token_sort_of(a, b) * TOKEN_WEIGHT, token_set_of(a, b) * TOKEN_WEIGHT)
        )
    scale = LONG_PARTIAL_WEIGHT if gap > LONG_FROM else PARTIAL_WEIGHT
    return round(
        max(
            plain,
            partial_ratio_of(a, b) * scale,
            token_sort_of(a, b, partial_ratio_of) * TOKEN_WEIGHT * scale,
            token_set_of(a, b, partial_ratio_of) * TOKEN_WEIGHT * scale,
        )
    )


@F.pandas_udf(IntegerType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``weighted_of`` over a batch of already filtered candidate pairs."""
    return pd.Series([weighted_of(x, y) for x, y in zip(a, b)], dtype="int32")


def set_text(items: Column) -> Column:
    """Array to the text form ``frozenset({a, b})`` used by exported rule files."""
    return F.concat(F.lit("frozenset({"), F.array_join(items.cast("array<string>"), ", "), F.lit("})"))


def parse_set_text(text: Column) -> Column:
    """Inverse of :func:`set_text` for whole-number items."""
    inner = F.regexp_extract(text, r"\{([^}]*)\}", 1)
    return F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("bigint"))


def first_quoted(text: Column) -> Column:
    """First single-quoted string, NULL when there's none."""
    found = F.regexp_extract(text, "'([^']+)'", 1)
    return F.when(found != "", found)


def without_last(code: Column) -> Column:
    """A code without its last character; NULL and '' give NULL."""
    return F.when(F.length(code) > 0, F.substring(code, F.lit(1), F.length(code) - 1))
