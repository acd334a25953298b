"""Removing repeated word passages with a compressed FM-index per shard.

A shard's segments become one sequence of word numbers, each segment closed by a
separator. Its Burrows-Wheeler transform is kept in a wavelet matrix: one bit
vector per binary digit of the word numbers, packed, with counts per block. The
segments are then streamed past the index. Backward search extends a match word
by word to the left, two rank queries a step; its matching statistics, cut off at
the window length, tell which windows occur, and the interval of a full match
names all places that have the window. The smallest document id in the interval
decides whether the window repeats an earlier document.

All positions of a block of the stream take their steps together. Positions whose
interval has shrunk to one place can match nothing but themselves and leave the
search early.

Texts shorter than the window, empty and null texts lose nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cartloom.llm import anchors
from cartloom.llm.anchors import Text, Unit

WINDOW = 13
GRAM = 5
#: Stream positions searched together.
BLOCK = 1 << 18


class BitVector:
    """Packed bits with ranks: ones before a place, from a count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        spare = -len(bits) % 64 + 64
        packed = np.packbits(np.concatenate((bits, np.zeros(spare, dtype=bool))), bitorder="little")
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32)

    def rank(self, place: np.ndarray) -> np.ndarray:
        block = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """Counts of a symbol before a place, in one rank per binary digit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.digits = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for digit in reversed(range(self.digits)):
            bits = (sequence >> digit & 1).astype(bool)
            self.levels.append((BitVector(bits), int(len(bits) - bits.sum())))
            sequence = np.concatenate((sequence[~bits], sequence[bits]))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's run of the last level stands, advanced by its occurrences before ``at``."""
        for digit, (bits, zeros) in zip(reversed(range(self.digits)), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> digit & 1, zeros + ones, at - ones)
        return at


def suffix_order(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by doubling."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    order, top, step = np.argsort(rank, kind="stable"), int(rank.max()) + 1, 1
    while top < len(rank) and step < depth:
        pair = rank * (top + 1)
        pair[:-step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.concatenate(([0], np.cumsum(pair[1:] != pair[:-1])))
        rank[order] = new
        top, step = int(new[-1]) + 1, step * 2
    return order


class FMIndex:
    """Backward search over a sequence of numbers from 1 up; 0 is added as its end."""

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int):
        closed = np.append(sequence, 0)
        self.order = suffix_order(closed, depth)
        self.n = len(closed)
        transform = closed[self.order - 1]
        self.tree = WaveletMatrix(transform, symbols + 1)
        counts = np.bincount(transform, minlength=symbols + 1)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))
        # Where each symbol's run begins on the last level, so that a place there becomes a count.
        self.zero = self.tree.place(np.arange(symbols + 1), np.zeros(symbols + 1, dtype=np.int64))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on as those of [low, high)."""
        shift = self.smaller[symbol] - self.zero[symbol]
        return self.tree.place(symbol, low) + shift, self.tree.place(symbol, high) + shift

    def matches(self, sequence: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to ``limit`` for what ends at each of ``ends`` (the last symbol's position).

        Returns the matched length and the interval. A search stops early, with
        the length reached, once its interval holds a single place.
        """
        symbol = sequence[ends]
        low, high = self.smaller[symbol].copy(), self.smaller[symbol + 1].copy()
        length = np.ones(len(ends), dtype=np.int64)
        going = np.flatnonzero(high - low > 1)
        for step in range(1, limit):
            symbol = sequence[ends[going] - step]
            a, b = self.extend(low[going], high[going], symbol)
            found = b > a
            going, a, b = going[found], a[found], b[found]
            low[going], high[going] = a, b
            length[going] += 1
            going = going[b - a > 1]
        return length, low, high


def smallest_ids(segs: list[bytes], least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows per segment, and for each window in order the smallest id of a segment that has it."""
    number: dict[bytes, int] = {}
    split = [s.split(b" ") for s in segs]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    flat = np.array([number.setdefault(w, len(number) + 2) for words in split for w in words], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(sizes + 1)))
    sequence = np.ones(int(start[-1]), dtype=np.int64)
    seg_of = np.repeat(np.arange(len(segs)), sizes + 1)
    inside = np.ones(len(sequence), dtype=bool)
    inside[start[1:] - 1] = False
    sequence[inside] = flat
    index = FMIndex(sequence, len(number) + 1, window)
    owner_of = np.append(least[seg_of], anchors.NO_ID)[index.order]
    offset = np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(start[:-1], counts) + np.arange(int(counts.sum())) - offset
    owner = np.repeat(least, counts)
    for a in range(0, len(first), BLOCK):
        ends = first[a:a + BLOCK] + window - 1
        length, low, high = index.matches(sequence, ends, window)
        full = np.flatnonzero((length == window) & (high - low > 1))
        if not len(full):
            continue
        # Intervals of one length are equal or apart.
        lows, which = np.unique(low[full], return_inverse=True)
        highs = np.zeros(len(lows), dtype=np.int64)
        highs[which] = high[full]
        cuts = np.stack((lows, highs), axis=1).ravel()
        best = np.minimum.reduceat(np.append(owner_of, anchors.NO_ID), cuts)[::2]
        owner[a + full] = best[which]
    return counts, owner


def _kept(t: Text, start: np.ndarray, end: np.ndarray) -> tuple[str, int, int]:
    pieces, at, n = [], 0, len(t.starts) - 1
    for a, b in [*zip(start.tolist(), end.tolist(), strict=True), (n, n)]:
        if a > at:
            pieces.append(t.text[t.starts[at]:t.starts[a] - 1])
        at = b
    return b" ".join(pieces).decode("utf-8", "replace"), n, int((end - start).sum())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the words kept, joined by one space, how many it had, and how many went."""
    return anchors.remove_repeats(docs, Unit(WINDOW, GRAM, words=True), smallest_ids,
                                  "kept string, n_words long, n_removed long", _kept, key, text)


#: DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM m),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN r USING (doc_id, p)
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
