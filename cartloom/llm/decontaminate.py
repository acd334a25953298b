"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. The words
of a training text stream through it; the automaton's state gives the longest
match that ends at each word. A match of ``window`` words, or of a whole shorter
item, marks its words as hit. Spans of hit words can be removed, and a document
whose hits cover enough of it counts as contaminated.

Items are taken in blocks of bounded size, one automaton a block; each block is
broadcast and all documents stream past it. So the memory of a task doesn't grow
with the number of items, and no document meets an item in a join.

Null texts and texts without words have no hits; items without words are never
found; equal items are all reported.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cartloom.llm.tables import held, small, whole_rows

#: Of the UTF-8 bytes, once A-Z are lower case: digits, letters, and all beyond ASCII.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Bytes of item texts in one automaton; it takes some hundred bytes of memory a word.
BLOCK_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Suffix automaton over the items' word numbers, with the items of each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[tuple[int, int]] = []
        for item, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self._extend(state, self.number.setdefault(word, len(self.number)))
                ends.append((state, item))
        self._mark(items, ends)

    def _extend(self, last: int, symbol: int) -> int:
        there = self.next[last].get(symbol)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, symbol, there)
        new = self._state(self.length[last] + 1, {})
        while last != -1 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            there = self.next[last][symbol]
            exact = self.length[there] == self.length[last] + 1
            self.link[new] = there if exact else self._split(last, symbol, there)
        return new

    def _state(self, length: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, last: int, symbol: int, there: int) -> int:
        """A copy of ``there`` for the shorter strings only."""
        clone = self._state(self.length[last] + 1, dict(self.next[there]))
        self.link[clone] = self.link[there]
        self.link[there] = clone
        while last != -1 and self.next[last].get(symbol) == there:
            self.next[last][symbol] = clone
            last = self.link[last]
        return clone

    def _mark(self, items: list[tuple[str, list[bytes]]], ends: list[tuple[int, int]]) -> None:
        """For each state: which windows (length, items) end there, the window length first.

        A long item's window of ``window`` words belongs to the state whose
        lengths include ``window``; a short item's only window to the state
        that its words lead to.
        """
        found: dict[int, dict[int, set[int]]] = {}
        for state, item in ends:
            if len(items[item][1]) < self.window:
                continue
            while state > 0 and self.length[self.link[state]] >= self.window:
                state = self.link[state]
            if self.length[state] >= self.window:
                found.setdefault(state, {}).setdefault(self.window, set()).add(item)
        for item, (_, words) in enumerate(items):
            if 0 < len(words) < self.window:
                state = 0
                for word in words:
                    state = self.next[state][self.number[word]]
                found.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self.windows = {s: sorted((n, sorted(i)) for n, i in w.items()) for s, w in found.items()}
        # The nearest state on the way to the start, itself included, that has windows.
        self.marked = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            own = state in self.windows
            self.marked[state] = state if own else (self.marked[self.link[state]] if state else -1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs [start, end) of word positions, merged, and the items found."""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        follow, link, length, marked = self.next, self.link, self.length, self.marked
        state = matched = 0
        for at, symbol in enumerate(map(self.number.get, words)):
            if symbol is None:
                state = matched = 0
                continue
            while True:
                there = follow[state].get(symbol)
                if there is not None:
                    state, matched = there, matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            mark = marked[state]
            while mark != -1:
                for size, items in self.windows[mark]:
                    if size <= matched:
                        found.update(items)
                        start = at + 1 - size
                        while runs and runs[-1][1] >= start:
                            start = min(start, runs.pop()[0])
                        runs.append((start, at + 1))
                mark = marked[link[mark]] if mark else -1
        return runs, found


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about ``limit`` bytes, by a hash of the row."""
    size = items.select(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n = 1 + size // limit
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n))
    return [items.where(block == i).select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
            for i in range(n)]


def _automaton(block) -> Automaton:
    """Built once in each Python worker for each broadcast block."""
    name, items = block.value
    return held(name, lambda: Automaton([(k, words_of(t)) for k, t in items]))


def scan(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
         item_key: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Per row: the key, n_words, the hit runs of words (``starts``, ``ends``) and the ``items`` found (sorted ids)."""
    none = {"starts": "array<long>", "ends": "array<long>", "items": "array<string>"}
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                      *(F.array().cast(kind).alias(name) for name, kind in none.items()), F.lit(0).cast("long").alias("n_words"))
    schema = out.schema
    kinds = to_arrow_schema(schema).types[2:]
    for block in blocks(items, item_key, item_text, limit):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.key, r.text) for r in block.collect()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared)
            for batch in small(batches):
                rows = []
                for value, starts, ends, before in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                    words = words_of(value)
                    runs, found = automaton.scan(words)
                    if starts:
                        runs = merged(runs + list(zip(starts, ends, strict=True)))
                    names = {*before, *(automaton.names[i] for i in found)} - {None}
                    rows.append(([r[0] for r in runs], [r[1] for r in runs], sorted(names), len(words)))
                made = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], names=schema.names)

        out = out.mapInArrow(run, schema)
    return out.drop("text").withColumnRenamed("key", key)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs without overlaps or touching ends."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((int(a), int(b)) for a, b in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def with_verdict(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, the digest of the items, and whether hits cover a twentieth of the words."""
    hit = F.expr("aggregate(zip_with(starts, ends, (s, e) -> e - s), 0L, (a, x) -> a + x)")
    return (scanned.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def without_hits(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that aren't contaminated."""
    judged = with_verdict(scan(whole_rows(docs, text), items, key="row"))
    return judged.where(~F.col("contaminated")).select("row.*")


#: DuckDB. Windows of every length that items have, by their words joined.
SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bwin),
dwin AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM dw, lens WHERE len(w) >= l)),
found AS (SELECT doc_id, l, i, item_id FROM dwin JOIN bwin USING (l, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM (SELECT DISTINCT doc_id, l, i FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
