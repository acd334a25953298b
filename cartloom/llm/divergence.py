"""Source divergence audit over a minimal acyclic transducer of the vocabulary.

A term is a run of letters A-Z (lower-cased) and of anything beyond ASCII. Each
language keeps the terms that at least ``MIN_DOCS`` of its documents have. The
kept terms, sorted, are built into minimal acyclic transducers that read a
language and a term and write the term's lexicographic ordinal. All texts are
then streamed through them to count each term by language and source, and the
ordinals stand for the terms until the end: they break ties, cut the vocabulary
into blocks, and are turned back into terms by walking a transducer.

Sources of a language are compared by their smoothed shares of the kept terms,
in whole numbers throughout (see ``SQL``).

How it holds: terms are counted per task before they are shuffled. A transducer
holds at most ``BLOCK`` terms; they are broadcast in sets of at most ``SET_BYTES``,
and a larger vocabulary costs one more pass over the texts for each set. Distances of
sources are summed over blocks of ordinals, so no task holds more than a block of
terms for the sources of one language. The pairs of sources are the result itself.

Null texts, languages and sources are empty ones. A language without kept terms
has pairs of distance 0 and no term rows. Each row counts as one document, rows
that share an id or a text included. Very long texts and terms are read in full.
Other columns of the input are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.session import settle

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of one transducer, and bytes of transducers that are broadcast at once.
BLOCK = 200_000
SET_BYTES = 64_000_000
#: Terms that a task counts before it hands them on, and text bytes walked at once.
HELD = 400_000
WALK_BYTES = 4_000_000
#: Cells (source, term) of a block of ordinals.
CELLS = 1 << 21

LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


# Minimal acyclic transducer


@dataclass
class Transducer:
    """States and arcs in arrays: an arc of state s by byte b is at ``base[s] + b`` if ``owner`` there is s.

    ``written`` of an arc is how many entries come before those through it; the
    sum along an entry's path is its ordinal.
    """

    base: np.ndarray
    final: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    written: np.ndarray
    entries: int

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, base=self.base, final=self.final, owner=self.owner, target=self.target, written=self.written,
                 entries=np.array(self.entries))
        return zstandard.ZstdCompressor(level=3).compress(out.getvalue())

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as file:
            return cls(**{n: file[n] for n in ("base", "final", "owner", "target", "written")}, entries=int(file["entries"]))

    def step(self, state: int, written: int, data: bytes) -> tuple[int, int] | None:
        """Where ``data`` leads from a state, and what has been written by then; None if it leads nowhere."""
        for byte in data:
            slot = int(self.base[state]) + byte
            if self.owner[slot] != state:
                return None
            state, written = int(self.target[slot]), written + int(self.written[slot])
        return state, written

    def ordinals(self, data: np.ndarray, starts: np.ndarray, root: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of ``data`` are entries (index into ``starts``), and their ordinals.

        All terms advance together, a byte at a time; each ends at a blank.
        """
        who = np.arange(len(starts))
        at, state = starts.astype(np.int64), np.full(len(starts), root[0], dtype=np.int32)
        written = np.full(len(starts), root[1], dtype=np.int64)
        found, numbers = [], []
        while len(who):
            byte = data[at]
            ended = byte == 32
            if ended.any():
                whole = ended & self.final[state]
                found.append(who[whole])
                numbers.append(written[whole])
            slot = self.base[state] + byte
            on = (self.owner[slot] == state) & ~ended
            slot = slot[on]
            who, at, written, state = who[on], at[on] + 1, written[on] + self.written[slot], self.target[slot]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(found), np.concatenate(numbers)

    def entry(self, ordinal: int) -> bytes:
        """The entry with this ordinal."""
        state, out = 0, bytearray()
        left = ordinal
        while True:
            if self.final[state]:
                if not left:
                    return bytes(out)
            begin = int(self.base[state])
            arcs = np.flatnonzero(self.owner[begin:begin + 256] == state)
            before = self.written[begin + arcs]
            byte = int(arcs[np.searchsorted(before, left, side="right") - 1])
            out.append(byte)
            left -= int(self.written[begin + byte])
            state = int(self.target[begin + byte])


def build(entries: Iterable[bytes]) -> Transducer:
    """The minimal transducer of sorted, different entries."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    below: list[int] = []
    known: dict[tuple, int] = {}

    def closed(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        at = known.get(state)
        if at is None:
            at = known[state] = len(states)
            states.append(state)
            below.append(final + sum(below[t] for _, t in arcs))
        return at

    # The path of the last entry: its states aren't closed yet, as further arcs may come.
    path: list[list] = [[False, []]]
    last, n = b"", 0
    for entry in entries:
        shared = 0
        most = min(len(last), len(entry))
        while shared < most and last[shared] == entry[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], closed(final, arcs)))
        path.extend([False, []] for _ in range(len(entry) - shared))
        path[-1][0] = True
        last, n = entry, n + 1
    for depth in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[depth - 1], closed(final, arcs)))
    root = closed(*path[0])
    return _laid_out(states, below, root, n)


def _laid_out(states: list, below: list[int], root: int, entries: int) -> Transducer:
    """The arcs of all states in one array, interleaved so that no two share a place. The root is state 0."""
    order = sorted((s for s in range(len(states)) if s != root), key=lambda s: -len(states[s][1]))
    number = {s: i for i, s in enumerate([root, *order])}
    taken = bytearray(512 + sum(len(arcs) for _, arcs in states))
    base = np.zeros(len(states), dtype=np.int64)
    final = np.zeros(len(states), dtype=bool)
    placed: list[tuple[int, int, int, int]] = []
    hint, width = 0, 0
    for s in [root, *order]:
        ends, arcs = states[s]
        me = number[s]
        final[me] = ends
        if not arcs:
            continue
        if len(arcs) != width:
            # States with fewer arcs fill the gaps between those with more.
            hint, width = 0, len(arcs)
        low = arcs[0][0]
        at = max(hint, low)
        while True:
            at = taken.find(0, at)
            if at < 0 or at + 256 >= len(taken):
                at = at if at >= 0 else len(taken)
                taken.extend(bytes(len(taken)))
            elif any(taken[at - low + b] for b, _ in arcs):
                at += 1
            else:
                break
        hint = base[me] = at - low
        before = int(ends)
        for b, t in arcs:
            taken[at - low + b] = 1
            placed.append((at - low + b, me, number[t], before))
            before += below[t]
    # Any byte from any state must be a place.
    size = int(base.max(initial=0)) + 256
    owner = np.full(size, -1, dtype=np.int32)
    target, written = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    if placed:
        slots, owners, targets, values = (np.array(c) for c in zip(*placed, strict=True))
        owner[slots], target[slots], written[slots] = owners, targets, values
    return Transducer(base.astype(np.int32), final, owner, target, written, entries)


# Vocabulary


def _read(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))


def vocabulary(read: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(entry): language, a zero byte and term, for each term kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in by_lang.items():
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(found), dtype=np.int32)), pa.array([lang])).cast(pa.string()),
                        pa.array(list(found.keys()), pa.binary()).cast(pa.string()),
                        pa.array(list(found.values()), pa.int64())], names=["lang", "term", "n"])
            by_lang.clear()

        held = 0
        for batch in batches:
            for value, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counter = by_lang[lang]
                before = len(counter)
                counter.update(set(value.as_buffer().to_pybytes().translate(LETTERS).split()))
                held += len(counter) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    each = read.select("text", "lang").mapInArrow(run, "lang string, term string, n long")
    # Built-in sums: partial sums before the shuffle, by (lang, term).
    kept = each.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    return settle(kept.select(F.concat("lang", F.lit("\0"), "term").alias("entry")), "vocabulary")


def transducers(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(part, at, entries, data): the kept entries in sorted blocks, one transducer each, settled in order of (part, at)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, []

        def flush() -> pa.RecordBatch:
            made = build(held)
            return pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "entries": pa.array([made.entries], pa.int64()),
                                               "data": pa.array([made.to_bytes()], pa.binary())})

        for batch in batches:
            for entry in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(entry)
                if len(held) >= block:
                    yield flush()
                    at, held = at + 1, []
        if held:
            yield flush()

    parts = 1 + kept.count() // block
    ranges = kept.repartitionByRange(parts, "entry").sortWithinPartitions("entry")
    made = ranges.mapInArrow(run, "at int, entries long, data binary")
    return settle(made.select(F.spark_partition_id().alias("part"), "at", "entries", "data"), "transducers")


def transducer_sets(made: DataFrame, most: int = SET_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Sets of (first ordinal, transducer) of at most ``most`` bytes; a set is read when it is asked for."""
    sizes = made.select("part", "at", "entries", F.octet_length("data").alias("size")).orderBy("part", "at").collect()
    first, total, chosen, held = {}, 0, [], 0
    for row in sizes:
        first[row.part, row.at] = total
        total += row.entries

    def read() -> list[tuple[int, bytes]]:
        a, b = chosen[0], chosen[-1]
        inside = f"(part, at) >= ({a[0]}, {a[1]}) AND (part, at) <= ({b[0]}, {b[1]})"
        return sorted((first[r.part, r.at], bytes(r.data)) for r in made.where(inside).select("part", "at", "data").collect())

    for row in sizes:
        if chosen and held + row.size > most:
            yield read()
            chosen, held = [], 0
        chosen.append((row.part, row.at))
        held += row.size
    if chosen:
        yield read()


_opened: dict[str, list[tuple[int, Transducer]]] = {}


def opened(shared) -> list[tuple[int, Transducer]]:
    """The transducers of one broadcast set, kept by a Python worker until it opens another."""
    if shared.id not in _opened:
        _opened.clear()
        _opened[shared.id] = [(first, Transducer.from_bytes(data)) for first, data in shared.value]
    return _opened[shared.id]


@dataclass(frozen=True)
class Shared:
    """A broadcast set under a name of its own, since workers outlive a query."""

    id: str
    broadcast: object

    @property
    def value(self) -> list[tuple[int, bytes]]:
        return self.broadcast.value


# Recounting


def recount(read: DataFrame, sets: list[Shared]) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of each kept term, by streaming all texts through the transducers."""
    def passing(shared: Shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = opened(shared)
            last = machines[-1][0] + machines[-1][1].entries
            groups: dict[tuple[str, str], int] = {}
            waiting: dict[str, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
            tallies: list[tuple[np.ndarray, np.ndarray]] = []
            size = waited = 0

            def walk() -> None:
                nonlocal size, waited
                for lang, (texts, of) in waiting.items():
                    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
                    inside = data != 32
                    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
                    ends = np.cumsum([len(t) + 1 for t in texts])
                    group = np.array(of, dtype=np.int64)[np.searchsorted(ends, starts, side="right")]
                    for first, machine in machines:
                        root = machine.step(0, first, lang.encode("utf-8", "surrogatepass") + b"\0")
                        if root is not None:
                            who, ordinals = machine.ordinals(data, starts, root)
                            tallies.append(np.unique(group[who] * last + ordinals, return_counts=True))
                            size += len(tallies[-1][0])
                waiting.clear()
                waited = 0
                if size > HELD:
                    merge()

            def merge() -> None:
                nonlocal size
                if tallies:
                    keys = np.concatenate([k for k, _ in tallies])
                    times = np.concatenate([n for _, n in tallies])
                    distinct, place = np.unique(keys, return_inverse=True)
                    total = np.zeros(len(distinct), dtype=np.int64)
                    np.add.at(total, place, times)
                    tallies[:] = [(distinct, total)]
                    size = len(distinct)

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal size
                merge()
                names = list(groups)
                for keys, times in tallies:
                    of = pa.array((keys // last).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        pa.DictionaryArray.from_arrays(of, pa.array([g[0] for g in names], pa.string())).cast(pa.string()),
                        pa.DictionaryArray.from_arrays(of, pa.array([g[1] for g in names], pa.string())).cast(pa.string()),
                        pa.array(keys % last), pa.array(times)], names=["lang", "source", "ordinal", "n"])
                tallies.clear()
                groups.clear()
                size = 0

            for batch in batches:
                for value, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    texts, of = waiting[lang]
                    texts.append(value.as_buffer().to_pybytes().translate(LETTERS))
                    of.append(groups.setdefault((lang, source), len(groups)))
                    waited += len(texts[-1])
                    if waited >= WALK_BYTES:
                        walk()
                        if size > HELD:
                            yield from flush()
            walk()
            yield from flush()

        return read.select("text", "lang", "source").mapInArrow(run, "lang string, source string, ordinal long, n long")

    out = passing(sets[0])
    for shared in sets[1:]:
        out = out.unionByName(passing(shared))
    return settle(out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recounted")


def terms_of(rows: DataFrame, sets: list[Shared]) -> DataFrame:
    """``rows`` with ``ordinal`` replaced by the term it stands for, as ``item``."""
    others = [c for c in rows.columns if c != "ordinal"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", item string"

    def passing(shared: Shared, first: int, stop: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = opened(shared)
            begins = np.array([f for f, _ in machines])
            for batch in batches:
                items = []
                for ordinal in batch.column(0).to_pylist():
                    begin, machine = machines[int(np.searchsorted(begins, ordinal, side="right")) - 1]
                    items.append(machine.entry(ordinal - begin).rpartition(b"\0")[2])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(items, pa.binary()).cast(pa.string())], names=[*others, "item"])

        inside = rows.where((F.col("ordinal") >= first) & (F.col("ordinal") < stop))
        return inside.select("ordinal", *others).mapInArrow(run, schema)

    begins = [shared.value[0][0] for shared in sets]
    parts = [passing(s, a, b) for s, a, b in zip(sets, begins, [*begins[1:], np.iinfo(np.int64).max], strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Shares and distances


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exact at any size."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    below = (total + SMOOTH * kept).cast("decimal(20,0)")
    return F.call_function("div", above, below).cast("long") + 1


def distances(rated: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, a, b, value) for sources a < b of a language: the sum over its kept terms of the difference of their shares.

    ``rated`` has (lang, source, ordinal, p) of terms that a source has, ``groups`` (lang, source, p0) with the share
    of those it hasn't. A block of ordinals is compared for all sources at once; blocks are added up.
    """
    sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(64, min(4096, cells // sources))
    parts = rated.select("lang", F.expr(f"ordinal div {width}").alias("block"), "source", "ordinal", "p")
    # Each block is told of all sources of its language; a language without terms has a block without terms.
    told = groups.join(parts.select("lang", "block").distinct(), "lang", "left").select(
        "lang", F.coalesce("block", F.lit(-1)).alias("block"), "source", F.lit(-1).cast("long").alias("ordinal"), F.col("p0").alias("p"))

    def compare(table: pa.Table) -> pa.Table:
        ordinal = table.column("ordinal").to_numpy()
        p = table.column("p").to_numpy()
        everyone, source = np.unique(np.array(table.column("source").to_pylist(), dtype=object), return_inverse=True)
        listed = ordinal < 0
        known, term = np.unique(ordinal[~listed], return_inverse=True)
        shares = np.zeros((len(everyone), len(known)), dtype=np.int64)
        shares[source[listed]] = p[listed][:, None]
        shares[source[~listed], term] = p[~listed]
        a, b, value = [], [], []
        for i in range(len(everyone) - 1):
            gap = np.abs(shares[i + 1:] - shares[i]).sum(axis=1)
            a.append(np.full(len(gap), i))
            b.append(np.arange(i + 1, len(everyone)))
            value.append(gap)
        take = lambda x: pa.array(everyone[np.concatenate(x)].tolist() if x else [], pa.string())
        values = np.concatenate(value) if value else np.zeros(0, dtype=np.int64)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(values), pa.string()), "a": take(a), "b": take(b), "value": pa.array(values, pa.int64())})

    each = parts.unionByName(told).groupBy("lang", "block").applyInArrow(compare, "lang string, a string, b string, value long")
    return each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, set_bytes: int = SET_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source apart from the others of its language.

    Part ``pair``: each other source and the distance to it, all ranks. Part
    ``term``: kept terms that the source has more often than its language, by how
    much, down to rank ``top``.
    """
    context = docs.sparkSession.sparkContext
    read = _read(docs, text, lang, source)
    kept = vocabulary(read, min_docs)
    made = transducers(kept, block)
    sets = [Shared(uuid.uuid4().hex, context.broadcast(chosen)) for chosen in transducer_sets(made, set_bytes)]
    # A number of terms for each language, of the entries: what follows the last zero byte is the term.
    sizes = kept.select(F.expr("substring(entry, 1, length(entry) - instr(reverse(entry), '\\0'))").alias("lang")).groupBy("lang").agg(
        F.count("*").alias("kept"))
    spark = docs.sparkSession
    counts = recount(read, sets) if sets else spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = settle(groups.fillna(0, ["kept", "total"]), "groups")
    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    rated = (counts.join(groups, ["lang", "source"]).join(whole, "lang")
             .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))))

    apart = distances(rated.select("lang", "source", "ordinal", "p"), groups.select("lang", "source", none.alias("p0")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = apart.select("lang", both.alias("of"), "value").select("lang", "of.source", "of.item", "value")
    own = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))

    everywhere = F.sum("n").over(Window.partitionBy("lang", "ordinal"))
    more = (rated.withColumn("q", share(everywhere, F.col("whole"), F.col("kept"))).where("p > q")
            .select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value")))
    # Ordinals of a language ascend as its terms do.
    best = more.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    if not sets:
        return pairs.select(columns)
    return pairs.select(columns).unionByName(terms_of(best, sets).withColumn("part", F.lit("term")).select(columns))


#: DuckDB. A row is a document.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM m),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM s WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
