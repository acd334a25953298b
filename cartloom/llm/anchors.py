"""Bringing equal windows of different documents together without shipping the corpus.

Two operators look for windows (so many bytes, so many words) that occur in more
than one document. Each window is known by its anchor: the least hash of the
``k``-grams inside it. Equal windows have equal anchors, so a window can only
recur where its anchor does, and all its occurrences can be sent to one shard by
the anchor.

1. ``pack``: documents go into compressed packs of bounded size, written once.
2. ``shared_anchors``: each pack sends its distinct anchors, 32 bits each, to
   slices of the hash space; a slice answers which of them occur in other texts.
   A chance collision only adds work.
3. ``segments``: maximal runs of windows with one shared anchor are cut out and
   sent to the shard of their anchor, equal ones of a pack once, with the places
   where they occur.
4. A solver per shard compares windows exactly and returns marked runs.
5. ``apply_marks``: the marks of a pack meet its texts again.

Texts that are equal within a pack are handled once. Ids are whole numbers; a
null id counts as larger than all others. Rows that share an id never remove
each other's text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.tables import WORD
from cartloom.session import settle

PACK_BYTES = 4_000_000
#: Text bytes for which there is one slice of the hash space, and one shard.
SLICE_BYTES = 8_000_000
SHARD_BYTES = 3_000_000
NO_ID = np.iinfo(np.int64).max

PACKED = "pack long, ids array<long>, lengths array<long>, blob binary"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = PACK_BYTES) -> DataFrame:
    """The documents in compressed packs, settled in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            row = {"pack": (part << 32) + made, "ids": list(ids), "lengths": [len(t) for t in texts], "blob": squeeze.compress(b"".join(texts))}
            return pa.RecordBatch.from_pylist([row], schema=PACK_SCHEMA)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append((value or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 16
                if held >= size:
                    yield flush()
                    made, held = made + 1, 0
                    ids.clear()
                    texts.clear()
        if ids:
            yield flush()

    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return settle(rows.mapInArrow(run, PACKED), "packs")


PACK_SCHEMA = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blob", pa.binary())])


def text_bytes(packs: DataFrame) -> int:
    return packs.select(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)"))).first()[0] or 0


# Windows and their anchors

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(values: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each value."""
    x = values * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


@dataclass(frozen=True)
class Unit:
    """What windows are counted in: ``window`` symbols, anchored by ``gram`` symbols."""

    window: int
    gram: int
    words: bool

    def symbols(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The canonical text, and for words the places where they start in it."""
        if not self.words:
            return text, None
        found = WORD.findall(text.decode("utf-8", "surrogatepass"))
        raw = [w.encode("utf-8", "surrogatepass") for w in found]
        starts = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(w) + 1 for w in raw], out=starts[1:])
        return b" ".join(raw), starts

    def gram_hashes(self, text: bytes, starts: np.ndarray | None) -> np.ndarray:
        """The hash of the ``gram`` symbols from each symbol on, as many as fit."""
        if starts is None:
            padded = text + bytes(8)
            n = len(text) - self.gram + 1
            if n <= 0:
                return np.zeros(0, dtype=np.uint64)
            words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
            h = mix(words[:n].astype(np.uint64))
            for at in range(8, self.gram, 8):
                step = min(at, self.gram - 8)
                h = mix(h ^ words[step:step + n])
            return h
        n = len(starts) - self.gram
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        own = word_hashes(text, starts)
        h = mix(own[:n])
        for at in range(1, self.gram):
            h = mix(h ^ own[at:at + n])
        return h


def word_hashes(text: bytes, starts: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes, from running sums over the whole text."""
    data = np.frombuffer(text + b" ", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    # Powers of an odd number are invertible modulo 2**64, so a word's sum can be shifted to a common place.
    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    powers, backs = _powers(base, len(data)), _powers(inverse, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * powers, out=sums[1:])
    first, last = starts[:-1], starts[1:] - 1
    return mix((sums[last] - sums[first]) * backs[first]) + (last - first).astype(np.uint64)


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _power_cache.get(base)
    if got is None or len(got) < n:
        got = np.ones(max(n, 1 << 16), dtype=np.uint64)
        if len(got) > 1:
            got[1:] = base
            np.multiply.accumulate(got, out=got)
        if n <= 1 << 22:
            _power_cache[base] = got
    return got[:n]


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: the anchor, the first window, how many."""
    span = window - gram + 1
    n = len(hashes) - span + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    least, width = hashes, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first], first, np.diff(np.append(first, n))


@dataclass
class Text:
    """One distinct text of a pack: its smallest id, the rows that have it, and its windows' anchors."""

    least: int
    rows: list[int]
    text: bytes
    starts: np.ndarray | None
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray


def ids_of(row: dict) -> list[int]:
    return [NO_ID if i is None else i for i in row["ids"]]


def texts_of(row: dict) -> dict[bytes, list[int]]:
    """The different texts of a pack, each with the rows that have it."""
    data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, sum(row["lengths"])))
    same: dict[bytes, list[int]] = {}
    at = 0
    for n, size in enumerate(row["lengths"]):
        same.setdefault(data[at:at + size], []).append(n)
        at += size
    return same


def open_pack(row: dict, unit: Unit) -> list[Text]:
    """The distinct texts of a pack, in order of first appearance."""
    ids, out = ids_of(row), []
    for raw, rows in texts_of(row).items():
        text, starts = unit.symbols(raw)
        found = anchors(unit.gram_hashes(text, starts), unit.window, unit.gram)
        out.append(Text(min(ids[r] for r in rows), rows, text, starts, *found))
    return out


def pack_anchors(texts: list[Text]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a pack, sorted, and which of them are in several of its texts."""
    if not texts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    each = [np.unique(t.keys) for t in texts]
    keys, times = np.unique(np.concatenate(each), return_counts=True)
    return keys, times > 1


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(slices)


def by_slice(keys: np.ndarray, slices: int) -> tuple[np.ndarray, list[int], list[tuple[int, int]]]:
    """The order of the keys by slice, the slices that have any, and where each of them begins and ends.

    Only slices that are used cost anything, however many there are.
    """
    place = slice_of(keys, slices).astype(np.int64)
    order = np.argsort(place, kind="stable")
    used, begins = np.unique(place[order], return_index=True)
    cuts = [*begins.tolist(), len(keys)]
    return order, used.tolist(), list(zip(cuts[:-1], cuts[1:], strict=True))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def shared_anchors(packs: DataFrame, unit: Unit, slices: int) -> DataFrame:
    """Per pack and slice: one bit for each of the pack's anchors there, in order: is it in another text too?"""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, several = pack_anchors(open_pack(row, unit))
            order, used, cuts = by_slice(keys, slices)
            low, several = (keys[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), several[order]
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(used, pa.int64()), "pack": pa.array([row["pack"]] * len(used), pa.int64()),
                "low": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
                "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        lows = [np.frombuffer(b, dtype=np.uint32) for b in group.column("low").to_pylist()]
        bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:len(low)].astype(bool)
                for b, low in zip(group.column("several").to_pylist(), lows, strict=True)]
        every = np.concatenate(lows)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        shared = np.concatenate(bits)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        ends = np.cumsum([len(low) for low in lows])
        parts = np.split(shared, ends[:-1])
        return pa.table({"pack": group.column("pack"), "slice": group.column("slice"),
                         "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})

    sent = packs.mapInArrow(send, "slice long, pack long, low binary, several binary")
    return sent.groupBy("slice").applyInArrow(answer, "pack long, slice long, bits binary")


SEGMENTS = "shard int, pack long, blob binary"


def _packed(segs: list[bytes], seg: list[int], text: list[int], at: list[int], ids: list[int]) -> bytes:
    """Segments and their places (segment, text of the pack, first symbol, smallest id) as one compressed message."""
    row = pa.record_batch([pa.array([v], t) for v, t in zip((segs, seg, text, at, ids), SENT.types, strict=True)], schema=SENT)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SENT) as out:
        out.write_batch(row)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    with pa.ipc.open_stream(raw) as source:
        row = source.read_next_batch()
    return (row.column(0).values.to_pylist(), *(row.column(i).values.to_numpy().astype(np.int64) for i in range(1, 5)))


SENT = pa.schema([("segs", pa.list_(pa.binary())), ("seg", pa.list_(pa.int32())), ("text", pa.list_(pa.int32())),
                  ("at", pa.list_(pa.int32())), ("id", pa.list_(pa.int64()))])


def segments(packs: DataFrame, shared: DataFrame, unit: Unit, slices: int, shards: int) -> DataFrame:
    """Per pack and shard: the distinct segments, and where they occur (text of the pack, first symbol, smallest id)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            texts = open_pack(row, unit)
            keys, _ = pack_anchors(texts)
            order, used, cuts = by_slice(keys, slices)
            place = dict(zip(used, cuts, strict=True))
            wanted = np.zeros(len(keys), dtype=bool)
            for flag in row["flags"]:
                a, b = place[flag["slice"]]
                wanted[order[a:b]] = np.unpackbits(np.frombuffer(flag["bits"], dtype=np.uint8))[:b - a].astype(bool)
            keys = keys[wanted]
            if not len(keys):
                continue
            gathered: dict[int, tuple[dict[bytes, int], list, list, list, list]] = {}
            for number, t in enumerate(texts):
                at = np.searchsorted(keys, t.keys)
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == t.keys)
                first, stop = t.first[hit], t.first[hit] + t.count[hit] + unit.window - 1
                if t.starts is not None:
                    left, right = t.starts[first], t.starts[stop] - 1
                else:
                    left, right = first, stop
                homes = ((t.keys[hit] >> np.uint64(16)) % np.uint64(shards)).tolist()
                for home, f, a, b in zip(homes, first.tolist(), left.tolist(), right.tolist(), strict=True):
                    into = gathered.get(home)
                    if into is None:
                        into = gathered[home] = ({}, [], [], [], [])
                    into[1].append(into[0].setdefault(t.text[a:b], len(into[0])))
                    into[2].append(number)
                    into[3].append(f)
                    into[4].append(t.least)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(list(gathered), pa.int32()), "pack": pa.array([row["pack"]] * len(gathered), pa.int64()),
                "blob": pa.array([_packed(list(g[0]), *g[1:]) for g in gathered.values()], pa.binary())})

    flags = shared.groupBy("pack").agg(F.collect_list(F.struct("slice", "bits")).alias("flags"))
    return packs.join(flags.hint("merge"), "pack").select("pack", "ids", "lengths", "blob", "flags").mapInArrow(cut, SEGMENTS)


MARKS = "pack long, texts array<int>, starts array<int>, ends array<int>"

#: From distinct segments and the smallest id of each: for each window of each segment, in order, the smallest id that has it.
Solver = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]


def solve(sent: DataFrame, unit: Unit, shards: int, solver: Solver) -> DataFrame:
    """Marked runs of symbols per pack.

    ``solver`` gets a shard's distinct segments and their smallest ids, and
    returns how many windows each segment has, and for every window the smallest
    id of any segment that contains it.
    """
    def marks(held: list[dict]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        seg, txt, at, ids, src = [], [], [], [], []
        for which, row in enumerate(held):
            segs, occ, text, place, own = _unpacked(row["blob"])
            local = np.array([number.setdefault(s, len(number)) for s in segs], dtype=np.int64)
            seg.append(local[occ])
            txt.append(text)
            at.append(place)
            ids.append(own)
            src.append(np.full(len(occ), which))
        seg, txt, at, ids, src = map(np.concatenate, (seg, txt, at, ids, src))
        least = np.full(len(number), NO_ID, dtype=np.int64)
        np.minimum.at(least, seg, ids)
        counts, owner = solver(list(number), least)
        begin = np.concatenate(([0], np.cumsum(counts)))
        smallest = np.minimum.reduceat(owner, begin[:-1]) if len(owner) else owner
        late = np.flatnonzero(smallest[seg] < ids)
        out: dict[int, list[list[np.ndarray]]] = {}
        for some in np.array_split(late, 1 + int(counts[seg[late]].sum()) // 4_000_000):
            n = counts[seg[some]]
            occ = np.repeat(np.arange(len(some)), n)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = owner[begin[seg[some]][occ] + shift] < ids[some][occ]
            occ, shift = occ[hit], shift[hit]
            if not len(occ):
                continue
            fresh = np.concatenate(([True], (occ[1:] != occ[:-1]) | (shift[1:] != shift[:-1] + 1)))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(occ)) - 1
            o, a, b = some[occ[first]], shift[first], shift[last] + unit.window
            for which in np.unique(src[o]):
                mine = src[o] == which
                out.setdefault(int(which), []).append([txt[o][mine], (at[o] + a)[mine], (at[o] + b)[mine]])
        packs, columns = [], ([], [], [])
        for which, parts in out.items():
            packs.append(held[which]["pack"])
            for column, values in zip(columns, zip(*parts, strict=True), strict=True):
                column.append(np.concatenate(values).astype(np.int32).tolist())
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_pydict({"pack": pa.array(packs, pa.int64()), "texts": pa.array(columns[0], kind),
                                           "starts": pa.array(columns[1], kind), "ends": pa.array(columns[2], kind)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["shard"] != row["shard"]:
                yield marks(held)
                held = []
            held.append(row)
        if held:
            yield marks(held)

    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, MARKS)


def covered(row: dict, texts: list[Text], unit: Unit) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text of the pack: the merged runs of marked symbols, of the row with the smallest id."""
    lists: dict[int, list[tuple[int, int]]] = {}
    for mark in row["marks"] or []:
        for t, a, b in zip(mark["texts"], mark["starts"], mark["ends"], strict=True):
            lists.setdefault(t, []).append((a, b))
    out = []
    for number in range(len(texts)):
        runs = np.array(sorted(lists.get(number, [])), dtype=np.int64).reshape(-1, 2)
        if len(runs):
            reach = np.maximum.accumulate(runs[:, 1])
            new = np.concatenate(([True], runs[1:, 0] > reach[:-1]))
            start = np.flatnonzero(new)
            out.append((runs[start, 0], reach[np.append(start[1:], len(runs)) - 1]))
        else:
            out.append((runs[:, 0], runs[:, 1]))
    return out


def apply_marks(packs: DataFrame, marks: DataFrame, unit: Unit, schema: str,
                rows: Callable[[Text, np.ndarray, np.ndarray], tuple], key: str = "doc_id") -> DataFrame:
    """One output row per document: the id and what ``rows`` makes of its text and its marked runs."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = ids_of(row)
            none = np.zeros(0, dtype=np.uint64)
            texts = [Text(min(ids[r] for r in own), own, *unit.symbols(raw), none, none, none) for raw, own in texts_of(row).items()]
            found: list[tuple | None] = [None] * len(ids)
            for t, (start, end) in zip(texts, covered(row, texts, unit), strict=True):
                n = len(t.text) if t.starts is None else len(t.starts) - 1
                whole = (np.array([0]), np.array([n])) if n >= unit.window else (start, end)
                first = rows(t, start, end)
                copy = rows(t, *whole) if any(ids[r] > t.least for r in t.rows) else None
                for r in t.rows:
                    found[r] = first if ids[r] == t.least else copy
            values = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *map(pa.array, values)], names=[key, *names])

    by_pack = marks.groupBy("pack").agg(F.collect_list(F.struct("texts", "starts", "ends")).alias("marks"))
    joined = packs.join(by_pack.hint("merge"), "pack", "left").select("pack", "ids", "lengths", "blob", "marks")
    return joined.mapInArrow(run, f"{key} long, {schema}")


def remove_repeats(docs: DataFrame, unit: Unit, solver: Solver, schema: str, rows: Callable[[Text, np.ndarray, np.ndarray], tuple],
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """All steps: the rows that ``rows`` makes of each document once the windows found in smaller ids are known."""
    packs = pack(docs, key, text)
    size = text_bytes(packs)
    slices, shards = 1 + size // SLICE_BYTES, 1 + size // SHARD_BYTES
    shared = settle(shared_anchors(packs, unit, slices), "shared")
    marks = settle(solve(segments(packs, shared, unit, slices, shards), unit, shards, solver), "marks")
    return apply_marks(packs, marks, unit, schema, rows, key)


def scratch() -> str:
    """Where this task may keep working files for its own use."""
    return os.environ.get("TMPDIR", "/tmp")
