"""Lists of whole numbers sent to groups in packs, one shuffled row for all lists of a task that go to one group.

A list (a user's items, an item's neighbours) goes to each of its receivers, so what is shuffled
is many times the table. Ids travel as the steps between them, values as places in the list's own
table of values, byte by byte of all numbers of a pack, which zstd brings close to what they tell.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship the helpers of this module inside the task, so that executors don't need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Entries of lists that a task sends at once.
CHUNK_ENTRIES = 8_000_000

WHOLE = ("bigint", "int", "smallint", "tinyint")


class Lists(NamedTuple):
    """One row per list and receiver: the receiver, whose list it is, whether that is known, a mark, the length; then all entries."""

    to: np.ndarray
    own: np.ndarray
    known: np.ndarray
    mark: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    values: np.ndarray


def sent(rows: DataFrame, first: int, last: int) -> DataFrame:
    """``g, pack`` for the groups from ``first`` to before ``last``.

    ``rows`` has ``to`` and ``g`` (arrays: receivers and their groups), ``own`` (a number or
    null), ``mark`` (boolean), ``ids`` (an ascending array) and ``vals`` (an array as long).
    """
    whole = [F.col(c).cast("array<bigint>").alias(c) for c in ("to", "ids", "vals")]
    plain = rows.select(*whole, "g", F.col("own").cast("bigint").alias("own"), "mark")
    return plain.mapInArrow(lambda batches: _send(batches, first, last), "g int, pack array<binary>")


def _send(batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
    held, cost = [], 0
    for batch in batches:
        g = batch.column("g")
        bounds = g.offsets.to_numpy()
        wanted = np.append(0, np.cumsum(_between(g.flatten().to_numpy(), first, last)))
        lengths = np.diff(bounds - bounds[0])
        starts = np.append(0, np.cumsum(lengths))
        receivers = wanted[starts[1:]] - wanted[starts[:-1]]
        entries = np.cumsum(receivers * np.maximum(np.diff(batch.column("ids").offsets.to_numpy()), 1))
        at = 0
        while at < len(entries):
            done = entries[at - 1] if at else 0
            upto = max(int(np.searchsorted(entries, done + CHUNK_ENTRIES - cost, "right")), at + (not held))
            if upto > at:
                held.append(batch.slice(at, upto - at))
                cost += int(entries[upto - 1] - done)
                at = upto
            if at < len(entries) or cost >= CHUNK_ENTRIES:
                yield from _packs(held, first, last)
                held, cost = [], 0
    if held:
        yield from _packs(held, first, last)


def _between(g: np.ndarray, first: int, last: int) -> np.ndarray:
    return (g >= first) & (g < last)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """The bytes of each number, lowest first, as far as any has one."""
    parts = np.ascontiguousarray(numbers, dtype=np.int64).view(np.uint8).reshape(-1, 8)
    most = int(numbers.view(np.uint64).max()) if len(numbers) else 0
    return [np.ascontiguousarray(parts[:, k]) for k in range((most.bit_length() + 7) // 8)]


def _numbers(planes: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view(np.int64).ravel()


def _steps(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each number less the one before it; the first of each list is kept."""
    steps = np.diff(numbers, prepend=numbers[:1])
    steps[starts] = numbers[starts]
    return steps


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat(total[starts] - steps[starts], sizes[sizes > 0])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all entries of these lists, one list after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _packs(batches: list[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    to, receivers = _flat(column("to"))
    g = _flat(column("g"))[0]
    rows = np.repeat(np.arange(table.num_rows), receivers)
    wanted = np.flatnonzero(_between(g, first, last))
    wanted = wanted[np.argsort(g[wanted], kind="stable")]
    if not len(wanted):
        return
    rows, to, g = rows[wanted], to[wanted], g[wanted]
    ids, sizes = _flat(column("ids"))
    values = _flat(column("vals"))[0]
    starts = np.cumsum(sizes) - sizes
    low = ids.min() if len(ids) else np.int64(0)
    steps = _planes(_steps(ids - low, starts[sizes > 0]))
    # Each list's different values in order, and the place of each entry's value among them.
    of = np.repeat(np.arange(len(sizes)), sizes)
    codes, span, _ = narrow(values, len(sizes))
    order = np.argsort(of * span + codes)
    fresh = np.append(True, (np.diff(values[order]) != 0) | (np.diff(of[order]) != 0))[:len(order)]
    counts = np.bincount(of[order][fresh], minlength=len(sizes))
    begin = np.cumsum(counts) - counts
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1 - begin[of[order]]
    places, tables = _planes(place), _planes(_steps(values[order][fresh], begin[counts > 0]))
    entries, named = _spread(starts[rows], sizes[rows]), _spread(begin[rows], counts[rows])
    steps, places, tables = ([plane[at] for plane in planes] for planes, at in ((steps, entries), (places, entries), (tables, named)))
    own = column("own")
    sent = [
        to.astype(np.int64), own.fill_null(0).to_numpy()[rows], own.is_valid().to_numpy(zero_copy_only=False)[rows],
        column("mark").to_numpy(zero_copy_only=False)[rows], sizes[rows], counts[rows],
    ]
    edges = np.append(np.flatnonzero(np.append(True, np.diff(g) != 0)), len(g))
    upto, named_upto = np.append(0, np.cumsum(sizes[rows])), np.append(0, np.cumsum(counts[rows]))
    codec = pa.Codec("zstd", compression_level=1)
    packs = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        parts = [x[a:b] for x in sent]
        parts += [x[upto[a]:upto[b]] for x in (*steps, *places)] + [x[named_upto[a]:named_upto[b]] for x in tables]
        head = np.array([low, b - a, upto[b] - upto[a], named_upto[b] - named_upto[a], len(steps), len(places), len(tables)], dtype=np.int64)
        packs.append([head.tobytes(), *(codec.compress(x.tobytes(), asbytes=True) for x in parts)])
    yield pa.RecordBatch.from_arrays([pa.array(g[edges[:-1]].astype(np.int32)), pa.array(packs, pa.list_(pa.binary()))], ["g", "pack"])


def received(packs: pa.ChunkedArray) -> Lists:
    """All lists of these packs."""
    codec = pa.Codec("zstd")
    found = []
    for pack in packs.to_pylist():
        low, n, entries, named, *widths = np.frombuffer(pack[0], dtype=np.int64).tolist()
        plain = lambda part, kind, size: np.frombuffer(codec.decompress(part, size * np.dtype(kind).itemsize), dtype=kind)
        kinds = (np.int64, np.int64, np.bool_, np.bool_, np.int64, np.int64)
        to, own, known, mark, size, count = (plain(part, kind, n) for part, kind in zip(pack[1:7], kinds, strict=True))
        planes, at = [], 7
        for width, length in zip(widths, (entries, entries, named), strict=True):
            planes.append(_numbers([plain(part, np.uint8, length) for part in pack[at:at + width]], length))
            at += width
        values = _sums(planes[2], count)
        begin = np.cumsum(count) - count
        found.append(Lists(to, own, known, mark, size, _sums(planes[0], size) + low, values[np.repeat(begin, size) + planes[1]]))
    return Lists(*(np.concatenate(part) for part in zip(*found, strict=True)))


def order_of(keys: np.ndarray) -> np.ndarray:
    """What sorts the keys (not negative), equal ones in their order; places ride in the low bits where there is room."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    ridden = (keys << bits) | np.arange(len(keys))
    ridden.sort()
    return ridden & ((1 << bits) - 1)


def narrow(ids: np.ndarray, rows: int) -> tuple[np.ndarray, int, np.ndarray | int]:
    """Codes of the ids in their order, below a number so small that ``rows`` times it is a key, and what gives the ids back."""
    if not len(ids):
        return ids, 1, 0
    low, high = int(ids.min()), int(ids.max())
    if (high - low + 1) * max(rows, 1) < 2**62:
        return ids - low, high - low + 1, low
    values, codes = np.unique(ids, return_inverse=True)
    return codes, len(values), values


def widened(codes: np.ndarray, base: np.ndarray | int) -> np.ndarray:
    return codes + base if isinstance(base, int) else base[codes]


def likely(score: np.ndarray, owner: np.ndarray, top: int) -> np.ndarray:
    """The places of scores that are among the ``top`` highest of their owner, or equal the last of these; owners lie together."""
    edges = np.append(np.flatnonzero(np.append(True, np.diff(owner) != 0)), len(owner))
    least = np.full(len(owner), -np.inf)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > top:
            least[a:b] = np.partition(score[a:b], b - a - top)[b - a - top]
    return np.flatnonzero(score >= least)
