"""Fill-in-the-middle rearrangement as one pyarrow.compute pipeline per batch.

A text is cut into units: a word with the white space before it, or white space
at the end. Per batch the units of all texts are split into a list array,
flattened with the index of their text, numbered within it, given the role of
prefix, middle or suffix by their number, filtered by role, gathered into lists
again, and each list joined to one piece. No unit is a Python object.

Where the cuts are, and in which order the pieces are written, is decided by a
hash of the row's id alone: running the job again, on any number of machines,
gives the same output. A null text is an empty text. Empty texts, and texts that
hold one of the markers, stay plain, so that every output can be undone. A null
id is hashed as an empty one. Repeated rows are treated one by one, other columns
of the input are ignored, and a very long text is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
ANY_MARK = "<[PSM]>"
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: Ends each unit before splitting; no byte of UTF-8.
END = b"\xff"
SEED = 42
#: Of 100: rows that stay plain, and rows of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 50, 80
BATCH_BYTES = 8_000_000

OUT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix", pa.string()), ("middle", pa.string()), ("suffix", pa.string()),
                 ("output", pa.string())])


def lots(key: Column, seed: int = SEED) -> Column:
    """Four whole numbers of 32 bits, from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def remainder(of: pa.Array, by) -> pa.Array:
    return pc.subtract(of, pc.multiply(pc.divide(of, by), by))


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """All units of the texts, the text each is of, and how many units each text has."""
    ended = pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\1" + END)
    lists = pc.split_pattern(ended, pattern=END)
    # What follows the last end is empty; no unit is.
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, real), pc.filter(parent, real), pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())


def starts(counts: pa.Array) -> pa.Array:
    """Where each list starts, and where the last ends."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])


def pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """How many units each text has, and the joined units before, between and after its two cuts.

    ``first`` and ``second`` are 32-bit numbers per text; a cut is their remainder by one more than the units.
    """
    flat, parent, counts = units(texts)
    room = pc.add(counts, 1)
    a, b = remainder(first, room), remainder(second, room)
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    begin = starts(counts)
    ordinal = pc.subtract(pa.array(np.arange(len(flat)), pa.int64()), pc.take(begin, parent))
    role = pc.add(pc.greater_equal(ordinal, pc.take(low, parent)).cast(pa.int8()),
                  pc.greater_equal(ordinal, pc.take(high, parent)).cast(pa.int8()))
    lengths = [low, pc.subtract(high, low), pc.subtract(counts, high)]
    joined = [pc.binary_join(pa.ListArray.from_arrays(starts(n).cast(pa.int32()), pc.filter(flat, pc.equal(role, r))), b"")
              for r, n in enumerate(lengths)]
    return counts, joined


def as_text(data: pa.Array) -> pa.Array:
    return pc.cast(data, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def rearranged(texts: pa.Array, draws: list[pa.Array]) -> pa.RecordBatch:
    """``OUT`` for a batch of binary texts and their four numbers."""
    counts, (prefix, middle, suffix) = pieces(texts, draws[0], draws[1])
    plain = pc.or_(pc.or_(pc.equal(counts, 0), pc.match_substring_regex(texts, pattern=ANY_MARK)),
                   pc.greater_equal(remainder(draws[2], 100), PLAIN))
    turned = pc.less(remainder(draws[3], 100), SUFFIX_FIRST)
    p, s, m = (pa.scalar(mark.encode(), pa.binary()) for mark in MARKS)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
    output = pc.if_else(plain, texts, pc.if_else(turned, spm, psm))
    form = pc.if_else(plain, "plain", pc.if_else(turned, "spm", "psm"))
    nothing = pa.scalar(None, pa.binary())
    shown = [as_text(pc.if_else(plain, nothing, piece)) for piece in (prefix, middle, suffix)]
    return pa.RecordBatch.from_arrays([counts, form, *shown, as_text(output)], schema=OUT)


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The text that an output was made of, from the output and its form alone."""
    plain = pc.equal(form, "plain")
    # Only the three markers are in an output that isn't plain, each once.
    parts = pc.split_pattern_regex(pc.if_else(plain, "".join(MARKS), output), pattern=ANY_MARK)
    one, two, middle = (pc.list_element(parts, i) for i in (1, 2, 3))
    turned = pc.equal(form, "spm")
    prefix, suffix = pc.if_else(turned, two, one), pc.if_else(turned, one, two)
    return pc.if_else(plain, output, pc.binary_join_element_wise(prefix, middle, suffix, ""))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose sizes add up to ``most`` at most; a larger row comes alone."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, stop
        at = stop


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: the key, ``n`` units, ``form`` (plain, psm or spm), ``prefix``, ``middle`` and ``suffix`` (null if plain), and ``output``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).cast(pa.binary())
            sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, stop in slices(sizes, BATCH_BYTES):
                draws = batch.column(1).slice(at, stop - at)
                made = rearranged(data.slice(at, stop - at), [pc.list_element(draws, i) for i in range(4)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), *made.columns], names=[key, *OUT.names])

    rows = docs.select(F.col(key), lots(F.col(key), seed).alias("_lots_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text_"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix string, middle string, suffix string, output string")


def restore(made: DataFrame, to: str = "restored") -> DataFrame:
    """Adds the text that ``output`` was made of, rebuilt from ``output`` and ``form`` alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            sizes = pc.binary_length(named["output"]).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, stop in slices(sizes, BATCH_BYTES):
                part = batch.slice(at, stop - at)
                back = restored(named["output"].slice(at, stop - at), named["form"].slice(at, stop - at))
                yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*batch.schema.names, to])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(run, f"{names}, `{to}` string")


#: DuckDB: cuts, form, and digests of the output and of the text it came from.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
d AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
