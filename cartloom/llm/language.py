"""Language identification by a bit-sliced Bloom filter of n-grams.

One filter holds all languages: each slot is a bit mask with one bit a language
(several masks beyond 64 languages),
so the masks at an n-gram's slots, ANDed, are the languages that may have it.
Counting each bit over the n-grams of a text gives its count per language; the
false positives to expect from how full each language's bits are get subtracted,
and the largest corrected count decides.

The filter is fitted on a bounded sample: for each language the ``SAMPLE``
labelled documents of the learning folds whose ids' hashes come first. Of their
n-grams the ``GRAMS`` in most documents go in, if at least two documents have
them. All languages that have such n-grams are learned: there is a column of masks
for each 64 of them.

A prediction reads the text only. Texts without a letter, empty and null texts
are ``und`` with score 0. Ties go to the first language by name.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.anchors import mix
from cartloom.llm.tables import held_out, map_texts

LETTERS = re.compile(r"[^\W\d_]+")
SIZES = (3, 4)
SAMPLE, GRAMS = 1500, 30_000
#: Languages in one column of masks, and slices of the ids' hashes, a power of two.
COLUMN, SLICES = 64, 4096
#: Slots of the filter, and slots looked at for each n-gram.
SLOTS, PROBES = 1 << 20, 3


def grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the lower-cased words, each with a blank before and after."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    found = []
    for size in SIZES:
        n = len(points) - size + 1
        if n > 0:
            h = np.full(n, size, dtype=np.uint64)
            for at in range(size):
                h = h * np.uint64(0x100000001B3) ^ points[at:at + n]
            found.append(mix(h))
    return np.concatenate(found)


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(SLOTS)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray
    #: Masks of the languages after the first ``COLUMN``, a column for each further ``COLUMN``.
    more: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray]) -> Filter:
        languages = sorted(by_language)
        bits = max(8, 1 << max(0, len(languages) - 1).bit_length())
        kind = np.dtype(f"<u{min(COLUMN, bits) // 8}")
        columns = [np.zeros(SLOTS, dtype=kind) for _ in range(0, max(1, len(languages)), COLUMN)]
        for n, language in enumerate(languages):
            masks = columns[n // COLUMN]
            for place in slots(by_language[language]):
                masks[place] |= kind.type(1 << n % COLUMN)
        return cls(languages, columns[0], columns[1:])

    def __post_init__(self):
        full = self._counts([self.masks, *self.more]) / SLOTS
        self.false = full ** PROBES

    def _counts(self, columns: list[np.ndarray]) -> np.ndarray:
        """For each language, how many of the masks have its bit."""
        one = self.masks.dtype.type
        return np.array([np.count_nonzero(columns[n // COLUMN] >> one(n % COLUMN) & one(1)) for n in range(len(self.languages))])

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = grams(text)
        if not len(hashes) or not self.languages:
            return "und", 0.0
        first, *others = slots(hashes)
        columns = []
        for masks in (self.masks, *self.more):
            found = masks[first]
            for place in others:
                found &= masks[place]
            columns.append(found)
        counts = self._counts(columns)
        true = np.maximum(0, (counts - len(hashes) * self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(np.argmax(true))
        total = true.sum()
        return self.languages[best], float(true[best] / total) if total else 0.0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filter:
    """Fitted on the sampled documents outside the held-out fold whose language is known."""
    known = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull()).select(key, F.col(lang).alias("language"))
    hashed = known.withColumn("hash", F.xxhash64(key)).withColumn("slice", F.shiftright("hash", 64 - SLICES.bit_length() + 1))
    # A language's first ids by hash are in its first slices; only so many of them are ranked as hold the sample.
    sizes = hashed.groupBy("language", "slice").count()
    in_front = F.coalesce(F.sum("count").over(Window.partitionBy("language").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sizes.withColumn("before", in_front).where(F.col("before") < SAMPLE).groupBy("language").agg(F.max("slice").alias("last"))
    front = hashed.join(F.broadcast(last), "language").where(F.col("slice") <= F.col("last"))  # a row a language
    ranked = front.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy("hash", key)))
    chosen = F.broadcast(ranked.where(F.col("rank") <= SAMPLE).select(key, "language").distinct())  # at most SAMPLE rows a language

    def make():
        return lambda texts: ((np.unique(grams(t)).view(np.int64).tolist(),) for t in texts)

    rows = docs.select(F.col(key), F.col(text)).join(chosen, key).select("language", text)
    each = map_texts(rows, make, "grams array<long>", "language", text)
    counted = each.select("language", F.explode("grams").alias("gram")).groupBy("language", "gram").count().where("count >= 2")
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("count"), "gram"))).where(F.col("rank") <= GRAMS)
    packed = top.groupBy("language").agg(F.collect_list("gram").alias("grams")).collect()  # at most GRAMS numbers a language
    return Filter.build({r["language"]: np.array(r["grams"], dtype=np.int64).view(np.uint64) for r in packed})


_filters: dict[str, Filter] = {}


def predict(docs: DataFrame, fitted: Filter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``lang_pred`` and ``score``, its share of all languages' corrected counts."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fitted))

    def make():
        name, own = shared.value
        if name not in _filters:
            _filters.clear()
            _filters[name] = own
        return lambda texts: map(_filters[name].predict, texts)

    return map_texts(docs, make, "lang_pred string, score double", key, text)
