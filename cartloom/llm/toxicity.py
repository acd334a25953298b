"""Toxicity by compression distance.

Zstandard dictionaries are trained on words of ordinary texts, on toxic texts
(ordinary words with what sets toxic texts apart), and on that difference alone.
A window is one word, written three times: repeats cost next to nothing, and very
short inputs wouldn't be compressed at all. A longer run of letters, as in scripts
without spaces, is several windows that overlap by half. Its compressed lengths under the
dictionaries, with its own length, are its cell. Cells that toxic training
documents have far more often than ordinary ones count for their log ratio; a
document's distance is the sum over its different cells, and the threshold is the
one that separates the training documents best.

The classifier is fitted on a bounded sample: ``TOXIC`` and ``ORDINARY`` labelled
documents of the folds that may be learned from, first by a hash of their ids,
equal texts once. Nothing else of a row than its text enters a score. A text
without letters, an empty or a null text has distance 0. Without toxic training
documents every score is below one half.
"""

from __future__ import annotations

import math
import random
import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.tables import held, held_out, map_texts, whole_rows

WORDS = re.compile(r"[^\W\d_]+")
#: Sampled labelled documents, at most.
TOXIC, ORDINARY = 2000, 4000
#: Bytes of the dictionaries, and of their parts on what is toxic only.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 512
LEVEL = 19
#: A word beginning marks toxic texts if it is so many times as frequent in them.
CONTRAST = 30
#: Longer runs of letters are cut into windows of at most so many bytes, one beginning in the middle of another.
WORD_BYTES = 64
#: Words remembered by a worker, in each of two generations.
REMEMBERED = 400_000


def windows_of(run: str) -> Iterator[str]:
    """A run of letters, or the overlapping windows of a longer one: all of it is in some window."""
    sizes = [len(c.encode("utf-8", "replace")) for c in run]
    start = end = held = 0
    while True:
        while end < len(run) and held + sizes[end] <= WORD_BYTES:
            held += sizes[end]
            end += 1
        yield run[start:end]
        if end == len(run):
            return
        while held > WORD_BYTES // 2:
            held -= sizes[start]
            start += 1


def words_of(text: str | None) -> list[str]:
    """The different words of a text, in order of first appearance, and of longer runs of letters the windows."""
    runs = dict.fromkeys(WORDS.findall((text or "").lower()))
    # A character has four bytes at most.
    if all(len(r) * 4 <= WORD_BYTES or len(r.encode("utf-8", "replace")) <= WORD_BYTES for r in runs):
        return list(runs)
    return list(dict.fromkeys(w for r in runs for w in windows_of(r)))


@dataclass
class Model:
    dictionaries: list[bytes]
    weights: dict[tuple[int, ...], float]
    threshold: float

    def __post_init__(self):
        self.compressors = None
        # The cells of the words met lately, in two generations; only cells that count are told apart.
        self.young: dict[str, tuple[int, ...] | None] = {}
        self.old: dict[str, tuple[int, ...] | None] = {}
        self.counting = {c: c for c in self.weights}

    def __getstate__(self):
        return self.dictionaries, self.weights, self.threshold

    def __setstate__(self, state):
        self.dictionaries, self.weights, self.threshold = state
        self.__post_init__()

    def cell(self, word: str) -> tuple[int, ...]:
        """The word's length in bytes and its compressed lengths."""
        if self.compressors is None:
            self.compressors = [_compressor(d) for d in self.dictionaries]
        raw = word.encode("utf-8", "replace")
        window = (b" " + raw) * 3 + b" "
        return (min(len(raw), 24), *(len(c.compress(window)) for c in self.compressors))

    def _remember(self, word: str) -> tuple[int, ...] | None:
        """The word's cell if it counts, else None."""
        found = self.old[word] if word in self.old else self.counting.get(self.cell(word))
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def distance(self, words: list[str]) -> float:
        if not self.weights:
            return 0.0
        young = self.young
        cells = {young[w] if w in young else self._remember(w) for w in words}
        cells.discard(None)
        return math.fsum(self.weights[c] for c in cells)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(self.threshold - self.distance(words_of(text))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def _beginnings(words: list[str]) -> set[str]:
    return {w[:n] for w in words for n in range(4, min(len(w), 12) + 1)}


def train(toxic: list[list[str]], ordinary: list[list[str]], seed: int = 1) -> Model:
    """A model from the different words of each toxic and each ordinary document."""
    if not toxic or not ordinary:
        return Model([], {}, 1.0)
    rng = random.Random(seed)
    in_toxic = Counter(b for words in toxic for b in _beginnings(words))
    least = max(2, len(toxic) // 125)
    in_toxic = Counter({b: n for b, n in in_toxic.items() if n >= least})
    in_ordinary = Counter(b for words in ordinary for b in _beginnings(words) if b in in_toxic)
    marks = {b: n for b, n in in_toxic.items()
             if n / len(toxic) > CONTRAST * (in_ordinary[b] + 0.5) / len(ordinary)}
    # A beginning that nearly always goes on in one way is left to the longer one.
    longer = Counter()
    for b, n in marks.items():
        longer[b[:-1]] = max(longer[b[:-1]], n)
    marks = {b: n for b, n in marks.items() if longer[b] < 0.9 * n}
    common = Counter(w for words in ordinary for w in words if len(w) > 2)
    plain = [f" {w}".encode() for w, n in sorted(common.items()) for _ in range(min(n, 5))]
    apart = [f" {b}".encode() for b, n in sorted(marks.items()) for _ in range(min(n, 100))]
    mixed = plain + apart * 4
    for samples in (plain, apart, mixed):
        rng.shuffle(samples)
    model = Model([_dictionary(ORDINARY_BYTES, plain), _dictionary(TOXIC_BYTES, apart),
                   _dictionary(ORDINARY_BYTES + TOXIC_BYTES, mixed)], {}, 1.0)
    known: dict[str, tuple[int, ...]] = {}
    for word in dict.fromkeys(w for group in (toxic, ordinary) for words in group for w in words):
        known[word] = model.cell(word)
    bad, good = (Counter(c for words in group for c in {known[w] for w in words}) for group in (toxic, ordinary))
    ratio = {c: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((good[c] + 0.5) / (len(ordinary) + 1)) for c, n in bad.items() if n >= 3}
    weights = {c: r for c, r in ratio.items() if r >= 1}
    ranked = sorted(((math.fsum(weights.get(c, 0.0) for c in {known[w] for w in words}), label)
                     for label, group in ((1, toxic), (0, ordinary)) for words in group), reverse=True)
    best, hits = (0.0, 1.0), 0
    for at, (distance, label) in enumerate(ranked):
        hits += label
        below = ranked[at + 1][0] if at + 1 < len(ranked) else 0.0
        if distance > below:
            best = max(best, (2 * hits / (at + 1 + len(toxic)), (distance + below) / 2))
    return Model(model.dictionaries, weights, best[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fitted on the sampled labelled documents outside the held-out fold."""
    spread = F.xxhash64(F.col(key))
    learnable = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("label"))
    parts = [learnable.where(F.col("label") == value).orderBy(spread, key).limit(most) for value, most in ((1, TOXIC), (0, ORDINARY))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most TOXIC + ORDINARY rows

    def make():
        return lambda texts: ((words_of(t),) for t in texts)

    rows = docs.select(F.col(key), F.col(text)).join(chosen, key)
    keyed = rows.select(F.struct(F.col("label"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("same"), F.col(key).alias("at")).alias("row"),
                        F.col(text))
    # One partition at a time comes to the driver, and equal words of different documents are one object.
    groups: dict[int, dict[str, tuple]] = {0: {}, 1: {}}
    for r in map_texts(keyed, make, "words array<string>", "row", text).toLocalIterator():
        at, held = r["row"]["at"], groups[r["row"]["label"]].get(r["row"]["same"])
        if held is None or at < held[0]:
            groups[r["row"]["label"]][r["row"]["same"]] = (at, list(map(sys.intern, r["words"])))
    toxic, ordinary = ([words for _, words in sorted(groups[label].values(), key=lambda v: v[0])] for label in (1, 0))
    return train(toxic, ordinary)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the ``score`` from 0 to 1, and ``predicted``, 1 from one half on."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def make():
        name, sent = shared.value
        own = held(name, lambda: sent)

        def rows(texts):
            for t in texts:
                value = own.score(t)
                yield value, int(value >= 0.5)
        return rows

    return map_texts(docs, make, "score double, predicted int", key, text)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that aren't predicted to be toxic."""
    return score(whole_rows(docs, text), model, key="row").where(F.col("predicted") == 0).select("row.*")

