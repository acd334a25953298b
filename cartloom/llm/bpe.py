"""BPE encoding and decoding with a contiguous array of ranks per word.

A tokenizer file of the public JSON format is read for its vocabulary, merges,
special tokens and word-end suffix. A text is cut at special tokens, normalised
(NFC, lower case), cut into words, and each word's UTF-8 bytes are written with
the printable stand-ins of byte-level BPE. Texts beyond common Latin characters
are normalised and cut by the tokenizers library, because letters are defined
by its version of Unicode; all merging is done here. A word holds its part boundaries and
the rank of each adjacent pair in two short arrays: the least rank is looked for,
its boundary deleted, and the ranks beside it refreshed, until no pair merges.
Words beyond ``SHORT`` parts go through a heap with the same result, since
scanning their arrays would take the square of their length.

A null text is an empty text; it has no tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from cartloom.llm.tables import held, map_texts

#: How the vocabulary's tokenizer cuts words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters only are the same under any Unicode version: NFC already, lower case by character.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ž‐-‧‰-›€]*")
SHORT = 64
#: Words remembered by a worker, in each of two generations.
REMEMBERED = 150_000
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else 256 and up in order."""
    out, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder:
    """Encodes and decodes as the file's tokenizer does without adding special tokens."""

    def __init__(self, definition: str):
        file = json.loads(definition)
        model = file["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {pair: at for at, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.cutter = Tokenizer.from_str(definition)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.cut.split(text or "") if self.cut else [text or ""]:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            if PLAIN.fullmatch(piece):
                young = self.young
                for word in WORDS.findall(piece.lower()):
                    got = young.get(word)
                    ids += got if got is not None else self._remember(word)
            else:
                for spelled, _ in self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(piece)):
                    ids += self.encode_spelled(spelled)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as a tokenizer without a decoder gives them."""
        return " ".join([self.tokens[i] for i in ids])

    def _remember(self, word: str) -> tuple[int, ...]:
        got = self.old.get(word)
        if got is None:
            got = self.encode_word(word)
        if len(word) <= SHORT:
            if len(self.young) >= REMEMBERED:
                self.old = dict(self.young)
                self.young.clear()
            self.young[word] = got
        return got

    def encode_word(self, word: str) -> tuple[int, ...]:
        return self.encode_spelled("".join([self.letters[b] for b in word.encode("utf-8")]))

    def encode_spelled(self, spelled: str) -> tuple[int, ...]:
        parts = self._merge_short(spelled) if len(spelled) <= SHORT else self._merge_long(spelled)
        return tuple(i for i in map(self.vocab.get, parts) if i is not None)

    def _merge_short(self, word: str) -> list[str]:
        bounds = [*range(len(word)), len(word) + len(self.suffix)]
        word += self.suffix
        rank = self.rank
        ranks = [rank.get((word[a:b], word[b:c]), NEVER) for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            del bounds[at + 1], ranks[at]
            if at < len(ranks):
                a, b, c = bounds[at:at + 3]
                ranks[at] = rank.get((word[a:b], word[b:c]), NEVER)
            if at:
                a, b, c = bounds[at - 1:at + 2]
                ranks[at - 1] = rank.get((word[a:b], word[b:c]), NEVER)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, word: str) -> list[str]:
        parts: list[str | None] = [*word[:-1], word[-1] + self.suffix]
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        queue = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1]), NEVER)) != NEVER]
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            right = after[at] if parts[at] is not None else -1
            if right < 0 or self.rank.get((parts[at], parts[right]), NEVER) != rank:
                continue
            parts[at] += parts[right]
            parts[right] = None
            after[at] = after[right]
            if after[right] >= 0:
                before[after[right]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    fresh = self.rank.get((parts[left], parts[after[left]]), NEVER)
                    if fresh != NEVER:
                        heapq.heappush(queue, (fresh, left))
        return [p for p in parts if p is not None]


def definition(spark: SparkSession, path: str) -> str:
    """The tokenizer file's text, from this machine or any store that Spark reads."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoder(shared) -> Encoder:
    """One encoder for each Python worker, built from the broadcast definition."""
    return held(f"bpe-{hash(shared.value)}", lambda: Encoder(shared.value))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``ids`` and the ``decoded`` text of the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(definition(docs.sparkSession, path))

    def make():
        coder = encoder(shared)

        def rows(texts):
            for value in texts:
                ids = coder.encode(value)
                yield ids, coder.decode(ids)
        return rows

    return map_texts(docs, make, "ids array<int>, decoded string", key, text)
