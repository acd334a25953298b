"""Quality rules as a short-circuit cascade.

Each rule rejects or passes a document. A sample gives every rule's cost (time
spent) and selectivity (share rejected); the cascade asks the rules in order of
rejections per cost and stops at the first that rejects. The order decides how
much work is done, never the verdict.

A null text has no words. A text without words fails the base rule. Repeated
rows are judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.tables import WORD, map_texts

SYMBOLS = "#*$%&|<>"
SHOUTED = re.compile(r"[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*")
LETTER = re.compile(r"[A-Za-z\u0080-\U0010FFFF]")

#: About so many documents are looked at to order the rules.
SAMPLE_DOCS = 2000


class Profile:
    """Measures of one text, each taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur at least twice."""
        windows = list(zip(self.words, self.words[1:], self.words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        covered, end = 0, 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                covered += at + 3 - max(at, end)
                end = at + 3
        return covered

    @cached_property
    def n_shouted(self) -> int:
        return sum(1 for word in self.words if SHOUTED.fullmatch(word))

    @cached_property
    def n_lettered(self) -> int:
        return sum(1 for word in self.words if LETTER.search(word))


def base_failed(p: Profile) -> bool:
    return p.n_words < 50 or 100 * p.n_repeat_words > 50 * p.n_words


#: True rejects. Whole numbers only, so that SQL gives the same verdicts.
RULES: dict[str, Callable[[Profile], bool]] = {
    "symbols": lambda p: 10 * p.n_symbols > 3 * p.n_words,
    "shouting": lambda p: 10 * p.n_shouted > 3 * p.n_words,
    "repeated_lines": lambda p: 10 * p.n_dup_lines > 5 * len(p.lines),
    "word_length": lambda p: p.word_chars > 15 * p.n_words or p.word_chars < 2 * p.n_words,
    "letters": lambda p: 10 * p.n_lettered < 6 * p.n_words,
}


def estimate(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_DOCS) -> list[dict]:
    """Per rule: how many sampled documents it saw and rejected, and its seconds.

    Every rule is asked about every sampled document that passes the base rule.
    Measures shared by rules are charged to the first that needs them.
    """
    parts = max(1, docs.count() // max(1, sample))

    def make():
        def measure(texts):
            for profile in map(Profile, texts):
                if base_failed(profile):
                    yield ([],)
                    continue
                row = []
                for name, rejects in RULES.items():
                    start = time.perf_counter()
                    no = rejects(profile)
                    row.append((name, int(no), time.perf_counter() - start))
                yield (row,)
        return measure

    picked = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(parts)) == 0)
    asked = map_texts(picked, make, "asked array<struct<rule:string,rejected:long,seconds:double>>", key, text)
    each = asked.select(F.explode("asked").alias("a")).select("a.*")
    totals = each.groupBy("rule").agg(F.count("*").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    return [row.asDict() for row in totals.collect()]


def cascade(estimates: list[dict]) -> list[str]:
    """The rules by falling rejections per second, ties by name; rules without an estimate last."""
    worth = {e["rule"]: e["rejected"] / max(e["seconds"], 1e-9) for e in estimates}
    return sorted(RULES, key=lambda name: (-worth.get(name, -1.0), name))


def judge(docs: DataFrame, order: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the id, the base measures, ``base_failed``, ``rejected_by`` (null if kept) and ``kept``.

    ``rejected_by`` is ``base`` or the first rule of ``order`` that rejects;
    later rules aren't evaluated.
    """
    def make():
        def rows(texts):
            for p in map(Profile, texts):
                failed = base_failed(p)
                by = "base" if failed else next((name for name in order if RULES[name](p)), None)
                yield p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, by, by is None
        return rows

    return map_texts(docs, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                 "base_failed boolean, rejected_by string, kept boolean", key, text)


#: DuckDB; :doc_id, the base measures and the verdict.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(l) AS n_lines, count(l) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len([x for x in w if regexp_full_match(x, '[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*')]) AS n_shouted,
    len([x for x in w if regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]')]) AS n_lettered
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_shouted > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines
       OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_lettered < 6 * n_words) AS kept
FROM b
"""
