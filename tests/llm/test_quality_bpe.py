import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartloom.llm import bpe, quality
from cartloom.llm.tables import WORD

ODD = [None, "", " ", "\n\t", "a", "a b " * 400, "word " * 60, "x" * 5000, "Ünï   çóde 日本語 ½", "a\x1cb\x85c", "# * $" * 40]
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, "no id", 7), (1, "", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long")


def slow_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + o for i, w in enumerate(windows) if times[w] > 1 for o in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(repeated)


def test_quality_measures_and_verdict(spark, odd):
    order = quality.cascade(quality.estimate(odd))
    assert sorted(order) == sorted(quality.RULES)
    for used in (order, order[::-1]):
        got = quality.judge(odd, used).collect()
        assert len(got) == len(ODD) + 2
        for r in got:
            text = "no id" if r.doc_id is None else ODD[r.doc_id]
            base = slow_base(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
            assert r.kept == (r.rejected_by is None) and (r.rejected_by == "base") == r.base_failed
    assert quality.judge(odd.limit(0), order).count() == 0
    assert quality.cascade(quality.estimate(odd.limit(0))) == sorted(quality.RULES)


def test_cascade_order_and_clean_text():
    rows = [{"rule": n, "seen": 9, "rejected": k, "seconds": 1.0} for k, n in enumerate(quality.RULES)]
    assert quality.cascade(rows) == list(quality.RULES)[::-1]
    rng = random.Random(1)
    clean = quality.Profile("\n".join(" ".join("".join(rng.choices("abcdeio", k=5)) for _ in range(12)) for _ in range(9)))
    shouted = quality.Profile(clean.text.upper())
    assert not any(rule(clean) for rule in quality.RULES.values())
    assert quality.RULES["shouting"](shouted)


def test_bpe_equals_the_library(spark, odd):
    library = Tokenizer.from_file(PATH)
    for r in bpe.encode(odd, PATH).collect():
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), PATH).count() == 0


def test_bpe_on_random_text():
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    ranges = [(32, 127), (32, 127), (0xA0, 0x250), (0x370, 0x500), (0x2000, 0x2100), (0x4E00, 0x4F00), (0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += ["<|startoftext|>I'VE<|endoftext|> don't", "a<|endoftext|", "ab" * 500, "don't we'll 'S", "ẞ İstanbul ΣΑΣ"]
    for text in texts:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text
    for word in ("abcabcabd" * 3, "zzzzzzz", "q"):
        assert own._merge_short(word) == own._merge_long(word)
    # Decoding and encoding again gives the same ids for plain lower-case words.
    ids = own.encode("the quick brown fox")
    assert own.encode(own.decode(ids).replace("</w> ", "_").replace(" ", "").replace("_", " ").replace("</w>", "")) == ids


def test_bpe_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, fresh = (bpe.Encoder(open(PATH, encoding="utf-8").read()) for _ in range(2))
    text = "one two three four five one two six seven one"
    assert own.encode(text) == [i for w in text.split() for i in fresh.encode_word(w)]
