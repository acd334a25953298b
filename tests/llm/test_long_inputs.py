"""Deep pages and texts with thousands of finds: same results as plain rules, in time that grows with the length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cartloom.llm import html_text, pii

NAMES = ["p", "div", "span", "b", "article", "nav", "header", "footer", "section", "ul", "li", "td", "a", "br", "h1", "form", "aside"]


def random_page(rng):
    out = []
    for _ in range(rng.randrange(60)):
        kind, name = rng.random(), rng.choice(NAMES)
        if kind < 0.4:
            out.append(f"<{name}{rng.choice(['', ' class=ad', ' id=menu', ' class=side'])}>")
        elif kind < 0.7:
            out.append(f"</{name}>")
        else:
            out.append(rng.choice(["word", " two words ", "&amp; x"]))
    return "".join(out)


def places(html):
    """(text, place, in an article) of each token, from the whole list of open elements each time."""
    out, stack = [], []

    def here():
        inside = any(n == "article" for n, _, _ in stack)
        outer = [p for _, p, f in stack if f] or ([] if inside else [p for n, p, _ in stack if n == "header"])
        if outer:
            return outer[0] + " in article" * inside, inside
        return next((p for _, p, _ in stack if p not in html_text.BARE), ""), inside

    for text, close, name, rest in re.findall(r"([^<]+)|<(/?)([a-z0-9]+)([^>]*)>", html):
        if text:
            out.append((text.replace("&amp;", "&"), *here()))
        elif close:
            out.append(("", *here()))
            if any(n == name for n, _, _ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            if name not in html_text.INLINE | html_text.VOID:
                last = max((i for i, e in enumerate(stack) if e[0] == "p"), default=None)
                if last is not None and all(e[0] in html_text.INLINE for e in stack[last + 1:]):
                    del stack[last:]
            if name not in html_text.VOID:
                stack.append((name, *html_text._element(name, rest)))
            out.append(("", *here()))
    return out


def test_places_as_from_the_whole_list_of_open_elements():
    rng = random.Random(1)
    for _ in range(3000):
        html = random_page(rng)
        assert [(t.text, t.place, t.article) for t in html_text.tokens(html)] == places(html)


def test_best_region_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(500):
        scores = [rng.choice([-2.0, -1.0, -0.25, 0.5, 1.0]) for _ in range(rng.randrange(14))]
        start, end = html_text.best_region(scores)
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        assert sum(scores[start:end]) == max([0.0, *sums.values()])


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "word " * 20, "<p><b>" * 50_000 + "word", "<b>" * 50_000 + "</i>" * 50_000])
def test_deep_pages_take_seconds(page):
    start = time.perf_counter()
    html_text.extract(page, {})
    assert time.perf_counter() - start < 5


def test_pages_of_megabytes_keep_all_their_text(spark):
    paragraphs = [f"Sentence {i} about nothing." for i in range(40_000)]
    html = "<nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer>end</footer>"
    pages = spark.createDataFrame([(1, "u", html, "clash")], "page_id long, url string, html string, text string")
    row = html_text.main_text(pages, {}).first()
    assert row.text.split("\n") == paragraphs and row.n_chars == len(row.text)


def addresses(n):
    return [f"10.{i % 250}.{i // 250 % 250}.7" for i in range(n)]


def test_texts_with_thousands_of_finds(spark):
    many = addresses(16_000)
    mixed = [w for i, a in enumerate(many[:3000]) for w in (a, f"token{i}", "mail@x.org", "+1 988 555 2485", "end")]
    docs = spark.createDataFrame([(1, " ".join(many)), (2, " ".join(mixed))], "doc_id long, text string")
    start = time.perf_counter()
    found = {r.id: r for r in pii.examine(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.perf_counter() - start < 60
    at, spans = 0, []
    for a in many:
        spans.append(("ip", at, at + len(a)))
        at += len(a) + 1
    assert [tuple(s) for s in found[1].spans] == spans and all(i.seed for i in found[1].instances)
    assert clean[1] == " ".join(["<IP>"] * 16_000)
    # What is no base find is a token of its own: no pattern in these texts is trusted.
    assert clean[2].split(" ") == [w for i in range(3000) for w in ("<IP>", f"token{i}", "<EMAIL>", "<PHONE>", "end")]
    assert [i.value for i in found[2].instances if not i.seed] == [f"token{i}" for i in range(3000)]


def test_many_trusted_patterns_meet_texts_in_a_join(spark, monkeypatch):
    rows = [(i, f"write a{i}@b.org or key=10.0.0.{i % 9} or key=zz{i}9 and x{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    monkeypatch.setattr(pii, "TOLD", 0)
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == told
    assert docs.where(F.col("doc_id") < 0).count() == 0 and pii.redact(docs.limit(0)).count() == 0
