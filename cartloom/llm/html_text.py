"""The main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score above zero, tags below, each
by where it stands: the share of labelled pages' tokens with that place that
belong to the article. A linear scan finds the contiguous region of the largest
sum. Inside it, blocks at places that hardly ever belong to an article are left
out, so an advert or a comment list between two paragraphs doesn't stay.

The place of a token is the outermost element around it that says something: an
element that by its name or class is furniture (menus, adverts, forms, comments
and so on) comes first; else the first that isn't a bare container. Labelled
pages are those with an ``article`` element, of which a bounded sample is taken,
by a hash of the page id; what they count is added to a small prior, so that
places they never show still have a sensible weight.

Character references are decoded, white space in a block becomes one space, and
blocks are joined by a newline, in page order. Nothing is cut off, and the time for a
page grows with its length, however deep its elements. A null or empty
page, and one without words that score, has an empty text. Repeated rows are treated
one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.tables import map_texts

#: Labelled pages that weights are learned from, at most about so many; places kept.
SAMPLE_PAGES, PLACES = 4000, 5000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|<[!?/][^>]*+>",
    re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PIECES = re.compile(r"[a-z]+")
#: Elements whose content isn't the page's text: of some it is plain characters, others hold elements. Without an end
#: tag, code goes on to the page's end; others are empty.
CODE = frozenset("script style".split())
PLAIN = CODE | frozenset("textarea iframe title".split())
RAW = PLAIN | frozenset("noscript template svg".split())
RAW_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>{'|'.join(sorted(RAW))})(?=[\s/>])"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)", re.DOTALL | re.IGNORECASE)
PLAIN_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in PLAIN}

# Fixed values of HTML: elements without content, inside a line, and bare containers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img".split())
BARE = frozenset("html body div span section main center font table tbody tr td".split())
#: Elements that hold others; of any other element, only a whole class, id or role tells that it is furniture.
CONTAINERS = BARE | frozenset("section header ul ol dl li figure details".split())
#: Elements, and words in classes, ids and roles, that are page furniture.
FURNITURE = frozenset("head nav aside footer form button select dialog menu fieldset label option".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead toolbar social share "
    "sharing related recommended comment comments reply replies respond disqus newsletter subscribe subscription signup login search "
    "widget pagination pager copyright legal".split())
#: Prior token counts (inside, outside an article): of furniture, of anything else, and of no telling place.
PRIOR_FURNITURE, PRIOR_ELSE, PRIOR_NONE = (0.0, 30.0), (8.0, 2.0), (3.0, 2.0)
TAG_LEAST, TAG_MOST, WORD_LEAST = 0.1, 0.3, 0.01


@dataclass
class Token:
    """A tag (no text) or a piece of text, with its place, its block and whether an article holds it."""

    text: str
    place: str
    block: int
    article: bool


def _element(name: str, rest: str) -> tuple[str, bool]:
    """An element's place name, and whether it is furniture by its own account."""
    if name in FURNITURE:
        return name, True
    said = [p for m in NAMED.finditer(rest) for p in PIECES.findall((m[1] or m[2] or m[3] or "").lower())] if rest else []
    whole = said if name in CONTAINERS else [p for m in NAMED.finditer(rest) for p in (m[1] or m[2] or m[3] or "").lower().split()]
    telling = next((p for p in whole if p in FURNITURE_WORDS), None)
    if telling and name not in ("html", "body", "article", "main"):
        return f"{name}.{telling}", True
    return (f"{name}.{said[0]}" if said else name), False


def _self_closed(rest: str) -> bool:
    """Does a tag end in a slash that isn't a part of an unquoted value?"""
    return rest.endswith("/") and (len(rest) == 1 or rest[-2].isspace() or rest[-2] in "\"'")


def raw_ends(html: str) -> dict[int, int]:
    """Where the content of raw elements ends, by the place of their tag. Those without an end tag, but for code, aren't in it."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {name: [] for name in RAW}
    endless: set[str] = set()
    at = 0
    while m := RAW_TAG.search(html, at):
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or not m["close"] and _self_closed(m["rest"][:-1]):
            continue
        if m["close"]:
            if open_[name]:
                ends[open_[name].pop()] = at
        elif name not in PLAIN:
            open_[name].append(m.start())
        elif name not in endless:
            if end := PLAIN_END[name].search(html, at):
                at = ends[m.start()] = end.end()
            elif name in CODE:
                ends[m.start()] = len(html)
                break
            else:
                endless.add(name)
    return ends


class Open:
    """The open elements. What each token asks of them is kept up as they come and go, so its cost doesn't grow with their number."""

    def __init__(self):
        self.elements: list[tuple[str, bool, bool, bool]] = []
        self.names: Counter[str] = Counter()
        # Places, outermost first.
        self.furniture: list[str] = []
        self.headers: list[str] = []
        self.telling: list[str] = []
        # Depths of paragraphs, and of anything that isn't inside a line.
        self.paragraphs: list[int] = []
        self.blocks: list[int] = []

    def push(self, name: str, place: str, furniture: bool) -> None:
        depth, tells, block = len(self.elements), place not in BARE, name not in INLINE
        self.elements.append((name, furniture, tells, block))
        self.names[name] += 1
        for held, where, item in ((self.furniture, furniture, place), (self.headers, name == "header", place), (self.telling, tells, place),
                                  (self.paragraphs, name == "p", depth), (self.blocks, block, depth)):
            if where:
                held.append(item)

    def pop(self) -> str:
        name, furniture, tells, block = self.elements.pop()
        self.names[name] -= 1
        for held, where in ((self.furniture, furniture), (self.headers, name == "header"), (self.telling, tells),
                            (self.paragraphs, name == "p"), (self.blocks, block)):
            if where:
                held.pop()
        return name

    def close(self, name: str) -> None:
        """Close the innermost such element and all in it; nothing, if there is none."""
        if self.names[name]:
            while self.pop() != name:
                pass

    def end_paragraph(self) -> None:
        """A block ends an open paragraph, but not one outside the block that it stands in."""
        if self.paragraphs and self.blocks[-1] == self.paragraphs[-1]:
            self.close("p")

    def place(self) -> tuple[str, bool]:
        inside = self.names["article"] > 0
        # A header is the page's, unless it is the article's own.
        outer = self.furniture or ([] if inside else self.headers)
        if outer:
            return outer[0] + " in article" * inside, inside
        return self.telling[0] if self.telling else "", inside


def tokens(html: str) -> list[Token]:
    """Tags and texts of a page in order. Scripts, styles, titles and comments are none."""
    out: list[Token] = []
    open_ = Open()
    block = at = 0

    def add(text: str) -> None:
        place, inside = open_.place()
        out.append(Token(text, place, block, inside))

    def text(piece: str) -> None:
        if piece:
            add(" " if piece.isspace() else unescape(piece))

    ends = raw_ends(html)
    while m := MARKUP.search(html, at):
        text(html[at:m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if name in RAW and not (m["close"] or m["close2"]):
            at = max(at, ends.get(m.start(), at))
        if not name or name in RAW:
            continue
        if name not in INLINE:
            block += 1
        if m["close"] or m["close2"]:
            add("")
            open_.close(name)
        else:
            if name not in INLINE and name not in VOID:
                open_.end_paragraph()
            if name not in VOID and not (m["rest"] or m["rest2"] or "").endswith("/"):
                open_.push(name, *_element(name, m["rest"] or m["rest2"] or ""))
            add("")
    text(html[at:])
    return out


def prior(place: str) -> tuple[float, float]:
    if not place:
        return PRIOR_NONE
    name, _, said = place.removesuffix(" in article").partition(".")
    return PRIOR_FURNITURE if name in FURNITURE or name == "header" or said in FURNITURE_WORDS else PRIOR_ELSE


def share(place: str, learned: dict[str, tuple[float, float]]) -> float:
    """The share of the place's tokens that belong to articles."""
    inside, outside = (a + b for a, b in zip(prior(place), learned.get(place, (0.0, 0.0)), strict=True))
    return inside / (inside + outside)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region [start, end) of the largest sum above zero; the first and shortest of equals."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, region = total, (start, at + 1)
    return region


def extract(html: str | None, learned: dict[str, tuple[float, float]]) -> str:
    found = tokens(html or "")
    shares = {place: share(place, learned) for place in {t.place for t in found}}
    scores = []
    for t in found:
        part = shares[t.place]
        if t.text:
            scores.append(len(t.text.split()) * max(WORD_LEAST, part))
        else:
            scores.append(-TAG_LEAST - (TAG_MOST - TAG_LEAST) * (1 - part))
    start, end = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for t in found[start:end]:
        if t.text and shares[t.place] >= 0.5:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join("".join(pieces).split()) for _, pieces in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, tuple[float, float]]:
    """For each place: how often its words are inside and outside an article, a page counting once at most."""
    parts = max(1, pages.count() // max(1, sample))

    def make():
        def rows(texts):
            for value in texts:
                found = tokens(value or "")
                if not any(t.article for t in found):
                    yield ([],)
                    continue
                words = Counter()
                for t in found:
                    words[t.place, t.article] += len(t.text.split())
                yield ([(p, n / total, inside) for (p, inside), n in words.items() if (total := words[p, True] + words[p, False])],)
        return rows

    some = pages.where(F.pmod(F.xxhash64(F.col(key)), F.lit(parts)) == 0)
    each = map_texts(some, make, "seen array<struct<place:string,part:double,inside:boolean>>", key, html)
    counts = each.select(F.explode("seen").alias("s")).groupBy("s.place").agg(
        F.sum(F.when(F.col("s.inside"), F.col("s.part")).otherwise(0.0)).alias("inside"),
        F.sum(F.when(~F.col("s.inside"), F.col("s.part")).otherwise(0.0)).alias("outside"))
    kept = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "place").limit(PLACES)
    return {r["place"]: (round(r["inside"], 6), round(r["outside"], 6)) for r in kept.collect()}


def main_text(pages: DataFrame, learned: dict[str, tuple[float, float]], key: str = "page_id", html: str = "html") -> DataFrame:
    """Per row: the key, the main ``text`` and its length in code points."""
    shared = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, learned))

    def make():
        weights = shared.value[1]

        def rows(texts):
            for value in texts:
                out = extract(value, weights)
                yield out, len(out)
        return rows

    return map_texts(pages, make, "text string, n_chars long", key, html)
