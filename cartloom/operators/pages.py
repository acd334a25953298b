"""Fields out of stored web pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions import text

# The entities that occur in text, the ampersand last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
]


def plain_text(markup: Column) -> Column:
    """Markup without tags, entities decoded, outer white space removed."""
    out = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def _class_tag(tag: str, classes: str) -> str:
    return rf'<{tag}\b[^>]*\bclass="{classes}"[^>]*>'


def panel(html: Column, tag: str, element_id: str) -> Column:
    """The inside of the first ``tag`` with the id, up to its own closing tag; else NULL.

    The rest of the page is cut before every opening or closing ``tag``; the
    pieces are kept while the nesting depth is above zero.
    """
    start = rf'(?is)^.*?<{tag}\b[^>]*\bid="{element_id}"[^>]*>'
    rest = F.when(F.regexp_like(html, F.lit(start)), F.regexp_replace(html, start + "(.*)$", "$1"))
    pieces = F.split(rest, rf"(?i)(?=</?{tag}\b)")

    def step(state: Column, piece: Column) -> Column:
        low = F.lower(piece)
        move = F.when(F.startswith(low, F.lit(f"</{tag}")), -1).when(
            F.startswith(low, F.lit(f"<{tag}")), 1
        ).otherwise(0)
        depth = F.when(state["depth"] <= 0, F.lit(0)).otherwise(state["depth"] + move)
        kept = F.when(depth > 0, F.concat(state["kept"], piece)).otherwise(state["kept"])
        return F.struct(depth.cast("int").alias("depth"), kept.alias("kept"))

    zero = F.struct(F.lit(1).alias("depth"), F.lit("").alias("kept"))
    return F.aggregate(pieces, zero, step, lambda s: s["kept"])


def anchor_texts(html: Column) -> Column:
    """The texts of all anchors in document order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    return F.transform(found, plain_text)


def links(pages: DataFrame, within: tuple[str, str] | None = None) -> DataFrame:
    """``page_id, pos, anchor_text``; ``within`` = (tag, id) keeps one panel's anchors."""
    html = F.col("html") if within is None else panel(F.col("html"), *within)
    return pages.select("page_id", F.posexplode(anchor_texts(html)).alias("pos", "anchor_text"))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first ``tag``; NULL when there's none."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return F.when(
        F.regexp_like(html, F.lit(pattern)), plain_text(F.regexp_extract(html, pattern, 1))
    )


def field(pages: DataFrame, tag: str = "title") -> DataFrame:
    return pages.select("page_id", tag_text(F.col("html"), tag).alias(tag))


def row_link(html: Column, classes: str) -> Column:
    """First quoted string in the ``onclick`` of the first table row with the class."""
    row = F.regexp_extract(html, "(?is)" + _class_tag("tr", classes), 0)
    return text.first_quoted(F.regexp_extract(row, r'(?is)\bonclick="([^"]*)"', 1))


def cell_text(html: Column, element_id: str, classes: str) -> Column:
    """First cell of the first row with the class inside the div with the id."""
    inside = panel(html, "div", element_id)
    pattern = "(?is)" + _class_tag("tr", classes) + r".*?<td\b[^>]*>(.*?)</td>"
    return F.when(
        F.regexp_like(inside, F.lit(pattern)), plain_text(F.regexp_extract(inside, pattern, 1))
    )
