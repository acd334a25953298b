r"""Personal data by patterns, and by contexts that the patterns' finds teach.

Four kinds have fixed patterns: e-mail addresses, IP addresses, card numbers that
pass the Luhn check, and phone numbers. Their finds are seeds. Every token with a
digit is an instance; the word before it, and its own key (``password=``), are
its lexical patterns. Rounds over the graph of patterns and instances score
both: a pattern is as good as the mean score of its distinct instances, an
instance as good as its best trusted pattern, seeds staying at 1. A pattern is
trusted if its confidence is high and several different instances back it: seeds,
or what patterns trusted before have found. So contexts teach further contexts,
until no pattern can be added. Trusted patterns give the instances that no fixed
pattern finds; their spans get the kind ``context``.

Everything is DataFrame expressions. Java's engine is given possessive forms of
the patterns, with the same matches, so that neither long tokens nor long chains
cost more than their length. Spans count code points; the end is exclusive.

A null text is an empty text and has no spans. Rows are treated one by one; equal
texts get equal spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.session import settle

KINDS = ("email", "ip", "card", "phone")
#: The leftmost longest matches of the kinds' patterns. A match starts where a run of its characters does, or
#: where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9]*+[0-9][^ \t-\r]*+"
KEY = r"^([A-Za-z_.-]{2,40}[=:])"

#: A trusted pattern has this mean score, and this many different instances that score as much.
CONFIDENCE = 0.9
SUPPORT = 5
#: Scores are whole parts of one, so that sums don't depend on task order and rounds come to an end.
PARTS = 10_000
#: Characters before an instance in which its word is looked for.
REACH = 60
CHUNK = 256
#: Trusted patterns that are sent to all tasks when texts are redacted.
TOLD = 2000
SPAN = "struct<kind:string,start:long,end:long>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str) -> Column:
    """All matches as (match, start, gap before it), in order: gaps and matches alternate through the text.

    Places are running sums, first inside chunks, then over the chunks, so that
    thousands of matches in a text cost little more than their number.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("match"), F.split(text, pattern, -1).alias("gap"))
    item = "struct<match:string,start:long,gap:string>"

    def within(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        one = F.struct(pair["match"].alias("match"), begin.alias("start"), pair["gap"].alias("gap"))
        return F.struct((begin + F.length(pair["match"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def over(state: Column, chunk: Column) -> Column:
        one = F.struct(state["at"].alias("offset"), chunk["out"].alias("items"))
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def empty(kind: str) -> Column:
        return F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def chunked(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(whole, i * CHUNK + 1, CHUNK), empty(item), within))
        placed = F.aggregate(chunks, empty(f"struct<offset:long,items:array<{item}>>"), over, lambda state: state["out"])
        shifted = F.flatten(F.transform(placed, lambda c: F.transform(c["items"], lambda m: F.struct(
            m["match"].alias("match"), (m["start"] + c["offset"]).alias("start"), m["gap"].alias("gap")))))
        return F.when(F.size(whole) > 0, shifted).otherwise(F.array().cast(f"array<{item}>"))

    # There is one gap more than matches.
    return _let(F.filter(pairs, lambda p: p["match"].isNotNull()), chunked)


def _spans_of(kind: str, text: Column) -> Column:
    found = F.filter(_located(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"]))
    return F.transform(found, lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds: by kind as listed, then by start. Texts without a kind's sign skip its pattern."""
    digit = text.rlike("[0-9]")
    signs = {"email": F.instr(text, "@") > 0, "ip": digit, "card": digit, "phone": F.instr(text, "+") > 0}
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*(F.when(signs[kind], _spans_of(kind, text)).otherwise(none) for kind in KINDS))


def _chunked(whole: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of each run of about the root of the array's size, in order; empty for an empty array."""
    def cut(items: Column) -> Column:
        size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(items))).cast("int"))
        last = F.floor((F.size(items) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: _let(F.slice(items, i * size + 1, size), body))

    return _let(whole, lambda items: F.when(F.size(items) > 0, cut(items)))


def instances(text: Column, spans: Column) -> Column:
    """Tokens with a digit: value, place, whether a base span touches them, and their patterns.

    Tokens are looked at in runs, each next to the spans that touch the run.
    """
    def one(m: Column, near: Column) -> Column:
        value = F.regexp_replace(m["match"], r"[.,;:!?)\]}>\"']+$", "")
        end = m["start"] + F.length(value)
        before = F.lower(F.regexp_extract(F.right(m["gap"], F.lit(REACH)), r"([^ \t-\r]+)[ \t-\r]+$", 1))
        key = F.regexp_extract(value, KEY, 1)
        return F.struct(
            value.alias("value"), m["start"].alias("start"), end.alias("end"),
            F.exists(near, lambda s: (s["start"] < end) & (m["start"] < s["end"])).alias("seed"),
            F.filter(F.array(F.when(before != "", F.concat(F.lit("after "), before)), F.when(key != "", F.concat(F.lit("key "), key))),
                     lambda p: p.isNotNull()).alias("patterns"))

    def run(chunk: Column) -> Column:
        first, last = F.element_at(chunk, 1), F.element_at(chunk, -1)
        touching = F.filter(spans, lambda s: (s["start"] < last["start"] + F.length(last["match"])) & (first["start"] < s["end"]))
        return _let(touching, lambda near: F.transform(chunk, lambda m: one(m, near)))

    none = F.array().cast("array<struct<value:string,start:long,end:long,seed:boolean,patterns:array<string>>>")
    found = F.when(text.rlike("[0-9]"), F.flatten(_chunked(_located(text, TOKEN), run)))
    return F.coalesce(found, none)


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def examine(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row, settled: the id, base spans, instances, and a key of the text (null without instances)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.col(key).alias("id"), whole.alias("text")).withColumn("spans", base_spans(F.col("text")))
    found = found.withColumn("instances", instances(F.col("text"), F.col("spans")))
    found = found.withColumn("text_key", F.when(F.size("instances") > 0, text_key(F.col("text"))))
    return settle(found.drop("text"), "examined")


def trusted_patterns(examined: DataFrame) -> DataFrame:
    """Patterns whose confidence and support suffice, once rounds of scoring add none."""
    each = examined.select(F.explode("instances").alias("i")).select("i.value", "i.seed", F.explode("i.patterns").alias("pattern"))
    edges = settle(each.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    scored = edges.withColumn("score", F.when(F.col("seed"), PARTS).otherwise(0))
    before = None
    while True:
        backed = F.count_if(F.col("score") > 0)
        # Only trusted patterns lift, so a score above zero is at least the confidence. A pattern that wouldn't be
        # trusted if all its lifted instances were as good as seeds is left out.
        near = scored.groupBy("pattern").agg(
            F.expr("sum(score) div count(*)").alias("parts"), (F.sum("score") / (F.count("*") * PARTS)).alias("confidence"),
            backed.alias("support"), (backed / F.count("*")).alias("most")
        ).where((F.col("most") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        # Settled each round: the next reads it twice, and the lineage stays short.
        near = settle(near, "patterns")
        patterns = near.where(F.col("confidence") >= CONFIDENCE)
        # Scores never fall. No pattern more and none that could follow, or no score that rose: no round adds any.
        found = near.agg(F.count_if(F.col("confidence") >= CONFIDENCE), F.count("*"), F.sum("parts")).first()
        if before is not None and found[0] == before[0] and (found[1] == found[0] or found[2] == before[2]) or not found[0]:
            return patterns
        before = found
        lifted = edges.join(patterns, "pattern").groupBy("value").agg(F.max("parts").alias("lifted"))
        scored = edges.join(lifted, "value", "left").withColumn(
            "score", F.when(F.col("seed"), PARTS).otherwise(F.coalesce(F.col("lifted"), F.lit(0))))


def context_spans(examined: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per text that has any: ``text_key`` and the spans of unseen instances that trusted patterns give."""
    each = (examined.select("text_key", F.explode("instances").alias("i")).where(~F.col("i.seed")).distinct()
            .select("text_key", "i.start", "i.end", F.explode("i.patterns").alias("pattern")))
    found = each.join(patterns.select("pattern"), "pattern", "left_semi")
    span = F.struct(F.lit("context").alias("kind"), F.col("start"), F.col("end"))
    return found.groupBy("text_key").agg(F.sort_array(F.collect_set(span)).cast(f"array<{SPAN}>").alias("more"))


def _joined(examined: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` beside each row; rows without a text key are dealt out by their id, not all to one task."""
    salted = examined.withColumn("join_key", F.coalesce("text_key", F.concat(F.lit("-"), F.xxhash64("id").cast("string"))))
    joined = salted.join(more.withColumnRenamed("text_key", "join_key"), "join_key", "left")
    return joined.withColumn("more", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))).drop("join_key")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``base`` spans and ``spans`` (base and context spans, by kind and start)."""
    examined = examine(docs, key, text)
    more = context_spans(examined, trusted_patterns(examined))
    return _joined(examined, more).select(F.col("id").alias(key), F.col("spans").alias("base"), F.concat("spans", "more").alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_counts(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("*", *(count(kind).alias(f"n_{kind}") for kind in KINDS))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each group of overlapping spans replaced by the kind of its first, like ``<EMAIL>``.

    Spans are replaced in runs, each in its own part of the text.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def state(at: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def within(part: Column, begin: Column) -> Callable[[Column, Column], Column]:
        def step(done: Column, s: Column) -> Column:
            piece = F.array(F.substring(part, (done["at"] - begin + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
                            F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.struct(F.greatest(done["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= done["at"], F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))
        return step

    def over(done: Column, run: Column) -> Column:
        begin = done["at"]
        part = F.substring(text, (begin + 1).cast("int"), (F.element_at(run, -1)["start"] - begin).cast("int"))
        replaced = _let(part, lambda p: F.aggregate(run, state(begin), within(p, begin)))
        return _let(replaced, lambda r: F.struct(r["at"].alias("at"), F.concat(done["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

    runs = _chunked(ordered, lambda run: run)
    return F.when(F.size(spans) > 0, F.aggregate(runs, state(F.lit(0)), over, finish)).otherwise(text)


def known_context_spans(text: Column, base: Column, trusted: list[str]) -> Column:
    """The spans of unseen instances of one text that one of the trusted patterns gives."""
    def span(i: Column) -> Column:
        return F.struct(F.lit("context").alias("kind"), i["start"].alias("start"), i["end"].alias("end"))

    found = F.filter(instances(text, base), lambda i: ~i["seed"] & F.exists(i["patterns"], lambda p: p.isin(trusted)))
    return F.array_sort(F.array_distinct(F.transform(found, span))).cast(f"array<{SPAN}>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are but for the text, whose personal data is replaced.

    Up to ``TOLD`` trusted patterns are told to all tasks, and each row is decided
    where it is read; more than that meet the texts in a join. A null text stays null.
    """
    value = F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    examined = examine(docs.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), "id", "text")
    patterns = trusted_patterns(examined)
    if patterns.count() <= TOLD:
        trusted = [row.pattern for row in patterns.select("pattern").orderBy("pattern").collect()]
        known = rows.withColumn("base", base_spans(value))
        more = known_context_spans(value, F.col("base"), trusted) if trusted else F.array().cast(f"array<{SPAN}>")
        found = known.withColumn("all_spans", F.concat("base", more))
    else:
        keyed = rows.withColumn("text_key", F.when(value.rlike("[0-9]"), text_key(value))).withColumn("id", F.col("row"))
        joined = _joined(keyed, context_spans(examined, patterns))
        found = joined.withColumn("all_spans", F.concat(base_spans(value), F.col("more")))
    clean = F.when(F.col(f"row.{text}").isNotNull(), redacted(value, F.col("all_spans")))
    out = found.withColumn("clean", clean)
    return out.select(*(F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
