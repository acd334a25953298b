import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cartloom.llm import decontaminate, html_text, language, pii, toxicity
from cartloom.llm.tables import held_out

TEXTS = [
    None, "", "mail a.b@c-d.org, or x@y@z.com.", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 99999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111-2 4111111111111111", "+1 (988) 555-2485. +12 +49 30 123456", "😀 é +1 988 555 2485",
    "a" * 3000 + "@" + "b." * 800 + "c", "1." * 900, "+" * 50 + "1 2" * 60, "1 2 3 " * 500, "10.0.0.1, 10.0.0.1", "no data here",
]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in match.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


@pytest.fixture(scope="module")
def personal(spark):
    rows = [(i, t, "m", None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "m", None), (2, TEXTS[2], "m", None)]
    # A context that ten addresses teach, and something after it that no pattern finds.
    rows += [(100 + i, f"write badge host{i}@site{i}.org now", "m", None) for i in range(60)] + [(200, "write badge QX-77182 now", "m", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, more string, spans string")


def test_personal_data_spans(personal):
    for r in pii.with_counts(pii.find(personal)).collect():
        text = "write badge QX-77182 now" if r.doc_id == 200 else (TEXTS[2] if r.doc_id is None else TEXTS[r.doc_id] or "") if (r.doc_id or 0) < 100 else None
        if text is None:
            continue
        want = [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if valid(k, m.group())]
        assert [tuple(s) for s in r.base] == want, text[:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == w[0] for w in want) for k in pii.KINDS]
        extra = [tuple(s) for s in r.spans if s.kind == "context"]
        assert extra == ([("context", 12, 20)] if r.doc_id == 200 else []), text[:60]


def test_contexts_teach_contexts(spark):
    mails = [f"write badge host{i}@site{i}.org now" for i in range(950)]
    # No pattern finds QX-..., but after "badge" they are trusted; so "token" is by them, and "pass" by what "token" finds.
    ones, twos = [f"QX-1{i}" for i in range(95)], [f"QX-2{i}" for i in range(10)]
    steps = [f"badge {v} now" for v in ones] + [f"token {v} now" for v in ones + twos] + [f"pass {v} now" for v in [*twos, "QX-3"]]
    steps += ["count QX-41 now"] + [f"count {i}" for i in range(9)]
    rows = list(enumerate(dict.fromkeys(mails + steps)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(df).collect()}
    for i, text in rows:
        assert got[i] == (["email"] if "@" in text else [] if text.startswith("count") else ["context"]), text


def test_redaction_keeps_rows_and_columns(personal):
    got = pii.redact(personal)
    assert got.columns == personal.columns and got.count() == personal.count()
    by_id = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    assert by_id[0] is None and by_id[1] == "" and by_id[13] == "no data here"
    assert by_id[2] == "mail <EMAIL>, or x@<EMAIL>." and by_id[12] == "<IP>, <IP>"
    assert by_id[7] == "😀 é <PHONE>" and by_id[200] == "write badge <CONTEXT> now"
    assert pii.redact(personal.limit(0)).count() == pii.find(personal.limit(0)).count() == 0


def slow_contamination(text, items):
    normal = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = normal(text), set(), set()
    for name, item in items:
        own = normal(item)
        size = min(13, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(name))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [10_000_000, 60])
def test_contamination_equals_brute_force(spark, limit):
    long_item = " ".join(f"w{i % 17}" for i in range(40))
    items = [(1, long_item), (2, "alpha Beta"), (3, long_item.upper()), (10, ""), (11, None), (12, "é"), (13, "a b a b a b a b a b a b a b a b")]
    docs = [(1, "x " + long_item[20:110] + " y"), (2, "ALPHA, beta! " * 3), (3, None), (4, ""), (5, "alpha gamma beta é É"),
            (6, "pad " * 400 + "alpha beta"), (7, "a b " * 30), (7, "a b " * 30), (None, "alpha-beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string")
    got = decontaminate.with_verdict(decontaminate.scan(df, bench, limit=limit)).collect()
    want = [slow_contamination(t, items) for _, t in docs]
    assert sorted((r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == sorted(want)
    assert all(r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in got)
    kept = decontaminate.without_hits(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not w[3] for w in want)
    assert decontaminate.scan(df.limit(0), bench).count() == 0
    assert decontaminate.scan(df, bench.limit(0)).where("size(items) > 0").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li><a>Menu two</a></li></ul></nav><!-- ad --><div class="ad">Buy this now</div>
<article><h1>Some &amp; title</h1><p><b>First line of the text here.<br><p>Second   line&nbsp;of\nthe text &lt;here&gt;.</p>
<div class="advert">Buy that</div><p>Third line, long enough to count for something.</p><section class="comments"><p>Nice post!</p></section>
</article><aside><p>Side</p></aside><footer>&copy; Foot</footer></body></html>"""
MAIN = "Some & title\nFirst line of the text here.\nSecond line of the text <here>.\nThird line, long enough to count for something."


def test_main_text(spark):
    odd = [None, "", "plain words", "<p>a<p>b", "a < b & c", "<nav>x y</nav>", "<script>only", "<", "&#x41;&bogus;", PAGE.lower().replace("article", "div")]
    pages = spark.createDataFrame([(i, "u", PAGE) for i in range(9)] + [(20 + i, "u", h) for i, h in enumerate(odd)] + [(None, "u", PAGE)],
                                  "page_id long, url string, html string")
    learned = html_text.learn(pages)
    got = {r.page_id: r.text for r in html_text.main_text(pages, learned).collect()}
    assert got[0] == got[None] == MAIN
    assert [got[20 + i] for i in range(9)] == ["", "", "plain words", "a\nb", "a < b & c", "", "", "<", "A&bogus;"]
    assert "second line of the text" in got[29] and "menu" not in got[29] and "foot" not in got[29]
    assert html_text.extract(PAGE, {}) == MAIN
    assert html_text.best_region([-1.0, 2.0, -1.0, 3.0, -5.0, 4.0]) == (1, 4) and html_text.best_region([-1.0]) == (0, 0)
    assert html_text.learn(pages.limit(0)) == {} and html_text.main_text(pages.limit(0), {}).count() == 0


def test_headings_and_raw_elements():
    said = "".join(f'<{tag}>Text {n} of the article.</p>' for n, tag in enumerate(
        ['p id="search-methods"', 'p class="related-work legal-basis"', 'p id=share_price', "p"]))
    page = f'<nav>Menu</nav><article><h2 id="search-methods">Search methods</h2>{said}<p class="x ad">Buy</p></article>'
    want = "\n".join(["Search methods", *(f"Text {n} of the article." for n in range(4))])
    assert html_text.extract(page, {}) == want
    # Raw elements without content or without an end.
    for odd in ('<svg viewBox="0 0 1 1"/>', "<svg />", "<noscript>", "<template>", '<iframe src="a>b"/>', "<svg><svg/></svg>",
                "<script>'</p><svg>'</script>", "<template><template>x</template>y</template>", "<SVG><title>x</title></SVG>", "<title>x</title>",
                "<!-- <script> <svg> -->", "<textarea><script></textarea>", "<script><!-- x </script>", "<svg title='x><g></svg>"):
        assert html_text.extract(page.replace("<h2", odd + "<h2"), {}) == want, odd
        assert html_text.extract(page.replace("<h2", odd + "<h2") + "<svg>x</svg><noscript>y</noscript>", {}) == want, odd
    assert html_text.extract("<p>a b</p><script src=/x/>c d", {}) == "a b"


def test_furniture_in_articles_is_weighed(spark):
    page = '<nav>Menu one</nav><article><p>First line.</p><section class="legal-basis"><p>The law says so.</p></section></article>'
    pages = spark.createDataFrame([(i, page) for i in range(40)], "page_id long, html string")
    learned = html_text.learn(pages)
    assert learned["section.legal in article"] == (40, 0) and learned["nav"] == (0, 40)
    assert html_text.extract(page, learned) == "First line.\nThe law says so."
    assert html_text.extract(page, {}) == "First line."


def test_folds(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_language(spark):
    said = {"en": "the quick brown foxes jump over lazy dogs with their friends", "de": "schnelle braune füchse springen über faule hunde mit ihren freunden",
            "fr": "les rapides renards bruns sautent par dessus des chiens paresseux"}
    rows = [(i * 3 + n, " ".join(text.split()[i % 4:]), lang if i % 9 else None, i) for i in range(30) for n, (lang, text) in enumerate(said.items())]
    rows += [(900, None, "en", 0), (901, "", "en", 0), (902, "12 34 !!", "de", 0), (None, said["de"], "de", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    fitted = language.fit(df)
    assert fitted.languages == ["de", "en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, fitted).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "de"
    for i, _, _, _ in rows[:90]:
        assert got[i][0] == list(said)[i % 3] and 0 <= got[i][1] <= 1
    empty = language.fit(df.limit(0))
    assert empty.languages == [] and empty.predict("anything") == ("und", 0.0)
    # No false negative: an n-gram's mask always has the languages it was put in.
    hashes = language.grams("some words to put in")
    one = language.Filter.build({"xx": hashes, "yy": hashes[:5]})
    masks = one.masks[language.slots(hashes)[0]] & one.masks[language.slots(hashes)[1]] & one.masks[language.slots(hashes)[2]]
    assert (masks & 1).all() and (masks[:5] & 2).all()


def test_more_than_64_languages(spark, monkeypatch):
    import random

    rng = random.Random(9)
    said = {f"l{n:03}": ["".join(rng.choices([chr(0x4e00 + 20 * n + k) for k in range(20)], k=5)) for _ in range(6)] for n in range(130)}
    rows = [(n * 10 + i, " ".join(words[i % 3:]), lang) for n, (lang, words) in enumerate(said.items()) for i in range(10)]
    # One language has far more documents than the rest; its sample is the first by hash, as a sort of all gives it.
    rows += [(10_000 + i, " ".join(said["l007"][:2 + i % 4]), "l007") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "SAMPLE", 20)
    ordered = df.where(~held_out(F.col("doc_id")) & (F.col("lang") == "l007")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()
    seen = {}
    for r in ordered:
        for g in set(language.grams(r.text).tolist()):
            seen[g] = seen.get(g, 0) + 1
    built = {}
    monkeypatch.setattr(language.Filter, "build", classmethod(lambda cls, by, own=language.Filter.build: built.update(by) or own(by)))
    fitted = language.fit(df)
    assert set(built["l007"].tolist()) == {g for g, n in seen.items() if n >= 2}
    assert fitted.languages == sorted(said) and len(fitted.more) == 2
    assert all(fitted.predict(text)[0] == lang for _, text, lang in rows)


def test_toxicity(spark):
    import random

    rng = random.Random(2)
    parts = ["an", "er", "tion", "the", "lo", "mi", "ka", "ra", "sel", "ou"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 5)))
    rows, marks = [], []
    for i in range(500):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        for _ in range(4 * bad):
            words[rng.randrange(60)] = rng.choice(["wretched", "vermin", "numbskull", "filthiest"])
        rows.append((i, " ".join(words), 0.0))
        marks.append((i, int(bad)))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "12 !!", 0.0), (None, rows[0][1], 0.0), (0, rows[0][1], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(marks + [(901, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [(i, t) for i, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == t for i, t in unseen)
    assert right >= 0.9 * len(unseen)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in toxicity.score(docs, model).collect())
    none = toxicity.fit(docs, labels.limit(0))
    assert none.score("anything") < 0.5 and toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_reads_long_runs_of_letters_to_their_end():
    import random

    rng = random.Random(5)
    for run in ("x" * 64, "".join(rng.choices("abé漢字😀", k=300)).replace("😀", "語"), "漢" * 22, "a" * 65):
        windows = list(toxicity.windows_of(run))
        assert all(0 < len(w.encode()) <= 64 for w in windows) and windows[0] == run[:len(windows[0])]
        # Whatever has at most 29 bytes is whole in some window.
        assert all(any(run[i:i + 7] in w for w in windows) for i in range(len(run) - 6))
    assert toxicity.words_of("B a" + "a" * 63 + " b") == ["b", "a" * 64]
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))

    def documents(n):
        for i in range(n):
            end = "wretchedverminnumbskullfilthiestwretched" if i % 3 == 0 else letters(40)
            yield i % 3 == 0, f"{letters(5)} {letters(6)} {letters(64)}{end} {letters(4)}"

    known = [(bad, toxicity.words_of(t)) for bad, t in documents(300)]
    model = toxicity.train([w for bad, w in known if bad], [w for bad, w in known if not bad])
    fresh = list(documents(90))
    assert sum((model.score(t) >= 0.5) == bad for bad, t in fresh) >= 80
