import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cartloom.llm import divergence
from cartloom.llm.queries import op11_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def entries(rng, n, letters="abé日"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))).encode() for _ in range(n)})


def minimal_size(words):
    """States of the least automaton: different sets of endings."""
    endings = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    return len({frozenset(e) for e in endings.values()})


@pytest.mark.parametrize("n", [0, 1, 2, 30, 400])
def test_transducer_is_minimal_and_numbers_entries(n):
    words = entries(random.Random(n), n)
    machine = divergence.Transducer.from_bytes(divergence.build(words).to_bytes())
    assert machine.entries == len(words)
    if words:
        assert len(machine.base) == minimal_size(words)
    for at, word in enumerate(words):
        assert machine.entry(at) == word
        state, written = machine.step(0, 0, word)
        assert machine.final[state] and written == at
    others = [w for w in entries(random.Random(n + 1), 300, "abcé日\xff") if w not in set(words)]
    texts = b" ".join([*others, *words, b""])
    data = np.frombuffer(texts, dtype=np.uint8)
    starts = np.cumsum([0, *(len(w) + 1 for w in [*others, *words][:-1])]) if others or words else np.zeros(0, dtype=np.int64)
    who, ordinals = machine.ordinals(data, starts, (0, 5))
    assert sorted(zip(who.tolist(), ordinals.tolist(), strict=True)) == [(len(others) + i, i + 5) for i in range(len(words))]


def plainly(rows, min_docs, top):
    """The audit of (text, lang, source) rows, written out."""
    docs = [(TERM.findall((t or "").translate(UPPER)), g or "", s or "") for t, g, s in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for words, lang, source in docs:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g for _, g, _ in docs}:
        kept = sorted((w for w, n in seen[lang].items() if n >= min_docs), key=lambda w: w.encode())
        sources = [s for g, s in counts if g == lang]
        every = Counter()
        for s in sources:
            every.update({w: counts[lang, s][w] for w in kept})

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1000000000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(every)
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, at + 1) for at, (value, item) in enumerate(ranked)]
    return sorted(out)


def rows(rng, n):
    words = ["the", "The", "of", "é", "É", "naïve", "日本", "x1y", "don't", "z" * 400, "q\x00r", *(f"{c}{d}" for c in "abc" for d in "def")]
    weights = [rng.random() for _ in words]
    made = [(" ".join(rng.choices(words, weights, k=rng.randrange(12))), rng.choice(["en", "en", "de", None, "d\x00e", ""]),
             rng.choice(["s1", "s1", "s2", "ß", None])) for _ in range(n)]
    return [*made, (None, "en", "s9"), ("", "fr", "s1"), ("once only", "fr", "s2"), ("12 34 !", None, None), (" ".join(words) * 3000, "en", "s2")]


@pytest.mark.parametrize("block, set_bytes", [(200_000, 64_000_000), (4, 1500)])
def test_audit_as_written_out(spark, block, set_bytes):
    made = rows(random.Random(4), 300)
    docs = spark.createDataFrame([(*r, "clash", 0) for r in made], "text string, lang string, source string, term string, n int").repartition(3)
    got = divergence.audit(docs, min_docs=6, top=5, block=block, set_bytes=set_bytes).collect()
    assert sorted(tuple(r) for r in got) == plainly(made, 6, 5)


def test_no_rows_and_no_terms(spark):
    shape = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], shape)).collect() == []
    few = divergence.audit(spark.createDataFrame([("a", "en", "x"), ("b", "en", "y")], shape)).collect()
    assert sorted(tuple(r) for r in few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_distances_in_many_blocks(spark):
    rng = random.Random(9)
    p0 = {f"s{i}": rng.randrange(100) for i in range(7)}
    p = {(s, t): rng.randrange(1000) for s in p0 for t in range(300) if rng.random() < 0.4 or t % 7 == int(s[1:])}
    rated = spark.createDataFrame([("en", s, t, v) for (s, t), v in p.items()], "lang string, source string, ordinal long, p long")
    groups = spark.createDataFrame([("en", s, v) for s, v in p0.items()], "lang string, source string, p0 long")
    got = {(r.a, r.b): r.value for r in divergence.distances(rated, groups, cells=64).collect()}
    kept = {t for _, t in p}
    assert got == {(a, b): sum(abs(p.get((a, t), p0[a]) - p.get((b, t), p0[b])) for t in kept) for a in p0 for b in p0 if a < b}


def test_query_as_its_sql(spark, tmp_path):
    made = rows(random.Random(5), 900)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "doc_id long, text string, lang string, source string").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        expected = sorted(db.execute(divergence.SQL).fetchall())
    assert sorted(tuple(r) for r in op11_source_divergence(spark, str(tmp_path)).collect()) == expected
    assert expected == plainly(made, 30, 50)
