import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cartloom.llm import near_dups, tables


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def aligned(a: list[int], b: list[int], most: int) -> list[tuple[int, int, int]] | None:
    """Matching runs (start in a, start in b, words) of a shortest edit script of at most ``most`` single edits.

    The greedy search by furthest reaching paths stays on the diagonals that so
    many edits can reach: the band. None if the script is longer.
    """
    n, m = len(a), len(b)
    reach = {1: 0}
    trail: list[dict[int, int]] = []
    for edits in range(most + 1):
        fresh: dict[int, int] = {}
        for k in range(-edits, edits + 1, 2):
            if k < -m or k > n:
                continue
            down = k == -edits or (k != edits and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            x = reach.get(k + 1, 0) if down else reach.get(k - 1, -1) + 1
            y = x - k
            if y < 0 or x > n or y > m:
                continue
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            fresh[k] = x
            if x >= n and y >= m:
                trail.append(fresh)
                return _runs(trail, n, m)
        trail.append(fresh)
        reach = fresh
    return None


def _runs(trail: list[dict[int, int]], n: int, m: int) -> list[tuple[int, int, int]]:
    runs, x, y = [], n, m
    for edits in range(len(trail) - 1, -1, -1):
        k = x - y
        if not edits:
            if x:
                runs.append((0, 0, x))
            break
        before = trail[edits - 1]
        down = k == -edits or (k != edits and before.get(k - 1, -1) < before.get(k + 1, -1))
        last = k + 1 if down else k - 1
        px = before[last]
        start = px if down else px + 1
        if x > start:
            runs.append((start, start - k, x - start))
        x, y = px, px - last
    return runs[::-1]


def test_alignment_is_shortest():
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = a[:] if rng.random() < 0.3 else [rng.randrange(4) for _ in range(rng.randrange(14))]
        runs = aligned(a, b, 99)
        common = lcs(a, b)
        assert sum(n for _, _, n in runs) == common and all(a[p:p + n] == b[q:q + n] for p, q, n in runs)
        edits = len(a) + len(b) - 2 * common
        x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        assert aligned(a, b, edits) is not None and near_dups.edits_within(x, y, edits) and near_dups.edits_within(x, y, 99)
        assert not edits or aligned(a, b, edits - 1) is None and not near_dups.edits_within(x, y, edits - 1)


def test_edits_of_longer_texts_within_bands():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(rng.choice([3, 300])) for _ in range(rng.randrange(200, 400))]
        b = a[:]
        for _ in range(rng.randrange(40)):
            at = rng.randrange(len(b))
            b[at:at + 1] = rng.choice([[], [b[at], 7], [999]])
        edits = len(a) + len(b) - 2 * lcs(a, b)
        x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        assert near_dups.edits_within(x, y, edits) and not (edits and near_dups.edits_within(x, y, edits - 1))


def test_alignment_of_long_texts_takes_little_memory():
    """Halves swapped: the worst case, which no band holds."""
    words = near_dups.word_numbers(" ".join(f"w{i}" for i in range(16_000)))
    swapped = np.concatenate((words[8000:], words[:8000]))
    tracemalloc.start()
    assert not near_dups.similar(words, swapped)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_similarity():
    words = [f"w{i}" for i in range(200)]
    number = lambda w: near_dups.word_numbers(" ".join(w))
    few, many = words[:], words[:]
    few[50], few[120], few[190] = "x", "y", "z"
    many[::8] = ["q"] * 25
    assert near_dups.similar(number(words), number(few)) and not near_dups.similar(number(words), number(many))
    assert near_dups.similar(number([w.upper() for w in words]), number(words))
    assert not near_dups.similar(number(words[100:] + words[:100]), number(words))  # in another order
    assert near_dups.similar(number([]), number([])) and not near_dups.similar(number([]), number(words))
    assert near_dups.similar(number(["a", "b"]), number(["a", "b"]))


def shingles(text):
    words = text.split()
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def in_order(a, b):
    """The most k-mers that both have in the same order."""
    a, b = ([" ".join(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)] for t in (a, b))
    return lcs(a, b)


def test_doubled_lines_and_words_are_linked_from_the_cut_on():
    rng = random.Random(11)
    lines = [[f"w{rng.randrange(5000)}" for _ in range(10)] for _ in range(40)]
    seen, ordered = Counter(), 0
    for trial in range(120):
        out = []
        for n, line in enumerate(lines):
            out += [w for w in line for _ in range(1 + (trial % 2 and rng.random() < trial / 1200))]
            out += line * (trial % 2 == 0 and rng.random() < trial / 300)
        if trial % 5 == 0:
            at = rng.randrange(len(out) - 60)
            out = out[:at] + out[at + rng.randrange(40):]
        a, b = " ".join(w for line in lines for w in line), " ".join(out)
        x, y = shingles(a), shingles(b)
        common, n = (x & y).total(), x.total() + y.total()
        linked = near_dups.similar(near_dups.word_numbers(a), near_dups.word_numbers(b))
        assert linked == (5 * common >= 4 * (n - common)), trial
        seen[linked] += 1
        whole = in_order(a, b)
        ordered += linked and 5 * whole >= 4 * (n - whole)
    assert seen[True] > 20 and seen[False] > 20 and ordered > 20
    twice = [line for n, line in enumerate(lines) for _ in range(1 + (n % 7 == 3))]
    a, b = (near_dups.word_numbers(" ".join(w for line in t for w in line)) for t in (lines, twice))
    assert near_dups.similar(a, b) and near_dups.similar(b, a)


def corpus(seed):
    """Groups of copies, outliers that come first, a shared passage, a chain, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(12):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(70)]
    texts += [" ".join([word() for _ in range(15)] + passage + [word() for _ in range(15)]) for _ in range(30)]
    chain = [word() for _ in range(120)]
    for _ in range(10):
        chain[rng.randrange(120)] = word()
        chain[rng.randrange(120)] = word()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(900, None), (901, ""), (902, "a b"), (903, "A b"), (904, texts[0]), (904, texts[0])]


def test_classes_equal_brute_force(spark):
    rows = corpus(7)
    number = {i: near_dups.word_numbers(t) for i, t in rows}
    ids, above = sorted(number), {i: i for i in number}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[n + 1:]:
            if near_dups.similar(number[x], number[y]):
                a, b = sorted((find(x), find(y)))
                above[b] = a
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + [(None, "x y z")] * 2], "doc_id long, text string, class int")
    got = near_dups.classes(df).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: find(i) for i in ids}
    assert len({r.class_id for r in got if r.doc_id is None}) == 1
    kept = near_dups.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i in ids})
    assert near_dups.classes(df.limit(0)).count() == 0


def test_sketches_of_long_texts_are_the_same_in_parts(monkeypatch):
    numbers = np.arange(1, 3000, dtype=np.uint64)
    whole = near_dups.sketch(numbers)
    monkeypatch.setattr(near_dups, "SKETCHES", 24)
    assert len(whole) == 24 and (near_dups.sketch(numbers[::-1].copy()) != whole).any()


def test_workers_get_few_bytes_of_texts_at_a_time(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    text = F.concat(F.repeat(F.lit("w "), 2000), F.floor(F.col("doc_id") / 2))
    docs = spark.range(0, 3000, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", text)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    found = near_dups.classes(docs)
    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= tables.BATCH_BYTES + 8192 < 12_000_000
    assert found.where("class_id = doc_id").count() < found.count() == 3000
    spark.conf.unset(limit)


def test_a_worker_holds_the_last_model_only():
    made = []

    def make(name):
        made.append(name)
        return [name]

    tables.let_go()
    first = tables.held("a", lambda: make("a"))
    assert tables.held("a", lambda: make("a")) is first and made == ["a"]
    assert tables.held("b", lambda: make("b")) == ["b"] and list(tables._held) == ["b"]
    tables.held("a", lambda: make("a"))
    assert made == ["a", "b", "a"]
    tables.let_go()
    assert not tables._held
