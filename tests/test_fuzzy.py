import random

import pytest

from cartloom.functions import text
from cartloom.operators import catalog, fuzzy


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def words(rng, n):
    stems = ["aspirin", "asperin", "forte", "tablet", "cream", "c", "b6", "old", "cold", "bolt", "nova", "novo"]
    out = set()
    while len(out) < n:
        parts = [rng.choice(stems) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            w = list(parts[0])
            w[rng.randrange(len(w))] = rng.choice("abcdest")
            parts[0] = "".join(w)
        out.add(" ".join(parts))
    return sorted(out)


def test_lcs_and_rounding():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))
        assert text.lcs_length(a, b) == slow_lcs(a, b)
    assert text.ratio_of("a" * 33 + "b" * 7, "a" * 33 + "c" * 7) == 82  # 82.5 goes to even
    assert text.ratio_of("", "a") == 0
    assert text.token_set_of("old bolt", "bolt old new") == 100
    assert text.token_set_of("old bolt", "cold bolt") == 94
    assert text.weighted_of("aspirin", "aspirin forte") == 90
    assert text.weighted_of("aspirin", "aspirin forte extra strong tablets with vitamin c and more") == 60


def test_process(spark):
    df = spark.createDataFrame([(" Asp-irin  No_5, №3 ",), ("ЙОД (5%)",)], "n string")
    got = [r[0] for r in df.selectExpr(text.process("n")).collect()]
    assert got == ["asp irin  no_5   3", "йод  5"]


@pytest.mark.parametrize("cutoff", [60, 75, 80, 92])
def test_token_set_pairs_equal_brute_force(spark, cutoff):
    names = words(random.Random(cutoff), 60)
    left, right = names[::2] + ["", "!!"], names
    got = {
        (r.left_name, r.right_name): r.score
        for r in fuzzy.token_set_pairs(
            spark.createDataFrame([(n,) for n in left], "left_name string"),
            spark.createDataFrame([(n,) for n in right], "right_name string"),
            cutoff,
        ).collect()
    }
    want = {}
    for a in left:
        for b in right:
            score = text.token_set_of(a, b) if a.strip("! ") else 0
            if score >= cutoff:
                want[a, b] = score
    assert got == want


@pytest.mark.parametrize("cutoff", [70, 90])
def test_ratio_pairs_equal_brute_force(spark, cutoff):
    names = words(random.Random(7), 60)
    sides = [spark.createDataFrame([(n,) for n in names], c + "_name string") for c in ("left", "right")]
    got = {(r.left_name, r.right_name): r.score for r in fuzzy.ratio_pairs(*sides, cutoff).collect()}
    want = {(a, b): text.ratio_of(a, b) for a in names for b in names if text.ratio_of(a, b) >= cutoff}
    assert got == want


@pytest.mark.parametrize("cutoff", [90, 95])
def test_weighted_pairs_equal_brute_force(spark, cutoff):
    names = words(random.Random(11), 60)
    sides = [spark.createDataFrame([(n,) for n in names], c + "_name string") for c in ("left", "right")]
    got = {(r.left_name, r.right_name): r.score for r in fuzzy.weighted_pairs(*sides, cutoff).collect()}
    want = {(a, b): text.weighted_of(a, b) for a in names for b in names if text.weighted_of(a, b) >= cutoff}
    assert got == want


def test_blocks_keep_names_apart(spark):
    left = spark.createDataFrame([("x", "old bolt")], "block string, left_name string")
    right = spark.createDataFrame([("x", "old bolts"), ("y", "old bolt")], "block string, right_name string")
    assert [r.right_name for r in fuzzy.token_set_pairs(left, right, 80).collect()] == ["old bolts"]


def test_low_cutoffs_are_refused(spark):
    df = spark.createDataFrame([("a",)], "left_name string")
    with pytest.raises(ValueError):
        fuzzy.ratio_pairs(df, df.withColumnRenamed("left_name", "right_name"), 50)


def test_enrich_codes(spark):
    products = spark.createDataFrame(
        [
            (1, "aspirin forte", None, "tablet", None),
            (2, "x", "iodine", "tablet", None),
            (3, "aspirin forte", None, "syrup", None),
            (4, "unknown thing", None, "tablet", None),
            (5, "aspirin", None, None, None),
        ],
        "id long, name string, tradeName string, medForm string, atx string",
    )
    book = spark.createDataFrame([("aspirin fortes", "A1"), ("iodines", "B2"), ("iodinex", "B1")], "name string, atx string")
    registry = spark.createDataFrame([("unknown thing", "R9")], "name string, atx string")
    got = dict(catalog.enrich_codes(products, book, ["tab"], 90, "auto", registry).select("id", "atx").collect())
    assert got == {1: "A1", 2: "B2", 3: None, 4: "R9", 5: None}


def test_windows_of_one_pass_equal_each_window():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("abcé ") for _ in range(rng.randint(len(a), 40)))
        windows = [b[i:i + len(a)] for i in range(len(b) - len(a) + 1)]
        assert text.best_window(a, b) == max(slow_lcs(a, w) for w in windows)
        assert text.partial_ratio_of(b, a) == max(text.ratio_of(a, w) for w in windows)
    assert text.partial_ratio_of("", "abc") == 0


def uneven(rng, n):
    """Names from one word to thirty, with repeated words."""
    out = set(words(rng, n // 2))
    while len(out) < n:
        parts = rng.choices(words(rng, 5), k=rng.choice([1, 2, 3, 9]))
        out.add(" ".join(parts + parts[:1] * rng.randrange(3)))
    return sorted(out)


@pytest.mark.parametrize("cutoff", [51, 57, 58, 60, 75, 85, 86, 87, 89])
def test_weighted_pairs_below_90_equal_brute_force(spark, cutoff):
    names = uneven(random.Random(cutoff), 60)
    left, right = names[::2], names
    sides = [spark.createDataFrame([(n,) for n in side], c + "_name string") for c, side in (("left", left), ("right", right))]
    got = {(r.left_name, r.right_name): r.score for r in fuzzy.weighted_pairs(*sides, cutoff).collect()}
    want = {(a, b): text.weighted_of(a, b) for a in left for b in right if text.weighted_of(a, b) >= cutoff}
    assert got == want


def test_dictionary_below_90(spark):
    names = spark.createDataFrame([("asperin fort",), ("nova cream",), ("zzz",)], "name string")
    book = spark.createDataFrame([("aspirin forte", "A"), ("aspirin", "B"), ("novo cream tablet", "C")], "name string, atx string")
    got = {r.name: (r.key, r.score) for r in catalog.best_dictionary_match(names, book, 70, "weighted").collect()}
    keys = ["aspirin forte", "aspirin", "novo cream tablet"]
    want = {}
    for n in ("asperin fort", "nova cream"):
        best = max(keys, key=lambda k: (text.weighted_of(n, k), [-ord(c) for c in k]))
        want[n] = (best, text.weighted_of(n, best))
    assert got == want
