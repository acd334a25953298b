import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartloom.operators import cosine, packs
from test_cosine_nearest import brute_cosine, skewed

FIELDS = {"to": pa.list_(pa.int64()), "g": pa.list_(pa.int32()), "own": pa.int64(), "mark": pa.bool_(), "ids": pa.list_(pa.int64()), "vals": pa.list_(pa.int64())}


def some_lists(rng, n):
    for _ in range(n):
        to = [rng.randrange(-2**62, 2**62) for _ in range(rng.choice([0, 1, 5, 9]))]
        far = rng.choice([50, 2**20, 2**62])
        ids = sorted({rng.randrange(-far, far) for _ in range(rng.choice([0, 1, 4, 12]))})
        yield {"to": to, "g": [rng.randrange(-1, 5) for _ in to], "own": rng.choice([None, -3, 2**40]), "mark": rng.random() < 0.3,
               "ids": ids, "vals": [rng.choice([-5, 0, 7, 10**9, 2**61]) for _ in ids]}


@pytest.mark.parametrize("chunk", [8_000_000, 30, 1])
def test_packs_hold_all_lists(monkeypatch, chunk):
    monkeypatch.setattr(packs, "CHUNK_ENTRIES", chunk)
    rows = list(some_lists(random.Random(chunk), 60))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], kind) for c, kind in FIELDS.items()], list(FIELDS)) for part in (rows[:35], rows[35:36], rows[36:])]
    got = []
    for sent in packs._send(iter(batches), 0, 4):
        for g, pack in zip(sent.column("g").to_pylist(), sent.column("pack").to_pylist(), strict=True):
            found, at = packs.received(pa.chunked_array([pa.array([pack], pa.list_(pa.binary()))])), 0
            for k, size in enumerate(found.size.tolist()):
                own = int(found.own[k]) if found.known[k] else None
                got.append((g, int(found.to[k]), own, bool(found.mark[k]), tuple(found.ids[at:at + size].tolist()), tuple(found.values[at:at + size].tolist())))
                at += size
    want = [(g, to, r["own"], r["mark"], tuple(r["ids"]), tuple(r["vals"])) for r in rows for to, g in zip(r["to"], r["g"], strict=True) if 0 <= g < 4]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("far", [1, 2**55])
def test_item_cosine_in_rounds(spark, monkeypatch, far):
    """Many rounds, each written: the result reads no shuffle. Ids so far apart that they need codes, too."""
    monkeypatch.setattr(cosine, "ROUND_ENTRIES", 100, raising=False)
    monkeypatch.setattr(cosine, "GROUP_ENTRIES", 40)
    rows = [(u, (i - 12) * far) for u, i in skewed(9)]
    found = cosine.item_cosine(spark.createDataFrame([*rows, (None, far), (3, None)], "user long, item long"), "user", "item", 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = brute_cosine([*rows, (-1, far)], 5)
    assert {(r.item_a, r.item_b): round(r.cosine, 9) for r in found.collect()} == want


@pytest.mark.parametrize("kinds", ["u int, i long", "u long, i int", "u string, i long"])
def test_recommending_in_rounds(spark, monkeypatch, kinds):
    """Rounds of packs, an item of many users and users with missing items, against lists that aren't packed."""
    monkeypatch.setattr(cosine, "ROUND_ENTRIES", 400, raising=False)
    monkeypatch.setattr(cosine, "GROUP_ENTRIES", 90)
    monkeypatch.setattr(packs, "CHUNK_ENTRIES", 30)
    rows = [*skewed(11, users=60), *((u, 2) for u in range(60) if u % 3)]
    sims = spark.createDataFrame([(a, b, c) for (a, b), c in brute_cosine(sorted(set(rows)), 6).items()], "item_a long, item_b long, cosine double")
    named = kinds.replace("u string", "u long")
    have = spark.createDataFrame([*sorted(set(rows)), (4, None), (5, None), (99, None), (98, 700), (None, 3)], named)
    have = have.select(F.col("u").cast(kinds.split()[1].rstrip(",")).alias("u"), "i")
    found = cosine.recommend_items(have, sims, "u", "i", 4)
    wanted = spark.createDataFrame([(u, i) for u in range(0, 60, 2) for i in range(0, 25, 3)], named).select(F.col("u").cast(have.schema["u"].dataType).alias("u"), "i")
    wanted = wanted.join(have, ["u", "i"], "left_anti")
    ranks = cosine.target_ranks(have, wanted, sims)
    monkeypatch.setattr(packs, "WHOLE", ())
    for got, plain in ((found, cosine.recommend_items(have, sims, "u", "i", 4)), (ranks, cosine.target_ranks(have, wanted, sims))):
        assert got.dtypes == plain.dtypes
        listed = sorted(map(tuple, got.collect()))
        assert listed == sorted(map(tuple, plain.collect())) and len(listed) > 50
    packed = kinds != "u string, i long"
    assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) != packed
