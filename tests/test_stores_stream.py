import json
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartloom import session
from cartloom.functions import phones
from cartloom.operators import sampling
from cartloom.sources import store, tables
from cartloom.streaming import ingest


def rows_for(users):
    return [(u, i, float(u % 7 + i)) for u in users for i in range(1 + u % 3)]


def buckets_of(spark, df):
    """How many buckets a plan reads; told only where the planner keeps the scan by buckets."""
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(setting, "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(setting)
    return re.search(r"SelectedBucketsCount: (\d+ out of \d+)", plan).group(1)


def test_lookups_read_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    made = spark.createDataFrame(rows_for(range(500)), "tel_hashed int, goods_id long, purchases double")
    store.write_store(made, "ratings_store", path, "tel_hashed", 32)
    found = store.lookup(spark.table("ratings_store"), "tel_hashed", [7])
    assert buckets_of(spark, found) == "1 out of 32"
    assert sorted(map(tuple, found.collect())) == rows_for([7])
    several = store.lookup(spark.table("ratings_store"), "tel_hashed", [7, 8, 499, 100_000])
    assert int(buckets_of(spark, several).split()[0]) <= 4
    assert sorted(map(tuple, several.collect())) == rows_for([7, 8, 499])
    assert store.lookup(spark.table("ratings_store"), "tel_hashed", []).count() == 0
    spark.sql("DROP TABLE ratings_store")
    # Another session declares the table over the same files.
    again = store.open_store(spark, "ratings_again", path, "tel_hashed INT, goods_id BIGINT, purchases DOUBLE", "tel_hashed", 32)
    found = store.lookup(again, "tel_hashed", [8])
    assert buckets_of(spark, found) == "1 out of 32" and sorted(map(tuple, found.collect())) == rows_for([8])
    # Files of other buckets aren't even opened.
    own = {Path(r.f).name for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    for file in Path(path).glob("*.parquet"):
        if file.name not in own:
            file.write_bytes(b"not a table")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert len(own) == 1 and sorted(map(tuple, store.lookup(again, "tel_hashed", [8]).collect())) == rows_for([8])
    spark.sql("DROP TABLE ratings_again")


def test_lookup_by_phone_as_typed(spark, tmp_path):
    raw = ["+7 (912) 345-67-89", "8-800-1", "79000000000", "no digits"]
    keyed = spark.createDataFrame([(p,) for p in raw[:3]], "phone string").withColumn(
        "tel_hashed", phones.hash_user(phones.clean_phone(F.col("phone"))))
    store.write_store(keyed.select("tel_hashed", F.col("phone").alias("who")), "by_phone", str(tmp_path / "p"), "tel_hashed", 8)
    got = store.lookup_phones(spark.table("by_phone"), [raw[0], raw[2], raw[3], raw[0]]).collect()
    assert sorted((r.phone, r.who) for r in got) == sorted([(raw[0], raw[0]), (raw[2], raw[2])])
    spark.sql("DROP TABLE by_phone")


def test_popular_list_is_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "popular")
    items = list(range(50))
    random.Random(1).shuffle(items)
    made = spark.createDataFrame(list(zip(items, range(1, 51))), "item long, rank int").repartition(5)
    tables.write_popular(made, path)
    assert len(list(Path(path).glob("*.parquet"))) == 1
    assert [r.item for r in tables.read_popular(spark, path).collect()] == items
    assert tables.preview(tables.read_popular(spark, path), 3)["item"].tolist() == items[:3]


@pytest.mark.parametrize("heap", [100_000, 20])
def test_exact_sample_whatever_the_partitions(spark, monkeypatch, heap):
    monkeypatch.setattr(sampling, "HEAP_ROWS", heap)
    table = spark.createDataFrame([(i, f"v{i}") for i in range(1000)], "k long, v string")
    taken = [sorted(map(tuple, sampling.exact_sample(table.repartition(n), ["k"], 100, 7).collect())) for n in (1, 3, 9)]
    assert len(set(taken[0])) == 100 and taken[0] == taken[1] == taken[2]
    assert sorted(map(tuple, sampling.exact_sample(table, ["k"], 100, 8).collect())) != taken[0]
    assert sampling.exact_sample(table, ["k"], 5000).count() == 1000
    assert sampling.exact_sample(table, ["k"], 0).count() == 0 and sampling.exact_sample(table.limit(0), ["k"], 30).count() == 0


def landed(folder, name, orders):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(o) for o in orders))


def order(number, when):
    return {"id": number, "clientTel": "7", "basket": [], "made": when and when.isoformat()}


def state_rows(query):
    return sum(op["numRowsTotal"] for progress in query.recentProgress[-1:] for op in progress["stateOperators"])


def test_bounded_state_drops_late_copies_and_forgets(spark, tmp_path):
    source, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    start = datetime(2024, 1, 1)

    def run():
        query = ingest.ingest_orders(spark, str(source), sink, mark, event_time="made", within="2 days")
        query.awaitTermination()
        return query, sorted((r.id, r.made) for r in spark.read.parquet(sink).collect())

    landed(source, "a.json", [order(1, start), order(2, start), order(2, start), order(3, None)])
    first, rows = run()
    assert rows == [(1, start), (2, start)] and state_rows(first) == 2
    # A day later: a copy within the interval is dropped, a new order is taken.
    landed(source, "b.json", [order(1, start), order(4, start + timedelta(days=1))])
    assert run()[1] == [(1, start), (2, start), (4, start + timedelta(days=1))]
    # Ten days later the first orders are forgotten; their old copies are too late to be taken for new ones.
    landed(source, "c.json", [order(5, start + timedelta(days=10))])
    run()
    landed(source, "d.json", [order(1, start), order(6, start + timedelta(days=10))])
    last, rows = run()
    assert [r[0] for r in rows] == [1, 2, 4, 5, 6] and state_rows(last) == 2
    # An id that comes again with a new time is a new order by then.
    landed(source, "e.json", [order(1, start + timedelta(days=11))])
    assert [r[0] for r in run()[1]] == [1, 1, 2, 4, 5, 6]


def test_event_time_and_interval_belong_together(spark):
    with pytest.raises(ValueError):
        ingest.ingest_orders(spark, "in", "out", "mark", event_time="made")


def test_nothing_is_left_after_clear(spark):
    settled = session.settle(spark.range(10).toDF("x"), "left-over")
    kept = session.keep(spark.range(5).toDF("y"))
    assert settled.count() == 10 and kept.count() == 5 and kept.is_cached
    folder = Path(session._session_dir(spark))
    assert list(folder.glob("left-over-*"))
    session.clear(spark)
    assert not folder.exists() and not kept.is_cached and not session._kept
    assert session.settle(spark.range(3).toDF("x"), "again").count() == 3
