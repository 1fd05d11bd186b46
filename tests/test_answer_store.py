"""The store of answers: what it writes, what moves, and what a break leaves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kinfold.operators import answer_store, joins
from kinfold.operators.answer_store import AnswerStore
from kinfold.operators.sketch import key_sketch

ROWS = "cache_key string, answer long, note string"


def held(store):
    return {r.cache_key: (r.answer, r.note) for r in store.read().collect()}


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"k{i}", i, "a") for i in range(200)] + [("k1", 1, "a"), (None, 5, "lost")]
    return AnswerStore.create(spark.createDataFrame(rows, ROWS), str(tmp_path / "s"), buckets=4)


def test_upserts_write_new_and_changed_rows_only(spark, store):
    assert held(store) == {f"k{i}": (i, "a") for i in range(200)}
    answers = [("k0", 0, "a"), ("k1", 7, "b"), ("new", 9, None), (None, 1, "x"), ("k2", None, None)]
    store = store.upsert(spark.createDataFrame(answers, ROWS))
    added = spark.table(store.table).filter("_version = 1").select("cache_key").collect()
    assert sorted(r.cache_key for r in added) == ["k1", "k2", "new"]
    want = {f"k{i}": (i, "a") for i in range(200)} | {"k1": (7, "b"), "new": (9, None), "k2": (None, None)}
    assert held(store) == want
    before = files(store.path)
    store.upsert(spark.createDataFrame(answers, ROWS))  # once more: nothing is left to write
    assert len(files(store.path)) == len(before) and held(store) == want
    store = store.upsert(spark.createDataFrame([(8, "k3")], "answer int, cache_key string"))
    assert held(store)["k3"] == (8, None)
    assert held(AnswerStore.attach(spark, store.path)) == held(store)
    with pytest.raises(Exception, match="more than one answer"):
        store.upsert(spark.createDataFrame([("k5", 1, "a"), ("k5", 2, "a")], ROWS))


def test_lookups_do_not_move_the_store(spark, store):
    uses = spark.createDataFrame([(i, f"k{i % 230}") for i in range(500)] + [(500, None)], "id long, cache_key string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (store.answers(uses), store.misses(uses)):
            frame.collect()
            plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            side = plan[plan.index("SortMergeJoin") :]
            stored = side[side.rindex("SortAggregate" if "SortAggregate" in side else "HashAggregate") :]
            assert "Bucketed: true" in side and "Exchange" not in stored and "ShuffleQueryStage" not in stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    found = {r.id: (r.hit, r.answer) for r in store.lookup(uses, "id").collect()}
    assert len(found) == 501 and found[500] == (False, None)
    assert all(found[i] == ((True, i % 230) if i % 230 < 200 else (False, None)) for i in range(500))
    assert {r.cache_key for r in store.misses(uses).collect()} == {f"k{i}" for i in range(200, 230)}


def test_many_versions_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(answer_store, "MOST_VERSIONS", 3)
    want = held(store)
    for n in range(4):
        store = store.upsert(spark.createDataFrame([(f"k{n}", 1000 + n, "z")], ROWS))
        want[f"k{n}"] = (1000 + n, "z")
        assert held(store) == want
    assert store.number == 2
    store.drop_older()
    assert set(os.listdir(store.path)) == {"gen-000002-b4", "schema"} and held(store) == want


def test_a_merge_that_breaks_off_changes_nothing(spark, store):
    want = held(store)
    merged = store.merge()
    os.remove(f"{store.path}/gen-000002-b4/_SUCCESS")  # as if its write had not ended
    again = AnswerStore.attach(spark, store.path)
    assert again.number == 1 and held(again) == want
    spark.sql(f"DROP TABLE {merged.table}")
    again = again.merge()
    assert again.number == 2 and held(again) == want
    assert spark.table(again.table).count() == len(want)


def test_empty_stores_and_wrong_places(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    store = AnswerStore.create(none, str(tmp_path / "e"), buckets=2)
    assert held(store) == {} and store.misses(none).count() == 0
    store = AnswerStore.attach(spark, str(tmp_path / "e")).upsert(none)
    assert held(store.upsert(spark.createDataFrame([("a", 1, "n")], ROWS))) == {"a": (1, "n")}
    with pytest.raises(ValueError):
        AnswerStore.create(none, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        AnswerStore.attach(spark, str(tmp_path / "nowhere"))


def test_a_sketch_passes_all_its_keys_and_few_others(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(1000)] + [(None,)], "k string")
    sketch = key_sketch(keys, "k", bits=1 << 14)
    assert 900 < sketch.n_set <= 1001 and sketch.passing < 0.07
    assert keys.filter(~sketch.may_hold("k")).count() == 0
    others = spark.range(10_000).select(F.concat(F.lit("o"), "id").alias("k"))
    assert others.filter(sketch.may_hold("k")).count() < 1000
    full = key_sketch(keys, "k", bits=64)
    assert full.passing == 1.0 and others.filter(full.may_hold("k")).count() == 10_000
    assert key_sketch(keys.filter("false"), "k").n_set == 0


def test_known_keys_are_sifted_in_the_scan(spark):
    rows = spark.createDataFrame([(i, f"h{i % 40}") for i in range(200)] + [(200, None)], "ord long, text_hash string")
    known = spark.range(50_000).select(F.concat(F.lit("h"), F.col("id") + 30).alias("text_hash"))
    kept = joins.reject_known(rows, known)
    assert sorted(r.ord for r in kept.collect()) == [i for i in range(200) if i % 40 < 30]
    sifted = known.filter(key_sketch(rows, "text_hash").may_hold("text_hash")).count()
    assert 10 <= sifted < 100  # the ten in common, and few that share a bucket
