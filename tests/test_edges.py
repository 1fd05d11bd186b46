"""Rows that must not vanish without a word, order from files, and records."""

import json

import pytest
from kinfold.config import DEFAULT_LABELS
from kinfold.functions import labels
from kinfold.functions.stats import two_sided_p
from kinfold.operators import checks, dedup, families, joins, split, votes
from kinfold.plans import build, experiment
from kinfold.sources import files, manifests
from kinfold.streaming.gate_stream import stream_gate
from pyspark.sql import functions as F


def body(i, n=130):
    return " ".join([f"w{i}"] * n)


MESSAGE = "msg_id string, label string, variant_type string, base_msg_id string, text string, ord long"


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


# --- rows without an order, a base, an id or a stratum ---


def test_a_row_without_order_is_an_error(spark):
    rows = messages(spark, [("a", "phish", "original", None, body(1), None), ("b", "phish", "original", None, body(2), 1)])
    hashed = rows.withColumn("text_hash", F.sha2("text", 256))
    with pytest.raises(Exception, match="a row has no ord"):
        dedup.dedup_first(hashed).collect()
    with pytest.raises(Exception, match="a row has no ord"):
        joins.flag_duplicates(hashed).collect()
    with pytest.raises(Exception, match="a row has no ord"):
        build.gate_and_dedup(rows).accepted.collect()


def test_a_variant_without_base_is_an_error_or_an_orphan(spark):
    rows = messages(spark, [("a", "phish", "original", None, "x", 1), ("v", "phish", "paraphrase", None, "y", 2)])
    with pytest.raises(Exception, match="variant without base_msg_id: v"):
        split.holdout_split(rows, 1)
    assert [r.msg_id for r in families.orphan_variants(rows).collect()] == ["v"]


def test_a_repeated_id_is_drawn_once(spark):
    rows = [(f"p{i}", "phish", "original", None, "x", i) for i in range(10)] * 2
    placed = split.holdout_split(messages(spark, rows), 3, 0.3)
    sides = placed.groupBy("msg_id").agg(F.collect_set("split").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sides) == 10 and all(len(r.s) == 1 and r.n == 2 for r in sides)


def test_null_strata_are_strata_and_null_ids_are_errors(spark):
    rows = spark.createDataFrame([(f"m{i}", None if i % 2 else "s") for i in range(20)], "msg_id string, s string")
    assert split.capped_sample(rows, 3, 1, ["s"]).groupBy("s").count().collect() == [
        r for r in split.capped_sample(rows, 3, 1, ["s"]).groupBy("s").count().collect() if r["count"] == 3
    ]
    assert split.train_val_split(rows, 1, 0.2, ["s"]).count() == 20
    nameless = rows.withColumn("msg_id", F.when(F.col("msg_id") != "m3", F.col("msg_id")))
    with pytest.raises(Exception, match="a row has no msg_id"):
        split.capped_sample(nameless, 100, 1, ["s"]).collect()


def test_a_key_that_comes_twice_on_the_right_is_an_error(spark):
    left = spark.range(5).select("id", F.lit(1).alias("k"))
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="more than one row for 1"):
        joins.skew_join(left, right, ["k"], ["id"]).collect()
    assert joins.skew_join(left, right.limit(1), ["k"], ["id"]).count() == 5


def test_hot_keys_are_bounded_by_the_number_of_shares(spark):
    left = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    right = spark.range(-1, 10_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    joined = joins.skew_join(left, right, ["k"], ["id"], share=50)
    assert joined.count() == 10_000 and joined.filter("k != v").count() == 0


def test_ranks_over_many_strata(spark):
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("msg_id"), (F.col("id") % 50_000).alias("s"))
    ranked = split.keyed_rank(rows, "msg_id", F.lit(1), ["s"])
    assert ranked.groupBy("rank", "n").count().orderBy("rank").collect() == [(1, 2, 50_000), (2, 2, 50_000)]
    plan = split.capped_sample(rows, 1, 1, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


# --- rules ---


def test_validation_side_has_the_ceiling_of_its_share(spark):
    rows = spark.range(192).select(F.concat(F.lit("m"), "id").alias("msg_id"), (F.col("id") % 2).alias("y"))
    for strata in (["y"], []):
        parts = split.train_val_split(rows, 9, 0.2, strata).groupBy("part").count().collect()
        assert {r.part: r["count"] for r in parts} == {"val": 39, "train": 153}
    uneven = rows.withColumn("y", F.when(F.col("id") < 10 if "id" in rows.columns else F.col("msg_id") < "m2", 1).otherwise(0))
    by_class = split.train_val_split(uneven, 9, 0.2, ["y"]).filter("part = 'val'").groupBy("y").count().collect()
    assert sum(r["count"] for r in by_class) == 39


def test_training_takes_negatives_by_label_only(spark):
    rows = messages(spark, [("a", "phish", "legit", None, "x", 1), ("b", "legit", "original", None, "x", 2)])
    assert [r.msg_id for r in rows.filter(labels.trains(DEFAULT_LABELS)).collect()] == ["b"]


# Two-sided tails of Student's t from public tables, and far out by the power law.
@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(0.0, 4, 1.0), (2.776445, 4, 0.05), (12.7062, 1, 0.05), (2.570582, 5, 0.05), (1.812461, 10, 0.1), (4.302653, 2, 0.05)],
)
def test_tail_of_t(spark, t, df, p):
    got = spark.range(1).select(two_sided_p(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(p, rel=2e-5)


def test_far_tails_keep_their_digits(spark):
    far = spark.range(1).select(
        two_sided_p(F.lit(40.0), F.lit(49)).alias("a"), two_sided_p(F.lit(1e6), F.lit(2)).alias("b")
    ).first()
    assert 0 < far.a < 1e-35
    assert far.b == pytest.approx(1e-12, rel=1e-6)  # 2 degrees: 1 - t / sqrt(2 + t^2)


def test_copies_of_a_text_are_one_family(spark, tmp_path):
    from kinfold.sources import tables

    docs = [(1, body(1)), (2, body(1)), (3, body(2)), (4, body(2)), (5, body(1))]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]
    spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: (r.label, r.variant_type, r.family_id) for r in tables.labelled_messages(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == ("legit", "original", "text_1") and got[5] == ("phish", "original", "text_1")
    assert got[3][1:] == ("original", "text_3") and got[4][1:] == ("paraphrase", "text_3")


def test_families_in_two_folds_are_an_error(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "group_id string, fold_9 int")
    with pytest.raises(ValueError, match="several folds"):
        checks.assert_folds_apart(rows, ["fold_9"])
    checks.assert_folds_apart(rows.filter("fold_9 = 1"), ["fold_9"])


def test_leaky_holdout_is_an_error(spark):
    rows = [("a", "phish", "original", None, "x", 1), ("b", "phish", "original", None, "x", 2)]
    rows += [("n", "legit", "original", None, "x", 3), ("n2", "legit", "original", None, "x", 4)]
    assert split.holdout_split(messages(spark, rows), 1).count() > 0
    assert experiment is not None


# --- files ---


def test_sources_keep_file_and_line_order(spark, tmp_path):
    (tmp_path / "one").mkdir()
    long = "x" * 300
    for name, ids in (("b.jsonl", range(500, 900)), ("a.jsonl", range(500))):
        lines = [json.dumps({"msg_id": f"m{i}", "text": long, "temperature": 0.5}) for i in ids]
        (tmp_path / "one" / name).write_text("\n\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text('{"msg_id": "last", "text": "t", "length_words": 3}\n')
    paths = [f"{tmp_path}/one", f"{tmp_path}/two.jsonl"]
    whole = files.read_sources(spark, paths).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        cut = files.read_sources(spark, paths)
        assert cut.rdd.getNumPartitions() > 8
        again = cut.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.msg_id for r in sorted(again, key=lambda r: r.ord)] == [f"m{i}" for i in range(900)] + ["last"]
    assert sorted(whole) == sorted(again)
    assert {r.length_words for r in whole if r.msg_id == "last"} == {3}
    (tmp_path / "two.jsonl").write_text('{"msg_id": \n')
    with pytest.raises(Exception):
        files.read_sources(spark, paths).collect()


def test_append_adds_to_what_is_there(spark, tmp_path):
    path = f"{tmp_path}/a"
    for i in range(3):
        files.write_jsonl(spark.createDataFrame([(f"m{i}", None)], "msg_id string, text string"), path, append=True)
    assert sorted(r.msg_id for r in files.read_jsonl(spark, path).collect()) == ["m0", "m1", "m2"]


def test_stream_over_files_without_order(spark, tmp_path):
    """The default schema has `ord`, the files have not: line order decides."""
    base = str(tmp_path)
    (tmp_path / "in").mkdir()
    for part in range(2):
        lines = [json.dumps({"msg_id": f"m{part}_{i}", "label": "phish", "text": body(i % 3)}) for i in range(6)]
        (tmp_path / "in" / f"{part}.jsonl").write_text("\n".join(lines) + "\n")
        run = stream_gate(spark, f"{base}/in", f"{base}/ok", f"{base}/no", f"{base}/state")
        run.awaitTermination()
    accepted = spark.read.parquet(f"{base}/ok").collect()
    assert sorted(r.msg_id for r in accepted) == ["m0_0", "m0_1", "m0_2"] and all(r.text for r in accepted)
    rejected = spark.read.parquet(f"{base}/no").collect()
    assert len(rejected) == 9 and {r.reason for r in rejected} == {"duplicate_hash"}


# --- records ---


def test_log_events_tell_what_they_are_about(spark):
    rows = messages(spark, [("v", "phish", "paraphrase", "a", "short", 1)]).withColumns(
        {"scenario": F.lit("s"), "paraphrase_strategy": F.lit("friendly_tone"), "attempt": F.lit(4)}
    )
    event = build.reject_log(build.gate_and_dedup(rows), "paraphrase", "2026-01-01").first()
    assert (event.scenario, event.base_msg_id, event.strategy, event.attempt) == ("s", "a", "friendly_tone", 4)
    assert (event.reason, event.detail, event.preview) == ("too_short(1)", 1, "short")


def test_answers_are_merged_into_the_cache(spark):
    old = spark.createDataFrame([("k1", 0), ("k2", 1)], "cache_key string, answer long")
    new = spark.createDataFrame([("k2", 0, "a,b"), ("k3", 1, None), (None, 1, None)], "cache_key string, answer long, raw string")
    merged = {r.cache_key: (r.answer, r.raw) for r in votes.save_answers(old, new).collect()}
    assert merged == {"k1": (0, None), "k2": (0, "a,b"), "k3": (1, None)}


def test_split_document_goes_out_and_in(spark, tmp_path):
    rows = messages(spark, [(f"p{i}", "phish", "original", None, "x", i) for i in range(5)] + [("n", "legit", "original", None, "x", 9)])
    sides = split.holdout_sides(rows, 4, 0.2)
    manifest = manifests.split_manifest(rows, sides, split.apply_sides(rows, sides), dataset="d", seed=4, test_ratio=0.2)
    manifests.write_split_document(manifest, f"{tmp_path}/m")
    doc = spark.read.json(f"{tmp_path}/m").first()
    assert (doc.dataset, doc.seed, doc.test_ratio) == ("d", 4, 0.2) and doc.counts.legit_total == 1
    back = manifests.read_split_document(spark, f"{tmp_path}/m")
    key = ["family_id", "kind", "side"]
    assert back.select(key).exceptAll(sides.select(key)).count() == 0 and back.count() == 6
    with pytest.raises(ValueError, match="more than 2 ids"):
        manifests.split_document(manifest, most=2)
