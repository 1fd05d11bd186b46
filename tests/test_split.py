"""Families, folds, holdouts, samples, joins and leakage checks."""

import pytest
from kinfold.config import NEGATIVE_SCENARIO, SCENARIOS, STRATEGIES
from kinfold.operators import checks, families, joins, split
from kinfold.plans import experiment
from kinfold.sources import manifests
from pyspark.sql import functions as F

SCHEMA = (
    "msg_id string, label string, scenario string, variant_type string, paraphrase_strategy string,"
    " base_msg_id string, text string"
)


@pytest.fixture(scope="module")
def corpus(spark):
    """The 840 message ids of the reported dataset: 4 x 30 families and 120 negatives."""
    rows = []
    for scenario in SCENARIOS:
        for i in range(1, 31):
            base = f"phish_{scenario}_{i:03d}_orig"
            rows.append((base, "phish", scenario, "original", "na", None, base))
            rows += [
                (f"phish_{scenario}_{i:03d}_{code}", "phish", scenario, "paraphrase", name, base, code + base)
                for code, name in STRATEGIES.items()
            ]
    rows += [(f"legit_{i:03d}", "legit", NEGATIVE_SCENARIO, "original", "na", None, str(i)) for i in range(1, 121)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_reported_counts(spark, corpus):
    from kinfold.operators.metrics import value_counts

    got = {(r.section, r.value): r.n for r in value_counts(corpus).collect()}
    assert got["label", "phish"] == 720 and got["label", "legit"] == 120
    assert all(got["scenario", s] == 180 for s in SCENARIOS)
    assert got["variant_type", "original"] == 120 and got["variant_type", "paraphrase"] == 600
    assert all(got["strategy", s] == 120 for s in STRATEGIES.values())


def test_reported_fold_sizes(corpus):
    sizes = split.fold_sizes(experiment.assign_folds(corpus, [9], 5)).collect()
    assert {(r.n_groups_train, r.n_groups_test, r.n_train_rows, r.n_testA_rows, r.n_testB_rows) for r in sizes} == {
        (192, 48, 192, 48, 144)
    }


def test_reported_holdout_counts(corpus):
    rows = split.holdout_split(corpus, seed=4, ratio=0.2)
    counts = {r.name: r.n for r in manifests.split_counts(corpus, rows).collect()}
    assert counts == {
        "phish_original_total": 120,
        "phish_paraphrase_total": 600,
        "legit_total": 120,
        "train_total": 192,
        "test_original_total": 48,
        "test_paraphrase_total": 144,
    }
    checks.assert_no_leakage(rows)
    assert checks.leakage_check(rows).count() == 0


def test_folds_do_not_depend_on_layout(corpus):
    first = experiment.assign_folds(corpus, [1, 2], 5).select("seed", "msg_id", "fold")
    second = experiment.assign_folds(corpus.orderBy(F.desc("text")).repartition(13), [1, 2], 5)
    assert first.exceptAll(second.select("seed", "msg_id", "fold")).count() == 0


def test_uneven_classes_differ_by_one(spark):
    groups = spark.range(103).select(F.concat(F.lit("g"), "id").alias("group_id"), (F.col("id") < 41).cast("int").alias("y"))
    rows = split.group_kfold(groups, [1, 2, 3], 5).groupBy("seed", "y", "fold").count().collect()
    for y, n in ((1, 41), (0, 62)):
        assert {r["count"] for r in rows if r.y == y} <= {n // 5, n // 5 + 1}
    totals = split.group_kfold(groups, [1], 5).groupBy("fold").count().collect()
    assert {r["count"] for r in totals} == {20, 21}


def test_too_few_groups_is_an_error(spark):
    groups = spark.range(9).select(F.col("id").cast("string").alias("group_id"), (F.col("id") < 3).cast("int").alias("y"))
    with pytest.raises(Exception, match="fewer than 5 folds"):
        split.group_kfold(groups, [1], 5).collect()


@pytest.mark.parametrize(("n", "expected"), [(1, 1), (2, 1), (25, 2), (35, 4)])
def test_holdout_rounds_half_to_even(spark, n, expected):
    rows = spark.range(n).select(
        F.concat(F.lit("p"), "id").alias("msg_id"),
        F.lit("phish").alias("label"),
        F.lit("original").alias("variant_type"),
        F.lit(None).cast("string").alias("base_msg_id"),
    )
    assert split.holdout_sides(rows, 1, 0.1).filter("side = 'test'").count() == expected


def test_replay_of_a_split_document(spark, corpus, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"seed": 4, "splits": {"train_phish_base_ids": ["phish_impersonation_001_orig"],\n'
        ' "test_phish_base_ids": ["phish_impersonation_002_orig"], "train_legit_ids": ["legit_001"],\n'
        ' "test_legit_ids": ["legit_002", "legit_003"]}}'
    )
    sides = manifests.read_split_document(spark, str(tmp_path / "m.json"))
    counts = {r.split: r["count"] for r in split.apply_sides(corpus, sides).groupBy("split").count().collect()}
    assert counts == {"train": 2, "test_original": 3, "test_paraphrase": 7}


def test_planted_leaks_are_found(corpus):
    rows = split.holdout_split(corpus, seed=4)
    variant = corpus.filter("msg_id = 'phish_impersonation_001_p1'").withColumn("split", F.lit("train"))
    leaky = rows.select(*corpus.columns, "split").unionByName(variant)
    found = {r.rule for r in checks.leakage_check(leaky).collect()}
    assert "variant_in_train" in found
    with pytest.raises(ValueError, match="leakage"):
        checks.assert_no_leakage(leaky)
    stray = rows.select(*corpus.columns, "split").filter(
        "not (split = 'test_original' and label = 'phish')"
    )
    assert {r.rule for r in checks.leakage_check(stray).collect()} == {"base_not_in_test"}


def test_bad_label_and_orphan_are_errors(spark, corpus):
    bad = corpus.limit(1).withColumn("label", F.lit("spam"))
    with pytest.raises(Exception, match="unexpected label: spam"):
        families.with_groups(bad).collect()
    orphan = corpus.filter("variant_type = 'paraphrase'").limit(1).withColumn("base_msg_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="variant without base_msg_id"):
        families.with_groups(orphan).select("group_id").collect()
    with pytest.raises(ValueError, match="variant_type"):
        families.with_groups(corpus.drop("variant_type"))


def test_missing_variants_and_quota(corpus):
    less = corpus.filter("msg_id not in ('phish_impersonation_007_p2', 'phish_account_recovery_030_p5')")
    assert {r.msg_id for r in families.missing_variants(less).collect()} == {
        "phish_impersonation_007_p2",
        "phish_account_recovery_030_p5",
    }
    gap = families.quota_gap(corpus, {**dict.fromkeys(SCENARIOS, 30), "new": 2}, NEGATIVE_SCENARIO, 122)
    assert sorted(r.msg_id for r in gap.collect()) == ["legit_121", "legit_122", "phish_new_001_orig", "phish_new_002_orig"]


def test_capped_sample_is_whole_when_small(corpus):
    assert split.capped_sample(corpus, 0, 1, ["label"]).count() == 840
    sample = split.capped_sample(corpus, 200, 1, ["label"]).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in sample} == {"phish": 200, "legit": 120}


def test_resample_levels_the_classes(corpus):
    rows = families.with_groups(corpus).select("msg_id", "y")
    drawn = split.balanced_resample(rows, 3)
    counts = {r.y: r.n for r in drawn.groupBy("y").agg(F.sum("n_draws").alias("n")).collect()}
    assert sum(counts.values()) == 840
    assert abs(counts[0] - 420) < 75
    one_class = split.balanced_resample(rows.filter("y = 1"), 3)
    assert one_class.agg(F.sum("n_draws")).first()[0] == 720


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, how):
    """Half of the rows share one key, some have none; results must not change."""
    left = spark.range(4000).select(
        F.col("id"), F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    split_join = joins.skew_join(left, right, ["k"], ["id"], how, share=40)
    plain = left.join(right, "k", how)
    assert split_join.count() == plain.count()
    assert split_join.select("id", "k", "v").exceptAll(plain.select("id", "k", "v")).count() == 0


def test_hot_text_is_deduplicated_exactly(spark):
    df = spark.range(3000).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text_hash")
    ).repartition(16)
    known = spark.createDataFrame([("1",), ("1",), ("4",)], "text_hash string")
    flagged = joins.flag_duplicates(df, known)
    assert flagged.count() == 3000
    assert flagged.filter("status = 'ok'").count() == 2001 - 2
    assert [r.ord for r in flagged.filter("status = 'ok' and text_hash = 'hot'").collect()] == [0]
    assert joins.reject_known(df, known).count() == 2998
