"""Shape of the physical plans: what must not appear, and what must."""

import pytest
from kinfold.catalog.queries import queries

FOLDER = "/root/testdata/sf0.001"
# These act while they are being defined (files, models, written tables).
EAGER = {
    "read_jsonl", "jsonl_roundtrip", "csv_roundtrip", "metrics_json", "replay_split", "tfidf", "assemble_features",
    "fit_logreg", "hashed_collisions", "fit_forest", "cv_experiment", "cv_seeds", "cache_store", "stream_first_within", "stream_gate", "append_jsonl", "read_sources", "split_document",
}


def plan(spark, name):
    return queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - EAGER))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "InPandas" not in text


def test_narrow_queries_read_narrow_columns(spark):
    for name in ("group_kfold", "value_counts", "train_rule", "family_sizes", "binary_metrics"):
        assert "text:string" not in plan(spark, name)


def test_texts_are_scored_once(spark):
    """What needs hashes or reasons several times reads them from a written table."""
    for name in ("reject_known_hash", "orphan_variants", "cache_lookup", "cache_misses", "cache_stats", "run_log"):
        text = plan(spark, name)
        assert "documents.parquet" not in text and "sha2" not in text.split("Scan parquet")[-1]


def test_dedup_moves_each_text_once(spark):
    text = plan(spark, "dedup_first")
    assert text.count("hashpartitioning(text_hash") == 1 and "partial_min_by" in text
    assert "Window" not in text


def test_term_counts_need_no_shuffle_of_their_own(spark):
    assert plan(spark, "word_ngrams").count("hashpartitioning") == 1
