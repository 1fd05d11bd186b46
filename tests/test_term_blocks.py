"""TF-IDF by blocks of documents next to plain Python."""

from __future__ import annotations

import math
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinfold.operators import term_blocks, vocab
from kinfold.session import BATCH_BYTES, materialize

# Ids 3 and null have several rows, on both sides of the fit; a text is null, one empty.
ROWS = [
    (1, True, "red green blue red"),
    (2, True, "green blue"),
    (3, True, "red blue gold"),
    (3, False, "red green red"),
    (3, None, "red gold"),
    (None, True, "gold green"),
    (None, True, "gold gold"),
    (4, False, "blue silver red"),
    (5, True, None),
    (6, True, ""),
    (7, False, "silver"),
]


def plain(rows, min_df, max_df):
    n = sum(bool(fit) for _, fit, _ in rows)
    tf = defaultdict(Counter)
    for i, fit, text in rows:
        words = (text or "").split()
        tf[i, fit].update([*words, *map(" ".join, zip(words, words[1:], strict=False))])
    df = Counter(t for (_, fit), terms in tf.items() if fit for t in terms)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if min_df <= d <= max_df * n}
    x = [(i, t, k * idf[t]) for (i, _), terms in tf.items() for t, k in terms.items() if t in idf]
    norm = Counter()
    for i, _, value in x:
        norm[i] += value * value
    return sorted((str(i), t, round(value / math.sqrt(norm[i]), 9)) for i, t, value in x)


@pytest.mark.parametrize(("parts", "min_df", "max_df"), [(1, 2, 0.95), (4, 2, 1.0), (7, 1, 0.5)])
def test_weights_equal_plain_ones(spark, parts, min_df, max_df):
    docs = spark.createDataFrame(ROWS, "id long, fit boolean, text string").repartition(parts)
    found = vocab.tfidf(docs, F.col("fit"), "id", min_df=min_df, max_df=max_df).collect()
    assert sorted((str(r.id), r.term, round(r.tfidf, 9)) for r in found) == plain(ROWS, min_df, max_df)


def test_no_rows_and_no_terms(spark):
    docs = spark.createDataFrame([], "id string, fit boolean, text string")
    assert vocab.tfidf(docs, F.col("fit"), "id").collect() == []
    docs = spark.createDataFrame([("a", True, "-")], "id string, fit boolean, text string")
    assert vocab.tfidf(docs, F.col("fit"), "id").collect() == []


def test_rows_of_terms_are_not_shuffled(spark):
    docs = spark.createDataFrame(ROWS, "id long, fit boolean, text string")
    plan = vocab.tfidf(docs, F.col("fit"), "id")._jdf.queryExecution().toString()
    assert "hashpartitioning(term" not in plan and "Window" not in plan


@pytest.mark.parametrize("batch", ["1b", "64m"])
def test_answers_of_a_block_are_not_collected(spark, monkeypatch, batch):
    """They were held as a list for many blocks at a time, and batches held all blocks of a task."""
    monkeypatch.setattr(term_blocks, "ENTRIES", 4)
    monkeypatch.setattr(term_blocks, "PART", 3)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        docs = spark.createDataFrame(ROWS, "id long, fit boolean, text string").repartition(2)
        found = vocab.tfidf(docs, F.col("fit"), "id", min_df=1, max_df=1.0)
        assert "collect_list(struct(at" not in found._jdf.queryExecution().toString()
        assert sorted((str(r.id), r.term, round(r.tfidf, 9)) for r in found.collect()) == plain(ROWS, 1, 1.0)
        assert spark.conf.get(key) in ("1b", str(BATCH_BYTES))
    finally:
        spark.conf.set(key, before)


def test_large_rows_are_flushed_one_by_one(spark):
    """Parquet held a hundred rows, of megabytes each, before it looked at their size."""

    def long(batches):
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays([pa.array([os.urandom(6 << 20)])], ["x"]) for _ in range(batch.num_rows))

    rows = spark.range(8, numPartitions=1).mapInArrow(long, "x binary")
    groups = {}
    for large in (False, True):
        written = materialize(rows, "large-rows", large_rows=large)
        groups[large] = [pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in written.inputFiles()]
        assert written.count() == 8
    assert groups[False] == [1] and groups[True][0] >= 2, groups
