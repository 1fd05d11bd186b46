"""TF-IDF, encoding, models, files and the streaming gate."""

import math
import os

import numpy as np
import pytest
from kinfold.operators import models, vocab
from kinfold.plans import build, experiment
from kinfold.sources import files, manifests
from kinfold.streaming.gate_stream import stream_gate
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

DOCS = [
    (0, "aa bb", True),
    (1, "aa cc", True),
    (2, "aa bb dd", True),
    (3, "aa bb zz zz zz", False),
    (4, "zz", False),
]


def test_tfidf_is_fitted_on_training_rows_only(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string, fit boolean")
    got = {}
    for r in vocab.tfidf(docs, F.col("fit"), "id", max_df=1.0).collect():
        got.setdefault(r.id, {})[r.term] = r.tfidf
    idf = {"aa": math.log(4 / 4) + 1, "bb": math.log(4 / 3) + 1, "aa bb": math.log(4 / 3) + 1}
    norm = math.sqrt(sum(v * v for v in idf.values()))
    assert got[3] == pytest.approx({t: v / norm for t, v in idf.items()})  # zz is unseen
    assert got[1] == pytest.approx({"aa": 1.0})
    assert 4 not in got  # nothing known: an empty vector


def test_vectors_agree_with_the_long_form(spark):
    spec = models.ModelSpec(max_df=1.0)
    docs = spark.createDataFrame(DOCS, "id long, text string, fit boolean")
    rows = models.with_terms(docs, spec)
    features = models.fit_features(rows.filter("fit"), spec)
    dense = features.transform(rows, ["id"]).select("id", vector_to_array("features").alias("v")).collect()
    long = {}
    for r in vocab.tfidf(docs, F.col("fit"), "id", max_df=1.0).collect():
        long.setdefault(r.id, []).append(r.tfidf)
    for r in dense:
        assert sorted(x for x in r.v if x) == pytest.approx(sorted(long.get(r.id, [])))


def test_encoding(spark):
    words = spark.createDataFrame([("aa", 9), ("bb", 5), ("cc", 5), ("dd", 1)], "token string, freq long")
    top = vocab.top_vocab(words, 4)
    assert {r.token: r.id for r in top.collect()} == {"aa": 2, "bb": 3}
    docs = spark.createDataFrame([(0, "aa xx bb"), (1, "aa aa aa aa"), (2, ""), (3, "bb aa bb aa bb")], "id long, text string")
    got = {r.id: (r.ids, r.length) for r in vocab.encode_sequences(docs, words, "id", vocab_size=4, max_len=4).collect()}
    assert got == {0: ([2, 1, 3, 0], 3), 1: ([2, 2, 2, 2], 4), 2: ([0, 0, 0, 0], 1), 3: ([3, 2, 3, 2], 4)}


def labelled(spark):
    """Families whose wording gives the class away; p1 is a variant of each."""
    rows = []
    for i in range(20):
        rows.append((f"p{i}", "phish", "original", None, f"verify your account now number {i} portal"))
        rows.append((f"p{i}v", "phish", "paraphrase", f"p{i}", f"please verify the account portal {i}"))
        rows.append((f"n{i}", "legit", "original", None, f"lunch meeting notes {i} from the team"))
    return spark.createDataFrame(rows, "msg_id string, label string, variant_type string, base_msg_id string, text string")


@pytest.mark.parametrize("spec", [models.ModelSpec(max_iter=30), models.ModelSpec(kind="forest", trees=40, depth=6, chars=True)])
def test_cross_validation_learns(spark, spec):
    measured = experiment.run_cv(labelled(spark), spec, [1], 2)
    rows = measured.collect()
    assert len(rows) == 4 and all(r.f1 > 0.8 for r in rows)
    assert all(r.tn + r.fp == 10 and r.fn + r.tp == 10 for r in rows)
    summary = {r.metric: r.n for r in experiment.cv_summary(measured).collect()}
    assert set(summary.values()) == {2}


def test_logistic_regression_solves_the_summed_objective(spark):
    """At the optimum of sum(w * loss) + |beta|^2 / 2 the gradient is zero."""
    spec = models.ModelSpec(max_iter=2000, tol=1e-10)
    rows = labelled(spark).withColumn("y", (F.col("label") == "phish").cast("int")).drop("base_msg_id")
    rows = models.with_terms(rows, spec)
    model = models.fit_model(rows, spec, 1)
    data = model.features.transform(rows, ["y"]).select("y", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r.x for r in data]), np.array([r.y for r in data])
    beta, intercept = model.classifier.coefficients.toArray(), model.classifier.intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    residual = weight * (1 / (1 + np.exp(-(x @ beta + intercept))) - y)
    assert np.abs(x.T @ residual + beta).max() < 1e-3
    assert abs(residual.sum()) < 1e-3


def test_weights_and_single_class(spark):
    rows = spark.createDataFrame([(1, 0)] * 3 + [(1, 1)], "fold int, y int")
    w = vocab.class_weights(rows, ["fold"]).first()
    assert (w.balanced0, w.balanced1) == (pytest.approx(4 / 6), 2.0)
    assert (w.inverse0, w.inverse1) == (pytest.approx(0.25), pytest.approx(0.75))
    with pytest.raises(ValueError, match="one class only"):
        models.class_counts(rows.filter("y = 0"))


def test_jsonl_edges(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "w") as f:
        f.write('{"msg_id": "a", "text": "é"}\n\n   \n{"msg_id": "b"}\n')
    rows = files.read_jsonl(spark, path, "msg_id string, text string").orderBy("msg_id").collect()
    assert [(r.msg_id, r.text) for r in rows] == [("a", "é"), ("b", None)]
    with open(path, "a") as f:
        f.write('{"msg_id": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, "msg_id string, text string").collect()
    assert files.read_jsonl(spark, str(tmp_path / "none"), optional=True).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none")).collect()


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [("a", 'x "quoted", and\nnew line \\ '), ("b", " lead"), ("c", None)]
    df = spark.createDataFrame(rows, "msg_id string, text string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect()))[:2] == rows[:2]


def stream_rows(spark):
    def body(i):
        return " ".join([f"w{i}"] * 130)

    rows = [(f"m{i}", body(i % 25), i) for i in range(60)] + [("short", "too short", 60)]
    return spark.createDataFrame(rows, "msg_id string, text string, ord long")


def run_stream(spark, base, schema):
    q = stream_gate(spark, f"{base}/in", f"{base}/ok", f"{base}/no", f"{base}/state", schema, files_per_batch=1)
    q.awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    base, rows = str(tmp_path), stream_rows(spark)
    rows.filter("ord < 30").coalesce(1).write.json(f"{base}/in")
    run_stream(spark, base, rows.schema)
    rows.filter("ord >= 30").coalesce(1).write.mode("append").json(f"{base}/in")
    run_stream(spark, base, rows.schema)
    run_stream(spark, base, rows.schema)  # nothing new: nothing written
    batch = build.gate_and_dedup(rows)
    accepted = spark.read.parquet(f"{base}/ok")
    assert {r.msg_id for r in accepted.collect()} == {r.msg_id for r in batch.accepted.collect()}
    rejected = spark.read.parquet(f"{base}/no")
    key = ["msg_id", "reason"]
    assert rejected.count() == batch.rejected.count() == 36
    assert rejected.select(key).exceptAll(batch.rejected.select(key)).count() == 0


def test_replayed_batch_does_not_double(spark, tmp_path):
    """A batch whose commit was lost runs again and overwrites itself."""
    base, rows = str(tmp_path), stream_rows(spark)
    rows.coalesce(1).write.json(f"{base}/in")
    run_stream(spark, base, rows.schema)
    before = spark.read.parquet(f"{base}/ok").count()
    for name in os.listdir(f"{base}/state/commits"):
        os.remove(f"{base}/state/commits/{name}")
    run_stream(spark, base, rows.schema)
    assert spark.read.parquet(f"{base}/ok").count() == before == 25


def test_logs_are_appended_by_date_and_stage(spark, tmp_path):
    path = str(tmp_path / "log")
    gated = build.gate_and_dedup(stream_rows(spark))
    for day in ("2026-01-01", "2026-01-02"):
        build.append_log(build.reject_log(gated, "build", day), path)
    build.append_log(build.run_log(gated, "fill", "2026-01-02").withColumn("reason", F.lit(None).cast("string")), path)
    log = spark.read.parquet(path)
    assert log.filter("stage = 'build'").count() == 72
    assert log.filter("stage = 'fill' and date = '2026-01-02'").count() == 25


def test_known_hashes_reject_a_second_run(spark):
    rows = stream_rows(spark)
    first = build.gate_and_dedup(rows)
    again = build.gate_and_dedup(rows, known=first.accepted)
    assert again.accepted.count() == 0
    assert again.rejected.filter("reason = 'duplicate_hash'").count() == 60


def test_provenance_and_report(spark):
    rows = build.with_provenance(
        build.finalize(
            stream_rows(spark).select(
                "msg_id", "text", "ord",
                F.lit("phish").alias("label"), F.lit("impersonation").alias("scenario"),
                F.lit("original").alias("variant_type"), F.lit("na").alias("paraphrase_strategy"),
                F.lit(None).cast("string").alias("text_hash"), F.lit(0).alias("length_words"),
            )
        ),
        "m", 0.85, 0.95, 900, "2026-01-01",
    )
    first = rows.first()
    assert (first.generation_model, first.temperature, first.max_output_tokens) == ("m", 0.85, 900)
    assert str(first.date_generated) == "2026-01-01"
    report = manifests.manifest_markdown(manifests.dataset_manifest(rows, {"model": "m"}))
    assert "- phish: 26" in report and "- median: 130" in report and "- model: m" in report
