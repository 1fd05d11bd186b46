"""Stages of the pipeline next to plain Python, and its whole run on a small table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import plain
from pyspark.sql import functions as F

from kinfold.llm import language

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_what_plain_python_keeps(spark, messy, tmp_path):
    docs = messy.select(*COLUMNS)
    told = corpus_pipeline.language_id(spark, docs, "")
    assert told.columns == COLUMNS
    letters = [(i, t) for i, t in kept(docs) if t and any(c.isalpha() for c in t)]
    assert Counter(kept(told)) == Counter(letters)

    single = corpus_pipeline.exact_dedup(spark, told, "").persist()
    assert single.columns == COLUMNS
    groups = plain.exact_groups(letters)
    assert sorted(plain.SPACES.sub(" ", t) for _, t in kept(single)) == sorted(
        {plain.SPACES.sub(" ", t) for _, t in letters}
    )
    least = {sha: keep for _, keep, _, sha in groups}
    assert all(i == least[plain.sha(plain.SPACES.sub(" ", t))] for i, t in kept(single))

    apart = corpus_pipeline.near_dedup(spark, single, "").persist()
    assert apart.columns == COLUMNS
    rows = kept(single)
    classes = plain.near_classes([((i is None, i or 0, t), t) for i, t in rows])
    assert len(kept(apart)) == len({c for _, _, c in classes})
    ids = [i for i, _ in kept(apart)]
    assert 10 in ids and 13 not in ids and 14 in ids

    cut = corpus_pipeline.suffix_dedup(spark, apart, "").persist()
    assert cut.columns == COLUMNS and cut.count() == apart.count()
    gone = {i: n for i, _, n, _, _ in plain.repeated(kept(apart))}
    text = dict(kept(apart))
    for i, t in kept(cut):
        if i in (15, 16, 17, 24):
            assert len(text[i].encode()) - len(t.encode()) == gone[i]
    assert cut.filter(F.length("text") != F.col("n_chars")).count() == 0

    packed = corpus_pipeline.pack(spark, cut, "")
    plain.pieces_fit(kept(cut), [tuple(r) for r in packed.collect()])


def test_whole_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert 0 < len(ids) <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and corpus_pipeline.ORACLE_SQL is None


def test_model_of_no_documents_rejects_all(spark, empty):
    assert language.train(empty).languages == []
    assert corpus_pipeline.language_id(spark, empty, "").count() == 0


def test_queries_are_registered_and_match_their_sql(spark):
    import __spark_entry__ as entry
    from compare import compare, connect

    from kinfold.llm import catalog

    names = set(catalog.queries())
    assert {n.split("_")[0] for n in names} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert names <= set(entry.queries())
    folder = "/root/testdata/sf0.001"
    for name, sql in catalog.oracle_sql().items():
        assert compare(entry.queries()[name](spark, folder), connect(folder), sql) == ""


def test_language_stage_sends_a_text_once(spark, messy, monkeypatch):
    """Rows and their texts went to the workers as two copies and came back with one."""
    docs = messy.select(*COLUMNS)
    sent = []
    whole = language.identify
    monkeypatch.setattr(language, "identify", lambda df, *a, **b: (sent.append(df.schema), whole(df, *a, **b))[1])
    told = Counter(map(tuple, corpus_pipeline.language_id(spark, docs, "").collect()))
    monkeypatch.setattr(language, "SLICE_BYTES", 100)
    assert Counter(map(tuple, corpus_pipeline.language_id(spark, docs, "").collect())) == told
    texts = [f for s in sent for f in (*s.names, *s["doc"].dataType.names) if f in ("text", "body")]
    assert len(texts) == len(sent) == 2
