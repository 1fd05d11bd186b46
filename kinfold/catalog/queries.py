"""One query per operator, each over its whole input tables.

Every callable takes (spark, folder) and returns a DataFrame.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FILL_RULES, NEGATIVE_SCENARIO, REQUIRED_COLUMNS, SCENARIOS
from ..functions import ids, labels, text, tokens
from ..functions.features import FEATURES, numeric_features
from ..functions.gate import gate_reason
from ..operators import answer_store, checks, dedup, families, hashed, joins, metrics, models, split, vocab, votes
from ..plans import build, experiment
from ..session import materialize, new_path
from ..sources import files, manifests, tables
from ..streaming.dedup_stream import dedup_stream
from ..streaming.gate_stream import stream_gate

SEED = 9
SEEDS = [1, 2, 3]
SWEEP_SEEDS = list(range(1, 11))
K = 5
TEST_RATIO = 0.2
VAL_RATIO = 0.2
SAMPLE_CAP = 40
VOCAB_SIZE = 20000
MAX_LEN = 256
BATCHES = 3
BUCKETS = 8
DAYS, DELAY, FIRST_DAY = 8, "1 day", datetime.datetime(2026, 1, 1)
CV_SEEDS = [9]
QUOTA, NEGATIVE_QUOTA = 400, 1600
MODEL_NAME, PROMPT_VERSION = "scorer", "v1"
CV_SPEC = models.ModelSpec(kind="logreg")
SWEEP_SPEC = models.ModelSpec(kind="logreg", bits=16)
FOREST_SPEC = models.ModelSpec(kind="forest")
GRADIENT = 1e-3  # per row, of a solved fit

REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict:
    return dict(REGISTRY)


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder)


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return tables.cleaned(tables.messages(spark, folder))


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned messages without their text, written once: what reads it several
    times cleans and hashes no text again."""
    return materialize(_cleaned(spark, folder).drop("text"), "hashed")


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return families.with_groups(tables.messages(spark, folder))


def _labelled_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "labels").select("doc_id")


# --- sources and sinks ---


@query
def read_jsonl(spark, folder):
    path = new_path(spark, "jsonl")
    files.write_jsonl(_documents(spark, folder).select("doc_id", "lang", "source", "text"), path)
    schema = "doc_id long, lang string, source string, text string"
    return files.read_jsonl(spark, path, schema)


@query
def jsonl_roundtrip(spark, folder):
    rows = tables.messages(spark, folder)
    path = new_path(spark, "jsonl")
    files.write_jsonl(rows, path, keep_nulls=True)
    return files.read_jsonl(spark, path, rows.schema)


@query
def append_jsonl(spark, folder):
    """A file per role, each added to what is there; null fields are left out."""
    rows = tables.messages(spark, folder)
    path = new_path(spark, "jsonl")
    for kept in (labels.is_original(), labels.is_variant(), labels.is_negative()):
        files.write_jsonl(rows.filter(kept), path, append=True)
    return files.read_jsonl(spark, path, rows.schema)


@query
def read_sources(spark, folder):
    """Three sources in files, read in order, merged, back-filled and deduplicated."""
    rows = tables.messages(spark, folder).withColumns(
        {"length_words": F.lit(0), "text_hash": F.lit(None).cast("string"), "temperature": F.lit(0.85)}
    )
    rows = rows.withColumn("date_generated", F.lit("2026-01-01").cast("date")).drop("doc_id")
    base = new_path(spark, "sources")
    roles = {"originals": labels.is_original(), "variants": labels.is_variant(), "negatives": labels.is_negative()}
    for name, kept in roles.items():
        part = rows.filter(kept).repartitionByRange("ord").sortWithinPartitions("ord").drop("ord")
        files.write_jsonl(part, f"{base}/{name}")
    merged = files.read_sources(spark, [f"{base}/{name}" for name in roles])
    kept = build.finalize(merged)
    return kept.select("msg_id", "label", "temperature", "date_generated", "length_words", "text_hash", "text")


@query
def csv_roundtrip(spark, folder):
    rows = tables.messages(spark, folder)
    path = new_path(spark, "csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query
def merge_sources(spark, folder):
    rows = tables.messages(spark, folder).withColumnRenamed("doc_id", "pos").drop("ord")
    merged = dedup.merge_sources(
        rows.filter(labels.is_original()).drop("base_msg_id"),
        rows.filter(labels.is_variant()),
        rows.filter(labels.is_negative()).drop("base_msg_id"),
    )
    return merged.select("msg_id", "base_msg_id", "ord", "text")


@query
def reject_log(spark, folder):
    gated = build.gate_and_dedup(tables.messages(spark, folder))
    return build.reject_log(gated, "build").drop("date")


@query
def run_log(spark, folder):
    gated = build.gate_and_dedup(tables.messages(spark, folder))
    return build.run_log(gated, "build").drop("date")


@query
def provenance(spark, folder):
    made = build.with_provenance(tables.messages(spark, folder), MODEL_NAME, 0.85, 0.95, 900, "2026-01-01")
    return made.select(
        "msg_id", "source", "prompt_id", "generation_model", "temperature", "top_p", "max_output_tokens", "date_generated"
    )


@query
def required_columns(spark, folder):
    """What each message lacks to be used: checked by name for the table, by row for values."""
    rows = labels.require_columns(tables.messages(spark, folder))
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in (*REQUIRED_COLUMNS, "base_msg_id")]
    return rows.select("msg_id", F.array_join(F.array_compact(F.array(*missing)), ",").alias("missing"))


@query
def split_manifest(spark, folder):
    rows = tables.messages(spark, folder)
    sides = split.holdout_sides(rows, SEED, TEST_RATIO)
    placed = split.apply_sides(rows, sides)
    return manifests.split_manifest(rows, sides, placed, dataset="documents", seed=SEED, test_ratio=TEST_RATIO)


@query
def split_document(spark, folder):
    """The manifest as one document, written, and its id lists read back."""
    rows = tables.messages(spark, folder)
    sides = split.holdout_sides(rows, SEED, TEST_RATIO)
    path = new_path(spark, "split")
    manifest = manifests.split_manifest(rows, sides, split.apply_sides(rows, sides), seed=SEED)
    manifests.write_split_document(manifest, path)
    return manifests.read_split_document(spark, path)


@query
def dataset_manifest(spark, folder):
    return manifests.dataset_manifest(build.finalize(_cleaned(spark, folder)))


@query
def metrics_json(spark, folder):
    record = _records(spark, folder)
    path = new_path(spark, "metrics")
    record.select("record.*").write.json(path)
    stored = spark.read.schema(record.select("record.*").schema).json(path)
    fold = stored.select("model", "dataset", "seed", F.explode("fold_results").alias("f"))
    return _round(
        fold.select(
            "model",
            "dataset",
            "seed",
            "f.fold",
            *[f"f.{c}" for c in manifests.SIZES],
            F.col("f.condition_A.f1").alias("A_f1"),
            "f.delta_f1",
        ),
        "A_f1",
        "delta_f1",
    )


def _records(spark, folder, seeds=SEEDS):
    placed = _folds(spark, folder, seeds)
    measured = _metrics(spark, folder, seeds)
    folds = metrics.ab_delta(measured)
    settings = {"dataset": "documents", "training_rule": "negatives and originals"}
    summary = metrics.fold_summary(folds)
    return manifests.metrics_record(measured, folds, summary, MODEL_NAME, split.fold_sizes(placed), settings)


@query
def json_dotpath(spark, folder):
    paths = ["aggregate.delta_f1.mean", "aggregate.A_recall.std"]
    return _round(manifests.sweep_values(_records(spark, folder), paths), "value")


@query
def sweep_record(spark, folder):
    """The summary record of a sweep over two chosen paths, read back as rows."""
    paths = ["aggregate.delta_f1.mean", "aggregate.delta_recall.mean"]
    values = manifests.sweep_values(_records(spark, folder), paths)
    record = manifests.sweep_record(values, MODEL_NAME, K)
    rows = record.select("model", "folds", F.size("seeds").alias("n_seeds"), F.inline("rows"))
    read = [F.get_json_object("values", f"$['{p}']").cast("double").alias(p.split(".")[1]) for p in paths]
    return _round(rows.select("model", "folds", "n_seeds", "seed", *read), "delta_f1", "delta_recall")


@query
def cache_key(spark, folder):
    return _cleaned(spark, folder).select(
        "msg_id", text.cache_key(F.col("text"), MODEL_NAME, PROMPT_VERSION).alias("cache_key")
    )


# --- projections ---


@query
def normalize_text(spark, folder):
    return _documents(spark, folder).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query
def word_count(spark, folder):
    return _documents(spark, folder).select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query
def text_hash(spark, folder):
    return _documents(spark, folder).select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query
def quality_gate(spark, folder):
    rows = _cleaned(spark, folder)
    return rows.select("msg_id", gate_reason(F.col("text"), F.col("length_words")).alias("reason"))


@query
def quality_gate_fill(spark, folder):
    rows = _cleaned(spark, folder)
    return rows.select("msg_id", gate_reason(F.col("text"), F.col("length_words"), FILL_RULES).alias("reason"))


@query
def truncation_gate(spark, folder):
    """Documents beyond 1,500 characters stand for cut-off answers."""
    finish = F.when(F.col("n_chars") > 1500, "FinishReason.MAX_TOKENS").otherwise("FinishReason.STOP")
    docs = tables.cleaned(_documents(spark, folder))
    return docs.select(
        "doc_id", gate_reason(F.col("text"), F.col("length_words"), finish_reason=finish).alias("reason")
    )


@query
def make_ids(spark, folder):
    docs = _documents(spark, folder)
    return docs.select(
        "doc_id",
        ids.phish_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("positive_id"),
        ids.legit_id(F.col("doc_id")).alias("negative_id"),
    )


@query
def parse_ids(spark, folder):
    """Null parts where an id has another shape, as negatives have."""
    key = F.col("msg_id")
    known = ids.id_index(key).isNotNull()
    return tables.messages(spark, folder).select(
        "msg_id",
        F.when(known, ids.id_scenario(key)).alias("id_scenario"),
        ids.id_index(key).alias("id_index"),
        F.when(known, ids.id_variant(key)).alias("id_variant"),
        F.when(known, ids.base_id(key)).alias("base_id"),
    )


@query
def label_to_int(spark, folder):
    return tables.messages(spark, folder).select("msg_id", labels.label_to_int(F.col("label")).alias("y"))


@query
def group_id(spark, folder):
    return tables.messages(spark, folder).select("msg_id", labels.group_id().alias("group_id"))


@query
def backfill(spark, folder):
    """Stored hash and length absent, empty or zero in turn; others must stay."""
    place = F.col("doc_id") % 7
    stored = tables.messages(spark, folder).withColumns(
        {
            "text_hash": F.when(place == 1, "").when(place != 0, F.md5("text")),
            "length_words": F.when(place == 2, 0).when(place != 3, F.col("doc_id").cast("int") + 1),
        }
    )
    return dedup.backfill(stored).select("msg_id", "text_hash", "length_words")


@query
def threshold_scores(spark, folder):
    scored = tables.predictions(tables.messages(spark, folder), SEEDS)
    other = text.hash_score(F.lit(0), F.col("msg_id"))
    return scored.select(
        "seed",
        "msg_id",
        metrics.threshold(F.col("score")).alias("pred"),
        metrics.argmax_class(other, F.col("score")).alias("pred_argmax"),
    )


# --- filters ---


@query
def role_partition(spark, folder):
    return tables.messages(spark, folder).select("msg_id", labels.role().alias("role"))


@query
def train_rule(spark, folder):
    return tables.messages(spark, folder).filter(labels.trains()).select("msg_id", "label")


@query
def condition_a(spark, folder):
    return tables.messages(spark, folder).filter(labels.in_condition("A")).select("msg_id", "label")


@query
def condition_b(spark, folder):
    return tables.messages(spark, folder).filter(labels.in_condition("B")).select("msg_id", "label")


# --- joins ---


def _folds(spark, folder, seeds):
    return experiment.assign_folds(tables.messages(spark, folder), seeds, K)


@query
def fold_rows(spark, folder):
    return _folds(spark, folder, SEEDS).select("seed", "fold", "msg_id", "group_id")


@query
def skip_existing(spark, folder):
    rows = tables.messages(spark, folder)
    existing = rows.join(_labelled_ids(spark, folder), "doc_id", "left_semi")
    return joins.skip_existing(rows, existing).select("msg_id")


@query
def reject_known_hash(spark, folder):
    rows = _hashed(spark, folder).select("msg_id", "doc_id", "ord", "text_hash")
    known = rows.join(_labelled_ids(spark, folder), "doc_id", "left_semi")
    return joins.reject_known(rows, known).select("msg_id", "text_hash")


@query
def orphan_variants(spark, folder):
    kept = materialize(dedup.dedup_first(_cleaned(spark, folder).drop("text")), "firsts")
    return families.orphan_variants(kept).select("msg_id", "base_msg_id")


@query
def family_rows(spark, folder):
    rows = families.family_rows(_cleaned(spark, folder))
    return rows.select(
        "base_msg_id", "msg_id", F.length("text").alias("n_chars"), F.length("base_text").alias("base_chars")
    )


@query
def missing_variants(spark, folder):
    return families.missing_variants(materialize(dedup.dedup_first(_cleaned(spark, folder).drop("text")), "firsts"))


@query
def quota_gap(spark, folder):
    kept = dedup.dedup_first(_cleaned(spark, folder).drop("text"))
    targets = dict.fromkeys(SCENARIOS, QUOTA)
    return families.quota_gap(kept, targets, NEGATIVE_SCENARIO, NEGATIVE_QUOTA).select("scenario", "idx", "msg_id")


@query
def leakage_check(spark, folder):
    """A split by row instead of by family: the check must find its leaks."""
    score = text.hash_score(F.lit(SEED), F.col("msg_id"))
    test = F.when(labels.is_variant(), "test_paraphrase").otherwise("test_original")
    rows = tables.messages(spark, folder).withColumn("split", F.when(score < TEST_RATIO, test).otherwise("train"))
    return checks.leakage_check(rows)


def _uses_and_cache(spark, folder):
    """(msg_id, cache_key) of all messages, and the answers known already: those of
    the texts of labelled documents. Texts are keyed once."""
    key = text.cache_key(F.col("text"), MODEL_NAME, PROMPT_VERSION).alias("cache_key")
    uses = materialize(_cleaned(spark, folder).select("msg_id", "doc_id", key), "uses")
    known = uses.join(tables.table(spark, folder, "labels"), "doc_id")
    return uses.drop("doc_id"), known.groupBy("cache_key").agg(F.max("quality").alias("answer"))


@query
def cache_lookup(spark, folder):
    found = votes.cache_lookup(*_uses_and_cache(spark, folder))
    return found.select("msg_id", "cache_key", "hit", F.coalesce("answer", F.lit(-1)).alias("answer"))


@query
def cache_misses(spark, folder):
    return votes.cache_misses(*_uses_and_cache(spark, folder))


@query
def cache_stats(spark, folder):
    return votes.cache_stats(*_uses_and_cache(spark, folder))


@query
def cache_upsert(spark, folder):
    """Misses are answered by three votes each, the answers merged in and written."""
    uses, cache = _uses_and_cache(spark, folder)
    misses = votes.cache_misses(uses, cache).withColumnRenamed("cache_key", "msg_id")
    voted = votes.majority_vote(tables.votes(misses), "msg_id", 3)
    answers = voted.select(
        F.col("msg_id").alias("cache_key"),
        (F.col("label") == "phish").cast("long").alias("answer"),
        F.col("vote_counts")["phish"].alias("n_phish"),
        F.array_join("raw_labels", ",").alias("raw_labels"),
    )
    path = new_path(spark, "cache")
    votes.write_cache(votes.save_answers(cache.withColumn("answer", F.col("answer").cast("long")), answers), path)
    return spark.read.parquet(path)


@query
def cache_store(spark, folder):
    """The same through a store in buckets: the misses are answered and added in two parts,
    a merge between them; the second part comes by a session that only knows the path."""
    uses, cache = _uses_and_cache(spark, folder)
    cache = cache.select("cache_key", F.col("answer").cast("long").alias("answer"))
    cache = cache.withColumns({"n_phish": F.lit(None).cast("long"), "raw_labels": F.lit(None).cast("string")})
    path = new_path(spark, "store")
    store = answer_store.AnswerStore.create(cache, path, buckets=BUCKETS)
    for half in (0, 1):
        misses = store.misses(uses.filter(F.pmod(F.crc32(F.col("cache_key").cast("binary")), F.lit(2)) == half))
        voted = votes.majority_vote(tables.votes(misses.withColumnRenamed("cache_key", "msg_id")), "msg_id", 3)
        answers = voted.select(
            F.col("msg_id").alias("cache_key"),
            (F.col("label") == "phish").cast("long").alias("answer"),
            F.col("vote_counts")["phish"].alias("n_phish"),
            F.array_join("raw_labels", ",").alias("raw_labels"),
        )
        store.upsert(answers).merge()
        store = answer_store.AnswerStore.attach(spark, path)
    return store.read()


# --- aggregations ---


@query
def group_table(spark, folder):
    return families.group_table(_grouped(spark, folder))


@query
def value_counts(spark, folder):
    return metrics.value_counts(tables.messages(spark, folder))


@query
def length_stats(spark, folder):
    return _round(metrics.length_stats(_cleaned(spark, folder)), "mean")


@query
def family_sizes(spark, folder):
    return families.family_sizes(tables.messages(spark, folder))


def _scored(spark, folder, seeds=SEEDS):
    rows = tables.messages(spark, folder)
    scored = tables.predictions(rows, seeds).withColumn("pred", metrics.threshold(F.col("score"))).drop("score")
    return metrics.eval_predictions(_folds(spark, folder, seeds), scored)


def _metrics(spark, folder, seeds=SEEDS):
    return metrics.binary_metrics(_scored(spark, folder, seeds))


@query
def eval_predictions(spark, folder):
    return _scored(spark, folder).select("seed", "fold", "cond", "msg_id", "y", "pred")


@query
def binary_metrics(spark, folder):
    return _round(_metrics(spark, folder), "accuracy", "precision", "recall", "f1", "fpr")


@query
def confusion_pct(spark, folder):
    return _round(metrics.confusion_pct(metrics.confusion(_scored(spark, folder))), "pct")


@query
def ab_delta(spark, folder):
    wide = metrics.ab_delta(_metrics(spark, folder))
    return _round(wide, *[c for c in wide.columns if c not in ("seed", "fold")])


def _fold_deltas(spark, folder, seeds=SEEDS):
    return metrics.ab_delta(_metrics(spark, folder, seeds))


@query
def fold_summary(spark, folder):
    return _round(metrics.fold_summary(_fold_deltas(spark, folder)), "mean", "std")


@query
def paired_ttest(spark, folder):
    tested = metrics.paired_ttest(_fold_deltas(spark, folder))
    return _round(tested, "mean", "sd", "se", "t", "p", digits=8)


@query
def seed_sweep(spark, folder):
    return _round(metrics.seed_sweep(_fold_deltas(spark, folder, SWEEP_SEEDS)), "value")


@query
def chart_series(spark, folder):
    return _round(metrics.chart_series(_fold_deltas(spark, folder)), "y", "err")


@query
def majority_vote(spark, folder):
    voted = votes.majority_vote(tables.votes(tables.messages(spark, folder)), "msg_id", 3)
    return _round(
        voted.select(
            "msg_id",
            "label",
            "confidence",
            F.col("vote_counts")["phish"].alias("n_phish"),
            F.col("vote_counts")["legit"].alias("n_legit"),
            F.array_join("raw_labels", ",").alias("raw_labels"),
        ),
        "confidence",
    )


@query
def token_freq(spark, folder):
    return vocab.token_freq(_documents(spark, folder))


@query
def doc_freq(spark, folder):
    return vocab.doc_freq(_documents(spark, folder), tokens.word_ngrams(F.col("text")))


@query
def class_weights(spark, folder):
    train = split.fold_train_rows(_folds(spark, folder, [SEED]), K)
    weights = vocab.class_weights(train, ["seed", "fold"])
    return _round(weights, "balanced0", "balanced1", "inverse0", "inverse1")


@query
def fold_sizes(spark, folder):
    return split.fold_sizes(_folds(spark, folder, SEEDS))


# --- dedup, folds, splits, samples ---


@query
def dedup_first(spark, folder):
    kept = dedup.dedup_first(_cleaned(spark, folder))
    return kept.select("msg_id", "label", "text_hash", "length_words", "text")


@query
def flag_duplicates(spark, folder):
    rows = _cleaned(spark, folder).select("msg_id", "text_hash", "ord")
    return joins.flag_duplicates(rows).select("msg_id", "status")


@query
def gate_and_dedup(spark, folder):
    gated = build.gate_and_dedup(tables.messages(spark, folder))
    return gated.accepted.select("msg_id", "reason").unionByName(gated.rejected.select("msg_id", "reason"))


@query
def finalize(spark, folder):
    rows = tables.messages(spark, folder).withColumns(
        {"text_hash": F.lit(None).cast("string"), "length_words": F.lit(0)}
    )
    return build.finalize(rows).select("msg_id", "text_hash", "length_words", "text")


@query
def group_kfold(spark, folder):
    return split.group_kfold(families.group_table(_grouped(spark, folder)), SEEDS, K)


@query
def holdout_split(spark, folder):
    return split.holdout_split(tables.messages(spark, folder), SEED, TEST_RATIO).select("split", "msg_id")


@query
def replay_split(spark, folder):
    rows = tables.messages(spark, folder)
    sides = split.holdout_sides(rows, SEED, TEST_RATIO)
    path = new_path(spark, "split")
    manifests.write_split_manifest(manifests.split_manifest(rows, sides, split.apply_sides(rows, sides)), path)
    return split.apply_sides(rows, manifests.read_split_ids(spark, path)).select("split", "msg_id", "family_id")


@query
def train_val_split(spark, folder):
    train = split.fold_train_rows(_folds(spark, folder, [SEED]), K)
    return split.train_val_split(train, SEED, VAL_RATIO, ["y"], ["fold"]).select("fold", "msg_id", "y", "part")


@query
def train_val_plain(spark, folder):
    train = split.fold_train_rows(_folds(spark, folder, [SEED]), K)
    return split.train_val_split(train, SEED, VAL_RATIO, within=["fold"]).select("fold", "msg_id", "part")


@query
def capped_sample(spark, folder):
    test = metrics.by_condition(_folds(spark, folder, [SEED]))
    return split.capped_sample(test, SAMPLE_CAP, SEED, ["fold", "cond"]).select("fold", "cond", "msg_id")


@query
def balanced_resample(spark, folder):
    rows = tables.messages(spark, folder).select("msg_id", labels.label_to_int(F.col("label")).alias("y"))
    return split.balanced_resample(rows, SEED).select("msg_id", "y", "n_draws")


# --- sorts, sets ---


@query
def sort_by_index(spark, folder):
    originals = tables.messages(spark, folder).filter(labels.is_original())
    return families.sort_by_index(originals).select("scenario", ids.id_index(F.col("msg_id")).alias("idx"), "msg_id")


@query
def top_vocab(spark, folder):
    return vocab.top_vocab(vocab.token_freq(_documents(spark, folder)), VOCAB_SIZE)


@query
def disjoint_check(spark, folder):
    """Texts on both sides of a split by family: copies that crossed it."""
    rows = split.holdout_split(_cleaned(spark, folder).drop("text"), SEED, TEST_RATIO)
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    return checks.shared_keys(train, test, "text_hash")


# --- text features ---


@query
def numeric_features_(spark, folder):
    rows = numeric_features(_documents(spark, folder).select("doc_id", "text"))
    return _round(rows.select("doc_id", *FEATURES), "avg_word_len", "caps_ratio", "digit_ratio", "punct_ratio")


REGISTRY["numeric_features"] = REGISTRY.pop("numeric_features_")


@query
def word_ngrams(spark, folder):
    return vocab.term_counts(_documents(spark, folder), "doc_id", tokens.folded(F.col("text")), tokens.ngrams_of)


@query
def char_wb_ngrams(spark, folder):
    """Each document's n-grams as a digest of their sorted (n-gram, count) list."""
    return vocab.char_wb_digests(_documents(spark, folder), "doc_id")


@query
def tfidf(spark, folder):
    rows = tables.messages(spark, folder)
    return _round(vocab.tfidf(rows, labels.trains(), "msg_id"), "tfidf")


@query
def seq_tokens(spark, folder):
    found = tokens.sequence_tokens(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("digest")
    )


@query
def encode_sequences(spark, folder):
    docs = _documents(spark, folder)
    freq = vocab.token_freq(docs)
    encoded = vocab.encode_sequences(docs, freq, "doc_id", vocab_size=VOCAB_SIZE, max_len=MAX_LEN)
    return encoded.select("doc_id", F.array_join("ids", " ").alias("ids"), "length")


def _model_rows(spark, folder, spec):
    rows = families.with_groups(tables.labelled_messages(spark, folder), family="family_id")
    rows = rows.select("msg_id", "label", "variant_type", "y", "text")
    return materialize(models.with_terms(rows, spec), "terms")


@query
def assemble_features(spark, folder):
    """The features of all labelled messages that are not zero, by block and term."""
    rows = _model_rows(spark, folder, FOREST_SPEC)
    return _round(models.assembled(rows, labels.trains(), FOREST_SPEC), "value", digits=6)


@query
def fit_logreg(spark, folder):
    """Rows predicted per class, and whether the fit of all labelled rows, in the hashed
    space, came to its end before the last step, with hardly any gradient left."""
    rows = _model_rows(spark, folder, CV_SPEC).withColumnRenamed("word_terms", "terms")
    model = hashed.fit_hashed(rows, F.array(F.coalesce(labels.trains(), F.lit(False))), CV_SPEC.hashed)
    solved = model.iterations[0] < CV_SPEC.max_iter and model.gradient[0] < GRADIENT
    scored = model.predict(rows, ["msg_id", "y"])
    return scored.groupBy("y").agg(
        F.count("pred").alias("n_rows"),
        F.lit(int(model.n_rows[0])).cast("long").alias("n_fitted"),
        F.lit(bool(solved)).alias("solved"),
        # Both classes are told apart on the rows fitted.
        (F.avg((F.col("pred") == F.col("y")).cast("double")) > 0.5).alias("learned"),
    )


@query
def hashed_collisions(spark, folder):
    """Distinct terms of the labelled messages; whether few enough of them share a slot
    of the hashed space, next to what chance gives."""
    spec = CV_SPEC.hashed
    rows = _model_rows(spark, folder, CV_SPEC).withColumnRenamed("word_terms", "terms")
    found = hashed.collisions(rows, spec)
    load = F.col("n_terms") / spec.width
    expected = spec.width * (1 - F.exp(-load))
    return found.select("n_terms", (F.abs(F.col("n_slots") - expected) < 0.02 * expected + 10).alias("as_by_chance"))


@query
def fit_forest(spark, folder):
    """Rows predicted per class by the forest, its number of trees and that none is too deep."""
    rows = _model_rows(spark, folder, FOREST_SPEC)
    model = models.fit_model(rows.filter(labels.trains()), FOREST_SPEC, SEED)
    forest = model.forest
    scored = model.predict(rows, ["msg_id", "y"])
    return scored.groupBy("y").agg(
        F.count("pred").alias("n_rows"),
        F.lit(model.n_rows).cast("long").alias("n_fitted"),
        F.lit(forest.trees).cast("long").alias("n_trees"),
        F.lit(forest.depth <= FOREST_SPEC.depth).alias("in_depth"),
        (F.avg((F.col("pred") == F.col("y")).cast("double")) > 0.5).alias("learned"),
    )


def _measured(spark, folder, spec, seeds):
    rows = tables.labelled_messages(spark, folder)
    measured = experiment.run_cv(rows, spec, seeds, K, family="family_id")
    return measured.select(
        "seed",
        "fold",
        "cond",
        (F.col("tn") + F.col("fp")).alias("n_negative"),
        (F.col("fn") + F.col("tp")).alias("n_positive"),
        F.forall(F.array("accuracy", "precision", "recall", "f1"), lambda x: x.between(0, 1)).alias("in_range"),
    )


@query
def cv_experiment(spark, folder):
    """Rows tested per seed, fold, condition and class; metrics are in range, and A
    and B share their negatives."""
    return _measured(spark, folder, CV_SPEC, CV_SEEDS)


@query
def cv_seeds(spark, folder):
    """The same for ten seeds of five folds, whose fifty models are fitted together."""
    return _measured(spark, folder, SWEEP_SPEC, SWEEP_SEEDS)


@query
def stream_gate_(spark, folder):
    """Files without `ord` in, several micro-batches, and each row's fate."""
    base = new_path(spark, "stream")
    rows = tables.messages(spark, folder)
    for part in range(BATCHES):
        # Ranges in files whose names are in order: no task holds a batch.
        lines = rows.filter(F.col("ord") % BATCHES == part).repartitionByRange("ord").sortWithinPartitions("ord")
        files.write_jsonl(lines.drop("doc_id", "ord"), f"{base}/in", append=True)
        run = stream_gate(spark, f"{base}/in", f"{base}/accepted", f"{base}/rejected", f"{base}/state")
        run.awaitTermination()
    accepted = spark.read.schema("msg_id string").parquet(f"{base}/accepted")
    rejected = spark.read.schema("msg_id string, reason string").parquet(f"{base}/rejected")
    fates = accepted.select("msg_id", F.lit("ok").alias("fate"))
    return fates.unionByName(rejected.select("msg_id", F.col("reason").alias("fate")))


REGISTRY["stream_gate"] = REGISTRY.pop("stream_gate_")


@query
def stream_first_within(spark, folder):
    """Messages of eight days, a file and a micro-batch each; the copies of a text that
    come while it is remembered go. Two runs, the second goes on from the first."""
    base = new_path(spark, "first-within")
    day = F.col("doc_id") % DAYS
    rows = _hashed(spark, folder).select("doc_id", "text_hash", F.timestamp_add("DAY", day, F.lit(FIRST_DAY)).alias("ts"))
    rows = materialize(rows, "days")
    for number in range(DAYS):
        files.write_jsonl(rows.filter(day == number).coalesce(1), f"{base}/in", append=True)
        if number in (DAYS // 2, DAYS - 1):
            run = dedup_stream(
                *[spark, f"{base}/in", f"{base}/out", f"{base}/state", rows.schema, "ts", DELAY, ["text_hash"]],
                files_per_batch=1,
            )
            run.awaitTermination()
    found = spark.read.schema(rows.schema).parquet(f"{base}/out")
    return found.select("text_hash", F.date_diff("ts", F.lit(FIRST_DAY)).alias("day"))
