"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Each text is an independent statement of what the query must return. Shared
views are common table expressions; a query lists the ones it needs.
"""

from __future__ import annotations

from ..config import MAX_WORDS, MIN_WORDS, NEGATIVE_SCENARIO, SCENARIOS, STRATEGIES
from ..functions.features import FEATURES, KEYWORDS
from . import queries as q

STRIDE = 1 << 56
BLANKS = r"E' \t\n\r\x0b\x0c'"
_SCENARIO = f"list_extract({list(SCENARIOS)}, (doc_id // 7) % 4 + 1)"
_INDEX = "printf('%03d', doc_id // 7)"
_STRATEGY = "CASE doc_id % 7 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(STRATEGIES.values(), start=1)
) + " ELSE 'na' END"


def _normalized(column: str) -> str:
    lf = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    blanks = rf"regexp_replace({lf}, '[ \t]+', ' ', 'g')"
    return rf"trim(regexp_replace({blanks}, '\n{{3,}}', E'\n\n', 'g'), {BLANKS})"


def _words(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '\S+'))::INT"


def _hash_score(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5({seed} || ':' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def _gate(text: str, words: str, fill: bool = False, finish: str | None = None) -> str:
    low = f"lower({text})"
    phrases = (
        f"WHEN contains({low}, 'as an ai') THEN 'meta'"
        if fill
        else f"WHEN contains({low}, 'as an ai') OR (contains({low}, 'i can''t') AND contains({low}, 'email'))"
        " THEN 'meta_or_refusal'"
        f" WHEN contains({low}, 'this is a simulation') OR contains({low}, 'for research') THEN 'meta_simulation'"
    )
    cut = f"WHEN {finish} LIKE '%MAX\\_TOKENS' ESCAPE '\\' THEN 'truncated_max_tokens'" if finish else ""
    return (
        f"CASE {cut} WHEN {text} = '' THEN 'empty'"
        f" WHEN {words} < {MIN_WORDS} THEN 'too_short(' || {words} || ')'"
        f" WHEN {words} > {MAX_WORDS} THEN 'too_long(' || {words} || ')' {phrases} ELSE 'ok' END"
    )


def _tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[^\s]')"


def _ngrams(text: str) -> str:
    """Words of two or more characters and their neighbour pairs, as a list."""
    words = rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}_]{{2,}}')"
    return (
        f"list_concat({words}, list_transform(list_zip({words}[:-2], {words}[2:]),"
        " lambda p: p[1] || ' ' || p[2]))"
    )


_VARIANT = "label = 'phish' AND variant_type = 'paraphrase'"
_ORIGINAL = "label = 'phish' AND variant_type = 'original'"


def _folds(seeds: list[int], groups: str = "groups") -> str:
    return f"""
  SELECT seed, group_id, y,
    ((row_number() OVER (PARTITION BY seed ORDER BY y, md5(seed || ':' || group_id), group_id) - 1) % {q.K} + 1)::INT AS fold
  FROM {groups}, (SELECT unnest({seeds}) AS seed)"""


# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (
        (),
        f"""
  SELECT doc_id, text,
    CASE WHEN doc_id % 7 = 6 THEN 'legit_' || {_INDEX}
         ELSE 'phish_' || {_SCENARIO} || '_' || {_INDEX} || '_' ||
              CASE WHEN doc_id % 7 = 0 THEN 'orig' ELSE 'p' || (doc_id % 7) END END AS msg_id,
    CASE WHEN doc_id % 7 = 6 THEN 'legit' ELSE 'phish' END AS label,
    CASE WHEN doc_id % 7 = 6 THEN '{NEGATIVE_SCENARIO}' ELSE {_SCENARIO} END AS scenario,
    CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN 'paraphrase' ELSE 'original' END AS variant_type,
    {_STRATEGY} AS paraphrase_strategy,
    CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN 'phish_' || {_SCENARIO} || '_' || {_INDEX} || '_orig' END AS base_msg_id,
    CASE WHEN doc_id % 7 = 6 THEN 'synthetic_legit' ELSE 'generated_llm' END AS source,
    CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 7 = 6 THEN 2 ELSE 1 END::BIGINT * {STRIDE} + doc_id AS ord
  FROM documents""",
    ),
    "cleaned0": (("messages",), f"SELECT * REPLACE ({_normalized('text')} AS text) FROM messages"),
    "cleaned": (
        ("cleaned0",),
        f"SELECT *, {_words('text')} AS length_words, sha256(text) AS text_hash FROM cleaned0",
    ),
    "scored": (("cleaned",), f"SELECT *, {_gate('text', 'length_words')} AS reason FROM cleaned"),
    "firsts": (("cleaned",), "SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY ord) = 1"),
    "gated": (
        ("scored",),
        """
  SELECT * REPLACE (CASE WHEN reason = 'ok' AND
      row_number() OVER (PARTITION BY text_hash, reason = 'ok' ORDER BY ord) > 1
      THEN 'duplicate_hash' ELSE reason END AS reason) FROM scored""",
    ),
    "grouped": (
        ("messages",),
        f"SELECT *, (label = 'phish')::INT AS y, CASE WHEN {_VARIANT} THEN base_msg_id ELSE msg_id END AS group_id FROM messages",
    ),
    "groups": (("grouped",), "SELECT group_id, max(y) AS y FROM grouped GROUP BY 1"),
    "folds": (("groups",), _folds(q.SEEDS)),
    "folds9": (("groups",), _folds([q.SEED])),
    "folds_sweep": (("groups",), _folds(q.SWEEP_SEEDS)),
    "labelled": (
        ("cleaned",),
        """
  SELECT 'doc_' || doc_id AS msg_id, text, quality::INT AS y,
    quality = 1 AND doc_id > min(CASE WHEN quality = 1 THEN doc_id END) OVER same AS variant,
    'text_' || min(doc_id) OVER same AS group_id
  FROM cleaned JOIN labels USING (doc_id) WINDOW same AS (PARTITION BY text_hash)""",
    ),
    "labelled_groups": (("labelled",), "SELECT group_id, max(y) AS y FROM labelled GROUP BY 1"),
    "labelled_folds": (("labelled_groups",), _folds(q.CV_SEEDS, "labelled_groups")),
    "sweep_folds": (("labelled_groups",), _folds(q.SWEEP_SEEDS, "labelled_groups")),
    "streamed": (
        ("scored",),
        f"""
  SELECT msg_id, CASE WHEN reason = 'ok' AND
      row_number() OVER (PARTITION BY text_hash, reason = 'ok' ORDER BY ord % {q.BATCHES}, ord) > 1
      THEN 'duplicate_hash' ELSE reason END AS fate FROM scored""",
    ),
    "train_rows": (
        ("grouped", "folds9"),
        f"""
  SELECT k.fold, msg_id, g.y FROM grouped g JOIN folds9 f USING (group_id),
    (SELECT unnest(range(1, {q.K + 1}))::INT AS fold) k WHERE variant_type = 'original' AND f.fold <> k.fold""",
    ),
    "sizes": (
        ("grouped", "folds"),
        f"""
  SELECT seed, k.fold::INT AS fold, count(DISTINCT group_id) FILTER (f.fold <> k.fold) AS n_groups_train,
    count(DISTINCT group_id) FILTER (f.fold = k.fold) AS n_groups_test,
    count(*) FILTER (f.fold <> k.fold AND variant_type = 'original') AS n_train_rows,
    count(*) FILTER (f.fold = k.fold AND variant_type = 'original') AS "n_testA_rows",
    count(*) FILTER (f.fold = k.fold AND (label = 'legit' OR variant_type = 'paraphrase')) AS "n_testB_rows"
  FROM grouped JOIN folds f USING (group_id), (SELECT unnest(range(1, {q.K + 1})) AS fold) k GROUP BY seed, k.fold""",
    ),
    "cond": ((), "SELECT unnest(['A', 'B']) AS cond"),
    "sides": (
        ("messages",),
        f"""
  SELECT msg_id AS family_id, kind, CASE WHEN
      row_number() OVER (PARTITION BY kind ORDER BY md5('{q.SEED}:' || msg_id), msg_id)
      <= greatest(1, round_even(count(*) OVER (PARTITION BY kind) * {q.TEST_RATIO}, 0)) THEN 'test' ELSE 'train' END AS side
  FROM (SELECT msg_id, CASE WHEN label = 'legit' THEN 'negative' ELSE 'positive_original' END AS kind
        FROM messages WHERE variant_type = 'original')""",
    ),
    "split_rows": (
        ("cleaned", "sides"),
        f"""
  SELECT m.*, s.family_id, s.side,
    unnest(CASE WHEN side = 'train' THEN CASE WHEN {_VARIANT} THEN [] ELSE ['train'] END
         WHEN label = 'legit' THEN ['test_original', 'test_paraphrase']
         WHEN variant_type = 'original' THEN ['test_original'] ELSE ['test_paraphrase'] END) AS split
  FROM cleaned m JOIN sides s ON s.family_id = CASE WHEN {_VARIANT} THEN base_msg_id ELSE msg_id END""",
    ),
    "cache": (
        ("cleaned",),
        f"""
  SELECT '{q.MODEL_NAME}|{q.PROMPT_VERSION}|' || text_hash AS cache_key, max(quality) AS answer
  FROM cleaned JOIN labels USING (doc_id) GROUP BY 1""",
    ),
    "uses": (
        ("cleaned",),
        f"SELECT msg_id, '{q.MODEL_NAME}|{q.PROMPT_VERSION}|' || text_hash AS cache_key FROM cleaned",
    ),
    "doc_terms": (
        (),
        f"SELECT doc_id, unnest({_ngrams('text')}) AS term FROM documents",
    ),
    "seq": ((), f"SELECT doc_id, {_tokens('text')} AS toks FROM documents"),
    "freq": (
        ("seq",),
        "SELECT token, count(*) AS freq FROM (SELECT unnest(toks) AS token FROM seq) GROUP BY 1 HAVING count(*) >= 2",
    ),
    "top": (
        ("freq",),
        f"""
  SELECT token, freq, (row_number() OVER (ORDER BY freq DESC, token) + 1)::INT AS id
  FROM freq QUALIFY id <= {q.VOCAB_SIZE - 1}""",
    ),
}


def _fold_views(folds: str, suffix: str) -> None:
    """Scored rows, metrics, fold deltas and summaries over one fold table."""
    VIEWS["tested" + suffix] = (
        ("grouped", folds, "cond"),
        f"""
  SELECT seed, fold, cond, msg_id, r.y, ({_hash_score('seed', 'msg_id')} >= 0.5)::INT AS pred
  FROM grouped r JOIN {folds} f USING (group_id) JOIN cond
    ON label = 'legit' OR (cond = 'A' AND variant_type = 'original') OR (cond = 'B' AND variant_type = 'paraphrase')""",
    )
    VIEWS["counts" + suffix] = (
        ("tested" + suffix,),
        f"""
  SELECT seed, fold, cond,
    count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
    count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp
  FROM tested{suffix} GROUP BY ALL""",
    )
    VIEWS["metrics" + suffix] = (
        ("counts" + suffix,),
        f"""
  SELECT *, coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0) AS accuracy,
    coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr
  FROM counts{suffix}""",
    )
    VIEWS["deltas" + suffix] = (
        ("metrics" + suffix,),
        f"""
  SELECT seed, fold, a.f1 AS A_f1, b.f1 AS B_f1, a.recall AS A_recall, b.recall AS B_recall,
    a.f1 - b.f1 AS delta_f1, a.recall - b.recall AS delta_recall
  FROM (SELECT * FROM metrics{suffix} WHERE cond = 'A') a JOIN (SELECT * FROM metrics{suffix} WHERE cond = 'B') b
  USING (seed, fold)""",
    )
    VIEWS["long" + suffix] = (
        ("deltas" + suffix,),
        f"UNPIVOT deltas{suffix} ON A_f1, B_f1, A_recall, B_recall, delta_f1, delta_recall INTO NAME metric VALUE value",
    )
    VIEWS["summary" + suffix] = (
        ("long" + suffix,),
        f"""
  SELECT seed, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n
  FROM long{suffix} GROUP BY ALL""",
    )


_fold_views("folds", "")
_fold_views("folds_sweep", "_sweep")


def _with(views: tuple[str, ...], body: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for view in views:
        add(view)
    if not needed:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in needed) + "\n" + body.strip()


_SECTIONS = f"""
  SELECT 'label' AS section, label AS value FROM {{t}}
  UNION ALL SELECT 'scenario', scenario FROM {{t}} WHERE label = 'phish'
  UNION ALL SELECT 'variant_type', variant_type FROM {{t}} WHERE label = 'phish'
  UNION ALL SELECT 'strategy', paraphrase_strategy FROM {{t}} WHERE {_VARIANT}"""

_STATS = """
  SELECT section, count(*) AS n, min(len) AS min, floor(quantile_cont(len, 0.25))::INT AS p25,
    floor(quantile_cont(len, 0.5))::INT AS median, floor(quantile_cont(len, 0.75))::INT AS p75,
    max(len) AS max, sum(len) / count(*) AS mean
  FROM (SELECT 'all' AS section, length_words AS len FROM {t} UNION ALL SELECT label, length_words FROM {t})
  GROUP BY section"""

# --- Fixed values: the patterns that define the features, in DuckDB's syntax. ---
_FEATURE_SQL = {
    "n_chars": "length(s)",
    "n_words": _words("s"),
    "n_lines": "CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, chr(10), '')) + 1 END",
    "avg_word_len": rf"CASE WHEN s = '' THEN 0 ELSE round(length(regexp_replace(s, '\s', '', 'g')) / {_words('s')}, 9) END",
    "caps_ratio": r"round(length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) / greatest(length(regexp_replace(s, '[^\p{Lu}\p{Ll}]', '', 'g')), 1), 9)",
    "digit_ratio": r"round(length(regexp_replace(s, '[^\p{Nd}]', '', 'g')) / greatest(length(s), 1), 9)",
    "punct_ratio": r"""round(length(regexp_replace(s, '[^.,;:!?()\[\]{}<>"'']', '', 'g')) / greatest(length(s), 1), 9)""",
    "exclam": "length(s) - length(replace(s, '!', ''))",
    "question": "length(s) - length(replace(s, '?', ''))",
    "n_urls": r"len(regexp_extract_all(s, '(?i)(https?://\S+|www\.\S+)'))",
    "n_emails": r"len(regexp_extract_all(s, '(?i)[\p{L}\p{N}_][\p{L}\p{N}_.-]*@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+'))",
    "n_phones": r"len(regexp_extract_all(s, '(\+\d{1,3}[\s-]?)?(\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}'))",
    "n_money": r"len(regexp_extract_all(s, '(?i)(\$|€|£)\s?\d+|\b\d+\s?(usd|eur|gbp)\b'))",
    "kw_hits": " + ".join(f"contains(lower(s), '{k}')::INT" for k in KEYWORDS),
    "has_url": r"regexp_matches(s, '(?i)(https?://\S+|www\.\S+)')::INT",
    "has_http": "contains(lower(s), 'http')::INT",
}
# --- end of fixed values ---
assert list(_FEATURE_SQL) == list(FEATURES)

_TTEST = """
  SELECT seed, n, mean, sd, sd / sqrt(n) AS se, n - 1 AS df, mean / nullif(sd / sqrt(n), 0) AS t
  FROM (SELECT seed, count(*) AS n, avg(delta_f1) AS mean, stddev_samp(delta_f1) AS sd FROM deltas GROUP BY seed)"""

# Twice the tail of Student's t from |t| on, summed over 20,000 slices of the angle
# atan(|t| / sqrt(df)): the density is cos(angle)^(df - 1) up to its own whole integral.
_ANGLE = "(SELECT avg(pow(cos({a} + (pi() / 2 - {a}) * (i + 0.5) / 20000), df - 1)) * (pi() / 2 - {a}) FROM range(20000) r(i))"
_P = f"{_ANGLE.format(a='atan(abs(t) / sqrt(df))')} / {_ANGLE.format(a='0')}"

_HOLDOUT_COUNTS = f"""
  SELECT 'phish_original_total' AS name, count(*) AS n FROM messages WHERE {_ORIGINAL}
  UNION ALL SELECT 'phish_paraphrase_total', count(*) FROM messages WHERE {_VARIANT}
  UNION ALL SELECT 'legit_total', count(*) FROM messages WHERE label = 'legit'
  UNION ALL SELECT s || '_total', count(split) FROM (SELECT unnest(['train', 'test_original', 'test_paraphrase']) AS s)
    LEFT JOIN split_rows ON split = s GROUP BY s"""

# Naive split by row, and the family each row belongs to.
_NAIVE = f"""
  SELECT *, {_VARIANT} AS variant, CASE WHEN {_VARIANT} THEN base_msg_id ELSE msg_id END AS family_id,
    CASE WHEN {_hash_score(f"'{q.SEED}'", 'msg_id')} < {q.TEST_RATIO}
      THEN CASE WHEN {_VARIANT} THEN 'test_paraphrase' ELSE 'test_original' END ELSE 'train' END AS split
  FROM messages"""

_CHAR_GRAMS = r"""
  SELECT doc_id, unnest(flatten(list_transform(
    list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''),
    lambda w: flatten(list_transform(range(3, greatest(3, least(5, length(w) + 2)) + 1),
      lambda n: list_transform(range(1, length(w) + 2 - n + 2), lambda i: substr(' ' || w || ' ', i, n))))))) AS gram
  FROM documents"""

ORACLES: dict[str, str] = {
    # --- sources and sinks ---
    "read_jsonl": "SELECT doc_id, lang, source, text FROM documents",
    "jsonl_roundtrip": _with(("messages",), "SELECT * FROM messages"),
    "append_jsonl": _with(("messages",), "SELECT * FROM messages"),
    "csv_roundtrip": _with(("messages",), "SELECT * FROM messages"),
    "read_sources": _with(
        ("firsts",),
        """SELECT msg_id, label, 0.85::DOUBLE AS temperature, DATE '2026-01-01' AS date_generated, length_words, text_hash, text
FROM firsts WHERE text <> ''""",
    ),
    "provenance": _with(
        ("messages",),
        """SELECT msg_id, source, CASE WHEN label = 'legit' THEN 'legit_base_v1'
    ELSE scenario || CASE WHEN doc_id % 7 = 0 THEN '_base' ELSE '_p' || (doc_id % 7) END || '_v1' END AS prompt_id,
  'scorer' AS generation_model, 0.85::DOUBLE AS temperature, 0.95::DOUBLE AS top_p, 900 AS max_output_tokens,
  DATE '2026-01-01' AS date_generated FROM messages""",
    ),
    "required_columns": _with(
        ("messages",),
        """SELECT msg_id, concat_ws(',', CASE WHEN text IS NULL THEN 'text' END,
  CASE WHEN base_msg_id IS NULL THEN 'base_msg_id' END) AS missing FROM messages""",
    ),
    "merge_sources": _with(("messages",), "SELECT msg_id, base_msg_id, ord, text FROM messages"),
    "reject_log": _with(
        ("gated",),
        """SELECT 'build' AS stage, scenario, base_msg_id, msg_id, paraphrase_strategy AS strategy, 1 AS attempt, reason,
  nullif(regexp_extract(reason, '[(]([0-9]+)[)]', 1), '')::INT AS detail,
  CASE WHEN reason <> 'duplicate_hash' THEN left(text, 200) END AS preview FROM gated WHERE reason <> 'ok'""",
    ),
    "run_log": _with(
        ("gated",),
        """SELECT 'build' AS stage, scenario, base_msg_id, msg_id, paraphrase_strategy AS strategy, 1 AS attempt, 'ok' AS status
FROM gated WHERE reason = 'ok'""",
    ),
    "split_manifest": _with(
        ("split_rows",),
        f"""SELECT 'settings' AS section, unnest(['dataset', 'seed', 'test_ratio']) AS name,
  unnest(['documents', '{q.SEED}', '{q.TEST_RATIO}']) AS value
UNION ALL SELECT 'counts', name, n::VARCHAR FROM ({_HOLDOUT_COUNTS})
UNION ALL SELECT 'ids', side || CASE WHEN kind = 'negative' THEN '_legit_ids' ELSE '_phish_base_ids' END, family_id
FROM sides""",
    ),
    "split_document": _with(("sides",), "SELECT family_id, kind, side FROM sides"),
    "sweep_record": _with(
        ("summary",),
        f"""SELECT '{q.MODEL_NAME}' AS model, {q.K} AS folds, {len(q.SEEDS)} AS n_seeds, seed,
  max(round(mean, 9)) FILTER (metric = 'delta_f1') AS delta_f1,
  max(round(mean, 9)) FILTER (metric = 'delta_recall') AS delta_recall FROM summary GROUP BY seed""",
    ),
    "dataset_manifest": _with(
        ("firsts",),
        f"""SELECT 'count_' || section AS section, value AS key, count(*)::VARCHAR AS value
FROM ({_SECTIONS.format(t='firsts')}) GROUP BY 1, 2
UNION ALL SELECT 'length_' || section, unnest(['n', 'min', 'p25', 'median', 'p75', 'max', 'mean']),
  unnest([n::VARCHAR, min::VARCHAR, p25::VARCHAR, median::VARCHAR, p75::VARCHAR, max::VARCHAR, printf('%.6f', mean)])
FROM ({_STATS.format(t='firsts')})
UNION ALL VALUES ('settings', 'word_bounds', '{MIN_WORDS}-{MAX_WORDS}'),
  ('settings', 'deduplication', 'sha256 of normalized text')""",
    ),
    "metrics_json": _with(
        ("deltas", "sizes"),
        f"""SELECT '{q.MODEL_NAME}' AS model, 'documents' AS dataset, s.*, round(A_f1, 9) AS A_f1, round(delta_f1, 9) AS delta_f1
FROM deltas JOIN sizes s USING (seed, fold)""",
    ),
    "json_dotpath": _with(
        ("summary",),
        """SELECT seed, 'aggregate.delta_f1.mean' AS path, round(mean, 9) AS value FROM summary WHERE metric = 'delta_f1'
UNION ALL SELECT seed, 'aggregate.A_recall.std', round(std, 9) FROM summary WHERE metric = 'A_recall'""",
    ),
    "cache_key": _with(("uses",), "SELECT * FROM uses"),
    # --- projections ---
    "normalize_text": f"SELECT doc_id, {_normalized('text')} AS text FROM documents",
    "word_count": f"SELECT doc_id, {_words('text')} AS n_words FROM documents",
    "text_hash": "SELECT doc_id, sha256(text) AS text_hash FROM documents",
    "quality_gate": _with(("scored",), "SELECT msg_id, reason FROM scored"),
    "quality_gate_fill": _with(
        ("cleaned",), f"SELECT msg_id, {_gate('text', 'length_words', fill=True)} AS reason FROM cleaned"
    ),
    "truncation_gate": f"""SELECT doc_id, {_gate('t', 'w', finish='finish')} AS reason
FROM (SELECT *, {_words('t')} AS w FROM (SELECT doc_id, {_normalized('text')} AS t,
  CASE WHEN n_chars > 1500 THEN 'FinishReason.MAX_TOKENS' ELSE 'FinishReason.STOP' END AS finish FROM documents))""",
    "make_ids": """SELECT doc_id, 'phish_' || source || '_' || printf('%03d', doc_id) || '_' || lang AS positive_id,
  'legit_' || printf('%03d', doc_id) AS negative_id FROM documents""",
    "parse_ids": _with(
        ("messages",),
        """SELECT msg_id, CASE WHEN label = 'phish' THEN scenario END AS id_scenario,
  CASE WHEN label = 'phish' THEN doc_id // 7 END AS id_index,
  CASE WHEN label = 'phish' THEN CASE WHEN variant_type = 'original' THEN 'orig' ELSE 'p' || (doc_id % 7) END END AS id_variant,
  CASE WHEN label = 'phish' THEN coalesce(base_msg_id, msg_id) END AS base_id FROM messages""",
    ),
    "label_to_int": _with(("grouped",), "SELECT msg_id, y FROM grouped"),
    "group_id": _with(("grouped",), "SELECT msg_id, group_id FROM grouped"),
    "backfill": _with(
        ("messages", "cleaned"),
        """SELECT m.msg_id, CASE WHEN doc_id % 7 IN (0, 1) THEN c.text_hash ELSE md5(m.text) END AS text_hash,
  CASE WHEN doc_id % 7 IN (2, 3) THEN c.length_words ELSE (doc_id + 1)::INT END AS length_words
FROM messages m JOIN cleaned c USING (doc_id)""",
    ),
    "threshold_scores": _with(
        ("messages",),
        f"""SELECT seed, msg_id, (s >= 0.5)::INT AS pred, (s > {_hash_score("'0'", 'msg_id')})::INT AS pred_argmax
FROM (SELECT seed, msg_id, {_hash_score('seed', 'msg_id')} AS s FROM messages, (SELECT unnest({q.SEEDS}) AS seed))""",
    ),
    # --- filters ---
    "role_partition": _with(
        ("messages",),
        f"""SELECT msg_id, CASE WHEN label = 'legit' THEN 'negative' WHEN {_VARIANT} THEN 'positive_variant'
  ELSE 'positive_original' END AS role FROM messages""",
    ),
    "train_rule": _with(("messages",), "SELECT msg_id, label FROM messages WHERE variant_type = 'original'"),
    "condition_a": _with(("messages",), f"SELECT msg_id, label FROM messages WHERE label = 'legit' OR ({_ORIGINAL})"),
    "condition_b": _with(("messages",), f"SELECT msg_id, label FROM messages WHERE label = 'legit' OR ({_VARIANT})"),
    # --- joins ---
    "fold_rows": _with(("folds",), "SELECT seed, fold, msg_id, group_id FROM grouped JOIN folds USING (group_id)"),
    "skip_existing": _with(
        ("messages",), "SELECT msg_id FROM messages WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    ),
    "reject_known_hash": _with(
        ("cleaned",),
        """SELECT msg_id, text_hash FROM cleaned
WHERE text_hash NOT IN (SELECT text_hash FROM cleaned JOIN labels USING (doc_id))""",
    ),
    "orphan_variants": _with(
        ("firsts",),
        f"""SELECT msg_id, base_msg_id FROM firsts v WHERE {_VARIANT}
AND NOT EXISTS (SELECT 1 FROM firsts o WHERE o.msg_id = v.base_msg_id)""",
    ),
    "family_rows": _with(
        ("cleaned",),
        """SELECT v.base_msg_id, v.msg_id, length(v.text)::INT AS n_chars, length(o.text)::INT AS base_chars
FROM cleaned v JOIN cleaned o ON o.msg_id = v.base_msg_id""",
    ),
    "missing_variants": _with(
        ("firsts",),
        f"""SELECT * FROM (SELECT replace(o.msg_id, '_orig', '_' || s.code) AS msg_id, o.msg_id AS base_msg_id, o.scenario,
    s.name AS paraphrase_strategy FROM firsts o,
    (SELECT unnest({list(STRATEGIES)}) AS code, unnest({list(STRATEGIES.values())}) AS name) s WHERE {_ORIGINAL}) w
WHERE NOT EXISTS (SELECT 1 FROM firsts v WHERE v.msg_id = w.msg_id)""",
    ),
    "quota_gap": _with(
        ("firsts",),
        f"""SELECT scenario, idx, CASE WHEN scenario = '{NEGATIVE_SCENARIO}' THEN 'legit_' || printf('%03d', idx)
    ELSE 'phish_' || scenario || '_' || printf('%03d', idx) || '_orig' END AS msg_id
FROM (SELECT t.scenario, unnest(range(count(f.msg_id) + 1, t.target + 1)) AS idx
  FROM (SELECT unnest({[*SCENARIOS, NEGATIVE_SCENARIO]}) AS scenario,
               unnest({[q.QUOTA] * len(SCENARIOS) + [q.NEGATIVE_QUOTA]}) AS target) t
  LEFT JOIN firsts f ON f.scenario = t.scenario AND f.variant_type = 'original' GROUP BY t.scenario, t.target)""",
    ),
    "leakage_check": _with(
        ("messages",),
        f""", naive AS ({_NAIVE})
SELECT 'variant_in_train' AS rule, family_id, count(*) AS n_rows FROM naive WHERE variant AND split = 'train' GROUP BY 2
UNION ALL SELECT 'base_not_in_test', family_id, count(*) FROM naive n WHERE variant AND split <> 'train'
  AND NOT EXISTS (SELECT 1 FROM naive o WHERE o.msg_id = n.family_id AND o.split = 'test_original') GROUP BY 2
UNION ALL SELECT 'family_on_both_sides', family_id, count(*) FROM naive GROUP BY 2
  HAVING bool_or(split = 'train') AND bool_or(split <> 'train')""",
    ),
    "cache_lookup": _with(
        ("uses", "cache"),
        """SELECT msg_id, cache_key, answer IS NOT NULL AS hit, coalesce(answer, -1) AS answer
FROM uses LEFT JOIN cache USING (cache_key)""",
    ),
    "cache_misses": _with(
        ("uses", "cache"),
        "SELECT DISTINCT cache_key FROM uses WHERE cache_key NOT IN (SELECT cache_key FROM cache)",
    ),
    "cache_stats": _with(
        ("uses", "cache"),
        """SELECT count(*) FILTER (NOT miss) AS hits, count(*) FILTER (miss) AS misses,
  (SELECT count(*) FROM cache) + count(*) FILTER (miss) AS entries
FROM (SELECT cache_key NOT IN (SELECT cache_key FROM cache)
  AND row_number() OVER (PARTITION BY cache_key ORDER BY msg_id) = 1 AS miss FROM uses)""",
    ),
    **dict.fromkeys(
        ("cache_upsert", "cache_store"),
        _with(
            ("uses", "cache"),
            f"""SELECT cache_key, answer::BIGINT AS answer, NULL::BIGINT AS n_phish, NULL::VARCHAR AS raw_labels FROM cache
    UNION ALL SELECT cache_key, (2 * count(*) FILTER (s >= 0.5) >= 3)::BIGINT, count(*) FILTER (s >= 0.5),
      string_agg(CASE WHEN s >= 0.5 THEN 'phish' ELSE 'legit' END, ',' ORDER BY vote)
    FROM (SELECT cache_key, vote, {_hash_score('cache_key', 'vote')} AS s
      FROM (SELECT DISTINCT cache_key FROM uses WHERE cache_key NOT IN (SELECT cache_key FROM cache)),
        (SELECT unnest([0, 1, 2]) AS vote)) GROUP BY cache_key""",
        ),
    ),
    # --- aggregations ---
    "group_table": _with(("groups",), "SELECT group_id, y FROM groups"),
    "value_counts": _with(
        ("messages",),
        f"SELECT section, value, count(*) AS n FROM ({_SECTIONS.format(t='messages')}) GROUP BY 1, 2",
    ),
    "length_stats": _with(
        ("cleaned",), f"SELECT * REPLACE (round(mean, 9) AS mean) FROM ({_STATS.format(t='cleaned')})"
    ),
    "family_sizes": _with(
        ("messages",),
        "SELECT base_msg_id, count(*) AS n_variants, "
        + ", ".join(f"count(*) FILTER (paraphrase_strategy = '{s}') AS n_{s}" for s in STRATEGIES.values())
        + f" FROM messages WHERE {_VARIANT} GROUP BY 1",
    ),
    "eval_predictions": _with(("tested",), "SELECT * FROM tested"),
    "binary_metrics": _with(
        ("metrics",),
        """SELECT seed, fold, cond, tn, fp, fn, tp, round(accuracy, 9) AS accuracy, round("precision", 9) AS "precision",
  round(recall, 9) AS recall, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM metrics""",
    ),
    "confusion_pct": _with(
        ("counts",),
        """SELECT seed, fold, cond, actual, predicted, n, round(coalesce(100 * n / nullif(total, 0), 0), 9) AS pct FROM (
  SELECT seed, fold, cond, 0 AS actual, 0 AS predicted, tn AS n, tn + fp AS total FROM counts
  UNION ALL SELECT seed, fold, cond, 0, 1, fp, tn + fp FROM counts
  UNION ALL SELECT seed, fold, cond, 1, 0, fn, fn + tp FROM counts
  UNION ALL SELECT seed, fold, cond, 1, 1, tp, fn + tp FROM counts)""",
    ),
    "ab_delta": _with(
        ("deltas",),
        """SELECT seed, fold, round(A_f1, 9) AS A_f1, round(B_f1, 9) AS B_f1, round(A_recall, 9) AS A_recall,
  round(B_recall, 9) AS B_recall, round(delta_f1, 9) AS delta_f1, round(delta_recall, 9) AS delta_recall FROM deltas""",
    ),
    "fold_summary": _with(
        ("summary",), "SELECT seed, metric, round(mean, 9) AS mean, round(std, 9) AS std, n FROM summary"
    ),
    "paired_ttest": _with(
        ("deltas",),
        f"""SELECT seed, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(se, 8) AS se, df, round(t, 8) AS t,
  CASE WHEN t IS NOT NULL THEN round({_P}, 8) END AS p FROM ({_TTEST})""",
    ),
    "seed_sweep": _with(("summary_sweep",), "SELECT seed, metric, round(mean, 9) AS value FROM summary_sweep"),
    "chart_series": _with(
        ("summary",),
        """SELECT 'bars_' || split_part(metric, '_', 2) AS chart, seed, split_part(metric, '_', 1) AS x,
  round(mean, 9) AS y, round(std, 9) AS err FROM summary WHERE metric NOT LIKE 'delta%'
UNION ALL SELECT metric || '_by_fold', seed, fold::VARCHAR, round(value, 9), 0 FROM long WHERE metric LIKE 'delta%'
UNION ALL SELECT metric || '_by_seed', seed, seed::VARCHAR, round(mean, 9), 0 FROM summary WHERE metric LIKE 'delta%'""",
    ),
    "majority_vote": _with(
        ("messages",),
        f"""SELECT msg_id, CASE WHEN n_phish >= n_legit THEN 'phish' ELSE 'legit' END AS label, confidence, n_phish, n_legit,
  raw_labels FROM (SELECT msg_id, round(avg(greatest(s, 1 - s)), 9) AS confidence,
    count(*) FILTER (s >= 0.5) AS n_phish, count(*) FILTER (s < 0.5) AS n_legit,
    string_agg(CASE WHEN s >= 0.5 THEN 'phish' ELSE 'legit' END, ',' ORDER BY vote) AS raw_labels
  FROM (SELECT msg_id, vote, {_hash_score('msg_id', 'vote')} AS s FROM messages, (SELECT unnest([0, 1, 2]) AS vote))
  GROUP BY msg_id)""",
    ),
    "token_freq": _with(("freq",), "SELECT token, freq FROM freq"),
    "doc_freq": _with(
        ("doc_terms",),
        """SELECT term, count(DISTINCT doc_id) AS df FROM doc_terms GROUP BY 1
HAVING df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents)""",
    ),
    "class_weights": _with(
        ("folds9",),
        f"""SELECT seed, fold, n0, n1, round((n0 + n1) / (2 * n0), 9) AS balanced0, round((n0 + n1) / (2 * n1), 9) AS balanced1,
  round((1 / n0) / (1 / n0 + 1 / n1), 9) AS inverse0, round((1 / n1) / (1 / n0 + 1 / n1), 9) AS inverse1
FROM (SELECT seed, k.fold::INT AS fold, count(*) FILTER (g.y = 0) AS n0, count(*) FILTER (g.y = 1) AS n1
  FROM grouped g JOIN folds9 f USING (group_id), (SELECT unnest(range(1, {q.K + 1})) AS fold) k
  WHERE variant_type = 'original' AND f.fold <> k.fold GROUP BY ALL)""",
    ),
    "fold_sizes": _with(("sizes",), "SELECT * FROM sizes"),
    # --- dedup, folds, splits, samples ---
    "dedup_first": _with(("firsts",), "SELECT msg_id, label, text_hash, length_words, text FROM firsts"),
    "flag_duplicates": _with(
        ("cleaned",),
        """SELECT msg_id, CASE WHEN row_number() OVER (PARTITION BY text_hash ORDER BY ord) = 1 THEN 'ok'
  ELSE 'duplicate_hash' END AS status FROM cleaned""",
    ),
    "gate_and_dedup": _with(("gated",), "SELECT msg_id, reason FROM gated"),
    "finalize": _with(("firsts",), "SELECT msg_id, text_hash, length_words, text FROM firsts WHERE text <> ''"),
    "group_kfold": _with(("folds",), "SELECT seed, group_id, y, fold FROM folds"),
    "holdout_split": _with(("split_rows",), "SELECT split, msg_id FROM split_rows"),
    "replay_split": _with(("split_rows",), "SELECT split, msg_id, family_id FROM split_rows"),
    # The validation side has ceil(ratio * n) rows of a fold; each class gets the whole
    # part of its share, and what is left goes to the largest remainders.
    "train_val_split": _with(
        ("train_rows",),
        f""", shares AS (SELECT fold, y, count(*) AS m, sum(count(*)) OVER (PARTITION BY fold) AS n,
    ceil((sum(count(*)) OVER (PARTITION BY fold)) * {q.VAL_RATIO}::DECIMAL(10, 9))::BIGINT AS v FROM train_rows GROUP BY 1, 2),
parts AS (SELECT *, (v * m) // n AS whole, (v * m) % n AS rest FROM shares),
places AS (SELECT fold, y, whole + (row_number() OVER (PARTITION BY fold ORDER BY rest DESC, m DESC, y)
    <= v - sum(whole) OVER (PARTITION BY fold))::INT AS k FROM parts)
SELECT fold, msg_id, y, CASE WHEN row_number() OVER (PARTITION BY fold, y ORDER BY md5('{q.SEED}:' || msg_id), msg_id) <= k
  THEN 'val' ELSE 'train' END AS part FROM train_rows JOIN places USING (fold, y)""",
    ),
    "train_val_plain": _with(
        ("train_rows",),
        f"""SELECT fold, msg_id, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY md5('{q.SEED}:' || msg_id), msg_id)
  <= ceil((count(*) OVER (PARTITION BY fold)) * {q.VAL_RATIO}::DECIMAL(10, 9)) THEN 'val' ELSE 'train' END AS part FROM train_rows""",
    ),
    "capped_sample": _with(
        ("folds9", "cond"),
        f"""SELECT fold, cond, msg_id FROM grouped JOIN folds9 USING (group_id) JOIN cond
  ON label = 'legit' OR (cond = 'A' AND variant_type = 'original') OR (cond = 'B' AND variant_type = 'paraphrase')
QUALIFY row_number() OVER (PARTITION BY fold, cond ORDER BY md5('{q.SEED}:' || msg_id), msg_id) <= {q.SAMPLE_CAP}""",
    ),
    "balanced_resample": _with(
        ("grouped",),
        f""", ranked AS (SELECT msg_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{q.SEED}:' || msg_id), msg_id) AS rank,
    count(*) OVER (PARTITION BY y) AS size, md5('draw{q.SEED}:' || msg_id) AS digest FROM grouped),
draws AS (SELECT ('0x' || substr(digest, 18, 15))::BIGINT % 2 AS y, ('0x' || substr(digest, 1, 15))::BIGINT AS u FROM ranked),
counted AS (SELECT d.y, u % s.size + 1 AS rank, count(*) AS n_draws
  FROM draws d JOIN (SELECT y, count(*) AS size FROM grouped GROUP BY 1) s USING (y) GROUP BY 1, 2)
SELECT msg_id, y, n_draws FROM ranked JOIN counted USING (y, rank)""",
    ),
    # --- sorts, sets ---
    "sort_by_index": _with(
        ("messages",),
        f"SELECT scenario, doc_id // 7 AS idx, msg_id FROM messages WHERE {_ORIGINAL} ORDER BY 1, 2",
    ),
    "top_vocab": _with(("top",), "SELECT token, freq, id FROM top"),
    "disjoint_check": _with(
        ("split_rows",),
        """SELECT text_hash FROM split_rows WHERE split = 'train'
INTERSECT SELECT text_hash FROM split_rows WHERE split <> 'train'""",
    ),
    # --- text features ---
    "numeric_features": "SELECT doc_id, "
    + ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in _FEATURE_SQL.items())
    + f" FROM (SELECT doc_id, trim(text, {BLANKS}) AS s FROM documents)",
    "word_ngrams": _with(("doc_terms",), "SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY 1, 2"),
    "char_wb_ngrams": f"""SELECT doc_id, count(*) AS n_grams, sum(tf)::BIGINT AS n_total,
  md5(string_agg(gram || '=' || tf, '|' ORDER BY gram || '=' || tf)) AS digest
FROM (SELECT doc_id, gram, count(*) AS tf FROM ({_CHAR_GRAMS}) GROUP BY 1, 2) GROUP BY 1""",
    "tfidf": _with(
        ("messages", "doc_terms"),
        """, counted AS (SELECT msg_id, variant_type = 'original' AS fit, term, count(*) AS tf
    FROM doc_terms JOIN messages USING (doc_id) GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM messages WHERE variant_type = 'original'),
vocab AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM counted, n WHERE fit GROUP BY term, n
  HAVING count(*) >= 2 AND count(*) <= 0.95 * n),
weighted AS (SELECT msg_id, term, tf * idf AS x FROM counted JOIN vocab USING (term))
SELECT msg_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY msg_id)), 9) AS tfidf FROM weighted""",
    ),
    "assemble_features": _with(
        ("labelled",),
        f""", counted AS (SELECT msg_id, NOT variant AS fit, term, count(*) AS tf
    FROM (SELECT msg_id, variant, unnest({_ngrams('text')}) AS term FROM labelled) GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM labelled WHERE NOT variant),
vocab AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM counted, n WHERE fit GROUP BY term, n
  HAVING count(*) >= 2 AND count(*) <= 0.95 * n),
weighted AS (SELECT msg_id, term, tf * idf AS x FROM counted JOIN vocab USING (term)),
numbers AS (SELECT msg_id, """
        + ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in _FEATURE_SQL.items())
        + f""" FROM (SELECT msg_id, trim(text, {BLANKS}) AS s FROM labelled))
SELECT msg_id, 'word' AS block, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY msg_id)), 6) AS value FROM weighted
UNION ALL SELECT msg_id, 'numeric', term, round(value, 6)
FROM (UNPIVOT numbers ON COLUMNS(* EXCLUDE msg_id) INTO NAME term VALUE value) WHERE value <> 0""",
    ),
    # A fit has no closed form in SQL: these state what must hold of it for every row.
    "fit_logreg": _with(
        ("labelled",),
        """SELECT y, count(*) AS n_rows, (SELECT count(*) FROM labelled WHERE NOT variant) AS n_fitted, true AS solved,
  true AS learned FROM labelled GROUP BY y""",
    ),
    "fit_forest": _with(
        ("labelled",),
        f"""SELECT y, count(*) AS n_rows, (SELECT count(*) FROM labelled WHERE NOT variant) AS n_fitted,
  {q.FOREST_SPEC.trees}::BIGINT AS n_trees, true AS in_depth, true AS learned FROM labelled GROUP BY y""",
    ),
    "hashed_collisions": _with(
        ("labelled",),
        f"""SELECT count(DISTINCT term) AS n_terms, true AS as_by_chance
FROM (SELECT unnest({_ngrams('text')}) AS term FROM labelled)""",
    ),
    **{
        name: _with(
            ("labelled", folds, "cond"),
            f"""SELECT seed, fold, cond, count(*) FILTER (r.y = 0) AS n_negative,
  count(*) FILTER (r.y = 1 AND (cond = 'B') = variant) AS n_positive, true AS in_range
FROM labelled r JOIN {folds} f USING (group_id), cond GROUP BY ALL""",
        )
        for name, folds in (("cv_experiment", "labelled_folds"), ("cv_seeds", "sweep_folds"))
    },
    "seq_tokens": _with(
        ("seq",),
        "SELECT doc_id, len(toks)::INT AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM seq",
    ),
    "encode_sequences": _with(
        ("seq", "top"),
        f"""SELECT doc_id, array_to_string(list_resize(ids, {q.MAX_LEN}, 0), ' ') AS ids, length FROM (
  SELECT doc_id, greatest(1, least(len(any_value(toks)), {q.MAX_LEN}))::INT AS length,
    list(coalesce(id, 1) ORDER BY pos) AS ids
  FROM (SELECT doc_id, toks, unnest(toks[:{q.MAX_LEN}]) AS token, generate_subscripts(toks[:{q.MAX_LEN}], 1) AS pos FROM seq)
  LEFT JOIN top USING (token) GROUP BY doc_id)""",
    ),
    # --- streaming ---
    "stream_gate": _with(("streamed",), "SELECT msg_id, fate FROM streamed"),
    # A text is remembered until a batch ends whose watermark, a delay behind the batches before
    # it, is a delay past its first day: it counts as new after four days, and after three for the
    # first batch of the second run, as a run ends with a batch without rows.
    "stream_first_within": _with(
        ("cleaned",),
        f"""SELECT text_hash, day FROM (
  WITH RECURSIVE days AS (SELECT DISTINCT text_hash, (doc_id % {q.DAYS})::INT AS day FROM cleaned),
  run(day, text_hash, remembered, is_new) AS (
    SELECT -1, text_hash, NULL::INT, false FROM (SELECT DISTINCT text_hash FROM days)
    UNION ALL
    SELECT r.day + 1, r.text_hash, CASE WHEN fresh THEN r.day + 1 ELSE remembered END, fresh
    FROM (
      SELECT r.*, d.day IS NOT NULL AND (remembered IS NULL
        OR d.day - remembered >= CASE WHEN d.day = {q.DAYS // 2 + 1} THEN 3 ELSE 4 END) AS fresh
      FROM run r LEFT JOIN days d ON d.text_hash = r.text_hash AND d.day = r.day + 1
      WHERE r.day < {q.DAYS - 1}
    ) r
  )
  SELECT day, text_hash FROM run WHERE is_new)""",
    ),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
