"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, disclosure, edit_counts, fingerprint, hamming, hard_negatives, html_text, language, licenses, packing
from . import prefix_trie, radix, suffix
from .vocabularies import tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return fingerprint.compare_edited(docs).withColumnRenamed("id", "doc_id")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = radix.exact_groups(table(spark, folder, "documents"))
    return groups.drop("doc").withColumnRenamed("id", "doc_id")


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts come back with the page's own url through the id column, a struct."""
    pages = table(spark, folder, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    found = html_text.extract(pages, "page")
    return found.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    spans = suffix.repeated_spans(table(spark, folder, "documents"))
    return suffix.digest_columns(spans).withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.piece_columns(packing.pack(docs, tokenizer("byte_bpe_50k.json")))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"), notices=licenses.ALL_NOTICES).withColumnRenamed("id", "doc_id")


def op7_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    edits = edit_counts.sample_edits(docs["text"])
    counted = edit_counts.count_edited(docs, edits, tokenizer("byte_bpe_50k.json"))
    return counted.drop("edited").withColumnRenamed("id", "doc_id")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hamming.near_classes(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_bpe_trie(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    coded = bpe_trie.encode_texts(docs, tokenizer("word_bpe_49k.json"), keep_ids=False)
    return coded.withColumnRenamed("id", "doc_id")


def op11_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.personal_data(table(spark, folder, "documents"))
    return disclosure.digest_columns(found).withColumnRenamed("id", "doc_id")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.rebuilt(table(spark, folder, "conversations"))
    return prefix_trie.digest_columns(prefix_trie.prefix_trie(turns))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """A seventh of the labels is moved on first; null ids are never anchors."""
    rows = table(spark, folder, "embeddings")
    seventh = F.pmod("vec_id", F.lit(7)) == 0
    rows = rows.withColumn("label", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, anchor=F.pmod("vec_id", F.lit(100)) == 0)


def queries() -> dict[str, Query]:
    found = (
        op1_fingerprints,
        op2_exact_dedup,
        op3_html_text,
        op4_suffix_dedup,
        op5_packing,
        op6_license_scan,
        op7_edit_counts,
        op8_near_dedup,
        op9_language_id,
        op10_bpe_trie,
        op11_disclosure,
        op12_prefix_trie,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


OP2 = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY body)
"""


# The CRC-32 of an id goes bit by bit: each byte is followed by eight shifts.
OP12 = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            sha256(concat(strlen(coalesce(role, '')), ':', role, text))) AS pos,
        {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, list(said ORDER BY pos) AS own,
        xor(list_reduce(
            list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END
        ), 4294967295) % 9 AS h
    FROM turns GROUP BY conv_id
),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS path
    FROM convs c LEFT JOIN convs b ON c.base = b.conv_id
),
members AS (
    SELECT conv_id, d AS depth, path[1:d] AS prefix, len(path) = d AS ended
    FROM rebuilt, unnest(range(0, len(path) + 1)) t(d)
),
nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends,
        CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(prefix[depth].text) ELSE 0 END AS own_saved
    FROM members GROUP BY depth, prefix
),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children, p.conv_id AS parent
    FROM nodes n LEFT JOIN children c ON n.prefix = c.prefix
    LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.prefix[1:n.depth - 1] = p.prefix
),
above AS (SELECT prefix[1:d] AS prefix, n_children, own_saved FROM counted, unnest(range(0, depth + 1)) t(d)),
sums AS (
    SELECT prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM above GROUP BY prefix
)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children,
    n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN sums USING (prefix)
"""


# Doubles hold the products of these vectors exactly.
OP13 = r"""
WITH vectors AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.row = b.row AS itself,
        list_dot_product(a.vector, b.vector)::BIGINT AS score
    FROM vectors a, vectors b WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth
    FROM scores WHERE same AND NOT itself QUALIFY nth <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
    row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT s.same
WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op12_prefix_trie": OP12, "op13_hard_negatives": OP13}
