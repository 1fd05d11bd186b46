"""Language identification: known words first, then shorter and shorter n-grams.

A word that the training texts have is scored by its log frequency in each
language. Any other word is read from its start: the longest known character
n-gram there is scored, and where none is known a shorter one is tried, down to
single letters. A word counts by the mean of its n-grams, so that long unknown
words weigh no more than known ones.
"""

from __future__ import annotations

import gc
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .texts import kept, pieces, slices, spans, strings

SAMPLE = 1_500  # training texts per language, about
BLOCK = 256  # languages scored at a time; results do not depend on it
LONGEST = 5
UNKNOWN = "und"
SLICE_BYTES = 1 << 20  # text handled at once; results do not depend on it
KNOWN_PIECES = 250_000  # pieces a worker remembers; results do not depend on it
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class LanguageModel:
    """Counts of every word and n-gram of the training texts, read as log frequencies
    smoothed by one half of an occurrence.

    A key that a language lacks scores log(0.5 / size) there, one that it has n times
    log(2n + 1) more; so only the languages that have a key are stored for it, and the
    model's size is that of the counts, whatever the number of languages.
    """

    def __init__(self, languages: list[str], words: pa.Table, grams: pa.Table):
        """`words` and `grams` have (lang, key, n), each pair of lang and key once."""
        self.languages = languages
        self.words_of, (begins, codes, n) = by_key(languages, words)
        self.grams_of, (gram_begins, gram_codes, gram_n) = by_key(languages, grams)
        # A row per word, then one per n-gram, then one for what is not known at all.
        self.begins = np.concatenate([begins[:-1], gram_begins + begins[-1], [begins[-1] + gram_begins[-1]]])
        self.codes, self.counts = np.concatenate([codes, gram_codes]), np.concatenate([n, gram_n])
        sizes = pc.utf8_length(self.grams_of).to_numpy(zero_copy_only=False)
        # What a row's base is: that of words, of n-grams of a length, or of the unknown.
        self.kinds = np.concatenate([np.zeros(len(begins) - 1), sizes, [LONGEST + 1]]).astype(np.int8)
        kind = np.repeat(self.kinds, np.diff(self.begins))
        self.bases = np.full((LONGEST + 2, len(languages)), math.log(1e-6))
        for k in range(LONGEST + 1):
            totals = np.bincount(self.codes[kind == k], self.counts[kind == k], len(languages))
            self.bases[k] = np.log(0.5 / (totals + 0.5 * (self.kinds == k).sum() + 1))
        self.open()

    def open(self) -> None:
        n = len(self.words_of)
        self.words = dict(zip(self.words_of.to_pylist(), range(n), strict=True))
        self.grams = dict(zip(self.grams_of.to_pylist(), range(n, n + len(self.grams_of)), strict=True))
        self.more = np.log(2 * self.counts + 1.0)

    def __getstate__(self) -> dict:
        """The columns only; a worker makes the tables from them."""
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "grams", "more")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def rows(self, word: str) -> list[int]:
        """The word's row, or those of the n-grams it is read as."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        padded, at, out = f"<{word}>", 0, []
        while at < len(padded):
            for size in range(min(LONGEST, len(padded) - at), 0, -1):
                found = self.grams.get(padded[at : at + size])
                if found is not None:
                    break
            else:
                found, size = len(self.kinds) - 1, 1
            out.append(found)
            at += max(1, size - 1)
        return out

    def scores(self, texts: list[list[str]], low: int = 0, high: int | None = None) -> np.ndarray:
        """Per list of words the sum of the words' scores in each language from `low` to `high`."""
        high = len(self.languages) if high is None else high
        found: list[int] = []
        weights: list[float] = []
        ends = []
        for words in texts:
            for word in words:
                rows = self.rows(word)
                found += rows
                weights += [1 / len(rows)] * len(rows)
            ends.append(len(found))
        row, weight = np.array(found, np.int64), np.array(weights)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        kinds = np.bincount(owner * len(self.bases) + self.kinds[row], weight, len(texts) * len(self.bases))
        begin = self.begins[row]
        n = self.begins[row + 1] - begin
        entry = spans(begin, n)
        code, width = self.codes[entry] - low, high - low
        here = (code >= 0) & (code < width)
        cell = (np.repeat(owner, n) * width + code)[here]
        more = np.bincount(cell, (np.repeat(weight, n) * self.more[entry])[here], len(texts) * width)
        return kinds.reshape(len(texts), -1) @ self.bases[:, low:high] + more.reshape(len(texts), -1)


def by_key(languages: list[str], counts: pa.Table) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The keys in order; where each one's entries begin (one more at the end), and of
    each entry the number of its language and its count."""
    counts = counts.sort_by([("key", "ascending"), ("lang", "ascending")])
    keys = pc.cast(counts.column("key"), pa.large_string()).combine_chunks()
    if not len(keys):
        return keys, (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    first = np.ones(len(keys), bool)
    first[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    begins = np.append(np.flatnonzero(first), len(keys))
    numbers = pc.index_in(pc.cast(counts.column("lang"), pa.string()), pa.array(languages, pa.string()))
    return keys.filter(pa.array(first)), (begins, numbers.to_numpy().astype(np.int32), counts.column("n").to_numpy())


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from the rows with text and language.

    Fitted on a sample of about SAMPLE texts per language, picked by a hash of
    the id and text; every word and n-gram of the sample is kept. Both are counted
    in tasks; the model's size is that of the sample and does not grow with the table,
    only with the number of languages, of which there may be any.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # the model's classes
    languages = sorted(sizes)
    if not languages:
        nothing = pa.table({"lang": pa.array([], pa.string()), "key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        return LanguageModel([], nothing, nothing)
    shares = F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, min(1.0, SAMPLE / n))])
    share = shares[F.col("lang")]
    chance = F.pmod(F.xxhash64("id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(chance < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            pairs = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for language, text in pairs:
                found[language].update(WORD.findall(text.lower()))
            yield counts_batch(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            columns = [batch.column(c).to_pylist() for c in ("lang", "key", "n")]
            for language, word, n in zip(*columns, strict=True):
                padded, counter = f"<{word}>", found[language]
                for size in range(1, LONGEST + 1):
                    for at in range(len(padded) - size + 1):
                        counter[padded[at : at + size]] += n
            yield counts_batch(found)

    schema = "lang string, key string, n long"
    summed = F.sum("n").alias("n")
    words = sample.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "key").agg(summed)
    words = materialize(words, "language-words")
    grams = words.mapInArrow(cut, schema).groupBy("lang", "key").agg(summed)
    # As many rows as the sample has distinct words and n-grams, as columns of Arrow.
    return LanguageModel(languages, words.toArrow(), grams.toArrow())


def counts_batch(found: dict[str, Counter]) -> pa.RecordBatch:
    columns = [*zip(*[(g, k, n) for g, c in found.items() for k, n in c.items()], strict=True)] or [(), (), ()]
    kinds = (pa.string(), pa.string(), pa.int64())
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=["lang", "key", "n"])


class Scores:
    """What a worker has scored so far for a block of languages: per piece its row, with
    the sum of its words' scores and, last, how many words it has."""

    def __init__(self, low: int, high: int, most: int) -> None:
        self.low, self.high, self.most = low, high, most
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, high - low + 1))

    def rows(self, model: LanguageModel, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.known, self.table = {}, self.table[:1024]
        known = self.known
        new = [p for p in found if p not in known]
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            words = [WORD.findall(p.lower()) for p in some]
            first = len(known)
            known.update(zip(some, range(first, first + len(some)), strict=True))
            while len(known) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : len(known), :-1] = model.scores(words, self.low, self.high)
            self.table[first : len(known), -1] = [len(w) for w in words]
        got = self.table[[known[p] for p in found]]
        return got[:, :-1], got[:, -1].astype(np.int64)


def by_block(model: LanguageModel) -> list[Scores]:
    """One per BLOCK languages; together they remember KNOWN_PIECES pieces."""
    begins = range(0, len(model.languages), BLOCK)
    return [Scores(b, min(b + BLOCK, len(model.languages)), KNOWN_PIECES // len(begins)) for b in begins]


def most_likely(
    model: LanguageModel, blocks: list[Scores], found: list[str], codes: np.ndarray, begins: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its best language's number, the posterior and how many words it has. Of
    each block only the best score and the sum of odds against it are carried on."""
    top = np.full(len(begins) - 1, -np.inf)
    best, odds, n = np.zeros(len(top), np.int64), np.zeros(len(top)), np.zeros(len(top), np.int64)
    for block in blocks:
        table, counts = block.rows(model, found)
        total = np.add.reduceat(table[codes], begins[:-1], axis=0)  # no text is without a piece
        n = np.add.reduceat(counts[codes], begins[:-1])
        high = total.max(axis=1)
        best = np.where(high > top, block.low + total.argmax(axis=1), best)
        most = np.maximum(top, high)
        sums = np.exp(np.maximum(total - most[:, None], -700)).sum(axis=1)
        odds, top = odds * np.exp(np.maximum(top - most, -700)) + sums, most
    return best, 1 / odds, n


def identify(
    df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """(id, lang_pred, score), with `keep_text` (id, text, lang_pred, score): the most likely language of each whole text and its
    posterior. `und` and 0 where the text is null or has no letters, or the model
    knows no language. Ties go to the first language by name; each row, repeated
    ones too, gives a row; other columns are ignored."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = ["id", "text"] if keep_text else ["id"]
    return _identify(df.select(df[id_col].alias("id"), df[text_col].alias("text")), shared, keep)


def _identify(rows: DataFrame, shared: Broadcast, keep: list[str]) -> DataFrame:
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*[rows.schema[c] for c in keep], *more])
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        gc.freeze()
        blocks = kept(("language", key), lambda: by_block(model))
        names = np.array([*model.languages, UNKNOWN], object)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                if not model.languages:
                    pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
                else:
                    found, codes, begins = pieces(strings(batch.column("text")))
                    best, score, n = most_likely(model, blocks, found, codes, begins)
                    score = np.where(n > 0, score, 0.0)
                    pred = names[np.where(n > 0, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)], names=schema.names
                )

    return rows.mapInArrow(run, schema)
