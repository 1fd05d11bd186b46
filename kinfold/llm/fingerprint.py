"""Document fingerprints from content-defined chunks.

A rolling gear hash over the last 32 bytes marks places where a text may be cut;
after the least length a cut needs a rare mark up to the normal length and a
common one from there on, which brings chunk lengths together (normalised
chunking). Cuts depend on nearby bytes only, so after an insertion or a deletion
the chunks soon fall into step again. A fingerprint is the set of chunk digests
with their lengths; what one text has of another is the share of bytes whose
chunks both have.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import slices, strings

LEAST, NORMAL, MOST = 32, 64, 256  # bytes; LEAST is the hash's window, so no hash reaches past its chunk's text
RARE, COMMON = 7, 5  # leading zero bits that mark a cut before and after NORMAL
BLOCK_BYTES = 8 << 20  # hashed at once
BLOCKS_PER_PARTITION = 4

NO_ID = -(1 << 63)  # stands for a null id, before all others

GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest()) for b in range(256)], np.uint32)

Fingerprint = dict[int, int]  # digest of a chunk -> its length


def marks(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of possible chunks by rare and by common marks, between code points only."""
    rare: list[np.ndarray] = []
    common: list[np.ndarray] = []
    for start in range(0, len(data), BLOCK_BYTES):
        lead = max(0, start - LEAST + 1)
        part = data[lead : start + BLOCK_BYTES + 1]
        h = GEAR[part[: start + BLOCK_BYTES - lead]]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        ends = np.flatnonzero(h >> np.uint32(32 - COMMON) == 0)
        inside = ends[ends + 1 < len(part)]
        cut = np.concatenate([inside[(part[inside + 1] & 0xC0) != 0x80], ends[len(inside) :]])
        cut = cut[cut >= start - lead]
        common.append(cut + lead + 1)
        rare.append(cut[h[cut] >> np.uint32(32 - RARE) == 0] + lead + 1)
    return [x for a in rare for x in a.tolist()], [x for a in common for x in a.tolist()]


def chunk_ends(data: np.ndarray, begins: list[int]) -> list[list[int]]:
    """Ends of the chunks of each text [begins[i], begins[i + 1]) of `data`."""
    rare, common = marks(data)
    out = []
    for begin, end in zip(begins, begins[1:], strict=False):
        ends, at = [], begin
        while end - at > LEAST:
            i = bisect_left(rare, at + LEAST)
            if i < len(rare) and rare[i] < at + NORMAL:
                cut = rare[i]
            else:
                i = bisect_left(common, at + NORMAL)
                cut = common[i] if i < len(common) and common[i] < at + MOST else at + MOST
                while cut < end and data[cut] & 0xC0 == 0x80:
                    cut -= 1
            at = min(cut, end)
            ends.append(at)
        if at < end:
            ends.append(end)
        out.append(ends)
    return out


def digests(data: bytes, begin: int, ends: list[int]) -> Fingerprint:
    found: Fingerprint = {}
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    for end in ends:
        found[digest(view[begin:end])] = end - begin
        begin = end
    return found


def fingerprints(texts: list[bytes]) -> list[tuple[Fingerprint, list[int]]]:
    """Of each text its fingerprint and the ends of its chunks."""
    data = b"".join(texts)
    begins = [0, *np.cumsum([len(t) for t in texts]).tolist()]
    ends = chunk_ends(np.frombuffer(data, np.uint8), begins)
    return [(digests(data, b, e), [x - b for x in e]) for b, e in zip(begins, ends, strict=False)]


def written(fingerprint: Fingerprint) -> str:
    return " ".join([f"{d:016x}:{n}" for d, n in sorted(fingerprint.items())])


def containment(part: Fingerprint, whole: Fingerprint) -> float:
    """Share of `part`'s bytes whose chunks `whole` has too; an empty one is
    wholly in another empty one and not at all in others."""
    if not part:
        return float(not whole)
    return sum([n for d, n in part.items() if d in whole]) / sum(part.values())


def edited(text: str, following: str) -> tuple[bytes, bytes]:
    """The kept head and the new tail: the last half of the code points gives
    way to as many of the next document's first ones."""
    half = len(text) // 2
    return text[: len(text) - half].encode(), following[:half].encode()


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each text is fingerprinted whole, and once more with its last half replaced
    by the beginning of the next document in id order (after the last, the
    first). near_* is how much of the text's fingerprint the edited text's and
    the next document's hold. Null texts are empty; rows of equal id stand in
    text order, null ids first; ids must be integers; a lone row follows itself;
    other columns are ignored.

    Texts are shuffled once, by blocks of consecutive ids; the rows with the
    first id of a block also go to the block before, where they follow its last.
    """
    spark = df.sparkSession
    number = F.coalesce(df[id_col].cast("long"), F.lit(NO_ID))
    rows = df.select(number.alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    ids = rows.select("id")
    n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions")) * BLOCKS_PER_PARTITION
    steps = [i / n_blocks for i in range(1, n_blocks)]
    limits = np.unique(np.array(ids.approxQuantile("id", steps, 0.25 / n_blocks), np.float64).astype(np.int64))

    def place_of(numbers: pd.Series) -> np.ndarray:
        return np.searchsorted(limits, numbers.to_numpy(np.int64), side="right").astype(np.int32)

    block_of = F.pandas_udf(lambda numbers: pd.Series(place_of(numbers)), "int")
    # One row per block, of which there are a few per shuffle partition.
    firsts = dict(ids.distinct().groupBy(block_of("id").alias("block")).agg(F.min("id")).collect())
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first block's rows follow the last one's

    def with_guests(numbers: pd.Series) -> pd.Series:
        pairs = zip(place_of(numbers).tolist(), numbers.tolist(), strict=True)
        return pd.Series([[b, before[b]] if firsts[b] == x else [b] for b, x in pairs])

    blocks_of = F.pandas_udf(with_guests, "array<int>")
    placed = rows.select("id", "text", F.posexplode(blocks_of("id")).alias("guest", "block"))
    laid = placed.repartition("block").sortWithinPartitions("block", "guest", "id", "text")
    kind = df.schema[id_col].dataType
    return laid.mapInArrow(_compare, SCHEMA).withColumn("id", F.nullif("id", F.lit(NO_ID)).cast(kind))


SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
Row = tuple[int | None, str, int, int, Fingerprint, list[int]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand in order; each is compared with the row after it in its block."""
    waiting: list[Row] = []
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = strings(batch.column("text")).to_pylist()
            made = fingerprints([t.encode() for t in texts])
            columns = [batch.column(n).to_pylist() for n in ("id", "guest", "block")]
            rows = [
                (i, t, guest, block, *f) for i, guest, block, t, f in zip(*columns, texts, made, strict=True)
            ]
            rows = waiting + rows
            yield _pairs([(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2] and a[3] == b[3]])
            waiting = rows[-1:]


def _pairs(pairs: list[tuple[Row, Row]]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in SCHEMA]
    tails, kept, hashes = [], [], []
    for (_, text, _, _, _, ends), (_, following, *_) in pairs:
        head, new = edited(text, following)
        digest = hashlib.sha256(head)
        digest.update(new)
        hashes.append(digest.hexdigest())
        # Chunks that end inside the kept head are the edited text's too.
        same = bisect_left(ends, len(head))
        if same < len(ends) and ends[same] == len(head) and not new:
            same += 1
        kept.append(ends[:same])
        tails.append(head[ends[same - 1] if same else 0 :] + new)
    for (row, after), head_ends, digest, (rest, _) in zip(pairs, kept, hashes, fingerprints(tails), strict=True):
        number, text, _, _, own, _ = row
        whole = digests(text.encode(), 0, head_ends) | rest
        values = number, len(text), digest, written(own), written(whole), containment(own, whole), containment(own, after[4])
        for column, value in zip(out, values, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=SCHEMA.names)
