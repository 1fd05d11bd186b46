"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A window is a string of `LENGTH` bytes; it goes if it also starts anywhere else.
Windows are first brought together: each is filed under the least hash among its
GRAM-byte strings, and neighbouring windows with the same least string form one
segment, a row of a narrow table. Equal windows have the same least string, so
strings that occur once need no look at their text. Segments that are equal as a
whole are counted; only segments that share a least string and differ somewhere
travel with their bytes and are compared by suffixes.

The comparison sorts the suffixes of many segments at once, takes their
Burrows-Wheeler transform and expands intervals breadth first: from the interval
of a string w, extending backwards by every letter c gives the intervals of cw.
The place behind such an interval gets the length of w as its common prefix if it
has none yet, so lengths are found by increasing value. The search stops at
LENGTH: places without a value are neighbours that share a whole window.

A least string that holds too much text for one task is split further: by where
it stands in the window, and by the bytes that all windows of such a class have
in common. At the end of this a class is a single window, which is only counted.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .texts import slices, strings

LENGTH = 200  # bytes of a window
GRAM = 32  # bytes of the strings that windows are filed under
GRAMS = LENGTH - GRAM + 1  # such strings in a window
SLICE_BYTES = 1 << 20
KEY_BYTES = 256 << 10  # text of one key that is compared at once; more is split
SORT_BYTES = 1 << 20  # text whose suffixes are sorted at once
PLACE = np.uint64(24)  # bits for a position in a slice
COUNT_BITS = 31  # for the windows of a segment, beside its start; texts are shorter than 2 GiB
COUNT_MASK = (1 << COUNT_BITS) - 1
PRIME = 0x9E3779B97F4A7C15
MET, ONCE, WINDOWS = 0, 1, 2  # segments under a shared key, those of them that are alone, windows found in them


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the GRAM bytes from each position on."""
    h, odd = data.astype(np.uint64) + np.uint64(1), PRIME
    for step in (1, 2, 4, 8, 16):
        h = h[:-step] * np.uint64(odd) + h[step:]
        odd = odd * odd % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def least_places(h: np.ndarray) -> np.ndarray:
    """For each window start, the place of the first least hash among its GRAMS."""
    packed = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= GRAMS:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    rest = GRAMS - span
    if rest:
        packed = np.minimum(packed[:-rest], packed[rest:])
    return (packed & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)


def segments(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window start, windows, place of the least string in the
    first window, its hash) arrays for texts [begins[i], begins[i + 1]) of `data`."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for low in range(0, max(0, len(data) - LENGTH + 1), 8 << 20):
        part = data[low : low + (8 << 20) + LENGTH - 1]
        h = gram_hashes(part)
        place = least_places(h)
        start = np.arange(low, low + len(place))
        text = owner[low : low + len(place)]
        whole = start + LENGTH <= begins[text + 1]
        start, text, place = start[whole], text[whole], place[whole]
        if not len(start):
            continue
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        count = np.diff(np.append(new, len(start)))
        first = start[new]
        yield text[new], first - begins[text[new]], count, place[new] + low - first, h[place[new]].view(np.int64)


ROW = "h long, key long, seg long, start long, n long, place long"


def segment_rows(docs: DataFrame) -> DataFrame:
    """(id, h, key, seg, start, n, place) of (id, h, text): where it starts, how many
    windows, the place of its least string; `seg` hashes its bytes and place."""
    kind = T.StructType([docs.schema["id"], *T.StructType.fromDDL(ROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = [t.as_buffer() for t in strings(batch.column("text"))]
                raw = b"".join(texts)
                begins = np.cumsum([0, *map(len, texts)])
                for text, start, n, place, key in segments(np.frombuffer(raw, np.uint8), begins):
                    at = begins[text] + start
                    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                    seg = np.fromiter(
                        (
                            digest(view[a : a + b + LENGTH - 1], c)
                            for a, b, c in zip(at.tolist(), n.tolist(), place.tolist(), strict=True)
                        ),
                        np.uint64,
                        len(at),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(text)),
                            batch.column("h").take(pa.array(text)),
                            *map(pa.array, (key, seg.view(np.int64), start, n, place)),
                        ],
                        names=kind.names,
                    )

    return docs.mapInArrow(run, kind)


def shared_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, h, start, n, kind) of segments whose key occurs again, MET, and once more, ONCE,
    of those among them that do not occur again as a whole; and the differing segments
    under keys that hold several: the rows of one occurrence each, with `copies` telling
    how many there are. So rows that occur again are not joined with what they share."""
    several = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.min("seg").alias("low"), F.max("seg").alias("high")
    )
    several = materialize(
        several.filter("many > 1").select("key", (F.col("low") == F.col("high")).alias("same")), "suffix-keys"
    )
    met = materialize(rows.join(several, "key"), "suffix-met")
    mixed = met.filter("NOT same")
    others = [F.col(c) for c in mixed.columns if c not in ("key", "seg", "same")]
    variants = mixed.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*others)).alias("one"))
    variants = materialize(variants, "suffix-variants")
    single = variants.filter("copies = 1").select(*[F.col(f"one.{c}") for c in ("id", "h", "start", "n")])
    whole = met.select("id", "h", "start", "n", F.lit(MET).alias("kind"))
    whole = whole.unionByName(single.withColumn("kind", F.lit(ONCE)))
    # A key whose variants all occur again has nothing left to find.
    once = variants.filter("copies = 1").select("key").distinct()
    return whole, variants.join(materialize(once, "suffix-once"), "key", "left_semi").select("key", "seg", "copies", "one.*")


def cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted segments with their bytes. Texts meet all their segments at once."""
    fields = [F.col(c) for c in ("key", "copies", "start", "n", "place")]
    lists = wanted.groupBy(F.col("id").alias("of_id"), F.col("h").alias("of_h")).agg(
        F.collect_list(F.struct(*fields)).alias("cuts")
    )
    kind = T.StructType([docs.schema["id"], *T.StructType.fromDDL(SEGMENT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t.as_buffer() for t in strings(batch.column("text"))]
                cuts = batch.column("cuts")
                flat = cuts.flatten()
                owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(cuts.offsets)))
                column = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
                where = zip(owner.tolist(), column["start"].to_pylist(), column["n"].to_pylist(), strict=True)
                data = [texts[o][s : s + n + LENGTH - 1].to_pybytes() for o, s, n in where]
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(own),
                        batch.column("h").take(own),
                        *[column[c] for c in ("key", "copies", "start", "n", "place")],
                        pa.array(data, pa.binary()),
                    ],
                    names=kind.names,
                )

    joined = docs.join(lists, docs["id"].eqNullSafe(lists["of_id"]) & (docs["h"] == lists["of_h"]))
    return joined.select("id", "h", "text", "cuts").mapInArrow(run, kind)


SEGMENT = "h long, key long, copies long, start long, n long, place long, bytes binary"


def split_further(rows: DataFrame, width: int) -> DataFrame:
    """Segments cut into classes of `width` places of the least string, filed under
    the bytes that all windows of the class have in common."""
    kind = T.StructType([rows.schema["id"], *T.StructType.fromDDL(ROW + ", copies long, bytes binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                # The window at start + i has its least string at place - i.
                i = 0
                while i < row["n"]:
                    low = (row["place"] - i) // width * width
                    n = min(row["n"] - i, row["place"] - i - low + 1)
                    data = row["bytes"][i : i + n + LENGTH - 1]
                    anchor = row["place"] - i
                    core = data[max(0, anchor - low) : anchor - low - width + 1 + LENGTH]
                    made = row | {"start": row["start"] + i, "n": n, "place": anchor, "bytes": data}
                    made["key"] = signed(xxhash.xxh3_64_intdigest(core, low) ^ (row["key"] & (2**64 - 1)))
                    made["seg"] = signed(xxhash.xxh3_64_intdigest(data, anchor))
                    out.append(made)
                    i += n
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = to_arrow(kind)
    return rows.mapInArrow(run, kind)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, h, start, n) of the windows of single segments that another segment has too."""
    found: DataFrame | None = None
    width = GRAMS
    while True:
        size = F.sum(F.octet_length("bytes")).alias("size")
        large = materialize(rows.groupBy("key").agg(size).filter(F.col("size") > KEY_BYTES).select("key"), "suffix-large")
        small = rows.join(large, "key", "left_anti")
        part = compare_suffixes(small)
        found = part if found is None else found.unionByName(part)
        if large.isEmpty():
            return found
        width = (width + 1) // 2
        split = materialize(split_further(rows.join(large, "key", "left_semi"), width), "suffix-split")
        # A segment that stands for several counts as many.
        several = split.groupBy("key").agg(
            F.sum("copies").alias("many"), F.min("seg").alias("low"), F.max("seg").alias("high")
        )
        several = materialize(several.filter("many > 1").withColumn("same", F.expr("low = high")), "suffix-keys")
        met = split.join(several.select("key", "same"), "key")
        counted = met.groupBy("key", "seg").agg(F.sum("copies").alias("all"))
        counted = materialize(counted.filter("all > 1"), "suffix-counted")
        met = materialize(met.join(counted, ["key", "seg"], "left"), "suffix-met")
        whole = met.filter("all > 1").select("id", "h", "start", "n")
        found = found.unionByName(whole)
        # One of those that occur again stays, for single ones to be compared with.
        single = met.filter("all IS NULL").drop("same", "all")
        names = [c for c in single.columns if c not in ("key", "seg")]
        again = met.filter("all > 1 AND NOT same").withColumn("copies", F.col("all")).groupBy("key", "seg")
        again = again.agg(F.min(F.struct(*names)).alias("one")).select("key", "seg", "one.*")
        keys = materialize(single.select("key").distinct(), "suffix-once")
        again = again.join(keys, "key", "left_semi")
        rows = materialize(single.unionByName(again).drop("seg"), "suffix-rows")


def compare_suffixes(rows: DataFrame) -> DataFrame:
    """Compares the segments under each key; keys stand together, many to a sort."""
    kind = T.StructType([rows.schema["id"], *T.StructType.fromDDL("h long, start long, n long")])
    schema = to_arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= SORT_BYTES and row["key"] != held[-1]["key"]:
                    yield pa.RecordBatch.from_pylist(ranges(held), schema)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        yield pa.RecordBatch.from_pylist(ranges(held), schema)

    laid = rows.repartition("key").sortWithinPartitions("key")
    return laid.mapInArrow(run, kind)


def ranges(rows: list[dict]) -> list[dict]:
    """Runs of windows of the single rows that stand in another row too."""
    out = []
    texts = [r["bytes"] for r in rows]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    hit = np.zeros(begins[-1] + 1, bool)
    hit[repeated_starts(texts, LENGTH)] = True
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        number = int(np.searchsorted(begins, low, side="right")) - 1
        if rows[number]["copies"] == 1:
            at = rows[number]["start"] + low - int(begins[number])
            out.append({"id": rows[number]["id"], "h": rows[number]["h"], "start": at, "n": high - low})
    return out


def repeated_starts(texts: list[bytes], length: int) -> np.ndarray:
    """Positions in the texts, laid out with one separator after each, whose next
    `length` bytes stand elsewhere as well."""
    if not texts:
        return np.zeros(0, np.int64)
    order, letters = sorted_suffixes(texts, length)
    prefix = common_prefixes(order, letters, length)
    same = np.flatnonzero(prefix[1:-1] < 0) + 1
    return np.unique(np.concatenate([order[same], order[same - 1]]))


def sorted_suffixes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by at least their first `length` letters, by doubling; every
    text ends in a letter of its own."""
    letters = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    letters[ends] = 256 + np.arange(len(texts))
    n, rank, step = len(letters), letters, 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(sorted_rank, prepend=sorted_rank[0]) != 0)
        if step >= length:
            return order, letters
        follow = np.zeros(n, np.int64)
        follow[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank)
        step *= 2


def common_prefixes(order: np.ndarray, letters: np.ndarray, length: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it, -1 from `length` on.

    Breadth-first backward extension: all intervals of a level at once.
    """
    n = len(order)
    bwt = np.minimum(letters[order - 1], 256).astype(np.uint16)  # letter before; ends are not extended by
    by_letter = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)  # where the suffix that is one letter longer stands
    to[by_letter] = np.arange(n)
    first = np.diff(bwt[by_letter], prepend=65535) != 0
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)  # the same letter's neighbours
    before[by_letter[1:]] = np.where(first[1:], -1, by_letter[:-1])
    after[by_letter[:-1]] = np.where(first[1:], n, by_letter[1:])
    prefix = np.full(n + 1, -1, np.int64)
    low = np.flatnonzero(np.diff(letters[order], prepend=-1) != 0)
    high = np.append(low[1:], n) - 1
    prefix[low], prefix[n] = 0, 0
    for level in range(1, length):
        size = high - low + 1
        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        at_low, at_high = np.repeat(low, size), np.repeat(high, size)
        inner = bwt[at] < 256
        lows = np.sort(to[at[inner & (before[at] < at_low)]])
        highs = np.sort(to[at[inner & (after[at] > at_high)]])
        new = prefix[highs + 1] < 0
        prefix[highs[new] + 1] = level
        low, high = lows[new], highs[new]
        if not len(low):
            break
    return prefix


def spans_by_text(found: DataFrame) -> DataFrame:
    """(of_id, of_h, found): per text its segments MET but not ONCE and its WINDOWS, in order,
    each as one number of its start and count. Spark takes arrays of numbers from each other
    by hashing, arrays of structs by comparing each with each."""
    piece = F.shiftleft("start", COUNT_BITS).bitwiseOR(F.col("n"))
    pieces = [F.collect_list(F.when(F.col("kind") == k, piece)) for k in (MET, ONCE, WINDOWS)]
    return found.groupBy(F.col("id").alias("of_id"), F.col("h").alias("of_h")).agg(
        F.sort_array(F.concat(F.array_except(pieces[0], pieces[1]), pieces[2])).alias("found")
    )


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False
) -> DataFrame:
    """(id, n_bytes, spans, kept), a row per input row.

    `spans` are the maximal [begin, end) byte ranges covered by strings of LENGTH
    bytes that also start anywhere else in the table, the same text included,
    judged on the input; `kept` is the remaining bytes in a row, or with `as_text`
    the text they make, without characters that lost a part of their bytes. Matches never
    cross texts. Null texts are empty; shorter texts and those without repeats
    keep everything; rows that repeat an id and a text repeat each other. Other
    columns are ignored; an empty table gives no rows.
    """
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    rows = materialize(segment_rows(docs.select("id", "h", "text")), "suffix-segments")
    whole, variants = shared_segments(rows)
    bytes_of = materialize(cut_segments(docs, variants), "suffix-bytes")
    found = whole.unionByName(repeated_windows(bytes_of).withColumn("kind", F.lit(WINDOWS)))
    spans = materialize(spans_by_text(found), "suffix-spans")
    kind = T.StructType(
        [
            docs.schema["id"],
            *T.StructType.fromDDL("n_bytes long, spans array<struct<begin:long,end:long>>"),
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        ]
    )
    schema = to_arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.as_buffer().to_pybytes() for t in strings(part.column("text"))]
                merged, kept = [], []
                for text, found in zip(texts, part.column("found").to_pylist(), strict=True):
                    spans: list[dict] = []
                    for piece in found or ():
                        start = piece >> COUNT_BITS
                        end = start + (piece & COUNT_MASK) + LENGTH - 1
                        if spans and start <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], end)
                        else:
                            spans.append({"begin": start, "end": end})
                    edges = [0, *[x for s in spans for x in (s["begin"], s["end"])], len(text)]
                    merged.append(spans)
                    kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(merged, schema.field("spans").type),
                        pa.array([k.decode(errors="ignore") for k in kept] if as_text else kept, schema.field("kept").type),
                    ],
                    names=kind.names,
                )

    same = docs["id"].eqNullSafe(spans["of_id"]) & (docs["h"] == spans["of_h"])
    return docs.join(spans, same, "left").select("id", "text", "found").mapInArrow(run, kind)


def digest_columns(spans: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of `repeated_spans`."""
    return spans.select(
        "id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
