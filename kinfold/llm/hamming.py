"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature at similarity 0.85 is 72 MinHash values of 8 bits. Two signatures that
differ in at most 23 values differ in at most one value in some of 12 chunks of 6
values, by the pigeonhole principle; so each chunk is filed under the 6 keys that
leave out one of its values, and every pair within the distance meets under some key.
Texts of Jaccard similarity 0.85 differ in 10.8 values on average; 24 or more happen
to less than 1 pair in 10,000 right at the limit, and to far fewer above it. For other
similarities `bands` finds the chunks that miss as few: 14 of 5 values at 0.80, where
pairs within 27 of 70 values are found.

Equal shingle sets are one node. What is already in one component needs no
further link, so the work goes from few pairs to all: first every node is paired
with the centre it shares most keys with, then with more and more of the others
that are not in its component yet, at last all members of keys that still hold
several components are paired between these. Pairs are compared by signature, then
confirmed on their full shingle sets. After this all pairs that can be similar have
been compared or stand in one component.

Different texts may share a key by the thousands. So members of the last step meet
by what similar sets must have in common: with shingles in one order, rare ones first,
the first shingle that two similar sets share is among the first few of both (`prefix`),
and from there on enough are left in both. And no more bits can differ between the parities
of two sets' hashes than shingles between the sets. This loses no similar pair, whatever the order.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .texts import slices, strings

WORDS = 5  # per shingle
CHUNKS, PER_CHUNK = 12, 6
VALUES = CHUNKS * PER_CHUNK
DISTANCE = 2 * CHUNKS - 1  # the most for which some chunk has at most one error
SIMILAR = 85  # hundredths
MISSED = 1e-4  # most pairs right at the similarity that may differ in more values than the distance
ROUNDS = (1, 4, 16)  # so many centres of a node have been tried after the first rounds; after the next, all
BLOCK = 1024  # members of a shingle that are compared with as many others at once
COUNT_BITS = 20  # of a shingle's hash, by which it is counted; they order shingles, results do not depend on it
COUNT_CHUNK = 1 << 16  # counts that are summed together
FEW_LINKS = 1 << 16  # between components, 16 bytes each, that the driver may follow at once
PARITY_BITS = 11  # of a shingle's hash, by which it turns one of a set's parities


@dataclass(frozen=True)
class Bands:
    """How signatures are cut for a similarity, in hundredths."""

    similar: int = SIMILAR
    chunks: int = CHUNKS
    per_chunk: int = PER_CHUNK

    @property
    def values(self) -> int:
        return self.chunks * self.per_chunk

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    @property
    def place_bit(self) -> int:
        return 8 * (self.per_chunk - 1)

    def missed(self) -> float:
        """Probability that a pair right at the similarity lies beyond the distance."""
        p, n = (1 - self.similar / 100) * 255 / 256, self.values
        return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(self.distance + 1, n + 1))


def bands(similar: int) -> Bands:
    """The longest chunks whose signature is no longer than VALUES and misses at most
    MISSED of the pairs at this similarity; else the shortest chunks that do."""
    if not 50 <= similar <= 100:
        raise ValueError("similarity of 50 to 100 hundredths")
    for size in (6, 5, 4, 3):
        tried = (Bands(similar, n, size) for n in range(2, 129))
        found = next((b for b in tried if b.missed() <= MISSED), None)
        if found and (found.values <= VALUES or size == 3):
            return found
    raise ValueError(f"no signature for a similarity of {similar} hundredths")


def odd_numbers(n: int, bits: int, seed: str) -> np.ndarray:
    """Fixed odd multipliers, made by a rule."""
    raw = hashlib.shake_256(seed.encode()).digest(n * 8)
    return (np.frombuffer(raw, "<u8") >> np.uint64(64 - bits)) | np.uint64(1)


STEPS = odd_numbers(WORDS, 64, "shingle")
MIX = odd_numbers(1, 64, "mix")[0]
TURNS = odd_numbers(VALUES, 32, "minhash").astype(np.uint32)
BASE = int(odd_numbers(1, 64, "base")[0])
BYTES = odd_numbers(256, 64, "bytes")
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]  # A-Z count as a-z
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SLICE_BYTES = 1 << 20


def powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts [begins[i], begins[i + 1]) of `data`, and where
    each text's words begin: differences of running sums of byte values times powers."""
    blank = BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[begins] = True
    edges = np.flatnonzero(edge)
    edges = edges[: np.searchsorted(edges, len(data), side="right")]
    starts, ends = edges[:-1], edges[1:]
    word = ~blank[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(len(data), BASE), out=sums[1:])
    back = powers(len(data) + 1, pow(BASE, -1, 1 << 64))
    hashes = mixed((sums[ends] - sums[starts]) * back[starts])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles: WORDS words in
    a row, or all words of a shorter text; none without words. Words stand between
    space, tab, line feed, vertical tab, form feed and return; A-Z are lowered."""
    raw = [t.as_buffer() for t in texts]
    places = np.cumsum([0, *map(len, raw)])
    hashes, begins = word_hashes(np.frombuffer(b"".join(raw), np.uint8), places)
    rolled = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for step, odd in enumerate(STEPS):
        rolled += hashes[step : step + len(rolled)] * odd
    rolled = mixed(rolled)
    out = []
    for begin, end in zip(begins.tolist(), begins[1:].tolist(), strict=False):
        if end - begin >= WORDS:
            out.append(np.unique(rolled[begin : end - WORDS + 1]))
        elif end > begin:
            part = hashes[begin:end]
            # The count goes in, so that a short text is no prefix of a longer one.
            out.append(mixed((part * STEPS[: len(part)]).sum(keepdims=True) + np.uint64(len(part))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def signature(shingles: np.ndarray, turns: np.ndarray = TURNS) -> bytes:
    """Low 8 bits of the least of each order of the hashes, one per turn."""
    low = (shingles >> np.uint64(24)).astype(np.uint32)
    least = np.full(len(turns), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[at : at + 4096, None] * turns).min(axis=0), out=least)
    return (least & np.uint32(0xFF)).astype(np.uint8).tobytes()


def sets_of(df: DataFrame, id_col: str, text_col: str, cut: Bands) -> DataFrame:
    """(id, n, digest, sig): size, digest and signature of each shingle set."""
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("sig", T.BinaryType()),
        ]
    )

    turns = odd_numbers(cut.values, 32, "minhash").astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = shingle_sets(strings(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest_of(s) for s in sets], pa.binary()),
                        pa.array([signature(s, turns) for s in sets], pa.binary()),
                    ],
                    names=schema.names,
                )

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def keys_of(nodes: DataFrame, cut: Bands) -> DataFrame:
    """(key, node): a key per chunk and value left out, which stand in its bits from `place_bit` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(rows, cut.chunks, cut.per_chunk)
            keys = np.empty((rows, cut.chunks, cut.per_chunk), np.int64)
            for out in range(cut.per_chunk):
                place = np.arange(cut.chunks, dtype=np.int64) * cut.per_chunk + out
                key = np.broadcast_to(place, (rows, cut.chunks)).copy()
                for value in range(cut.per_chunk):
                    if value != out:
                        key = key << 8 | sig[:, :, value]
                keys[:, :, out] = key
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel()),
                    pa.array(np.repeat(np.asarray(batch.column("node")), cut.values)),
                ],
                names=["key", "node"],
            )

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def near_pairs(pairs: DataFrame, nodes: DataFrame, cut: Bands) -> DataFrame:
    """(a, b, distance) of the pairs of sizes that can be similar, whose signatures
    differ in at most the distance."""
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, cut.values)
                for c in ("sig_a", "sig_b")
            )
            distance = (a != b).sum(axis=1)
            near = pa.array(distance <= cut.distance)
            made = [batch.column("a"), batch.column("b"), pa.array(distance.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([x.filter(near) for x in made], names=["a", "b", "distance"])

    both = pairs.join(left, "a").join(right, "b").filter(similar_sizes("n_a", "n_b", cut.similar)).drop("n_a", "n_b")
    return both.mapInArrow(run, "a long, b long, distance long")


class NearDuplicates:
    """One run over a table: its nodes, what is known of their components, and
    the full sets of those that share a key with another."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, similar: int = SIMILAR):
        self.cut = bands(similar)
        self.docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
        self.sets = materialize(sets_of(df, id_col, text_col, self.cut), "near-sets")
        full = self.sets.filter("n > 0").groupBy("digest")
        nodes = full.agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig"))
        self.nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        self.full: DataFrame | None = None  # (node, shingles)
        self.labels: DataFrame | None = None  # (node, comp) of nodes in some confirmed pair

    def run(self) -> None:
        keys = keys_of(self.nodes, self.cut)
        # Partial minima and maxima of numbers.
        centres = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        centres = materialize(centres.filter("low != high"), "near-centres")
        met = materialize(keys.join(centres, "key"), "near-met")
        # In the end all of these are needed: some confirmed, the others unsettled. So the texts move once.
        self.gather(met.select("node").distinct())
        linked = met.select("node", F.explode(F.array("low", "high")).alias("centre")).filter("node != centre")
        shared = linked.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("shared"))
        # A node has two centres per key at most, so the windows are small.
        closest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "centre"))
        ranked = materialize(shared.withColumn("rank", closest).drop("shared"), "near-ranked")
        for low, high in zip((0, *ROUNDS), (*ROUNDS, 2 * self.cut.values), strict=True):
            some = ranked.filter((F.col("rank") > low) & (F.col("rank") <= high))
            if self.labels is not None:
                some = self.labelled(self.labelled(some, "node", "comp"), "centre", "of_centre").filter("comp != of_centre")
            self.confirm(near_pairs(ordered(some), self.nodes, self.cut))
        self.confirm(self.all_pairs(self.unsettled(met.select("key", "node"))))

    def all_pairs(self, keys: DataFrame) -> DataFrame:
        """(a, b, distance) of near pairs of different components among the members of the keys.

        Members are filed under the shingles of their prefixes, those of a shingle dealt
        to blocks of about BLOCK, and each two blocks meet in a cell; a task holds one
        cell at a time.
        """
        members = materialize(keys.select("node", "comp").distinct(), "near-members")
        if self.full is None:
            return members.select(F.col("node").alias("a"), F.col("comp").alias("b"), F.lit(0).cast("long").alias("distance"))
        sets = members.join(self.full, "node")
        filed = materialize(prefixes(sets, shingle_counts(sets), self.cut), "near-prefixes")
        marks = materialize(parities(sets).join(self.nodes.select("node", "sig"), "node"), "near-parities")
        # Someone must have the shingle among its first as the smaller set of a pair.
        size = F.count(F.lit(1))
        sized = filed.groupBy("key").agg(
            F.ceil(size / F.lit(BLOCK)).cast("int").alias("blocks"),
            (F.max("leads") & (F.min("comp") != F.max("comp"))).alias("several"),
        )
        sized = materialize(sized.filter("several").drop("several"), "near-sizes")
        rows = filed.join(sized, "key").join(marks, "node")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = rows.select("key", *[c for c in CELL if c != "block"], block, others)
        dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
        cut = self.cut
        laid = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell: list[tuple] = []
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", *CELL)]
                found: list[tuple[int, int, int]] = []
                for row in zip(*columns, strict=True):
                    if cell and cell[-1][:3] != row[:3]:
                        found += cell_pairs(cell, cut)
                        cell = []
                    cell.append(row)
                yield pair_batch(found)
            yield pair_batch(cell_pairs(cell, cut))

        # Similar sets may meet under several shingles.
        return laid.mapInArrow(run, "a long, b long, distance long").distinct()

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """Members of the keys that have several components, with their component."""
        keys = materialize(self.labelled(keys), "near-labelled")
        several = keys.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        several = materialize(several.filter("low != high").select("key"), "near-several")
        return keys.join(several, "key", "left_semi")

    def labelled(self, df: DataFrame, node: str = "node", comp: str = "comp") -> DataFrame:
        names = self.labels.select(F.col("node").alias(node), F.col("comp").alias("known"))
        return df.join(names, node, "left").withColumn(comp, F.coalesce("known", node)).drop("known")

    def confirm(self, near: DataFrame) -> None:
        """Confirm near pairs on their full sets: the nearest of each node first, then
        whatever still lies between components."""
        near = materialize(near, "near-pairs")
        if near.isEmpty():
            if self.labels is None:
                self.labels = self.nodes.select("node", F.col("node").alias("comp")).limit(0)
            return
        nearest = near.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("first")).select("first.a", "b")
        self.join_up(self.similar(materialize(nearest, "near-first")))
        rest = self.labelled(self.labelled(near, "a", "comp_a"), "b", "comp_b")
        rest = materialize(rest.filter("comp_a != comp_b").select("a", "b"), "near-rest")
        if not rest.isEmpty():  # else the full sets would move for nothing
            self.join_up(self.similar(rest))

    def gather(self, wanted: DataFrame) -> None:
        """Make the full sets of the nodes from the texts; a node is known by its least
        id and its digest."""
        wanted = materialize(self.nodes.select("node", "id", "digest").join(wanted, "node"), "near-wanted")
        if wanted.isEmpty():
            return
        ids = wanted.select("id", "node", "digest")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", SLICE_BYTES):
                    sets = shingle_sets(strings(batch.column("text")))
                    own = [digest_of(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
                    shingles = pa.array([s.tobytes() for s in sets], pa.binary())
                    made = [x.filter(pa.array(own, pa.bool_())) for x in (batch.column("node"), shingles)]
                    yield pa.RecordBatch.from_arrays(made, names=["node", "shingles"])

        # Always by sorting: the texts move in the same way at any size.
        texts = self.docs.join(ids.hint("merge"), self.docs["id"].eqNullSafe(ids["id"])).select("node", "digest", "text")
        made = texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])
        self.full = materialize(made, "near-full")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose sets are similar enough. Sets of other nodes are left
        where they are as long as the pairs are few, for Spark to tell."""
        similar = self.cut.similar

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                    a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    found.append(100 * both >= similar * (len(a) + len(b) - both))
                made = [batch.column(c).filter(pa.array(found, pa.bool_())) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays(made, names=["a", "b"])

        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = self.full.join(ends, "node", "left_semi")
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        joined = pairs.select("a", "b").join(left, "a").join(right, "b")
        return joined.mapInArrow(run, "a long, b long")

    def join_up(self, links: DataFrame) -> None:
        """Merge the components that confirmed links connect."""
        links = materialize(links, "near-links")
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.labels is None:
            labels = ends.select("node", F.col("node").alias("comp"))
        else:
            new = ends.join(self.labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
            labels = self.labels.unionAll(new)
        self.labels = components(materialize(labels, "near-labels"), links)

    def classes(self) -> DataFrame:
        """(id, n_shingles, component_id, kept), a row per document."""
        named = materialize(self.labelled(self.nodes.select("node", "id", "digest")), "near-named")
        least = materialize(named.groupBy("comp").agg(F.min("id").alias("component_id")), "near-least")
        classes = materialize(named.join(least, "comp").select("digest", "component_id"), "near-classes")
        joined = self.sets.select("id", "n", "digest").join(classes, "digest", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        return joined.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
            "kept", F.col("id").eqNullSafe(F.col("component_id"))
        )


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) of (node, centre), each pair once."""
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def prefix(n: int, similar: int) -> tuple[int, int]:
    """How many of its first shingles a set of `n` may have to share with a similar set
    that is no larger, and with one that is no smaller."""
    return n - -(-similar * n // 100) + 1, n - -(-2 * similar * n // (100 + similar)) + 1


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle with these first COUNT_BITS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                np.add.at(total, np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - COUNT_BITS), 1)
        chunks = total.reshape(-1, COUNT_CHUNK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(chunks)), pa.int32()),
                pa.array([TaskContext.get().partitionId() // 64] * len(chunks), pa.int32()),
                pa.array([c.tobytes() for c in chunks], pa.binary()),
            ],
            names=["chunk", "part", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"])
        return pa.table([table["chunk"][:1], table["part"][:1], pa.array([total.tobytes()])], names=table.column_names)

    schema = "chunk int, part int, counts binary"
    parts = sets.select("shingles").mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    total = np.zeros((1 << COUNT_BITS) // COUNT_CHUNK * COUNT_CHUNK, np.int64).reshape(-1, COUNT_CHUNK)
    for row in parts.groupBy("chunk").applyInArrow(add, schema).collect():
        total[row.chunk] = np.frombuffer(row.counts, np.int64)
    return np.minimum(total.ravel(), (1 << 31) - 1).astype(np.int32)


def prefixes(sets: DataFrame, counts: np.ndarray, cut: Bands) -> DataFrame:
    """(key, node, comp, n, at, leads): the shingles of each set's prefix that others may
    have too, where they stand, and whether the set may be the smaller one that meets
    others there."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            keys, sizes, leads, places = [], [], [], []
            for x in batch.column("shingles"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                # By count, equal ones by hash.
                count = of[s >> np.uint64(64 - COUNT_BITS)]
                most, first = prefix(len(s), cut.similar)
                order = np.argsort(count, kind="stable")[:most]
                places.append(np.flatnonzero(count[order] != 1))  # the rest is this set's alone
                keys.append(s[order[places[-1]]].view(np.int64))
                sizes.append(len(s))
                leads.append(places[-1] < first)
            many = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])),
                    pa.array(np.repeat(np.asarray(batch.column("node")), many)),
                    pa.array(np.repeat(np.asarray(batch.column("comp")), many)),
                    pa.array(np.repeat(np.array(sizes, np.int64), many)),
                    pa.array(np.concatenate([*places, np.zeros(0, np.int64)])),
                    pa.array(np.concatenate([*leads, np.zeros(0, bool)])),
                ],
                names=["key", "node", "comp", "n", "at", "leads"],
            )

    schema = "key long, node long, comp long, n long, at long, leads boolean"
    return sets.select("node", "comp", "shingles").mapInArrow(run, schema)


def parities(sets: DataFrame) -> DataFrame:
    """(node, parity): of each bit whether an odd number of the set's shingles fall on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column("shingles"):
                at = (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - PARITY_BITS)).astype(np.int64)
                made.append(np.packbits(np.bincount(at, minlength=1 << PARITY_BITS) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "parity"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, parity binary")


CELL = ("node", "comp", "n", "at", "leads", "block", "sig", "parity")


def cell_pairs(cell: list[tuple], cut: Bands = Bands()) -> list[tuple[int, int, int]]:
    """(a, b, distance) of the near pairs of a cell that lie between components and have
    enough shingles left from the one they meet under, and few enough apart. Within one block each two rows
    meet, else those of different blocks."""
    if len(cell) < 2:
        return []
    node, comp, n, at, leads, block = (np.array([r[i] for r in cell], np.int64) for i in range(3, 9))
    sig = np.frombuffer(b"".join([r[9] for r in cell]), np.uint8).reshape(-1, cut.values)
    parity = np.frombuffer(b"".join([r[10] for r in cell]), np.uint64).reshape(len(cell), -1)
    across = cell[0][1] != cell[0][2]
    out = []
    for i in range(len(cell) - 1):
        later = np.arange(i + 1, len(cell))
        later = later[(comp[later] != comp[i]) & ((block[later] != block[i]) if across else True)]
        smaller = np.where(n[later] < n[i], leads[later], leads[i])
        smaller = np.where(n[later] == n[i], leads[later] | leads[i], smaller)
        left = np.minimum(n[later] - at[later], n[i] - at[i])
        later = later[(smaller > 0) & ((100 + cut.similar) * left >= cut.similar * (n[later] + n[i]))]
        distance = (sig[later] != sig[i]).sum(axis=1)
        near = np.flatnonzero(distance <= cut.distance)
        apart = np.bitwise_count(parity[later[near]] ^ parity[i]).sum(axis=1, dtype=np.int64)
        few = (100 + cut.similar) * apart <= (100 - cut.similar) * (n[later[near]] + n[i])
        for k in near[few].tolist():
            a, b = sorted((int(node[i]), int(node[later[k]])))
            out.append((a, b, int(distance[k])))
    return out


def first_key(differ: np.ndarray, cut: Bands = Bands()) -> int:
    """Chunk and left-out value of the first key that two signatures share."""
    chunks = differ.reshape(cut.chunks, cut.per_chunk)
    chunk = int(np.argmax(chunks.sum(axis=1) <= 1))
    return chunk * cut.per_chunk + int(np.argmax(chunks[chunk]))


def pair_batch(pairs: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = [*zip(*pairs, strict=True)] or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "distance"])


def similar_sizes(a: str, b: str, similar: int) -> str:
    """Sets of these sizes can be similar enough at all."""
    return f"100 * least({a}, {b}) >= {similar} * greatest({a}, {b})"


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after merging along the links: in each round every component hooks on
    to its least neighbour below it, hooks are followed to their ends, and labels
    are renamed; until no link lies between components. FEW_LINKS or fewer between
    components are followed at once, by the driver: each round is a dozen small jobs."""
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
        b = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        between = links.join(a, "a").join(b, "b").filter("comp_a != comp_b")
        ends = F.greatest("comp_a", "comp_b").alias("comp"), F.least("comp_a", "comp_b").alias("root")
        between = materialize(between.select(*ends).distinct(), "near-between")
        few = between.limit(FEW_LINKS + 1).toArrow()
        if not few.num_rows:
            return labels
        settled = few.num_rows <= FEW_LINKS
        hooks = labels.sparkSession.createDataFrame(least_linked(few)) if settled else followed(between)
        moved = labels.join(hooks, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        labels = materialize(moved, "near-labels")
        if settled:
            return labels


def least_linked(links: pa.Table) -> pa.Table:
    """(comp, root): of the components that the links (comp, root) connect, each but the
    least one with the least."""
    above: dict[int, int] = {}

    def end(x: int) -> int:
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    for one, other in zip(links["comp"].to_pylist(), links["root"].to_pylist(), strict=True):
        low, high = sorted((end(one), end(other)))
        if low != high:
            above[high] = low
    columns = [[*above], [end(x) for x in above]]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["comp", "root"])


def followed(between: DataFrame) -> DataFrame:
    """(comp, root): every component's least neighbour below it, followed to its end."""
    hooks = materialize(between.groupBy("comp").agg(F.min("root").alias("root")), "near-hooks")
    while True:
        above = hooks.select(F.col("comp").alias("root"), F.col("root").alias("above"))
        longer = hooks.join(above, "root", "left").select("comp", F.coalesce("above", "root").alias("root"), "above")
        longer = materialize(longer, "near-hooks")
        hooks = longer.select("comp", "root")
        if longer.filter("above IS NOT NULL").isEmpty():
            return hooks


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR
) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row per input row.

    Documents whose shingle sets have a Jaccard similarity of `similar` hundredths
    (0.85) or more are linked; `component_id` is the least id reachable, and the row with that id is
    kept. Null and empty texts have no shingles and stand alone, as do null ids
    in a component of their own; equal texts are one class; rows that repeat an
    id stay together if their texts do. Other columns are ignored.
    """
    run = NearDuplicates(df, id_col, text_col, similar)
    run.run()
    return run.classes()
