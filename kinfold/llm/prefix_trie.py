"""The prefix trie of conversations, from vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. Conversations are dealt over shards by hash. A shard indexes
(position, turn) to a bitset of its conversations and walks depth first: a parent's
bitset intersected with the postings of the next position gives its children, a
popcount their members, and the bitsets of where conversations end their end lists.

Nodes of several shards meet by their path, a SHA-256 chained from turn to turn,
one row per shard and node, so that a first turn shared by a third of all
conversations costs one row a shard. A node is owned by the shard of its smallest
member. What is summed over subtrees is added up inside each shard over the nodes
it owns: whoever owns a node also holds all nodes above it, so the shards' sums add.

A posting that a single conversation holds ends its part in all sharing. From there
on its nodes have one member each and are made by plain expressions, so a shard
gets the shared stretches only, 32 bytes a turn, whatever the length of the texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import materialize

SHARD = 4096  # conversations of a shard: the bits of a bitset
ROOT = b""
BLOCK, HEADS = 5, 9  # of `rebuilt`: ids that share a head, and what its length is taken modulo

SHARD_ROWS = (
    "shard long, node int, up int, depth int, path binary, up_path binary, low long, n long, "
    "n_bytes long, ends array<long>, tails array<long>"
)
SUMMED = "path binary, depth int, conv long, parent long, n long, n_children long, n_leaves long, saved long"


@dataclass(frozen=True)
class Turns:
    """rows: (conv, pos, code, n_bytes), positions from 1; sizes: (conv, n_turns), every
    conversation once, turnless ones too."""

    rows: DataFrame
    sizes: DataFrame


@dataclass(frozen=True)
class Trie:
    """nodes: (conv, depth, parent, n, n_children, n_leaves, saved), where conv is the
    smallest member and parent that of the node above; ends: (conv, depth, member),
    the members of exactly that many turns, for nodes of several members; nodes of
    one member have it as their end if they have no child."""

    nodes: DataFrame
    ends: DataFrame


def turn_code(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _placed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns in order with the number of their place, and one row for each
    conversation in each partition: where it begins there and what came before.

    A conversation of any length is numbered by all the partitions it lies in.
    """
    text_col = F.coalesce(df[text], F.lit(""))
    rows = df.filter(df[conv].isNotNull()).select(
        df[conv].cast("long").alias("conv"),
        df[turn].alias("turn"),
        turn_code(df[role], df[text]).alias("code"),
        F.octet_length(text_col).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("code"), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        placed.select("conv", "code", "n_bytes", F.monotonically_increasing_id().alias("at")), "trie-turns"
    ).withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return placed, runs.select("conv", "part", "n", (F.col("begin") - before - 1).alias("shift"))


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Turns:
    """The turns of a table in order: null turns first, ties by content. Null role or
    text counts as empty; rows without a conversation id take no part. An empty table
    has no conversations."""
    placed, runs = _placed(df, conv, turn, role, text)
    rows = placed.join(runs.drop("n"), ["conv", "part"])
    rows = rows.select("conv", (F.col("at") - F.col("shift")).alias("pos"), "code", "n_bytes")
    return Turns(materialize(rows, "trie-numbered"), runs.groupBy("conv").agg(F.sum("n").alias("n_turns")))


def rebuilt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Turns:
    """Conversations with the head of another one, as `numbered` orders them.

    Conversation c gets the first h turns of c - c % BLOCK (all, if it has fewer; none,
    if there is no such one), then its own after its first h, for h = crc32 of its
    decimal id modulo HEADS.
    """
    placed, runs = _placed(df, conv, turn, role, text)
    sizes = runs.groupBy("conv").agg(F.sum("n").alias("n"))
    own = sizes.select(
        "conv",
        "n",
        (F.col("conv") - F.col("conv") % BLOCK).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"),
    )
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(bases, "base", "left").withColumn(
        "head", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long"))
    )
    plan = materialize(plan.select("conv", "n", "base", "h", "head"), "trie-plan")
    # One row of `runs` per conversation and partition, so that the turns of a very
    # long conversation are joined where they lie in the partitions' order.
    known = runs.select("conv", "part", "shift").join(plan.select("conv", "h", "head"), "conv")
    rows = placed.join(known, ["conv", "part"]).withColumn("pos", F.col("at") - F.col("shift"))
    rows = materialize(rows.select("conv", "pos", "code", "n_bytes", "h", "head"), "trie-own")
    # Of a base, at most HEADS - 1 turns go to at most BLOCK conversations.
    heads = (
        rows.filter(F.col("pos") < HEADS)
        .select(F.col("conv").alias("base"), "pos", "code", "n_bytes")
        .join(plan.select("conv", "base", "head"), "base")
        .filter(F.col("pos") <= F.col("head"))
    )
    rest = rows.filter(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    columns = ["conv", "pos", "code", "n_bytes"]
    n_turns = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return Turns(
        materialize(heads.select(*columns).unionAll(rest.select(*columns)), "trie-rebuilt"),
        plan.select("conv", n_turns.alias("n_turns")),
    )


def prefix_trie(turns: Turns) -> Trie:
    """All nodes of the trie of these conversations, the root included.

    `saved` is summed over a node's subtree: (members - 1) times the bytes of the last
    text of each node. Repeated conversations are members of the same nodes. Without
    conversations there is no node, not even a root. A conversation's shared stretch,
    at 32 bytes a turn, has to fit a task; the rest of it is never held together.
    """
    spark = turns.rows.sparkSession
    # Where each conversation first has a turn that no other has at that place.
    postings = turns.rows.groupBy("pos", "code").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    cuts = postings.filter("n = 1").groupBy("conv").agg(F.min("pos").alias("cut"))
    convs = materialize(turns.sizes.join(cuts, "conv", "left"), "trie-convs")
    total = convs.count()
    shards = max(1, -(-total // SHARD))
    sizes = convs.select("conv", F.col("n_turns").alias("_rows"))
    known = skew_join(turns.rows, convs, ["conv"], ["pos"], counts=sizes)
    shared = known.filter(F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
    shard = F.pmod(F.xxhash64("conv"), F.lit(shards)).alias("shard")
    closing = convs.select(
        shard,
        "conv",
        F.coalesce(F.col("cut"), F.col("n_turns") + 1).alias("pos"),
        F.lit(None).cast("binary").alias("code"),
        F.when(F.col("cut").isNull(), 0).otherwise(1).cast("long").alias("n_bytes"),
    )
    rows = shared.select(shard, "conv", "pos", "code", "n_bytes").unionAll(closing)
    found = materialize(rows.groupBy("shard").applyInArrow(_shard_nodes, SHARD_ROWS), "trie-shards")

    merged = found.groupBy("path").agg(
        F.min("low").alias("conv"),
        F.max("up_path").alias("up_path"),
        F.sum("n").alias("n_convs"),
        F.sum(F.size("tails")).alias("n_tails"),
    )
    merged = materialize(merged, "trie-merged")
    below = merged.filter("up_path IS NOT NULL").groupBy(F.col("up_path").alias("path"))
    whole = merged.join(below.agg(F.count(F.lit(1)).alias("n_below")), "path", "left").select(
        "path", "conv", "n_convs", (F.coalesce("n_below", F.lit(0)) + F.col("n_tails")).alias("n_children")
    )
    placed = materialize(found.drop("up_path").join(whole, "path"), "trie-placed")
    summed = (
        placed.select(
            *["shard", "node", "up", "depth", "path", "low", "conv", "n_convs", "n_children", "n_bytes"],
            F.size("tails").cast("long").alias("n_tails"),
        )
        .groupBy("shard")
        .applyInArrow(_subtree_sums, SUMMED)
        .groupBy("path")
        .agg(
            *[F.max(c).alias(c) for c in ("conv", "depth", "parent", "n", "n_children")],
            *[F.sum(c).alias(c) for c in ("n_leaves", "saved")],
        )
        .drop("path")
    )

    # The turns from the cut on: nodes of one member.
    tails = known.filter(F.col("pos") >= F.col("cut"))
    parents = placed.select(F.explode("tails").alias("conv"), F.col("conv").alias("parent"))
    first = tails.filter(F.col("pos") == F.col("cut")).join(parents, "conv")
    later = tails.filter(F.col("pos") > F.col("cut")).withColumn("parent", F.col("conv"))
    columns = ["conv", "pos", "parent", "n_turns"]
    alone = first.select(*columns).unionAll(later.select(*columns))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = alone.select(
        "conv",
        F.col("pos").cast("int").alias("depth"),
        "parent",
        one.alias("n"),
        (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved"),
    )
    ends = placed.filter(F.size("ends") > 0).select("conv", "depth", F.explode("ends").alias("member"))
    return Trie(summed.select(*alone.columns).unionAll(alone), ends)


def _shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of a shard, parents before children, from its vertical bitmaps."""
    convs, who = np.unique(table["conv"].to_numpy(), return_inverse=True)
    places = table["pos"].to_numpy()
    coded = pc.dictionary_encode(table["code"].combine_chunks(), null_encoding="mask")
    codes = coded.dictionary.to_pylist()
    turn = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n_bytes = table["n_bytes"].to_numpy()
    postings: dict[tuple[int, int], int] = {}
    weight: dict[int, int] = {}
    turn_at: dict[int, dict[int, int]] = defaultdict(dict)
    order = np.lexsort((turn, places))
    starts = np.flatnonzero(np.diff(places[order], prepend=-1) | np.diff(turn[order], prepend=-2))
    closes: dict[tuple[int, int], int] = {}  # (depth, has a tail) to conversations
    for start, stop in zip(starts, [*starts[1:], len(order)], strict=True):
        rows = order[start:stop]
        at, code = int(places[rows[0]]), int(turn[rows[0]])
        if code < 0:
            for tail in (0, 1):
                closes[at - 1, tail] = _bitset(who[rows[n_bytes[rows] == tail]], len(convs))
            continue
        postings[at, code] = _bitset(who[rows], len(convs))
        weight[code] = int(n_bytes[rows[0]])
        turn_at[at].update(dict.fromkeys(who[rows].tolist(), code))

    shard = table["shard"][0].as_py()
    out: dict[str, list] = {name: [] for name in _names(SHARD_ROWS)}
    stack = [((1 << len(convs)) - 1, 0, ROOT, -1, 0)]
    while stack:
        bits, depth, path, up, size = stack.pop()
        node = len(out["node"])
        ended, tailed = bits & closes.get((depth, 0), 0), bits & closes.get((depth, 1), 0)
        low = int(convs[(bits & -bits).bit_length() - 1])
        up_path = out["path"][up] if up >= 0 else None
        ends, tails = convs[_members(ended)], convs[_members(tailed)]
        row = (shard, node, up, depth, path, up_path, low, bits.bit_count(), size, ends, tails)
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
        rest = bits & ~(ended | tailed)
        while rest:
            code = turn_at[depth + 1][(rest & -rest).bit_length() - 1]
            child = bits & postings[depth + 1, code]
            rest &= ~child
            stack.append((child, depth + 1, hashlib.sha256(path + codes[code]).digest(), node, weight[code]))
    schema = pa.schema(
        [
            *[(c, pa.int64()) for c in ("shard",)],
            *[(c, pa.int32()) for c in ("node", "up", "depth")],
            *[(c, pa.binary()) for c in ("path", "up_path")],
            *[(c, pa.int64()) for c in ("low", "n", "n_bytes")],
            *[(c, pa.list_(pa.int64())) for c in ("ends", "tails")],
        ]
    )
    return pa.table({c: pa.array(v, schema.field(c).type) for c, v in out.items()})


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _bitset(members: np.ndarray, n: int) -> int:
    flags = np.zeros(n, np.uint8)
    flags[members] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _subtree_sums(table: pa.Table) -> pa.Table:
    """Leaves and saved bytes below each node of a shard, of the nodes it owns."""
    table = table.sort_by("node")
    get = {c: table[c].to_numpy() for c in table.column_names if c not in ("path",)}
    owned = get["low"] == get["conv"]
    leaves = (owned & (get["n_children"] == 0)) + get["n_tails"]
    saved = np.where(owned, (get["n_convs"] - 1) * get["n_bytes"], 0)
    by_depth = np.argsort(-get["depth"], kind="stable")
    bounds = np.flatnonzero(np.diff(get["depth"][by_depth], prepend=-1))
    for start, stop in zip(bounds, [*bounds[1:], len(by_depth)], strict=True):
        rows = by_depth[start:stop]
        rows = rows[get["up"][rows] >= 0]
        np.add.at(leaves, get["up"][rows], leaves[rows])
        np.add.at(saved, get["up"][rows], saved[rows])
    parent = pa.array(get["conv"][np.maximum(get["up"], 0)], mask=get["up"] < 0)
    columns = [table["path"], table["depth"], table["conv"], parent, table["n_convs"], table["n_children"]]
    return pa.table([*columns, pa.array(leaves), pa.array(saved)], names=_names(SUMMED))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): SHA-256 of the members' decimal ids, ascending and
    joined by commas.

    Members are sorted and written out by all tasks; only the hash of a node's text,
    which is one chain by its nature, runs in one task, over a stream of its pieces.
    """
    order = ["conv", "depth", "member"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.mapInArrow(_joined, "conv long, depth int, first long, part string")
    dealt = parts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return dealt.mapInArrow(_hashed, "conv long, depth int, ends_sha256 string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth, member = (batch.column(c).to_numpy() for c in ("conv", "depth", "member"))
        starts = np.flatnonzero((np.diff(conv, prepend=conv[0] - 1) != 0) | (np.diff(depth, prepend=depth[0] - 1) != 0))
        written = member.astype(str)
        parts = [",".join(written[a:b]) for a, b in zip(starts, [*starts[1:], len(conv)], strict=True)]
        columns = [conv[starts], depth[starts], member[starts], parts]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["conv", "depth", "first", "part"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, chain = None, hashlib.sha256()
    for batch in batches:
        done = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "part")), strict=True)
        for conv, depth, part in rows:
            if (conv, depth) != node:
                if node:
                    done.append((*node, chain.hexdigest()))
                node, chain = (conv, depth), hashlib.sha256(part.encode())
            else:
                chain.update(f",{part}".encode())
        yield _digests(done)
    if node:
        yield _digests([(*node, chain.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("conv", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string()))
    columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in kinds])


def digest_columns(trie: Trie) -> DataFrame:
    """The nodes with the digest of their end lists; that of no text where nobody ends."""
    nodes = trie.nodes.join(ends_digest(trie.ends), ["conv", "depth"], "left")
    own = F.when((F.col("n") == 1) & (F.col("n_children") == 0), F.col("conv").cast("string")).otherwise("")
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(own, 256)).alias("ends_sha256"),
    )
