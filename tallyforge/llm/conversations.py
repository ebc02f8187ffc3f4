"""Conversation prefix trie by mergeable partial tries.

A node stands for the first d turns, roles and texts, of the conversations that start with
them. Its key is a digest of d and of four sums over the turns of 32-bit hashes of place,
role and text, so a key follows from sums before a turn and the turn itself, wherever the
turns of a conversation lie. Each task combines the nodes of its own rows into a partial
trie: members, least member, and the conversations that end there (Spark's partial
aggregates). Partial tries merge by node key in two rounds, first within ``SLICES`` slices
of the conversations, so that a node that all conversations share is summed by many tasks,
then over slices. Counts of a subtree roll up from the bottom by doubling: a node hands the
sum of its nearest 2**k - 1 levels to the ancestor 2**k above it, so a trie of depth d takes
log2(d) rounds, and each round has only the nodes that are so deep.

Order and sums do not need a conversation in one task: turns are dealt by ranges of
(conversation, turn), places count on from range to range, and sums go by blocks of
``BLOCK`` turns. Lists of ends are merged in chunks of neighbouring ids; a digest over
several chunks is streamed over them.

Cases: null roles and texts are empty. Turns without a number come first; equal numbers go
by the digest of role and text. Rows without a conversation id take no part; repeated rows
are turns each. Conversations without turns end at the root. Very long texts count whole.
Ids are whole numbers; other columns are not looked at, whatever their names. An empty
table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._scratch import Scope, keep

#: Slices of conversations in which partial tries merge first; turns of a block of sums; ids of a chunk of ends, as a power of two.
SLICES, BLOCK, CHUNK_BITS = 16, 4096, 16
_SUMS = ("s0", "s1", "s2", "s3")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with the place of each among those of its conversation in this partition."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        at = np.arange(len(conv))
        rank = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
        if not new[0]:
            rank[: np.argmax(new) if new.any() else len(new)] += count
        last, count = conv[-1], int(rank[-1])
        yield batch.append_column("rank", pa.array(rank, pa.int64()))


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, size) of every turn: its place from 1, a digest of role and text, code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("size"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size", F.spark_partition_id().alias("part"))
    held = keep(dealt.mapInArrow(_ranked, "conv_id long, digest binary, size long, part int, rank long"), "turns-ranked")
    counts = held.groupBy("conv_id", "part").agg(F.max("rank").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition at most: only a conversation that goes on from another partition has turns before.
    shift = keep(counts.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before"), "turns-before")
    return held.join(shift, ["conv_id", "part"], "left").select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "size")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def keyed_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, pos, size, key, parent) for each row (conv_id, pos, digest, size): the node of its first ``pos`` turns and the one before.

    The row at place 0 stands for the root.
    """
    hashes = [F.xxhash64("pos", "digest"), F.xxhash64(F.lit(17), "pos", "digest")]
    half = [x for h in hashes for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    rows = paths.select("conv_id", "pos", "size", (F.col("pos") / BLOCK).cast("long").alias("block"), *(F.when(F.col("pos") > 0, x).otherwise(0).alias(f"h{i}") for i, x in enumerate(half)))
    whole = rows.groupBy("conv_id", "block").agg(*(F.sum(f"h{i}").alias(s) for i, s in enumerate(_SUMS)))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "block", *(F.sum(s).over(earlier).alias(s) for s in _SUMS)).where("block > 0")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("conv_id", "block", "pos", "size", *(f"h{i}" for i in range(4)), *(F.sum(f"h{i}").over(upto).alias(f"r{i}") for i in range(4)))
    running = running.join(before, ["conv_id", "block"], "left")
    sums = [F.col(f"r{i}") + F.coalesce(s, F.lit(0)) for i, s in enumerate(_SUMS)]
    parent = F.when(F.col("pos") > 0, _key(F.col("pos") - 1, [s - F.col(f"h{i}") for i, s in enumerate(sums)]))
    return running.select("conv_id", "pos", "size", _key(F.col("pos"), sums).alias("key"), parent.alias("parent"))


def partial_tries(keyed: DataFrame) -> DataFrame:
    """Nodes with their members within each slice of the conversations; tasks combine their own rows before any are sent."""
    part = F.pmod(F.xxhash64("conv_id"), F.lit(SLICES)).alias("slice")
    return keyed.groupBy("key", part).agg(
        F.first("parent").alias("parent"), F.first("pos").alias("depth"), F.first("size").alias("size"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )


def merged_tries(partial: DataFrame) -> DataFrame:
    """(key, parent, depth, size, n_convs, conv_id): one row a node; conv_id is the least member."""
    return partial.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) over each node's subtree below it, for nodes that have children.

    ``nodes`` has key, parent, depth, leaves and saved, the node's own share.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # The active nodes have an ancestor ``up`` 2**k above; leaves and saved are those of their next 2**k - 1 levels.
    active = nodes.where("depth > 0").select("key", F.col("parent").alias("up"), "depth", "leaves", "saved")
    parts, reach = [], 1
    while reach <= deepest:
        handed = keep(active.groupBy("up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumnRenamed("up", "key"), "trie-sums")
        parts.append(handed)
        reach *= 2
        if reach <= deepest:
            more = handed.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
            above = active.select(F.col("key").alias("up"), F.col("up").alias("next"))
            left = active.where(F.col("depth") >= reach).join(more, "key", "left").join(above, "up")
            add = lambda own, other: (F.col(own) + F.coalesce(other, F.lit(0))).alias(own)
            active = keep(left.select("key", F.col("next").alias("up"), "depth", add("leaves", "more_leaves"), add("saved", "more_saved")), "trie-active")
    if not parts:
        return nodes.where("false").select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's chunks in order, joined by commas."""
    key, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").cast(pa.binary()), strict=True):
            if k != key:
                if key is not None:
                    yield done()
                key, digest = k, hashlib.sha256(ids.as_py())
            else:
                digest.update(b"," + ids.as_py())
    if key is not None:
        yield done()


def end_digests(keyed: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas."""
    ends = keyed.groupBy("conv_id").agg(F.max(F.struct("pos", "key"))["key"].alias("key"))
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    lists = ends.groupBy("key", chunk).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    lists = keep(lists, "trie-ends")
    several = keep(lists.groupBy("key").count().where("count > 1").select("key"), "trie-long-ends")
    one = lists.join(several, "key", "left_anti").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    long = lists.join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids")
    return one.unionByName(long.mapInArrow(_streamed, "key binary, ends_sha256 string"))


def prefix_trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie over ``paths`` (conv_id, pos, digest, size) of the conversations ``convs`` (conv_id).

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    with Scope(paths.sparkSession) as passing:
        roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
        keyed = keep(keyed_paths(paths.select("conv_id", "pos", "digest", "size").unionByName(roots)), "trie-keyed")
        merged = keep(merged_tries(partial_tries(keyed)), "trie-merged")
        children = merged.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
        nodes = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
        nodes = passing.hand_over(nodes, "trie-nodes")
        below = passing.hand_over(rolled_up(nodes), "trie-below")
        ends = passing.hand_over(end_digests(keyed), "trie-digests")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(below, "key", "left").join(parents, "parent", "left").join(ends, "key", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``prefix_trie`` over a table of turns as it is."""
    with Scope(turns.sparkSession) as passing:
        paths = passing.hand_over(numbered_turns(turns, conv_col, turn_col, role_col, text_col), "trie-turns")
    return prefix_trie(paths, paths.select("conv_id").distinct())


#: Conversations share the opening of the first of their hundred, of at most OPENING - 1 turns.
HUNDRED, OPENING = 100, 6


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size) after each conversation's opening is replaced by that of the first of its hundred.

    The opening has h turns, the digest of the id modulo ``OPENING``; fewer if the first has fewer, none if it is absent.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    heads = turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < OPENING))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("head"))
    convs = turns.select("conv_id").distinct().withColumn("base", base).join(heads, "base", "left")
    opened = convs.select("conv_id", F.explode(F.filter("head", lambda x: x["pos"] <= h)).alias("t")).select("conv_id", "t.*")
    short = heads.select("base", F.size("head").cast("long").alias("held"))
    own = turns.where(F.col("pos") > h).withColumn("base", base).join(short, "base", "left")
    given = F.least(h, F.coalesce("held", F.lit(0)))
    return own.select("conv_id", (F.col("pos") - h + given).alias("pos"), "digest", "size").unionByName(opened)


def op11_conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie over rebuilt conversations."""
    with Scope(turns.sparkSession) as passing:
        own = keep(numbered_turns(turns), "trie-turns")
        paths = passing.hand_over(rebuilt_paths(own), "trie-paths")
        convs = passing.hand_over(own.select("conv_id").distinct(), "trie-convs")
    return prefix_trie(paths, convs)
