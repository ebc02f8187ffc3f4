"""All pairs of similar sets within one table: equal sets count as one, and bitmaps sift the pairs before sets are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import learning
from tallyforge.session import cut_lineage

# Joins are told to be merges: what Spark thinks of a checkpoint's size is far too small for rows made by explode, which it would broadcast.

#: A bitmap has a bit for each token of its set at least, within these bounds.
LEAST_BITS, MOST_BITS = 64, 4096
#: Sets of a group, on average; a task holds the bitmaps of two groups, of 64 MB at most. There are at least so many groups.
GROUP, LEAST_GROUPS = 1 << 16, 8
#: Ids of equal sets that are paired at once.
SLICE = 1024


def _hashes(tokens: str = "tokens") -> F.Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _mark() -> F.Column:
    """The tokens' hashes, put together by XOR: with an id it names a set, should an id have several."""
    return F.aggregate(_hashes(), F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(h))


def _spread(n: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(n)), n)


def _bitmaps(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bitmap of each set: whether a bit is set tells if an odd number of tokens falls on it. Sets of ``n`` hashes lie one after the other.

    A bitmap of twice the bits folds into one by XOR of its halves.
    """
    size = np.clip(1 << np.ceil(np.log2(n)).astype(np.int64), LEAST_BITS, MOST_BITS)
    starts = np.concatenate([[0], np.cumsum(size)])
    places = starts[:-1][_spread(n)] + (hashes & (size[_spread(n)] - 1))
    bits = np.packbits((np.bincount(places, minlength=starts[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(bits)])


def _digests(words: pa.Array, n: np.ndarray) -> list[bytes]:
    """A digest of each set's words, in their order."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, places = np.cumsum(n), np.concatenate([[0], np.cumsum(size)])
    data = memoryview(words.buffers()[2] or b"")
    return [hashlib.blake2b(size[e - k : e].tobytes() + bytes(data[places[e - k] : places[e]]), digest_size=16).digest() for e, k in zip(ends, n, strict=True)]


def _sketched(x: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """(id, n, mark, digest, first, bits) of each set that is not empty: ``first`` has the hashes of its rarest tokens, one of which all similar sets have among theirs."""
    shared = x.sparkSession.sparkContext.broadcast(common)
    kind = x.schema["id"].dataType
    types = {"id": kind, "n": T.IntegerType(), "mark": T.LongType(), "digest": T.BinaryType(), "first": T.ArrayType(T.LongType()), "bits": T.BinaryType()}
    schema = T.StructType([T.StructField(*f) for f in types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, learning.AT_ONCE):
                some = batch.slice(start, learning.AT_ONCE)
                some = some.filter(pc.and_(some.column("id").is_valid(), pc.fill_null(pc.greater(pc.list_value_length(some.column("tokens")), 0), False)))
                if not some.num_rows:
                    continue
                ids, tokens, hashes = some.columns
                n, h = tokens.value_lengths().to_numpy().astype(np.int64), hashes.flatten().to_numpy()
                order = np.lexsort((h, shared.value[h & (learning.BUCKETS - 1)], _spread(n)))
                h, begins = h[order], np.cumsum(n) - n
                most = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
                rare = h[np.arange(len(h)) - begins[_spread(n)] < most[_spread(n)]]
                first = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(most)]).astype(np.int32), rare)
                digests = _digests(tokens.flatten().take(pa.array(order)), n)
                out = [ids, pa.array(n.astype(np.int32)), pa.array(np.bitwise_xor.reduceat(h, begins)), pa.array(digests, pa.binary()), first, _bitmaps(h, n)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return x.select("id", "tokens", _hashes().alias("hashes")).mapInArrow(run, schema)


def distinct_sets(x: DataFrame, least: float) -> DataFrame:
    """(set, id, n, mark, first, bits, ids): the sets of ``x`` (id, tokens) by numbers, equal ones once, with the ids of all that have them."""
    each = x.select(F.explode_outer("tokens").alias("token"), F.lit(1).alias("df"))  # outer: a filter would cut texts into tokens once more
    sketched = _sketched(x, learning._bucket_counts(each.where("token is not null")), least)
    once = sketched.groupBy("digest").agg(F.first(F.struct("id", "n", "mark", "first", "bits")).alias("one"), F.collect_list("id").alias("ids"))
    return cut_lineage(once.select(F.monotonically_increasing_id().alias("set"), "one.*", "ids"))


def meeting_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, token, at): pairs of ``sets`` that share a token among their first ones, each one way round and some more than once.

    By the places of the token and the sizes they can still be ``least`` alike; ``learning.candidate_pairs`` says why none is missed.
    The rarest tokens are dealt once, for both sides of the join.
    """
    x = sets.select("set", "n", "first", F.posexplode("first").alias("at", "token"))
    x = x.select("set", "n", "at", "token", *(F.get("first", F.col("at") - k).alias(f"before{k}") for k in (1, 2)))
    a, b = x.alias("a"), x.alias("b")
    m, n = F.col("a.n"), F.col("b.n")
    able = (m >= least * n - 1e-9) & (F.least(m - F.col("a.at"), n - F.col("b.at")) >= F.ceil(least / (1 + least) * (m + n) - 1e-9))
    already = F.lit(False)
    for i in (1, 2):
        for j in (1, 2):
            already = already | F.coalesce(F.col(f"a.before{i}") == F.col(f"b.before{j}"), F.lit(False))
    smaller = (m < n) | ((m == n) & (F.col("a.set") < F.col("b.set")))
    met = a.join(b.hint("merge"), (F.col("a.token") == F.col("b.token")) & smaller & able & ~already)
    return met.select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.col("a.token").alias("token"), F.col("a.at").alias("at"))


def _differing(flat: np.ndarray, starts: np.ndarray, widths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps ``a`` differ from ``b``, the larger folded to the smaller: no more than tokens do. Bitmaps are ``widths`` words of ``flat`` from ``starts`` on."""
    out = np.zeros(len(a), np.int64)
    kinds, kind = np.unique(widths[a] * (MOST_BITS + 1) + widths[b], return_inverse=True)
    for k, both in enumerate(kinds):
        at, w = np.flatnonzero(kind == k), divmod(int(both), MOST_BITS + 1)
        sides = [flat[starts[s[at], None] + np.arange(v)].reshape(len(at), -1, min(w)) for s, v in zip((a, b), w, strict=True)]
        x, y = (np.bitwise_xor.reduce(s, axis=1) for s in sides)
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def sifted_pairs(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, key) of the pairs ``met`` whose bitmaps do not tell that they are less than ``least`` alike, each once.

    Sets are dealt over groups, pairs over pairs of groups, each with the bitmaps of its two groups only.
    """
    groups = max(LEAST_GROUPS, -(-sets.count() // GROUP))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    block = lambda g, h: (F.least(g, h) * groups + F.greatest(g, h)).cast("int").alias("block")
    held = sets.select("set", "n", "bits", group("set").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"))
    held = held.select(block(F.col("g"), F.col("h")), F.col("set").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("token"), F.col("n").alias("at"), "bits")
    flow = held.unionByName(met.select(block(group("a"), group("b")), "a", "b", "token", "at", F.lit(None).cast("binary").alias("bits")))
    flow = flow.repartition("block").sortWithinPartitions("block", F.col("b").isNotNull())
    schema = met.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, ready = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if blocks[start] != now:
                    now, kept, ready = blocks[start], [], None
                x = batch.slice(start, end - start)
                pairs = x.column("b").is_valid()
                own = x.filter(pc.invert(pairs))
                if own.num_rows:
                    kept.append((own.column("a").to_numpy(), own.column("at").to_numpy(), own.column("bits")))
                x = x.filter(pairs)
                if not x.num_rows:
                    continue
                if ready is None:
                    ids, n, bits = (np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]).astype(np.int64), pa.concat_arrays([k[2] for k in kept]))
                    places = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64) // 8
                    order = np.argsort(ids)
                    ready = (ids[order], n[order], np.frombuffer(bits.buffers()[2], np.uint64, places[-1]), places[:-1][order], np.diff(places)[order])
                    kept = []
                ids, n, flat, starts, widths = ready
                a, b = (np.searchsorted(ids, x.column(c).to_numpy()) for c in ("a", "b"))
                size = n[a] + n[b]
                most = size - 2 * np.ceil(least / (1 + least) * size - 1e-9).astype(np.int64)
                yield x.select(schema.names).filter(pa.array(_differing(flat, starts, widths, a, b) <= most))

    return flow.mapInArrow(run, schema).groupBy("a", "b").agg(F.min_by("token", "at").alias("key"))


def _paired(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of ids, both ways round: of the pairs ``near`` of sets, and of those with equal sets."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / SLICE).cast("int")), lambda i: F.slice("ids", i * SLICE + 1, F.lit(SLICE)))
    slices = sets.select("set", F.explode(chunks).alias("ids"), F.size("ids").alias("copies"))
    x = slices.select(F.col("set").alias("a"), F.col("ids").alias("x"))
    y = slices.select(F.col("set").alias("b"), F.col("ids").alias("y"))
    there = near.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("similarity", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    many = slices.where("copies > 1")
    equal = many.select("set", F.col("ids").alias("x")).join(many.select("set", F.col("ids").alias("y")).hint("merge"), "set")
    # By number: few rows give many pairs, so by their size all would go to one task.
    equal = equal.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select(F.lit(1.0).alias("similarity"), F.struct("x", "y").alias("p"))
    out = there.unionByName(equal).select(F.explode("p.x").alias("a"), "p.y", "similarity")
    return out.select("a", F.explode("y").alias("b"), "similarity").where("a <> b")


def similar_pairs(x: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs of different ids, both ways round, of ``x`` (id, tokens without repeats) with a Jaccard similarity of ``least`` or more.

    Empty sets are like none. Texts are read three times: to count tokens, to sketch sets, and for the sets that are compared.
    """
    sets = distinct_sets(x, least)
    pairs = cut_lineage(sifted_pairs(meeting_pairs(sets, least), sets, least))  # read three times
    named = sets.select(F.col("set"), "id", "mark")
    words = x.select("id", _mark().alias("mark"), "tokens")

    def joined(asked: DataFrame) -> DataFrame:
        return asked.withColumn("set", F.coalesce("a", "b")).join(named.hint("merge"), "set").join(words.hint("merge"), ["id", "mark"])

    held, passing = learning._asked(pairs)
    return _paired(learning._compared(held, passing, least, joined, once=True), sets)
