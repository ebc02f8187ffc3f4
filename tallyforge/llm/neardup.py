"""Near-duplicates by BagMinHash over multisets of word shingles.

Weights are counts of shingles, discretised to whole levels. Levels fall into the
intervals [0,1), [1,2), [2,4), [4,8) ..., each with a Poisson process of points seeded
by shingle and interval; a point counts if its level lies below the weight. The first
point to fall on each of the signature's components is kept, so two texts agree in a
component with the probability of their weighted Jaccard similarity. Intervals are drawn
from the highest down, and a process ends as soon as its next point comes after the first
points of all components, so a text takes some thousand points whatever its length.

Signatures are cut into bands. In each bucket of a band all texts are compared with one
hub, the text that meets most others; links are verified on the texts. Large buckets that
then still hold several components are split by their texts' rarest shingles, of which similar
texts share one, where that leaves fewer pairs, and go through hubs again. What is left is compared
in full, in blocks, and gives out no more links than join components. Neither way loses a similar
pair of a bucket, so the classes do not depend on its size. Exact copies are folded before all this.

Cases: a null text is empty; texts without words are near nothing but equal texts. A
text of fewer words than a shingle is one shingle. Very long texts are signed and
compared whole, by one task with some 40 bytes for each of the text's own. Ties for a hub go to the greater digest. Rows that repeat an id or a
text, or lack an id, get the class of their text. Other columns are not looked at,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._graph import components
from tallyforge.llm._scratch import Scope, keep
from tallyforge.llm._words import mix, slices, window_hashes, word_hashes

WORDS = 5
SIMILAR = 0.8
#: A pair at the least similarity shares no band of the 32 with probability (1 - 0.8**5)**32, 3 in a million.
BANDS, ROWS = 32, 5
#: Leftover buckets are compared in blocks of this many texts.
BLOCK = 1024


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of all windows of ``k`` words in order; one window if there are fewer words."""
    return window_hashes(words, min(k, len(words)), seed=len(words) if len(words) < k else 0) if len(words) else words


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: So many points are drawn at a time, and so many of one process at most.
DRAWN, POINTS = 1 << 18, 256


def bag_minhash(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """``m`` signature components of a multiset with positive whole weights.

    Intervals of levels go from the highest, whose points are densest, to [0, 1); a process stops once its
    next point lies beyond the latest of the components' first points so far.
    """
    until = m * (math.log(m) + 4) / float(weights.sum())
    while True:
        best, out = np.full(m, np.inf), np.zeros(m, np.uint64)
        group: list[tuple[np.ndarray, ...]] = []
        rows = room = 0
        for j in range(int(weights.max()).bit_length(), -1, -1):
            low = (1 << (j - 1)) if j else 0
            held = np.flatnonzero(weights > low)
            while len(held):
                if not group:  # intervals whose points fit together are drawn together, those of the highest set the number
                    room = DRAWN // _points(until, max(low, 1.0))
                some, held = held[: room - rows], held[room - rows :]
                key = mix(elements[some] ^ np.uint64(j * 0xA24BAED4963EE407 & (1 << 64) - 1))
                group.append((key, weights[some], np.full(len(some), float(low)), np.full(len(some), max(low, 1.0))))
                rows += len(some)
                if rows == room:
                    _draw(group, until, best, out)
                    group, rows = [], 0
        if group:
            _draw(group, until, best, out)
        if np.isfinite(best).all():
            return out
        until *= 2


def _points(until: float, rate: float) -> int:
    return min(POINTS, 4 + int(until * rate))


def _draw(group: list[tuple[np.ndarray, ...]], until: float, best: np.ndarray, out: np.ndarray) -> None:
    """Let processes (key, weight, least level, rate) put their first points on ``best`` and ``out``."""
    key, weights, low, rate = map(np.concatenate, zip(*group, strict=True))
    m, x, k = len(best), np.zeros(len(key)), 0
    while len(key):
        limit = min(until, float(best.max()))
        step = _points(limit, rate.max())
        seeds = mix(key[:, None] + (np.arange(k, k + step, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))[None, :])
        times = x[:, None] - np.cumsum(np.log(_uniform(seeds)), axis=1) / rate[:, None]
        soon = times <= limit
        owner, seed, when = np.nonzero(soon)[0], seeds[soon], times[soon]
        second = mix(seed + np.uint64(0x632BE59BD9B4E019))
        counts = low[owner] + _uniform(mix(second ^ seed)) * rate[owner] < weights[owner]  # the point's level lies below the weight
        where, when, seed = (second[counts] % np.uint64(m)).astype(np.int64), when[counts], seed[counts]
        order = np.argsort(-when, kind="stable")
        where, when, seed = where[order], when[order], seed[order]
        first, name = np.full(m, np.inf), np.zeros(m, np.uint64)
        first[where], name[where] = when, seed  # the last of equal places is the earliest point
        sooner = first < best
        out[sooner], best[sooner] = name[sooner], first[sooner]
        x = times[:, -1]
        on = x <= min(until, float(best.max()))
        key, weights, low, rate, x, k = key[on], weights[on], low[on], rate[on], x[on], k + step


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a signature."""
    parts = signature.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, j])
    return out


def _signed(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            words, first = word_hashes(texts)
            keys, size = [], []
            for i in range(len(texts)):
                found, n = np.unique(shingles(words[first[i] : first[i + 1]], k), return_counts=True)
                size.append(bands if len(found) else 0)
                if len(found):
                    keys.append(band_keys(bag_minhash(found, n, bands * rows), bands, rows))
            flat = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), lists], names=["doc_id", "tk", "bands"])

    return run


def bag(t: bytes, k: int = WORDS) -> Counter:
    """The word shingles of a text with their counts."""
    w = t.split()
    return Counter(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else Counter([tuple(w)] if w else [])


def overlap(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity of two multisets, counted exactly."""
    both = sum((x & y).values())
    every = sum(x.values()) + sum(y.values()) - both
    return both / every if every else 0.0


def _verified(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_bag = None, Counter()
        for batch in batches:
            a, b = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            good = []
            for name, x, y in zip(batch.column("b").to_pylist(), a, b, strict=True):
                if name != hub:  # rows of a hub follow each other
                    hub, hub_bag = name, bag(y.as_py(), k)
                good.append(overlap(bag(x.as_py(), k), hub_bag) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _expanded(words: np.ndarray, k: int) -> np.ndarray:
    """A set whose Jaccard similarity is the multiset's weighted one: each occurrence of a shingle by number."""
    found = np.sort(shingles(words, k))
    new = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
    nth = np.arange(len(found)) - np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return np.unique(mix(found + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def _elements(k: int, lists: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, first = word_hashes([x.as_py() for x in batch.column("text").cast(pa.binary())])
            sets = [_expanded(words[first[i] : first[i + 1]], k) for i in range(batch.num_rows)]
            held = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())) if lists else pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("tk"), held], names=["tk", "elements"])

    return run


def block_links(table: pa.Table, least: float = SIMILAR, columns: int = 8192) -> pa.Table:
    """Links between different components (``root``) among the texts of a block that join components not joined yet.

    Intersections come from products of incidence matrices, some thousand elements at a time.
    """
    names = table.column("tk").to_pylist()
    ids = {r: i for i, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
    root = np.array([ids[r] for r in table.column("root").to_pylist()])
    sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
    size = np.array([len(s) for s in sets])
    flat, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), size)
    held = shared[inverse]
    row, col = row[held], place[inverse[held]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], col[a:b] - at] = 1
        both += part @ part.T
    good = (both >= least * (size[:, None] + size[None, :] - both) - 1e-6) & (root[:, None] < root[None, :])
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(good), strict=True):
        x, y = find(root[i]), find(root[j])
        if x != y:
            parent[x] = y
            out.append((names[i], names[j]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: float = SIMILAR,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(tk, doc_id, root, class_id) for every row of ``docs``.

    ``tk`` is the digest of the text, ``root`` the digest that stands for its class and
    ``class_id`` the least id in the class.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("tk"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    with Scope(docs.sparkSession) as passing:
        signed = keep(picked.mapInArrow(_signed(bands, rows, k), f"doc_id {kind}, tk binary, bands array<long>"), "near-signed")
        nodes = keep(signed.groupBy("tk").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-texts")
        member = _shared(keep(nodes.select("tk", F.explode("bands").alias("key")), "near-bands"))
        pairs = _hub_pairs(member)

        needed = pairs.select(F.col("a").alias("tk")).union(pairs.select(F.col("b").alias("tk"))).distinct().join(nodes.select("tk", "rep"), "tk")
        same = picked["doc_id"].eqNullSafe(needed["rep"]) & (picked["tk"] == needed["tk"])
        texts = keep(picked.join(needed, same, "left_semi").select("tk", "text").dropDuplicates(["tk"]), "near-needed")
        links = _verified_links(pairs, texts, k, least)

        left = _unjoined(member, keep(components(links), "near-components"))
        large = left.where(F.col("n") > BLOCK)
        if not large.isEmpty():
            split, rarer = _rarer_keys(large, texts, k, least)
            links = links.unionByName(_verified_links(_hub_pairs(rarer), texts, k, least))
            member = left.join(split, "key", "left_anti").select("tk", "key", "n").unionByName(rarer)
            left = _unjoined(member, keep(components(links), "near-components"))
        sets = texts.join(left.select("tk").distinct(), "tk", "left_semi").mapInArrow(_elements(k), "tk binary, elements binary")
        more = _blocks(left).join(sets, "tk").groupBy("key", "at").applyInArrow(lambda t: block_links(t, least), "a binary, b binary")
        found = components(links.unionByName(more))
        root = nodes.select("tk", "rep").join(found.withColumnRenamed("node", "tk"), "tk", "left").withColumn("root", F.coalesce("root", "tk"))
        root = keep(root, "near-roots")
        ids = root.groupBy("root").agg(F.min("rep").alias("class_id"))
        by_text = root.join(ids, "root").select("tk", "root", "class_id", "rep")
        return passing.hand_over(signed.select("doc_id", "tk").join(by_text, "tk"), "near-classes")


def _shared(member: DataFrame) -> DataFrame:
    """(tk, key, n): the rows of ``member`` whose bucket holds several texts."""
    sizes = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keep(member.join(sizes, "key"), "near-members")


def _rarer_keys(large: DataFrame, texts: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(keys of large buckets worth splitting, (tk, key, n) of what they fall into).

    Two sets of a similarity of ``least`` share one of the first n - ceil(least n) + 1 elements of each, in any one order of
    all elements; here the rarest come first. So a bucket taken apart by these elements loses no similar pair, and its
    links are those of the whole bucket compared in full. It is split if fewer pairs are left to compare.
    """
    some = texts.join(large.select("tk").distinct(), "tk", "left_semi")
    each = keep(some.mapInArrow(_elements(k, lists=True), "tk binary, elements array<long>").select("tk", F.explode("elements").alias("element")), "near-elements")
    met = each.join(each.groupBy("element").agg(F.count("*").alias("df")), "element")
    first = F.slice("of", 1, (F.size("of") - F.ceil(least * F.size("of") - 1e-9) + 1).cast("int"))
    rare = met.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("of")).select("tk", F.explode(first).alias("x"))
    rare = rare.where("x.df > 1").select("tk", "x.element")
    parts = large.select("tk", F.col("key").alias("origin")).join(rare, "tk").select("tk", "origin", F.xxhash64("origin", "element").alias("key"))
    parts = _shared(keep(parts, "near-rarer"))
    pairs = parts.groupBy("origin").agg(F.sum("n").alias("after")).withColumnRenamed("origin", "key")
    whole = large.groupBy("key").agg((F.first("n") * F.first("n")).alias("before"))
    split = keep(whole.join(pairs, "key", "left").where(F.coalesce("after", F.lit(0)) < F.col("before")).select("key"), "near-split")
    return split, parts.join(split.withColumnRenamed("key", "origin"), "origin", "left_semi").select("tk", "key", "n")


def _hub_pairs(member: DataFrame) -> DataFrame:
    """(a, b): each text of a bucket with the one of them that meets most others, once."""
    central = member.groupBy("tk").agg(F.sum("n").alias("meets"))
    hubs = member.join(central, "tk").groupBy("key").agg(F.max(F.struct("meets", "tk"))["tk"].alias("hub"))
    pairs = member.join(hubs, "key").where("tk <> hub").select(F.col("tk").alias("a"), F.col("hub").alias("b")).distinct()
    return keep(pairs, "near-pairs")


def _verified_links(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs whose texts are similar."""
    joined = pairs.join(texts.select(F.col("tk").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("tk").alias("b"), F.col("text").alias("text_b")), "b")
    return keep(joined.select("a", "b", "text_a", "text_b").mapInArrow(_verified(k, least), "a binary, b binary"), "near-links")


def _unjoined(member: DataFrame, found: DataFrame) -> DataFrame:
    """(key, tk, root, n) of buckets that still hold several components; of buckets with the same members one is enough."""
    state = member.join(found.withColumnRenamed("node", "tk"), "tk", "left").select("key", "n", "tk", F.coalesce("root", "tk").alias("root"))
    state = keep(state, "near-state")
    open_keys = state.groupBy("key").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.first("n").alias("n"),
        F.sum(F.xxhash64("tk").cast("decimal(38,0)")).alias("s0"), F.bit_xor(F.xxhash64("tk", F.lit(1))).alias("s1"),
    ).where("r0 <> r1").groupBy("n", "s0", "s1").agg(F.min("key").alias("key"))
    return keep(state.join(open_keys.select("key"), "key"), "near-open")


def _blocks(left: DataFrame) -> DataFrame:
    """(key, tk, root, at): each text of a bucket in all pairs of blocks that its own block is part of."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("tk", F.lit(2)), blocks.cast("long")).cast("int")
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return left.select("key", "tk", "root", F.explode(F.array_distinct(places)).alias("at"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: the one with its least id."""
    found = classes(docs, id_col, text_col)
    chosen = found.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("root", "class_id").agg(F.min("tk").alias("tk"))
    tk = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("tk")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), tk)
    chosen = chosen.select(F.col("tk").alias("first_tk"), F.col("class_id").alias("first_id"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tk") == F.col("first_tk"))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "tk"]).select("row.*")


def op5_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and class_id, the least id among its near-duplicates."""
    return classes(docs).select("doc_id", "class_id")
