"""Substring dedup by recurring phrases, confirmed and located by sharded automata.

A phrase is a window of 13 words. Each window names an anchor, the least hash among its
runs of seven words, so equal windows have equal anchors and a document has few of them.
Anchors that several documents hold tell which windows can recur; these windows are
counted by hash, and each recurring one belongs to the least document that holds it.
The owners' own words are compiled into Aho-Corasick automata, sharded by owner, with a
word as one letter of the alphabet. Every document streams through the automata of
the shards that own one of its windows, which locate all places word by word.

Cases: a null or short text has no window and loses nothing. A document without an id
neither owns windows nor loses words. Rows that repeat an id are one document as to
ownership, and each row is rewritten by itself. Very long texts count whole, held by one
task with some 40 bytes for each of the text's own; a tie for
the owner cannot arise between ids. Other columns are not looked at, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._scratch import Scope, keep
from tallyforge.llm._words import slices, window_hashes, word_hashes

WINDOW = 13
ANCHOR = 7
#: About so many windows go into one automaton, and so many documents through one copy of it.
SHARD_WINDOWS, SHARD_DOCS = 20_000, 2000


def anchors(words: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> np.ndarray:
    """The anchor of each window in an array of word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    runs = window_hashes(words, k)
    out = runs[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(out, runs[j : j + n], out)
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [x.as_py() for x in batch.column("text").cast(pa.binary())]
        hashes, first = word_hashes(texts)
        split = [t.split() for t in texts]
        found = [np.unique(anchors(hashes[first[i] : first[i + 1]])).astype(np.int64) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("tk"), pa.array([len(w) for w in split], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split]), _lists(found, pa.int64()),
            ],
            names=["doc_id", "tk", "n_words", "whole_sha256", "anchors"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, first = word_hashes([x.as_py() for x in batch.column("text").cast(pa.binary())])
        hits = batch.column("hits").to_pylist()
        which, place, code = [], [], []
        for i, hit in enumerate(hits):
            words = hashes[first[i] : first[i + 1]]
            at = np.flatnonzero(np.isin(anchors(words), np.array(hit, np.int64).astype(np.uint64)))
            value, once = np.unique(window_hashes(words, WINDOW)[at], return_index=True)
            which.append(np.full(len(value), i))
            place.append(at[once])
            code.append(value)
        w, p, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, place, code))
        ids = batch.column("doc_id").take(pa.array(w))
        for a in range(0, len(c), 1 << 16):
            s = np.s_[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[s].astype(np.int64)), ids.slice(a, 1 << 16), pa.array(p[s].astype(np.int32))], names=["w", "doc_id", "place"]
            )


class WordAlphabet(dict):
    """Two characters for each word of the phrases; other words share two that no phrase holds.

    An automaton looks through a node's branches one by one, so a word takes a character for
    its number by 256 and one for the rest, which keeps branches few.
    """

    def letters(self, word: bytes) -> str:
        n = len(self)
        return self.setdefault(word, chr(0x100 + n // 256) + chr(n % 256))

    def __missing__(self, word: bytes) -> str:
        return "\U00010000\U00010000"


def phrase_automaton(owners: list[tuple[object, bytes, list[int]]], window: int = WINDOW) -> tuple[ahocorasick.Automaton, WordAlphabet]:
    """An automaton over the windows of (owner, text, places), each with its owner."""
    a, alphabet = ahocorasick.Automaton(), WordAlphabet()
    for owner, text, places in owners:
        line = "".join(map(alphabet.letters, text.split()))
        for p in places:
            if 2 * (p + window) <= len(line):
                a.add_word(line[2 * p : 2 * (p + window)], owner)
    a.make_automaton()
    return a, alphabet


def _locate(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    owners = list(
        zip(phrases.column("owner").to_pylist(), (x.as_py() for x in phrases.column("own_text").cast(pa.binary())), phrases.column("places").to_pylist(), strict=True)
    )
    ids, spans = [], []
    if owners and docs.num_rows:
        automaton, alphabet = phrase_automaton(owners)
        for i, (doc_id, text) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()), strict=True)):
            runs: list[int] = []
            for end, owner in automaton.iter("".join(map(alphabet.__getitem__, text.as_py().split()))):
                if owner < doc_id:
                    end = end // 2 + 1
                    if runs and end - WINDOW <= runs[-1]:
                        runs[-1] = end
                    else:
                        runs += [end - WINDOW, end]
            if runs:
                ids.append(i)
                spans.append(np.array(runs))
    picked = docs.select(["doc_id", "tk"]).take(pa.array(ids, pa.int64()))
    return picked.append_column("spans", _lists(spans, pa.int32()))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, kept_text = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
            words = text.as_py().split()
            stay = np.ones(len(words), bool)
            for run in spans:
                for a, b in zip(run[::2], run[1::2], strict=True):
                    stay[a:b] = False
            kept = b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)
            n.append(int(len(words) - stay.sum()))
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tk"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
            names=["doc_id", "tk", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs``.

    ``kept_text`` is the words left, joined by a space; null where nothing was removed.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("tk"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, tk binary, n_words long, whole_sha256 string, anchors array<long>"
    with Scope(spark) as passing:
        survey = keep(picked.mapInArrow(_survey, shape), "phrase-survey")
        held = survey.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("h"))
        again = held.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
        again = keep(again, "phrase-anchors")
        hits = keep(held.join(again, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hits")), "phrase-hits")
        # A copy of an earlier text loses all of its windows; only the first of equal texts goes on.
        firsts = survey.groupBy("tk").agg(F.min("doc_id").alias("first"))
        firsts = passing.hand_over(firsts, "phrase-firsts")
        first = firsts.select("tk", F.col("first").alias("doc_id"))
        hits = first.join(hits, "doc_id")
        affected = passing.hand_over(picked.join(hits, ["doc_id", "tk"]).select("doc_id", "tk", "text", "hits"), "phrase-affected")
        survey = passing.hand_over(survey.drop("anchors"), "phrase-sizes")
    with Scope(spark) as passing:
        spans = passing.hand_over(_spans(affected, kind), "phrase-spans")
    cut = affected.drop("hits").join(spans, ["doc_id", "tk"]).mapInArrow(
        _rewrite, f"doc_id {kind}, tk binary, n_removed long, kept_sha256 string, kept_text string"
    )
    cut = cut.dropDuplicates(["doc_id", "tk"])
    sized = survey.join(firsts, "tk", "left").withColumn("copy", F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= WINDOW), F.lit(False)))
    gone = lambda whole, part, none: F.when(F.col("copy"), whole).otherwise(F.coalesce(part, none))
    return sized.join(cut, ["doc_id", "tk"], "left").select(
        "doc_id", "n_words", gone(F.col("n_words"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        gone(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("whole_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def _spans(affected: DataFrame, kind: str) -> DataFrame:
    """(doc_id, tk, spans): runs of words to remove, as found by the automata."""
    with Scope(affected.sparkSession) as passing:
        windows = keep(affected.mapInArrow(_windows, f"w long, doc_id {kind}, place int"), "phrase-places")
        least = windows.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("b")).where("owner < b").select("w", "owner")
        least = keep(least, "phrase-windows")
        shards = max(1, -(-least.count() // SHARD_WINDOWS))
        own_place = F.when(F.col("doc_id") == F.col("owner"), F.col("place"))
        shared = windows.join(least, "w").groupBy("doc_id", "owner").agg(F.count("*").alias("n"), F.collect_list(own_place).alias("places"))
        shared = passing.hand_over(shared, "phrase-shared")
    # Owners go where the document goes that owns most of their own windows, so copies of one text share a shard.
    # A leader whose followers own more than an automaton holds has them dealt over several shards.
    own = shared.where("owner = doc_id").select("owner", F.size("places").alias("own"))
    leader = shared.groupBy(F.col("doc_id").alias("owner")).agg(F.max(F.struct("n", "owner"))["owner"].alias("leader")).join(own, "owner")
    parts = leader.groupBy("leader").agg(F.ceil(F.sum("own") / SHARD_WINDOWS).alias("parts"))
    part = F.pmod(F.xxhash64("owner", F.lit(3)), F.greatest("parts", F.lit(1)))
    leader = leader.join(parts, "leader").select("owner", F.pmod(F.xxhash64("leader", part), F.lit(shards)).alias("shard"))
    leader = keep(leader, "phrase-leaders")
    routes = keep(shared.where("owner < doc_id").join(leader, "owner").select("doc_id", "shard").distinct(), "phrase-routes")
    # A shard that many documents visit has several copies, so its documents spread over tasks.
    copies = routes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).alias("copies"))
    goes = routes.join(copies, "shard").select("doc_id", "shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("copies")).alias("copy"))
    visits = affected.select("doc_id", "tk", "text").join(goes, "doc_id").select("shard", "copy", "doc_id", "tk", "text")
    # Of rows that repeat an owner's id, any may hold a place; each text adds its own words there.
    places = shared.where("owner = doc_id").select("owner", "places").join(leader, "owner").join(copies, "shard")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("own_copy")
    places = places.select(F.col("shard").alias("own_shard"), each, "owner", "places")
    owners = affected.select(F.col("doc_id").alias("owner"), F.col("text").alias("own_text")).join(places, "owner")
    owners = owners.select("own_shard", "own_copy", "owner", "own_text", "places")
    found = visits.groupBy("shard", "copy").cogroup(owners.groupBy("own_shard", "own_copy"))
    found = found.applyInArrow(_locate, f"doc_id {kind}, tk binary, spans array<int>")
    return found.groupBy("doc_id", "tk").agg(F.collect_list("spans").alias("spans"))


def op7_repeated_phrases(docs: DataFrame) -> DataFrame:
    """The digest of ``remove_repeats`` over documents."""
    return remove_repeats(docs).drop("kept_text")
