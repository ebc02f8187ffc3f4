"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words are runs of letters a-z (A-Z folded), digits and anything beyond ASCII. A window is
``WINDOW`` consecutive words of an item; an item of fewer words is one window by itself.
The automaton holds all factors of all items; a state stands for factors that end in the
same places, so a state reached by ten words or more names one window and, through it, the
items that hold it. A document's words stream through it: each step keeps the longest
factor that ends there, found by suffix links, and from its length and state the windows
that end there follow. Words that are in no item reset the automaton at once.

The benchmark is dealt into blocks of about ``BLOCK_WORDS`` words, items longer than
``PIECE_WORDS`` as pieces that overlap by a window less a word, so no window is lost. One
block at a time reaches the driver, and is sent with the function that scans all documents
for it; a task holds one automaton. With one block no row is shuffled. With several, what
was found in each text is joined to the rows by the text's digest, equal texts once.

Cases: null texts have no words; items without words no windows. An item without an id
marks words and is not counted among items; rows that repeat an item's id are one item.
Very long texts stream a megabyte at a time. Ties: of items that share a window all count.
Rows that repeat a document's id, or lack one, are each judged by their text. Other columns
are not looked at, whatever their names. No documents give an empty result, no items no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._scratch import Scope, keep
from tallyforge.llm._words import pieces, slices

WINDOW = 10
#: Words of a block on average, and of a piece of a long item at most; an automaton has two states a word at most.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000
#: A span goes if it has this many words; a document goes if this part of its words is hit.
LEAST_SPAN, MOST_COVERAGE = 10, 0.5

_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """All factors of several word sequences; ``step`` maps words to states, ``link`` leads to the longest shorter class."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest factor and ``c``: the one that is there, or a copy for the shorter factors of its class."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        """Add a sequence and all its factors."""
        last = 0
        for c in words:
            if c in self.step[last]:
                last = self._split(last, c)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new


class ItemIndex:
    """The windows of some items, to be found in streams of words."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        held = [(item, [self.ids.setdefault(w, len(self.ids)) for w in text.split()]) for item, text in items]
        a = self.automaton = SuffixAutomaton()
        for _, words in held:
            a.add(words)
        states = range(len(a.length))
        #: The state of the last ``window`` words of a state's factors, for those long enough.
        self.last = [-1 for _ in states]
        for v in sorted(states, key=a.length.__getitem__):
            if a.length[v] >= window:
                self.last[v] = v if a.length[a.link[v]] < window else self.last[a.link[v]]
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, dict[int, set[str | None]]] = {}
        for item, words in held:
            v = 0
            for i, c in enumerate(words, 1):
                v = a.step[v][c]
                if i >= window:
                    self.items.setdefault(self.last[v], set()).add(item)
            if words and len(words) < window:
                # The words lead to a state of factors that end alike; of those only the item itself counts.
                self.short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        #: The nearest state with short items on the way up the links, the state itself first.
        self.near = [-1 for _ in states]
        if self.short:
            for v in sorted(states, key=a.length.__getitem__):
                self.near[v] = v if v in self.short else self.near[a.link[v]] if v else -1
        self.least = min([window, *(n for x in self.short.values() for n in x)])

    def track(self, texts: Iterable[bytes]) -> tuple[int, int, list[int], set[str | None]]:
        """(words, longest factor, runs of hit words as start, end, start, ..., items found) of one text in parts."""
        a, known, window, least, last, near = self.automaton, self.ids, self.window, self.least, self.last, self.near
        step, link, length = a.step, a.link, a.length
        v = n = at = longest = 0
        runs: list[int] = []
        whole: set[int] = set()
        found: set[str | None] = set()
        for part in texts:
            words = part.split()
            for at, c in enumerate(map(known.get, words), at + 1):
                if c is None:
                    v = n = 0
                    continue
                while c not in step[v]:
                    v = link[v]
                    if v < 0:
                        break
                    n = length[v]
                if v < 0:
                    v = n = 0
                    continue
                v = step[v][c]
                n += 1
                if n < least:
                    continue
                if n > longest:
                    longest = n
                reach = 0
                if n >= window:
                    whole.add(last[v])
                    reach = window
                if (u := near[v]) >= 0:
                    while u >= 0:
                        for size, items in self.short[u].items():
                            if size <= n:
                                found |= items
                                reach = max(reach, size)
                        u = near[link[u]] if u else -1
                if reach:
                    if runs and at - reach <= runs[-1]:
                        runs[-1] = at
                        start = at - reach
                        while len(runs) > 2 and start <= runs[-3]:  # a longer window reaches back over earlier runs
                            del runs[-3:-1]
                        runs[-2] = min(runs[-2], start)
                    else:
                        runs += [at - reach, at]
        for u in whole:
            found |= self.items[u]
        return at, longest, runs, found


_held: dict[str, ItemIndex] = {}


def _index(name: str, block: list[tuple[str | None, bytes]], window: int) -> ItemIndex:
    """The block's index, built once in each worker; one at a time stays."""
    if name not in _held:
        _held.clear()
        _held[name] = ItemIndex(block, window)
    return _held[name]


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes = [], [], []
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = raw.as_py().translate(_FOLDED).split()
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    if piece:
                        ids.append(item)
                        texts.append(b" ".join(piece))
                        sizes.append(len(piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["item", "words", "size"]
            )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[tuple[int, list[tuple[str | None, bytes]]]]:
    """(number of blocks, a block) for each block of about BLOCK_WORDS words, one at a time; copies of an item are dealt over blocks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text.alias("text"))
    cut = items.mapInArrow(_cut(window), "item string, words binary, size long").dropDuplicates(["item", "words"])
    cut = keep(cut, "benchmark-pieces")
    n = max(1, -(-(cut.agg(F.sum("size")).first()[0] or 0) // BLOCK_WORDS))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    for i in range(n):
        yield n, [(r.item, bytes(r.words)) for r in dealt.where(F.col("block") == i).collect()]


_FOUND = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_()]
_SHAPE = "n_words long, longest long, runs array<int>, items array<string>, unnamed boolean"


def _tracked(key: str, block: list[tuple[str | None, bytes]], window: int, only_hits: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, block, window)
        for batch in slices(batches):
            rows = [index.track(pieces(x.as_py().translate(_FOLDED))) for x in batch.column("text").cast(pa.binary())]
            stay = [i for i, r in enumerate(rows) if r[2] or not only_hits]
            rows = [rows[i] for i in stay]
            items = [sorted(x for x in r[3] if x is not None) for r in rows]
            cells = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], items, [None in r[3] for r in rows]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(stay, pa.int64())), *map(pa.array, cells, _FOUND)], names=[key, "n_words", "longest", "runs", "items", "unnamed"]
            )

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that several blocks gave, each start, end, start, ..., as runs in order that do not touch."""
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            one: list[int] = []
            for start, end in sorted(zip(runs[::2], runs[1::2], strict=True)):
                if one and start <= one[-1]:
                    one[-1] = max(one[-1], end)
                else:
                    one += [start, end]
            out.append(one)
        yield batch.set_column(batch.schema.get_field_index("runs"), "runs", pa.array(out, pa.list_(pa.int32())))


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, n_words, longest, runs, items, unnamed) for every row of ``docs``.

    ``longest`` is the length of the longest factor of an item, from the shortest window on;
    ``runs`` the hit words as start, end, start, ...; ``items`` the ids, as strings in order,
    of items with windows in the text; ``unnamed`` whether an item without an id has one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    with Scope(docs.sparkSession) as passing:
        found = None
        for n, block in _blocks(benchmark, item_col, item_text_col, window):
            if n == 1:
                return picked.mapInArrow(_tracked("doc_id", block, window, False), f"doc_id {kind}, {_SHAPE}")
            if found is None:
                picked = picked.withColumn("tk", F.unhex(F.md5("text")))
                texts = keep(picked.select("tk", "text").dropDuplicates(["tk"]), "benchmark-texts")
                found = []
            found.append(keep(texts.mapInArrow(_tracked("tk", block, window, True), f"tk binary, {_SHAPE}"), "benchmark-found"))
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        every = every.groupBy("tk").agg(
            F.max("longest").alias("longest"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("unnamed").alias("unnamed"),
        )
        every = passing.hand_over(every.mapInArrow(_united, every.schema), "benchmark-hits")
    sized = picked.withColumn("n_words", _n_words(F.col("text"))).drop("text")
    none = lambda kind: F.array().cast(kind)
    return sized.join(every, "tk", "left").select(
        "doc_id", "n_words", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.coalesce("runs", none("array<int>")).alias("runs"),
        F.coalesce("items", none("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"),
    )


def _n_words(text: F.Column) -> F.Column:
    """Words of a text: starts of runs, counted without a list of them."""
    marks = F.regexp_replace(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "a")
    return F.length(F.regexp_replace(marks, r"[^a]", "")).cast("long")


def hit_words(runs: F.Column) -> F.Column:
    """How many words a list of start, end, start, ... covers."""
    signs = F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a + x)


def without_spans(text: str, runs: list[int], least: int = LEAST_SPAN) -> str:
    """The text without the spans of at least ``least`` words, from the first letter of a span to its last."""
    raw = text.encode()
    spans = [(a, b) for a, b in zip(runs[::2], runs[1::2], strict=True) if b - a >= least]
    out, at, k = [], 0, 0
    for i, m in enumerate(_WORD.finditer(raw)):
        if k == len(spans):
            break
        if i == spans[k][0]:
            out.append(raw[at : m.start()])
        if i == spans[k][1] - 1:
            at, k = m.end(), k + 1
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, least_span: int = LEAST_SPAN, most_coverage: float = MOST_COVERAGE,
) -> DataFrame:
    """(doc_id, clean_text, n_hit, n_words) of the rows that stay.

    Rows of which more than ``most_coverage`` of the words is hit go; from the others spans of at least
    ``least_span`` hit words are removed. A null text stays null.
    """
    whole = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = whole.schema["row"].dataType["doc_id"].dataType.simpleString()
    found = scan_benchmark(whole, benchmark, "row", "text", item_col, item_text_col, window).withColumn("n_hit", hit_words(F.col("runs")))
    stay = found.where(F.col("n_hit") <= most_coverage * F.col("n_words")).select("doc_id.doc_id", "doc_id.text", "runs", "n_hit", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [without_spans(x, r, least_span) if r else x for x, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(clean, pa.string()), batch.column("n_hit"), batch.column("n_words")], names=["doc_id", "clean_text", "n_hit", "n_words"]
            )

    return stay.mapInArrow(run, f"doc_id {kind}, clean_text string, n_hit long, n_words long")


def op12_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan_benchmark`` over documents."""
    found = scan_benchmark(docs, benchmark).withColumn("n_hit", hit_words(F.col("runs")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
