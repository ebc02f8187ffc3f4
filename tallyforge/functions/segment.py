"""Chinese words by a dictionary: a prefix trie, a word graph of each run of characters and the best path through it.

The dictionary is a table (word, weight). ``discover_words`` makes one from a corpus: strings
of up to ``MOST_LETTERS`` characters that occur often and hold together, counted by Spark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut_lineage

MOST_LETTERS = 4
#: Texts are cut, and their strings counted, about so many bytes or characters at a time.
AT_ONCE = 1 << 20
#: The first and the last Han character.
_FIRST, _LAST = 0x4E00, 0x9FFF
#: A dictionary is sent to all tasks, so it may have so many words.
MOST_WORDS = 500_000
#: Weights are logarithms in millionths, whole numbers, so that sums along paths are exact.
UNIT = 1_000_000
_PART = re.compile("([一-鿿]+)|([A-Za-z0-9_]+)")
#: Chinese stop words of two characters or more.
STOP_WORDS_ZH = "一个 没有 自己 什么 怎么 如何 为什么 可以 应该 必须 需要 所有 每个 还是 或者 然后 因为 所以 但是 如果 虽然 已经 正在".split()


def _sliced(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts again, of about AT_ONCE bytes together; a longer one comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield texts.slice(at, upto - at)
        at = upto


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one to MOST_LETTERS Han characters with their counts, by some texts at a time: a string is a number made of its characters."""
    for batch in batches:
        for some in _sliced(batch.column(0).cast(pa.binary())):
            whole = b"\n".join(t for t in some.to_pylist() if t).decode("utf-8", "replace")
            letters = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
            letters = np.where((letters >= _FIRST) & (letters <= _LAST), letters - _FIRST + 1, 0)
            for at in range(0, len(letters), AT_ONCE):  # strings that begin in this part; they may end in the next
                part = np.concatenate([letters[at : at + AT_ONCE + MOST_LETTERS - 1], np.zeros(MOST_LETTERS, np.int64)])
                used, number = np.flatnonzero(np.bincount(part)[1:]) + 1, 0
                place = np.zeros(_LAST - _FIRST + 2, np.int64)
                place[used] = np.arange(len(used))
                begin, part = np.flatnonzero(part[:AT_ONCE]), np.where(part > 0, place[part], -1)
                for k in range(1, MOST_LETTERS + 1):
                    last = part[begin + k - 1]
                    begin, number = begin[last >= 0], (number * len(used) + last)[last >= 0]
                    if len(used) ** k <= AT_ONCE:  # few different letters: their numbers need no sorting
                        n = np.bincount(number, minlength=1)
                        found = np.flatnonzero(n)
                        n = n[found]
                    else:
                        found, n = np.unique(number, return_counts=True)
                    codes = np.stack([used[found // len(used) ** (k - 1 - i) % len(used)] + _FIRST - 1 for i in range(k)], axis=1) if len(found) else found
                    said = codes.astype(np.uint32).tobytes().decode("utf-32-le").encode()  # three bytes a character
                    places = np.arange(len(found) + 1, dtype=np.int32) * (3 * k)
                    words = pa.StringArray.from_buffers(len(found), pa.py_buffer(places), pa.py_buffer(said))
                    yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "weight"])


def discover_words(docs: DataFrame, text_col: str = "text", least: int = 5, cohesion: float = 20.0) -> DataFrame:
    """(word, weight): strings of Han characters that occur ``least`` times and hold together, with their counts.

    A string holds together if it is, wherever it is cut in two, ``cohesion`` times as frequent as its
    parts would make it by chance. Single characters are kept with their counts.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_strings, "word string, weight long").groupBy("word").agg(F.sum("weight").alias("weight"))
    # Parts of a string that occurs so often occur as often themselves.
    counts = cut_lineage(counts.where((F.col("weight") >= least) | (F.length("word") == 1)))  # else each use below would read all texts again
    total = counts.where(F.length("word") == 1).agg(F.sum("weight").alias("total"))
    long = counts.where(F.length("word") > 1)
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    cuts = long.select("word", "weight", at).select("word", "weight", F.substring("word", F.lit(1), F.col("at")).alias("a"), F.expr("substring(word, at + 1)").alias("b"))
    part = lambda name: counts.select(F.col("word").alias(name), F.col("weight").alias(f"n{name}"))
    met = cuts.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(total))  # one row
    holds = met.groupBy("word").agg(F.first("weight").alias("weight"), F.min(F.col("weight") * F.col("total") / (F.col("na") * F.col("nb"))).alias("c"))
    return holds.where(F.col("c") >= cohesion).select("word", "weight").unionByName(counts.where(F.length("word") == 1))


@dataclass(frozen=True)
class Trie:
    """Words by their characters; a node holds the next characters and, under "", the weight of the word that ends there."""

    root: dict
    unseen: int

    @classmethod
    def of(cls, weights: dict[str, float]) -> Trie:
        total = sum(w for w in weights.values() if w > 0) or 1.0
        root: dict = {}
        for word, weight in weights.items():
            if word and weight > 0:
                node = root
                for letter in word:
                    node = node.setdefault(letter, {})
                node[""] = round(UNIT * math.log(weight / total))
        return cls(root, round(UNIT * math.log(1 / (total + 1))))

    def words_from(self, run: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, weight) of the edges of the word graph from ``start``: its words there, and the single character."""
        node, single = self.root, False
        for end in range(start, len(run)):
            node = node.get(run[end])
            if node is None:
                break
            if "" in node:
                single |= end == start
                yield end + 1, node[""]
        if not single:
            yield start + 1, self.unseen

    def cut(self, run: str) -> list[str]:
        """The words of the path of greatest weight; of equals that of fewest words, then of the longest first words."""
        n = len(run)
        best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        step = [0] * n
        for i in range(n - 1, -1, -1):
            weight, fewer, size = max((best[end][0] + w, best[end][1] - 1, end - i) for end, w in self.words_from(run, i))
            best[i], step[i] = (weight, fewer), size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def words(self, text: str | None) -> list[str]:
        """Words of two characters or more but stop words, in order; letters and digits beside Han characters in lower case."""
        found = (w for m in _PART.finditer(text or "") for w in (self.cut(m[1]) if m[1] else [m[2].lower()]))
        return [w for w in found if len(w) >= 2 and w not in STOP_WORDS_ZH]


def segmenter(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A function from a text to its words by ``dictionary`` (word, weight); the weights of repeated words add up.

    The dictionary must have at most MOST_WORDS words, as every worker holds its trie.
    """
    held = dictionary.where(F.col("word").isNotNull() & (F.col("weight") > 0)).groupBy("word").agg(F.sum("weight").cast("double").alias("weight"))
    rows = held.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    sent = dictionary.sparkSession.sparkContext.broadcast({r.word: r.weight for r in sorted(rows)})

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie.of(sent.value)
        for texts in batches:
            for some in _sliced(texts):  # words of a whole batch would take some fifty bytes each
                yield pa.array([trie.words(t) for t in some.to_pylist()], pa.list_(pa.string()))

    return cut
