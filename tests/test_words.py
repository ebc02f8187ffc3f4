"""Segmentation against all paths, discovery by hand, postings over words."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import segment
from tallyforge.functions import text as tx
from tallyforge.operators import retrieval, search


def all_cuts(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        for rest in all_cuts(run[i:]):
            yield [run[:i], *rest]


def plain_best(run, weights):
    """The best of all ways to cut a run into words and single characters."""
    total = sum(weights.values()) or 1.0
    unseen = round(segment.UNIT * math.log(1 / (total + 1)))

    def worth(cut):
        each = [round(segment.UNIT * math.log(weights[w] / total)) if w in weights else unseen if len(w) == 1 else None for w in cut]
        return None if None in each else (sum(each), -len(cut), [len(w) for w in cut])

    return max((c for c in all_cuts(run) if worth(c)), key=worth)


def test_the_best_of_all_paths():
    rng = random.Random(2)
    letters = "中文分词器"
    for _ in range(400):
        weights = {"".join(rng.choices(letters, k=rng.randint(1, 4))): float(rng.choice([1, 1, 2, 3, 10, 0.5])) for _ in range(rng.randint(0, 9))}
        run = "".join(rng.choices(letters, k=rng.randint(0, 9)))
        assert segment.Trie.of(weights).cut(run) == plain_best(run, weights)


def test_known_texts():
    words = {w: 10.0 for w in ("研究", "研究生", "生命", "起源", "北京", "大学", "北京大学")} | {"命": 1.0, "的": 50.0}
    trie = segment.Trie.of(words)
    assert trie.cut("研究生命的起源") == ["研究", "生命", "的", "起源"]
    assert trie.words("北京大学的GDP 2024年, 没有x研究") == ["北京大学", "gdp", "2024", "研究"]
    assert trie.words(None) == trie.words("") == trie.words("，。") == [] and segment.Trie.of({}).cut("中文") == ["中", "文"]
    assert len(trie.cut("研究" * 50_000)) == 50_000


@pytest.fixture(scope="module")
def words(spark):
    rows = [("研究", 10), ("生命", 10), ("起源", 10), ("北京", 7), ("北京", 3), (None, 9), ("无", 0), ("的", 50)]
    return segment.segmenter(spark.createDataFrame(rows, "word string, weight int"))


def test_tokens_by_words_and_without(spark, words):
    df = spark.createDataFrame([(1, "研究生命的起源"), (2, "北京 research of 生命"), (3, "plain words"), (4, None), (5, "")], "id long, text string")
    got = {r.id: r.t for r in df.select("id", tx.tokens_by_language(F.col("text"), words).alias("t")).collect()}
    assert got[3] == ["plain", "words"] and set(got[2]) >= {"北京", "生命", "research"}
    plain = {r.id: r.t for r in df.select("id", tx.tokens_by_language(F.col("text")).alias("t")).collect()}
    assert plain[1][:2] == ["研", "究"] and "研究" in plain[1]


def test_a_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(segment, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        segment.segmenter(spark.createDataFrame([("一二", 1), ("三四", 1), ("五六", 1)], "word string, weight int"))


def test_discovery_by_hand(spark):
    rng = random.Random(4)
    filler = [chr(0x4E00 + i) for i in range(200)]
    texts = ["".join(rng.choices(filler, k=30)) + "葡萄" + "".join(rng.choices(filler, k=30)) for _ in range(60)] + [None, "", "abc"]
    found = {r.word: r.weight for r in segment.discover_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert found["葡萄"] == 60 and found["葡"] == 60 and {w for w in found if len(w) > 1} == {"葡萄"}


def test_discovery_reads_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([("葡萄" * 9,)] * 20, "text string").select(seen("text").alias("text"))
    assert {r.word for r in segment.discover_words(docs, cohesion=0.0).collect()} >= {"葡", "萄", "葡萄", "萄葡萄葡"} and read.value == 20


def test_strings_are_counted_across_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("中文分词器a，", weights=[9, 9, 9, 9, 9, 1, 1], k=rng.randint(0, 60))) for _ in range(80)] + [None, "".join(map(chr, range(0x4E00, 0x4F00)))]
    want = Counter(run[i : i + k] for t in texts for run in re.findall("[一-鿿]+", t or "") for k in range(1, 5) for i in range(len(run) - k + 1))
    for most in (7, 100, 1 << 20):
        monkeypatch.setattr(segment, "AT_ONCE", most)
        got = Counter()
        for x in segment._strings(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
            for word, n in zip(*(c.to_pylist() for c in x.columns), strict=True):
                got[word] += n
        assert got == want


def test_words_are_handed_on_a_few_texts_at_a_time(words):
    texts = ["北京的生命" * 200] * 2_000 + [None]
    parts = list(words.func(iter([pa.array(texts)])))
    assert len(parts) > 3 and [w for p in parts for w in p.to_pylist()] == [["北京", "生命"] * 200] * 2_000 + [[]]


def test_postings_over_words(spark, words, tmp_path):
    docs = spark.createDataFrame([(1, "研究生命的起源"), (2, "北京的生命"), (3, "命的生")], "doc_id long, text string").select("doc_id", words(F.col("text")).alias("w"))
    index = search.PostingsIndex(spark, str(tmp_path / "words"))
    index.build(docs, F.col("w"))
    assert sorted(r.doc_id for r in index.search(["生命"], 5).collect()) == [1, 2]
    assert index.search(["生命", "北京"], 5).collect() == retrieval.bm25(docs, F.col("w"), ["生命", "北京"], 5).collect()
