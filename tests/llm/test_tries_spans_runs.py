"""Conversation tries, benchmark decontamination and periodic runs against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import conversations, decontamination, periodic
from tests.llm.test_operators import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_trie(turns, rebuild=True):
    """Rows of the trie of (conv_id, turn, role, text), by sequences themselves."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, p in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        paths[c] = own.get(c - c % 100, [])[:h] + p[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    n_children, n_leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        n_children[k[:-1]] += bool(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            n_leaves[k[:d]] += not n_children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = defaultdict(list)
    for c, p in paths.items():
        ends[tuple(p)].append(c)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), n_children[k], n_leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
        for k, m in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, SIZE string, `s0` int, `a.b` int"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
told = lambda df: sorted(tuple(r[c] for c in TRIE) for r in df.collect())


def some_turns(seed, hot=0):
    rng = random.Random(seed)
    out = []
    for c in [*range(0, 12), *range(95, 112), 200, 203, 299, 40_000, 70_001, 70_002, *range(300, 300 + hot)]:
        n = 4 if c >= 300 and c < 40_000 else rng.randint(1, 9)
        same = c >= 300 and c < 40_000
        for t in range(n):
            out.append((c, None if rng.random() < 0.05 and not same else t, rng.choice(["user", None, ""]) if not same else "user", "é🙂" if same else rng.choice(["a", "b", None, "long text", ""]), None, 1, None))
    out += out[:3]  # repeated rows are turns
    out += [(None, 1, "user", "no conversation", None, 1, None)]
    return out


@pytest.mark.parametrize(("block", "bits", "slices", "hot"), [(4096, 16, 16, 0), (3, 1, 2, 60)])
def test_trie_equals_brute_force(spark, monkeypatch, block, bits, slices, hot):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    monkeypatch.setattr(conversations, "SLICES", slices)
    turns = some_turns(block, hot)
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    want = brute_trie([t[:4] for t in turns])
    assert told(conversations.op11_conversation_trie(df)) == want
    assert told(conversations.conversation_trie(df)) == brute_trie([t[:4] for t in turns], rebuild=False)


def test_a_conversation_of_many_turns_spans_partitions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 64)
    turns = [(7, i, "user", str(i % 10)) for i in range(1000)] + [(8, i, "user", str(i % 10)) for i in range(600)] + [(9, 0, "user", "0"), (100, 0, "x", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8)
    spread = conversations.numbered_turns(df)
    assert sorted((r.conv_id, r.pos) for r in spread.collect()) == sorted((c, t + 1) for c, t, _, _ in turns)
    got = told(conversations.conversation_trie(df))
    assert got == brute_trie(turns, rebuild=False)
    top = [r for r in got if r[1] == 1 and r[0] == 7][0]
    assert top[3:7] == (3, 1, 1, 2 * 1 + 599)


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.op11_conversation_trie(empty).count() == 0
    # h of conversation 1 is 3 or more and its hundred has no first: it loses its turns and ends at the root.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 3)
    one = spark.createDataFrame([(c, 0, "user", "x"), (c, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    assert told(conversations.op11_conversation_trie(one)) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trie_on_tables(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert told(conversations.op11_conversation_trie(turns)) == brute_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def brute_hits(docs, items, window=10):
    """(id, words, hit words, items) of each text by comparing all windows."""
    words = lambda t: PLAIN.findall((t or "").translate(LOW))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[i : i + window])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return sorted(out, key=repr)


HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
hits = lambda df: sorted((tuple(r[c] for c in HITS) for r in df.collect()), key=repr)


def test_automaton_finds_all_windows_of_random_words():
    rng = random.Random(5)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcdé"
        draw = lambda n: " ".join(rng.choices(letters, k=n))
        items = [(str(i), draw(rng.randint(0, 14))) for i in range(rng.randint(0, 6))]
        text = draw(rng.randint(0, 60)) + " ".join(["", *(x for _, x in items if rng.random() < 0.3)])
        index = decontamination.ItemIndex([(i, x.encode()) for i, x in items], window=4)
        n, longest, runs, found = index.track([text.encode()])
        want = brute_hits([(0, text)], items, window=4)[0]
        assert (n, sum(b - a for a, b in zip(runs[::2], runs[1::2], strict=True)), len(found)) == want[1:4]
        assert runs == sorted(runs) and all(a < b for a, b in zip(runs, runs[1:], strict=False))
        cuts = sorted(rng.choices(range(len(text) + 1), k=3))
        parts = [p for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if (p := text[a:b])]
        if all(x[-1] == " " or y[0] == " " for x, y in zip(parts, parts[1:], strict=False)):
            assert index.track([p.encode() for p in parts]) == (n, longest, runs, found)
        if n:
            w, all_words = text.split(), [x.split() for _, x in items]
            factors = max((k for k in range(1, n + 1) if any(w[i : i + k] == x[j : j + k] for x in all_words for i in range(n - k + 1) for j in range(len(x) - k + 1))), default=0)
            assert longest == (factors if factors >= index.least else 0)


ITEMS = [
    (1, "The Quick brown fox jumps over the lazy dog, while SEVEN wizards quietly boil green tea"), (2, "été où ça"), (3, None), (4, ""), (5, "...!"),
    (None, "copper pots near old stone walls the quick brown fox jumps over"), (1, "no id at all"), (10, "the quick brown fox jumps over the lazy dog while seven"),
    (7, "The Quick brown fox jumps over the lazy dog, while SEVEN wizards quietly boil green tea"), (7, "The Quick brown fox jumps over the lazy dog, while SEVEN wizards quietly boil green tea"),
]


@pytest.mark.parametrize(("block", "piece"), [(200_000, 20_000), (12, 3)])
def test_decontamination_equals_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", piece)
    docs = spark.createDataFrame(rows(), SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_hits([(r[0], r[1]) for r in rows()], ITEMS)
    assert hits(decontamination.op12_decontamination(docs, items)) == want
    assert any(x[2] for x in want)
    none = decontamination.op12_decontamination(docs, items.limit(0))
    assert hits(none) == brute_hits([(r[0], r[1]) for r in rows()], [])
    assert decontamination.op12_decontamination(docs.limit(0), items).count() == 0


def test_decontaminated_texts(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [(1, f"Before it. {passage.upper()}! After it, " + "and more words " * 9), (2, f"short {passage}"), (3, None), (4, "clean text"), (4, "clean text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = sorted(((r.doc_id, r.clean_text, r.n_hit) for r in decontamination.decontaminate(docs, items).collect()), key=repr)
    assert got == sorted([(1, "Before it. ! After it, " + "and more words " * 9, 12), (3, None, 0), (4, "clean text", 0), (4, "clean text", 0)], key=repr)
    whole = decontamination.decontaminate(docs, items, least_span=13, most_coverage=1.0)
    assert {r.doc_id: r.clean_text for r in whole.collect()} == dict(texts)


def brute_runs(ids):
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            size, w = j - i + q, ids[i : j + q]
            if j > i and size >= max(6, 4 * q) and not any(w[p:] == w[: size - p] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_random_words(monkeypatch):
    rng = random.Random(3)
    for k in range(1500):
        sparse = k % 3 == 0
        monkeypatch.setattr(periodic, "FIRST", 8 if sparse else 64)
        n = rng.randint(60, 300) if sparse else rng.randint(0, 60)
        ids = rng.choices(range(rng.randint(1, 3)), k=n)
        for _ in range(rng.randint(0, 3)):
            p, a, b = rng.randint(1, 40 if sparse else 6), rng.randint(0, n), rng.randint(0, n)
            ids[a:b] = [ids[a + (i - a) % p] for i in range(a, b)]
        numbers = {x: i for i, x in enumerate(dict.fromkeys(ids))}
        ids = [numbers[x] for x in ids]
        assert periodic.runs_of(np.array(ids, np.int32), dense=0 if sparse else periodic.DENSE) == brute_runs(ids)


def brute_digest(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    numbers = {x: i for i, x in enumerate(dict.fromkeys(words))}
    runs = brute_runs([numbers[w] for w in words])
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_equal_brute_force(spark, sf):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sorted((tuple(r[c] for c in RUNS) for r in periodic.op13_periodic_runs(docs.where("doc_id is null or doc_id <> 11")).collect()), key=repr)
    assert got == sorted((brute_digest(r[0], r[1]) for r in rows() if r[0] != 11), key=repr)
    assert periodic.op13_periodic_runs(docs.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 12_000)
    got = sorted(tuple(r[c] for c in RUNS) for r in periodic.op13_periodic_runs(real).collect())
    assert got == sorted(brute_digest(r.doc_id, r.text) for r in real.select("doc_id", "text").collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_very_long_texts_of_equal_words_and_of_none(spark):
    """Twenty megabytes: a run of equal words, distinct words, and a passage of the benchmark at the end."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    passage = " ".join(f"item{i}" for i in range(12))
    long = " ".join(["0"] * 150_000 + rng.choices(vocabulary, k=3_300_000)) + " " + passage
    docs = spark.createDataFrame([(2, long), (3, "a b " * 9)], "doc_id long, text string")
    r = {x.doc_id: x for x in periodic.periodic_runs(docs).select("doc_id", "n_words", F.col("runs")[0].alias("first"), F.length("collapsed").alias("n")).collect()}
    assert r[2].n_words == 3_450_012 and tuple(r[2].first) == (0, 150_000, 1) and abs(len(long) - 2 * 149_999 - r[2].n) < 1000
    assert tuple(r[3].first) == (0, 18, 2) and r[3].n == 3
    items = spark.createDataFrame([(1, passage), (2, "0 0 0")], "item_id long, text string")
    got = {x.doc_id: x for x in decontamination.op12_decontamination(docs, items).collect()}
    assert (got[2].n_words, got[2].n_hit, got[2].n_items) == (3_450_012, 150_012, 2) and not got[3].contaminated
