"""LM scoring by context-tree weighting over binary-decomposed byte contexts.

Each byte is eight binary decisions, a walk down a tree of 255 nodes. Every decision
node has counts of zeros and ones under each context of 0 to ``depth`` bytes, and a
Krichevsky-Trofimov estimate from them. Context-tree weighting mixes the estimates of
all depths: a context's weighted probability is half its own estimate's and half the
product of its longer contexts', and the same halves give the share of each depth in
the prediction. A longer context that training never saw is an empty subtree: it
predicts 1/2 with the share that is left to it. The code length of a text is the sum
over its bytes.

Spark counts byte strings of depth + 1 over all texts, those of held-out ones as 0, sums
them up the tree and sends shares down it, so every node of the training texts is used
at any size. Nothing is broadcast or brought to the driver: scores of byte strings and
counts of words for the base score meet those of each chunk of documents by joins. A
chunk is a run of rows of one input partition with a bounded sum of bytes, whatever
their ids, so neither null ids nor repeated ones gather in a task.

Cases: a null or empty text has no words, the end alone is scored. A null id counts as
an empty text of an id. Repeated rows count each time and score alike; equal texts tie.
A very long text is a chunk of its own: its bytes are held, its byte strings and words are
worked out a piece at a time, and the different ones are held, some 30 bytes each. With no
training text each binary decision has probability 1/2. Other columns are not looked at, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._scratch import Scope, keep, sweep
from tallyforge.llm._words import pieces

#: A chunk ends once its texts have so many bytes, or it has so many rows; its codes and words fit in a task.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 1 << 15
EDGE = 0xFF  # never a byte of UTF-8: stands before a text and ends it
END = b""  # the end token among words
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
LOG10E = math.log10(math.e)


def byte_strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with its context, number of the text it belongs to); the end is a byte too."""
    pad = bytes([EDGE]) * depth
    raw = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.uint64)
    n = len(raw) - depth
    code = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | raw[k : k + n]
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size + depth)])[:-1]
    which = np.repeat(np.arange(len(texts)), size + 1)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
    return code[np.repeat(start, size + 1) + offset], which


#: Bytes of texts that are turned into byte strings at a time.
PIECE_BYTES = 2 << 20


def string_pieces(texts: list[bytes], depth: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts, code of each of their bytes with its context, place of its text among the numbers) of about PIECE_BYTES each.

    A text of more than two pieces is read in parts, each after the ``depth`` bytes before it.
    """
    held, n = [], 0
    for i, t in enumerate(texts):
        if len(t) > 2 * PIECE_BYTES:
            before = bytes([EDGE]) * depth
            for at in range(0, len(t), PIECE_BYTES):
                part = t[at : at + PIECE_BYTES]
                codes, which = byte_strings([before + part], depth)
                # Without the strings of the context itself, and of the end but for the last part.
                last = at + PIECE_BYTES >= len(t)
                yield [i], codes[depth : None if last else -1], which[depth : None if last else -1]
                before = (before + part)[-depth:] if depth else b""
            continue
        held.append(i)
        n += len(t)
        if n >= PIECE_BYTES:
            yield held, *byte_strings([texts[j] for j in held], depth)
            held, n = [], 0
    if held:
        yield held, *byte_strings([texts[j] for j in held], depth)


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and its end, those of a long text a piece at a time."""
    if len(text) <= 2 * PIECE_BYTES:
        yield text.split()
    else:
        for part in pieces(text.translate(_SPACES), PIECE_BYTES):
            yield part.split()
    yield [END]


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, train, text) with a number ``chunk``: rows of a partition in their order, bounded by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        chunk, size, rows = 0, 0, 0
        for batch in batches:
            at = []
            for n in pc.binary_length(batch.column("text")).to_pylist():
                if rows and (size + n > CHUNK_BYTES or rows == CHUNK_ROWS):
                    chunk, size, rows = chunk + 1, 0, 0
                size, rows = size + n, rows + 1
                at.append(first + chunk)
            yield batch.append_column("chunk", pa.array(at, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, train boolean, text binary, chunk long")


def count_strings(docs: DataFrame, depth: int) -> DataFrame:
    """(chunk, code, n): the byte strings of ``depth`` + 1 bytes of each chunk, and how often its training documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, tuple[list[bytes], list[bytes]]] = {}
            for chunk, train, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "train", "text")), strict=True):
                by.setdefault(chunk, ([], []))[0 if train else 1].append(text.lower())
            for chunk, (trained, others) in by.items():
                codes, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for texts, counts in ((trained, True), (others, False)):
                    for _, found, _ in string_pieces(texts, depth):
                        more, m = np.unique(found, return_counts=True)
                        both = np.union1d(codes, more)
                        total = np.zeros(len(both), np.int64)
                        total[np.searchsorted(both, codes)] = n
                        if counts:
                            total[np.searchsorted(both, more)] += m
                        codes, n = both, total
                for at in range(0, len(codes), 1 << 16):
                    c = codes[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(c), chunk, np.int64)), pa.array(c.astype(np.int64)), pa.array(n[at : at + (1 << 16)])],
                        names=["chunk", "code", "n"],
                    )

    return docs.select("chunk", "train", "text").mapInArrow(run, "chunk long, code long, n long")


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2: Stirling's series at x + 8, and down again."""
    z = x + 8.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    down = F.lit(1.0)
    for k in range(8):
        down = down * (x + float(k))
    return series - F.ln(down)


def _log_kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


def _steps() -> Column:
    """The eight decisions (node, one) of a code's last byte."""
    bit = lambda k: F.shiftright("code", 7 - k).bitwiseAND(1)
    node = lambda k: (F.shiftright(F.col("code").bitwiseAND(255), 8 - k) + F.lit(1 << k)).cast("int")
    return F.explode(F.array(*(F.struct(node(k).alias("node"), bit(k).alias("one")) for k in range(8))))


def weighted_nodes(strings: DataFrame, depth: int) -> DataFrame:
    """(context, node, p) for the nodes of all codes: the probability of a one after ``depth`` bytes.

    Codes with ``n`` = 0 are asked about but teach nothing: an empty subtree has probability 1
    and predicts 1/2, by the same formulas.
    """
    x = strings.select(F.shiftrightunsigned("code", 8).alias("context"), "n", _steps().alias("s"))
    ones = F.sum(F.col("n") * F.col("s.one"))
    level = x.groupBy("context", F.col("s.node").alias("node")).agg((F.sum("n") - ones).alias("zeros"), ones.alias("ones"))
    half = math.log(0.5)
    seen = F.col("zeros") + F.col("ones") > 0
    log_kt = F.when(seen, _log_kt(F.col("zeros"), F.col("ones"))).otherwise(0.0)  # exactly 0 for no counts
    level = level.withColumn("log_w", log_kt).withColumn("share", F.lit(1.0))
    levels = [keep(level, f"ctw-{depth}")]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << (8 * d)) - 1)
        level = levels[0].groupBy(shorter.alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("below"))
        level = level.withColumn("log_kt", log_kt)
        own, rest = F.col("log_kt") + half, F.col("below") + half
        top = F.greatest(own, rest)
        level = level.withColumn("log_w", top + F.ln(F.exp(own - top) + F.exp(rest - top))).drop("below")
        levels.insert(0, keep(level.withColumn("share", F.exp(F.col("log_kt") + half - F.col("log_w"))).drop("log_kt"), f"ctw-{d}"))
        sweep(strings.sparkSession)
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    above = None  # (context, node, so_far, left): what shorter contexts give, and what share is left
    for d, level in enumerate(levels):
        level = level.withColumn("kt", kt)
        if above is None:
            level = level.withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0)})
        else:
            key = F.col("context").bitwiseAND((1 << (8 * (d - 1))) - 1)
            level = level.withColumn("shorter", key).join(above, ["shorter", "node"]).drop("shorter")
        level = level.withColumn("p", F.col("so_far") + F.col("left") * F.col("share") * F.col("kt"))
        if d < depth:
            level = keep(level.select("context", "node", "p", (F.col("left") * (1.0 - F.col("share"))).alias("left")), f"ctw-mixed-{d}")
            above = level.select(F.col("context").alias("shorter"), "node", F.col("p").alias("so_far"), "left")
    return level.select("context", "node", "p")


def score_strings(strings: DataFrame, depth: int) -> DataFrame:
    """(code, log_p) for each row of ``strings`` (code, n), one a code: ln of the probability of its last byte after the bytes before it."""
    nodes = keep(weighted_nodes(strings, depth), "ctw-nodes")
    sweep(strings.sparkSession)
    asked = strings.select("code", F.shiftrightunsigned("code", 8).alias("context"), _steps().alias("s"))
    asked = asked.select("code", "context", F.col("s.node").alias("node"), F.col("s.one").alias("one"))
    log_p = F.ln(F.when(F.col("one") == 1, F.col("p")).otherwise(1.0 - F.col("p")))
    return asked.join(nodes, ["context", "node"]).groupBy("code").agg(F.sum(log_p).alias("log_p"))


class Model:
    """The counts of training texts, to ask about codes in small numbers."""

    def __init__(self, strings: DataFrame, depth: int):
        self.strings, self.depth = strings, depth

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """ln of the probability of each code's last byte after the bytes before it."""
        spark = self.strings.sparkSession
        asked = spark.createDataFrame([(c,) for c in np.unique(codes).astype(np.int64).tolist()], "code long")
        with Scope(spark):
            strings = self.strings.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).groupBy("code").agg(F.sum("n").alias("n"))
            found = dict(score_strings(keep(strings, "ctw-asked"), self.depth).join(asked, "code").select("code", "log_p").collect())
        return np.array([found[c] for c in codes.astype(np.int64).tolist()])


def fit_model(docs: DataFrame, depth: int = 4) -> Model:
    """The model of training texts (column ``text``, binary), with every node."""
    strings = count_strings(docs.select(F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("train"), "text"), depth)
    return Model(keep(strings.groupBy("code").agg(F.sum("n").alias("n")), "ctw-strings"), depth)


def count_words(docs: DataFrame) -> DataFrame:
    """(chunk, word, n): the distinct words of each chunk, and how often its training documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, tuple[Counter, set]] = {}
            for chunk, train, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "train", "text")), strict=True):
                counts, others = by.setdefault(chunk, (Counter(), set()))
                for words in tokens_of(text.lower()):
                    (counts if train else others).update(words)
            for chunk, (counts, others) in by.items():
                for w in others:
                    counts.setdefault(w, 0)
                words, n = list(counts), list(counts.values())
                for at in range(0, len(words), 50_000):
                    w = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n[at : at + 50_000], pa.int64())],
                        names=["chunk", "word", "n"],
                    )

    return docs.select("chunk", "train", "text").mapInArrow(run, "chunk long, word binary, n long")


def score_documents(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 4
) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    ``train`` tells which rows to learn from. ``score`` is log10 of the model's probability
    of the text with A-Z in lower case; ``bits_per_byte`` its code length per byte.
    """
    picked = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    picked = keep(chunked(picked), "lm-documents")  # read three times, in the same chunks
    with Scope(docs.sparkSession) as passing:
        codes = keep(count_strings(picked, depth), "ctw-codes")
        strings = keep(codes.groupBy("code").agg(F.sum("n").alias("n")), "ctw-strings")
        scores = keep(score_strings(strings, depth), "ctw-scores")
        sweep(docs.sparkSession)
        log_p = F.col("log_p").alias("value")
        known_codes = passing.hand_over(codes.join(scores, "code").select("chunk", F.lit(None).cast("binary").alias("word"), "code", log_p), "ctw-known")
    with Scope(docs.sparkSession) as passing:
        words = keep(count_words(picked), "lm-words")
        counts = keep(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")
        sweep(docs.sparkSession)
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        c = F.col("c").cast("double").alias("value")
        known_words = passing.hand_over(words.join(counts, "word").select("chunk", "word", F.lit(None).cast("long").alias("code"), c), "lm-known")
    known = known_words.unionByName(known_codes)
    norm = math.log10(total + distinct + 1)
    kind = picked.schema["doc_id"].dataType

    def run(docs_: pa.Table, known_: pa.Table) -> pa.Table:
        is_word = pc.is_valid(known_.column("word"))
        of_words, of_codes = known_.filter(is_word), known_.filter(pc.invert(is_word))
        log = {w: math.log10(c + 1) - norm for w, c in zip(of_words.column("word").to_pylist(), of_words.column("value").to_pylist(), strict=True)}
        code, once = np.unique(of_codes.column("code").to_numpy(), return_index=True)
        log_p, place = of_codes.column("value").to_numpy()[once], pd.Index(code)
        texts = [x.as_py().lower() for x in docs_.column("text")]
        n_tokens, n_known, base = [], [], []
        for text in texts:
            n, known_n, sums = 0, 0, []
            for tokens in tokens_of(text):
                found = [x for x in map(log.get, tokens) if x is not None]
                n, known_n = n + len(tokens), known_n + len(found)
                sums.append(math.fsum(found))
            n_tokens.append(n)
            n_known.append(known_n)
            base.append(math.fsum(sums) - norm * (n - known_n))
        score = np.zeros(len(texts))
        for piece, codes_, which in string_pieces(texts, depth):
            score[piece] += np.bincount(which, log_p[place.get_indexer(codes_.astype(np.int64))], len(piece))
        size = np.array([len(t) + 1 for t in texts])
        return pa.table(
            {
                "doc_id": docs_.column("doc_id"), "train": docs_.column("train"), "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * len(texts), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score * LOG10E, pa.float64()),
                "bits_per_byte": pa.array(-score / math.log(2) / size, pa.float64()),
            }
        )

    out = (
        f"doc_id {kind.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, bits_per_byte double"
    )
    return picked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, out)


def op6_ctw(docs: DataFrame) -> DataFrame:
    """The digest of ``score_documents`` over documents; every seventh id by checksum is held out."""
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    out = score_documents(docs, part != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
