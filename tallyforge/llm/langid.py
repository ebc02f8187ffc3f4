"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is the product of
its letters' vectors, each rotated by its place; a text is the sum of its runs, a
language the sum of its training texts. Texts go to the language of largest cosine.
Runs of other characters count as one boundary letter.

Training sums count runs by language in Spark first, as bundles are linear in counts,
so each distinct run is bound once. Prototypes alone are broadcast: languages times
``dims`` numbers.

Cases: a null text, or one without letters, is ``und`` with score 0, as is every text if
nothing was learned. Ties go to the language first by code point. Repeated rows count
each time in training. A very long text counts whole and is held by one task, with some 30 bytes for each of its own. Other columns are not looked at,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._words import mix, slices

DIMS = 1024
UNKNOWN = "und"
_COLUMNS = 4096
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _letters[0]


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the distinct runs of three letters, the number of each run in them, its text's number, whether texts have letters)."""
    lower = [f" {t.lower()} " for t in texts]
    size = np.array([len(t) for t in lower], np.int64)
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    which = np.repeat(np.arange(len(texts)), size)
    letter = is_letter()[code]
    has = np.bincount(which[letter], minlength=len(texts)) > 0
    code = np.where(letter, code, 32)
    first = np.zeros(len(code), bool)
    first[np.cumsum(size) - size] = True
    keep = letter | np.concatenate([[True], letter[:-1]]) | first
    code, which = code[keep], which[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), has
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    alphabet = np.flatnonzero(seen)
    number = np.cumsum(seen)[code] - 1
    n = len(alphabet)
    runs = (number[:-2] * n + number[1:-1]) * n + number[2:]
    same = which[:-2] == which[2:]
    runs, which = runs[same], which[:-2][same]
    if n**3 <= 1 << 24:  # few letters: a table of all runs instead of sorting
        found = np.zeros(n**3, bool)
        found[runs] = True
        distinct, place = np.flatnonzero(found), (np.cumsum(found) - 1)[runs]
    else:
        distinct, place = np.unique(runs, return_inverse=True)
    codes = (alphabet[distinct // (n * n)] << 42) | (alphabet[distinct // n % n] << 21) | alphabet[distinct % n]
    return codes, place, which, has


def run_vectors(runs: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The hypervector of each run: rotated letter vectors multiplied."""
    letters, place = np.unique(np.concatenate([runs >> 42, (runs >> 21) & 0x1FFFFF, runs & 0x1FFFFF]), return_inverse=True)
    bits = mix(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dims, dtype=np.uint64)[None, :])
    vectors = np.where(bits & np.uint64(1), np.float32(1), np.float32(-1))
    a, b, c = place.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def bundle(distinct: np.ndarray, place: np.ndarray, which: np.ndarray, n: int, dims: int = DIMS, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of run vectors for each of ``n`` texts, some thousand distinct runs at a time."""
    out = np.zeros((n, dims), np.float32)
    for at in range(0, len(distinct), _COLUMNS):
        part = distinct[at : at + _COLUMNS]
        held = (place >= at) & (place < at + _COLUMNS) if len(distinct) > _COLUMNS else slice(None)
        counts = np.bincount(which[held] * len(part) + place[held] - at, None if weights is None else weights[held], n * len(part))
        out += counts.reshape(n, len(part)).astype(np.float32) @ run_vectors(part, dims)
    return out


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=2 << 20):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        distinct, place, which, _ = letter_runs(batch.column("text").to_pylist())
        n = np.bincount(number[which] * len(distinct) + place, minlength=len(names) * len(distinct))
        held = np.flatnonzero(n)
        for at in range(0, len(held), 1 << 16):
            h = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in h // max(1, len(distinct))], pa.string()), pa.array(distinct[h % max(1, len(distinct))]), pa.array(n[h])],
                names=["lang", "run", "n"],
            )


def _bundled(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs], np.int64)
            distinct, place = np.unique(batch.column("run").to_numpy(), return_inverse=True)
            sums = bundle(distinct, place, which, len(names), dims, batch.column("n").to_numpy().astype(float))
            for name, row in zip(names, sums, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(row.astype(float))], names=["lang", "dim", "x"]
                )

    return run


def learn_prototypes(docs: DataFrame, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """(languages by code point, unit vectors) from columns ``text`` and ``lang``, both not null."""
    counts = docs.select("text", "lang").mapInArrow(_count_runs, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(_bundled(dims), "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    rows = sums.collect()  # languages times dims
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), dims))
    number = {x: i for i, x in enumerate(names)}
    for r in rows:
        out[number[r["lang"]], r["dim"]] = r["x"]
    return names, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def identify_languages(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = DIMS
) -> DataFrame:
    """(doc_id, train, lang_pred, score) for every row of ``docs``; ``train`` tells which rows to learn from."""
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
    )
    names, prototypes = learn_prototypes(picked.where("train and text is not null and lang is not null"), dims)
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes.astype(np.float32)))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors = model.value
        for batch in slices(batches, most=2 << 20):
            distinct, place, which, has = letter_runs([x or "" for x in batch.column("text").to_pylist()])
            sums = bundle(distinct, place, which, batch.num_rows, dims)
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            near = sums @ vectors.T if known else np.zeros((batch.num_rows, 1))
            best = near.argmax(axis=1)
            sure = np.clip(near[np.arange(len(best)), best], 0, 1).astype(float)
            good = has & bool(known)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("train"),
                    pa.array([known[b] if g else UNKNOWN for b, g in zip(best, good, strict=True)], pa.string()), pa.array(np.where(good, sure, 0.0)),
                ],
                names=["doc_id", "train", "lang_pred", "score"],
            )

    return picked.drop("lang").mapInArrow(run, f"doc_id {kind}, train boolean, lang_pred string, score double")


def op8_language_id(docs: DataFrame) -> DataFrame:
    """The digest of ``identify_languages`` over documents; every fourth id by checksum is held out."""
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    return identify_languages(docs, part != 2).select("doc_id", (~F.col("train")).alias("held_out"), "lang_pred", "score")
