"""Ranked retrieval: BM25 over postings, cosine over vectors, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.5, 0.75


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf, len): one row per term of a document."""
    x = docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens")).withColumn("len", F.size("tokens"))
    return x.select("doc_id", "len", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def bm25(docs: DataFrame, tokens: Column, terms: list[str], k: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score): the ``k`` best documents for any of ``terms``.

    Only matches of the query's terms leave the scan: they are counted inside each row, and
    document frequencies and the mean length come from one aggregate. Nothing is shuffled but
    those few sums and k rows a task.
    """
    asked = list(dict.fromkeys(terms))
    counts = lambda x: F.struct(
        F.size(x).alias("len"), *((F.size(x) - F.size(F.array_remove(x, t))).alias(f"tf{i}") for i, t in enumerate(asked))
    )
    # Generated columns: a filter on them can't be pushed down, which would tokenise a text once more for each term.
    x = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.transform(F.array(tokens), counts)))
    stats = x.agg(
        F.count("*").alias("n_docs"), F.avg("len").alias("mean"),
        *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(asked))),
    )
    y = x.where(F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(asked)))) > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        df, f = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.ln(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return y.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine similarity of an array column with a constant vector."""
    norm = sum(x * x for x in b) ** 0.5
    v = F.array(*map(F.lit, b))
    dot = F.aggregate(F.zip_with(a, v, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (own * norm)


def cosine_top(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, distance, score): the nearest vectors that pass the filter; score is 1 / (1 + distance)."""
    x = vectors.where(where) if where is not None else vectors
    x = x.select(F.col(id_col).alias("vec_id"), F.round(1 - cosine(F.col("embedding"), query), 6).alias("distance"))
    x = x.orderBy("distance", "vec_id").limit(k)
    return x.withColumn("score", F.round(1 / (1 + F.col("distance")), 6))


def ranked(x: DataFrame, score: Column, id_col: str) -> DataFrame:
    """(id, rank) of a short result list, first occurrence only."""
    best = x.groupBy(F.col(id_col).alias("id")).agg(F.max(score).alias("s"))
    return best.select("id", F.row_number().over(Window.orderBy(F.col("s").desc(), "id")).alias("rank"))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of two short ranked lists (id, rank); ties by id."""
    d, s = dense.withColumnRenamed("rank", "rd"), sparse.withColumnRenamed("rank", "rs")
    score = F.coalesce(alpha / (k + F.col("rd")), F.lit(0.0)) + F.coalesce((1 - alpha) / (k + F.col("rs")), F.lit(0.0))
    return d.join(s, "id", "full_outer").select("id", F.round(score, 8).alias("score"))


def chunk_windows(docs: DataFrame, size: int = 2048, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, text): windows of whole texts that share ``overlap`` characters."""
    n, step = F.length(text_col), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    return docs.where(n > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(
        "doc_id", "chunk", F.substring("whole", F.col("chunk") * step + 1, F.lit(size)).alias("text")
    )


def cached_answers(asked: DataFrame, held: DataFrame, most: float, id_col: str = "vec_id") -> DataFrame:
    """(asked, vec_id, distance): for each asked vector the nearest held one, if it lies within ``most``.

    A stated set of questions meets all held vectors in one pass; minima are pre-aggregated.
    """
    a = asked.select(F.col(id_col).alias("asked"), F.col("embedding").alias("a"))
    x = held.select(F.col(id_col).alias("vec_id"), F.col("embedding").alias("b")).crossJoin(a)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    distance = F.round(1 - dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))), 6)
    best = x.select("asked", F.struct(distance.alias("distance"), "vec_id").alias("p")).groupBy("asked").agg(F.min("p").alias("p"))
    return best.select("asked", "p.vec_id", "p.distance").where(F.col("distance") <= most)
