"""Queries of search: a stored index, hybrid search over three targets, similar questions; with SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as tx
from tallyforge.operators import alike, catalog, documents, learning, retrieval, routing, search, vectors
from tallyforge.plans import metrics
from tallyforge.queries import _COS, _COS_SQL, _TERMS, _TOKENS, _VECTOR, CATALOG
from tallyforge.queries_catalog import _C
from tallyforge.registry import query
from tallyforge.session import TABLES, schema_revision, shared_folder, table
from tallyforge.sources.versions import fingerprint

K = 10


def documents_index(spark: SparkSession, d: str) -> search.PostingsIndex:
    """The keyword index of a folder's documents; built once for the files as they are."""
    docs = table(spark, d, "documents")
    name = hashlib.sha256(fingerprint(spark, docs.inputFiles()).encode()).hexdigest()[:32]
    index = search.PostingsIndex(spark, f"{shared_folder(spark)}/tallyforge-index/documents-{name}", fields=("lang",))
    if not index.versions.numbers():
        index.build(docs, tx.english_tokens(F.col("text")))
    return index


def embeddings_index(spark: SparkSession, d: str) -> vectors.VectorIndex:
    """The vector index of a folder's embeddings; built once for the files as they are."""
    x = table(spark, d, "embeddings")
    name = hashlib.sha256(fingerprint(spark, x.inputFiles()).encode()).hexdigest()[:32]
    index = vectors.VectorIndex(spark, f"{shared_folder(spark)}/tallyforge-index/embeddings-{name}", fields=("label",))
    if not index.versions.numbers():
        index.build(x)
    return index


def _bm25(source: str, k: int, terms: list[str]) -> str:
    """BM25 in DuckDB over a source (id, text)."""
    names = ", ".join(f"'{t}'" for t in terms)
    return (
        f"WITH d AS (SELECT id, {_TOKENS} AS t FROM ({source})), n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), "
        f"p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) WHERE term IN ({names}) GROUP BY ALL), "
        "f AS (SELECT term, count(*) AS df FROM p GROUP BY term) "
        "SELECT p.id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / n.m))), 6) AS score "
        f"FROM p JOIN f USING (term) JOIN d USING (id), n GROUP BY p.id ORDER BY score DESC, p.id LIMIT {k}"
    )


def _fused(sparse: str, dense: str, k: int) -> str:
    """Reciprocal rank fusion in DuckDB of two lists (id, score)."""
    return (
        f"WITH s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({sparse})), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({dense})) "
        f"SELECT id, round(coalesce(0.5 / (60 + v.r), 0) + coalesce(0.5 / (60 + s.r), 0), 8) AS score FROM v FULL JOIN s USING (id) ORDER BY score DESC, id LIMIT {k}"
    )


_DOCS = "SELECT doc_id AS id, text FROM documents"


@query("bm25_topk", _bm25(_DOCS, 20, _TERMS).replace("SELECT p.id,", "SELECT p.id AS doc_id,"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents_index(spark, d).search(_TERMS, 20)


@query("bm25_filtered", _bm25(f"{_DOCS} WHERE lang = 'en'", 20, _TERMS).replace("SELECT p.id,", "SELECT p.id AS doc_id,"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents_index(spark, d).search(_TERMS, 20, F.col("lang") == "en")


@query("bm25_scan", _bm25(_DOCS, 20, _TERMS).replace("SELECT p.id,", "SELECT p.id AS doc_id,"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), tx.english_tokens(F.col("text")), _TERMS, 20)


@query("index_build", f"SELECT lang, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents_index(spark, d).postings().groupBy("lang", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_REPLACED = (
    "SELECT doc_id AS id, text || ' licensed segments' AS text FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 20 = 1 "
    "UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 20 NOT IN (0, 2)"
)


@query("index_replace", _bm25(_REPLACED, 20, [*_TERMS, "segments"]).replace("SELECT p.id,", "SELECT p.id AS doc_id,"))
def _(spark: SparkSession, d: str) -> DataFrame:
    docs, tokens = table(spark, d, "documents").select("doc_id", "text"), tx.english_tokens(F.col("text"))
    name = hashlib.sha256(fingerprint(spark, docs.inputFiles()).encode()).hexdigest()[:32]
    index = search.PostingsIndex(spark, f"{shared_folder(spark)}/tallyforge-index/replaced-{name}")
    if not index.versions.numbers():
        index.build(docs, tokens)
        index.replace(docs.where("doc_id % 20 = 0").withColumn("text", F.concat("text", F.lit(" licensed segments"))), tokens)
        index.delete(docs.where("doc_id % 20 = 2"))
        index.replace(docs.where("doc_id % 20 = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000_000), tokens)
        index.compact()
    return index.search([*_TERMS, "segments"], 20)


@query("rrf_fuse", _fused(_bm25(_DOCS, 20, _TERMS), f"SELECT vec_id AS id, score FROM ({_COS_SQL.format(_COS, 'true', 20)})", 40))
def _(spark: SparkSession, d: str) -> DataFrame:
    sparse = documents_index(spark, d).search(_TERMS, 20)
    dense = retrieval.cosine_top(table(spark, d, "embeddings"), _VECTOR, 20)
    return retrieval.fuse(retrieval.ranked(dense, F.col("score"), "vec_id"), retrieval.ranked(sparse, F.col("score"), "doc_id"))


_ARM = search.arm_size(K)
_HYBRID_DOCUMENTS = _fused(
    _bm25(f"{_DOCS} WHERE lang = 'en'", _ARM, _TERMS),
    f"SELECT vec_id AS id, score FROM ({_COS_SQL.format(_COS, chr(118) + 'ec_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')', _ARM)})", K,
)


def hybrid_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents in English by keywords and vectors, with their source."""
    docs = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source")
    sparse = documents_index(spark, d).search(_TERMS, _ARM, F.col("lang") == "en").withColumnRenamed("doc_id", "id").join(docs, "id")
    near = table(spark, d, "embeddings").join(docs.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    dense = retrieval.cosine_top(near, _VECTOR, _ARM).select(F.col("vec_id").alias("id"), "score").join(docs, "id")
    return search.hybrid(sparse, dense, K, ["source"])


@query("hybrid_documents", f"SELECT h.id, h.score, t.source FROM ({_HYBRID_DOCUMENTS}) h JOIN documents t ON t.doc_id = h.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_documents(spark, d)


_ASKED, _MEASURE = ["customer", "nationkey", "string"], ["total", "urgent", "orders"]
#: Hash vectors in DuckDB, and nearness of a text's vector to another's.
_HASH_SQL = (
    "(WITH b AS (SELECT list_transform(range(256), lambda i: xor(('0x' || substr(sha256({0}), (2 * (i % 32) + 1)::INT, 2))::INT, i::INT) / 127.5 - 1) AS v) "
    "SELECT list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE) FROM b)"
)
_NEAR = (
    "SELECT id, round(1 / (1 + distance), 6) AS score FROM (SELECT id, round(1 - list_cosine_similarity({}, {}::DOUBLE[]), 6) AS distance FROM ({})) ORDER BY distance, id LIMIT {}"
)


def _near(words: list[str], source: str) -> str:
    return _NEAR.format(_HASH_SQL.format("text"), [float(v) for v in documents.hash_vector(" ".join(words))], source, _ARM)


_SCHEMA = f"{_C} SELECT table_name || '.' || column_name AS id, table_name, replace(table_name || ' ' || column_name, '_', ' ') || ' ' || data_type AS text FROM c"


def _told(of: str, column: str, alias: str) -> str:
    """A dimension's words in DuckDB."""
    values = f"SELECT CASE WHEN count(DISTINCT {column}) <= {catalog.MOST_VALUES} THEN string_agg(DISTINCT {column}, ' ' ORDER BY {column}) END FROM {of}"
    return f"rtrim('by {alias.replace('_', ' ')} ' || coalesce(({values}), ''))"


def _metric_sql(m: metrics.Metric) -> str:
    told = [_told(m.table, d, d) for d in m.dimensions] + [_told(m.lookup.table, c, a) for a, c in m.lookup.dimensions]
    return f"SELECT '{m.name}' AS id, '{m.table}' AS fact, concat_ws(' ', '{m.name.replace('_', ' ')} {m.aggregation} of {m.column} in {m.table}', {', '.join(told)}) AS text"


_METRICS = " UNION ALL ".join(map(_metric_sql, CATALOG.metrics))
_HYBRID_SCHEMA = _fused(_bm25(_SCHEMA, _ARM, _ASKED), _near(_ASKED, _SCHEMA), K)
_HYBRID_METRICS = _fused(_bm25(_METRICS, _ARM, _MEASURE), _near(_MEASURE, _METRICS), K)


def catalog_index(spark: SparkSession, name: str, fields: tuple[str, ...], of: dict[str, DataFrame], docs: Callable[[], DataFrame]) -> search.CatalogIndex:
    """A stored index of documents about tables; built once for the schemas, rules and files as they are."""
    seen = "".join(schema_revision(x) for x in of.values()) + "".join(fingerprint(spark, x.inputFiles()) for x in of.values()) + repr(CATALOG)
    index = search.CatalogIndex(spark, f"{shared_folder(spark)}/tallyforge-index/{name}-{hashlib.sha256(seen.encode()).hexdigest()[:32]}", fields)
    if not index.ready():
        index.build(docs(), tx.english_tokens(F.col("text")))
    return index


def hash_question(words: list[str]) -> list[float]:
    """The hash vector of a question's words."""
    return [float(v) for v in documents.hash_vector(" ".join(words))]


def hybrid_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns of all tables by keywords and vectors."""
    of = {t: table(spark, d, t) for t in TABLES}
    index = catalog_index(spark, "columns", ("table_name",), of, lambda: catalog.column_documents(catalog.columns_of(spark, of)))
    return index.search(_ASKED, hash_question(_ASKED), K)


def metrics_index(spark: SparkSession, d: str) -> search.CatalogIndex:
    """The stored index of the catalog's metrics, with the values of their dimensions."""
    of = {t: table(spark, d, t) for t in ("lineitem", "orders", "customer")}
    return catalog_index(spark, "metrics", ("fact", "dimensions"), of, lambda: catalog.metric_documents(list(CATALOG.metrics), of))


def hybrid_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the catalog by keywords and vectors."""
    return metrics_index(spark, d).search(_MEASURE, hash_question(_MEASURE), K).select("id", "score", "fact")


@query("hybrid_schema", f"SELECT h.id, h.score, t.table_name FROM ({_HYBRID_SCHEMA}) h JOIN ({_SCHEMA}) t USING (id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_schema(spark, d)


@query("hybrid_metrics", f"SELECT h.id, h.score, t.fact FROM ({_HYBRID_METRICS}) h JOIN ({_METRICS}) t USING (id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_metrics(spark, d)


@query("metric_docs", _METRICS)
def _(spark: SparkSession, d: str) -> DataFrame:
    of = {t: table(spark, d, t) for t in ("lineitem", "orders", "customer")}
    return catalog.metric_documents(list(CATALOG.metrics), of).select("id", "fact", "text")


def found_dimensions(index: search.CatalogIndex, words: list[str], k: int = 5) -> DataFrame:
    """(dimension, score): dimensions of the metrics that ``words`` find, each with the sum of these metrics' scores."""
    hits = index.search(words, hash_question(words), k)
    return hits.select(F.explode("dimensions").alias("dimension"), "score").groupBy("dimension").agg(F.round(F.sum("score"), 8).alias("score"))


_DIMENSIONS = " UNION ALL ".join(f"SELECT '{m.name}' AS id, unnest({list(m.dimension_names())}) AS dimension" for m in CATALOG.metrics)


@query("found_dimensions", f"SELECT dimension, round(sum(score), 8) AS score FROM ({_fused(_bm25(_METRICS, search.arm_size(3), _MEASURE), _near(_MEASURE, _METRICS), 3)}) h JOIN ({_DIMENSIONS}) d USING (id) GROUP BY dimension")
def _(spark: SparkSession, d: str) -> DataFrame:
    return found_dimensions(metrics_index(spark, d), _MEASURE, 3)


@query(
    "hybrid_union",
    f"SELECT 'schema' AS target, id, score FROM ({_HYBRID_SCHEMA}) UNION ALL SELECT 'metrics', id, score FROM ({_HYBRID_METRICS}) UNION ALL SELECT 'documents', id::VARCHAR, score FROM ({_HYBRID_DOCUMENTS})",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ask = {"schema": lambda: hybrid_schema(spark, d), "metrics": lambda: hybrid_metrics(spark, d), "documents": lambda: hybrid_documents(spark, d)}
    return search.search_all(spark, ask, K)


@query(
    "semantic_cache",
    "SELECT asked, vec_id, d AS distance FROM (SELECT q.vec_id AS asked, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS d, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS r FROM embeddings e JOIN embeddings q ON q.vec_id IN (0, 7, 11)) WHERE r = 1 AND d <= 0.05",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "embeddings").where("vec_id in (0, 7, 11)")
    return embeddings_index(spark, d).nearest_within(asked.select(F.col("vec_id").alias("asked"), "embedding"), 0.05)


@query("cosine_indexed", _COS_SQL.format(_COS, "true", 20))
def _(spark: SparkSession, d: str) -> DataFrame:
    return embeddings_index(spark, d).search(_VECTOR, 20)


@query("cosine_indexed_filtered", _COS_SQL.format(_COS, "label = 3", 10))
def _(spark: SparkSession, d: str) -> DataFrame:
    return embeddings_index(spark, d).search(_VECTOR, 10, F.col("label") == 3)


@query(
    "question_history",
    "WITH h AS (SELECT item_id AS id, text, list_distinct({0}) AS t FROM benchmark WHERE item_id > 0), a AS (SELECT item_id AS ask_id, text, list_distinct({0}) AS t FROM benchmark WHERE item_id % 10 = 0), "
    "s AS (SELECT ask_id, id, trim(regexp_replace(regexp_replace(lower(a.text), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(h.text), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS same, "
    "len(list_intersect(a.t, h.t)) AS b, len(a.t) AS m, len(h.t) AS n FROM a, h), r AS (SELECT ask_id, id, CASE WHEN same THEN 1.0::DOUBLE ELSE round(b / (m + n - b), 4) END AS similarity, same FROM s WHERE same OR (b > 0 AND b / (m + n - b) >= 0.2)) "
    "SELECT ask_id, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY same DESC, similarity DESC, id DESC)::INT AS place FROM r) WHERE place <= 5".format(_TOKENS),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "benchmark")
    asked = x.where("item_id % 10 = 0").select(F.col("item_id").alias("ask_id"), F.col("text").alias("question"))
    history = x.where("item_id > 0").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return learning.similar_questions(asked, history, tx.english_tokens, 0.2)


#: Texts before and after an edit, in Spark and in DuckDB.
_BEFORE = "'select ' || event_type || ' from t'"
_AFTER = (
    "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'selec ' || event_type || ' from t' ELSE 'select ' || CASE user_id % 5 WHEN 0 THEN 'a' ELSE event_type END || ' from t' END || "
    "CASE user_id % 4 WHEN 0 THEN ' -- limit ' || event_type WHEN 1 THEN ' limit ' || user_id WHEN 2 THEN ' ' || event_type || ' /* where */' ELSE CASE event_id % 3 WHEN 0 THEN ' where a == 1' ELSE '' END END"
)
_PLAIN_SQL = r"trim(regexp_replace(regexp_replace({}, '(?s)/\*.*?\*/', '', 'g'), '--[^\n]*', '', 'g'))"


@query(
    "edit_meaning",
    f"SELECT event_id, q <> '' AND NOT regexp_matches(q, '{learning.INVALID_SQL}') AS plausible, x <> '' AND CASE WHEN p = q THEN false WHEN starts_with(q, p) THEN len(list_filter({learning.EDIT_WORDS}, lambda w: contains(lower(trim(substr(q, length(p) + 1))), w))) > 0 ELSE true END AS meaningful "
    f"FROM (SELECT event_id, {_AFTER} AS x, {_PLAIN_SQL.format(_BEFORE)} AS p, {_PLAIN_SQL.format(_AFTER)} AS q FROM events)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    before, after = F.expr(_BEFORE), F.expr(_AFTER)
    return table(spark, d, "events").select("event_id", learning.plausible_sql(after).alias("plausible"), learning.meaningful_edit(before, after).alias("meaningful"))


_DOMAINS = (("shop", ("click", "purchase"), ("view", "cart"), ("orders", "gone")), ("web", ("login",), ("signup", "click", "x"), ("events",)), ("none", (), (), ()))


@query(
    "domain_shares",
    "SELECT event_type AS ask_id, domain, round(least(1, 0.5::DOUBLE * kw + 0.3::DOUBLE * te + 0.2::DOUBLE * sc), 4) AS score FROM (SELECT event_type, domain, "
    "len(list_filter(keywords, lambda w: contains(event_type || ' of orders', w))) / greatest(len(keywords), 1) AS kw, len(list_filter(terms, lambda w: contains(event_type || ' of orders', w))) / greatest(len(terms), 1) AS te, "
    "list_sum(list_transform(tables || ['~'], lambda t: (t IN ('orders', 'events'))::INT + contains(event_type || ' of orders', t)::INT)) / greatest(2 * len(tables), 1) AS sc "
    f"FROM (SELECT DISTINCT event_type FROM events), (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {list(k)}::VARCHAR[], {list(t)}::VARCHAR[], {list(s)}::VARCHAR[])' for n, k, t, s in _DOMAINS)}) AS dom(domain, keywords, terms, tables))",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    domains = spark.createDataFrame([(n, list(k), list(t), list(s)) for n, k, t, s in _DOMAINS], "domain string, keywords array<string>, terms array<string>, tables array<string>")
    asked = table(spark, d, "events").select(F.col("event_type").alias("ask_id"), F.concat("event_type", F.lit(" of orders")).alias("question")).distinct()
    return routing.domain_shares(asked, domains, ["orders", "events"])


@query(
    "retrieval_confidence",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(0.4::DOUBLE * coalesce(CASE WHEN event_id % 3 > 0 THEN (event_id % 10) / 10 END, 0) + 0.4::DOUBLE * coalesce(CASE WHEN event_id % 5 > 0 THEN (event_id % 7) / 7 END, 1) "
    "+ 0.2::DOUBLE * CASE WHEN event_id % 6 > 0 THEN least(1, (event_id % 4) / (event_id % 6)) ELSE 0.5 END, 3) END AS confidence FROM events",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    score = routing.retrieval_confidence(F.when(e % 3 > 0, e % 10 / 10), F.when(e % 5 > 0, e % 7 / 7), e % 4, e % 6)
    return table(spark, d, "events").select("event_id", score.alias("confidence"))


@query("admitted")
def _(spark: SparkSession, d: str) -> DataFrame:
    return learning.admitted(table(spark, d, "events"), "event_type", "ts", 5, 3600).select("event_id", "admitted")


@query("started")
def _(spark: SparkSession, d: str) -> DataFrame:
    return learning.started(table(spark, d, "events"), "event_type", "ts", 5, 3600).select("event_id", "started")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))"


@query(
    "similar_texts",
    f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), e AS (SELECT doc_id, {_WORDS} AS t FROM documents), "
    "p AS (SELECT d.doc_id AS a, e.doc_id AS b, len(list_intersect(d.t, e.t)) AS n, len(d.t) + len(e.t) AS m FROM d JOIN e ON len(e.t) BETWEEN 0.8 * len(d.t) AND len(d.t) / 0.8 AND len(d.t) > 0 AND d.doc_id <> e.doc_id) "
    "SELECT a, b, round(n / (m - n), 6) AS similarity FROM p WHERE n / (m - n) >= 0.8",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), learning.words_set(F.col("text")).alias("tokens"))
    return alike.similar_pairs(x, 0.8).withColumn("similarity", F.round("similarity", 6))
