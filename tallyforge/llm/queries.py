"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, conversations, ctw, decontamination, langid, licenses, mixing, neardup, periodic, phrases, quality, secrets, topk


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over whole tables."""
    return {
        "op1_secrets": lambda spark, d: secrets.op1_secrets(_docs(spark, d)),
        "op2_bpe": lambda spark, d: bpe.op2_bpe(_docs(spark, d)),
        "op3_quality": lambda spark, d: quality.op3_quality(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op4_top_k": lambda spark, d: topk.op4_top_k(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op5_near_duplicates": lambda spark, d: neardup.op5_near_duplicates(_docs(spark, d)),
        "op6_ctw": lambda spark, d: ctw.op6_ctw(_docs(spark, d)),
        "op7_repeated_phrases": lambda spark, d: phrases.op7_repeated_phrases(_docs(spark, d)),
        "op8_language_id": lambda spark, d: langid.op8_language_id(_docs(spark, d)),
        "op9_mix_sources": lambda spark, d: mixing.op9_mix_sources(_docs(spark, d)),
        "op10_license_scan": lambda spark, d: licenses.op10_license_scan(_docs(spark, d)),
        "op11_conversation_trie": lambda spark, d: conversations.op11_conversation_trie(spark.read.parquet(f"{d}/conversations.parquet")),
        "op12_decontamination": lambda spark, d: decontamination.op12_decontamination(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op13_periodic_runs": lambda spark, d: periodic.op13_periodic_runs(_docs(spark, d)),
    }


#: Words of each document in DuckDB.
_WORDS = (
    "d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), "
    "lambda x: x <> '') AS w FROM documents)"
)
_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
_NEAR = f"""
WITH RECURSIVE {_WORDS}, g AS (
    SELECT doc_id, list_slice(w, i, i + 4) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), s AS (SELECT doc_id, k, count(*) AS c FROM g GROUP BY doc_id, k), n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * i >= 4 * (a.n + b.n - i)
    UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id < b.doc_id
), r(doc_id, c) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT f.y, r.c FROM r JOIN (SELECT x, y FROM e UNION SELECT y, x FROM e) f ON f.x = r.doc_id
)
SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id
"""
_REPEATED = f"""
WITH {_WORDS}, g AS (
    SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), o AS (SELECT k, min(doc_id) AS owner FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN o USING (k), range(13) t(j) WHERE owner < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 of the decimal digits of conv_id.
_CRC32 = (
    "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)
_TRIE = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS p FROM t GROUP BY conv_id),
c AS (SELECT conv_id, p, {_CRC32} % 6 AS h FROM own),
r AS (SELECT c.conv_id, coalesce(list_slice(b.p, 1, h), []) || list_slice(c.p, h + 1, len(c.p)) AS p FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
x AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM r),
n AS (
    SELECT list_slice(p, 1, d) AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = d), '')) AS ends_sha256
    FROM x GROUP BY list_slice(p, 1, d), d
), s AS (
    SELECT n.*, (SELECT count(*) FROM n u WHERE u.d = n.d + 1 AND list_slice(u.k, 1, n.d) = n.k) AS n_children,
        CASE WHEN d > 0 THEN (n_convs - 1) * length(k[d].text) ELSE 0 END AS saved FROM n
), up AS (SELECT list_slice(k, 1, a) AS k, a AS d, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM s)),
sub AS (SELECT k, d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY k, d)
SELECT s.conv_id, s.d AS depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
FROM s JOIN sub ON sub.d = s.d AND sub.k = s.k LEFT JOIN n q ON q.d = s.d - 1 AND q.k = list_slice(s.k, 1, s.d - 1)
"""
_LOW = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATED = f"""
WITH d AS (SELECT doc_id, list_filter({_LOW}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter({_LOW}, lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(k) AS n FROM g),
p AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, n, i FROM p JOIN g USING (k)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS j FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for queries that it can express; the others are tested against brute-force versions."""
    return {"op4_top_k": _TOP_K, "op5_near_duplicates": _NEAR, "op7_repeated_phrases": _REPEATED, "op11_conversation_trie": _TRIE, "op12_decontamination": _CONTAMINATED}
