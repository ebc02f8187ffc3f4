"""Queries of word discovery and segmentation, over texts whose letters are written as Han characters; with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import segment
from tallyforge.functions import text as tx
from tallyforge.operators import retrieval
from tallyforge.registry import query
from tallyforge.session import table

_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Twenty-six characters that stand for the letters, so the given texts read as unspaced Chinese.
_HAN = "".join(chr(0x4E00 + 16 * i) for i in range(26))
_HAN_SQL = f"translate(translate(lower(coalesce(text, '')), ' ', ''), '{_LATIN}', '{_HAN}')"


def _han(text: Column) -> Column:
    """Letters as Han characters, spaces gone; marks and other letters stay and end a run."""
    return F.translate(F.replace(F.lower(text), F.lit(" "), F.lit("")), _LATIN, _HAN)


@query(
    "discovered_words",
    f"WITH r AS (SELECT unnest(regexp_extract_all({_HAN_SQL}, '[\\x{{4e00}}-\\x{{9fff}}]+')) AS run FROM documents), "
    "g AS (SELECT run[i:i + k - 1] AS word FROM (SELECT run, k, unnest(range(1, length(run) - k + 2)) AS i FROM r, range(1, 5) AS t(k) WHERE length(run) >= k)), "
    "c AS (SELECT word, count(*) AS weight FROM g GROUP BY word HAVING count(*) >= 5 OR length(word) = 1), "
    "p AS (SELECT word, weight, substring(word, 1, m) AS a, substring(word, m + 1) AS b FROM (SELECT *, unnest(range(1, length(word))) AS m FROM c WHERE length(word) > 1)), "
    "h AS (SELECT p.word, any_value(p.weight) AS weight, min(p.weight * (SELECT sum(weight) FROM c WHERE length(word) = 1) / (x.weight * y.weight)) AS hold FROM p JOIN c x ON x.word = a JOIN c y ON y.word = b GROUP BY p.word) "
    "SELECT word, weight FROM h WHERE hold >= 20 UNION ALL SELECT word, weight FROM c WHERE length(word) = 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return segment.discover_words(table(spark, d, "documents").select(_han(F.col("text")).alias("text")))


def _segmented(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """(documents as unspaced text, their words by the words of the benchmark's items)."""
    items = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''")
    words = items.groupBy(F.translate("w", _LATIN, _HAN).alias("word")).agg(F.count("*").alias("weight"))
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", _han(F.col("text")).alias("text"))
    return docs, tx.chinese_tokens(F.col("text"), segment.segmenter(words))


@query("segmented_words")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs, words = _segmented(spark, d)
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("segmented_bm25")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs, words = _segmented(spark, d)
    asked = [w.translate(str.maketrans(_LATIN, _HAN)) for w in ("the", "tion", "and")]
    return retrieval.bm25(docs.select("doc_id", words.alias("words")), F.col("words"), asked, 10)
