"""Hybrid search over stored documents of a catalog, against scans; metrics as documents."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.functions import text as tx
from tallyforge.operators import catalog, documents, retrieval, routing, search
from tallyforge.plans.metrics import Lookup, Metric
from tallyforge.queries_search import found_dimensions, hash_question

DOCS = [(f"t{i % 7}.c{i}", f"t{i % 7}", f"column number {i} of group {i % 5} {'price total' if i % 9 == 0 else 'name'}") for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, fact string, text string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    x = search.CatalogIndex(spark, str(tmp_path_factory.mktemp("catalog")), ("fact",))
    assert not x.ready()
    x.build(docs, tx.english_tokens(F.col("text")))
    return x


def scanned(docs, words, k):
    n = search.arm_size(k)
    sparse = retrieval.bm25(docs, tx.english_tokens(F.col("text")), words, n, "id").withColumnRenamed("doc_id", "id")
    dense = retrieval.cosine_top(documents.embedded(docs), hash_question(words), n, id_col="id").withColumnRenamed("vec_id", "id")
    known = docs.select("id", "fact")
    return search.hybrid(sparse.join(known, "id"), dense.select("id", "score").join(known, "id"), k, ["fact"]).collect()


@pytest.mark.parametrize("words", [["price", "total"], ["group"], ["nothing", "like", "it"]])
def test_equal_to_a_scan(index, docs, words):
    assert index.ready() and index.search(words, hash_question(words), 8).collect() == scanned(docs, words, 8)


def test_a_filter_counts_its_own_documents(index, docs):
    got = index.search(["price"], hash_question(["price"]), 6, F.col("fact") == "t2").collect()
    assert got == scanned(docs.where("fact = 't2'"), ["price"], 6) and {r.fact for r in got} == {"t2"}


def test_vectors_of_any_embedding(spark, docs, tmp_path):
    x = search.CatalogIndex(spark, str(tmp_path), ("fact",))
    by_length = lambda d: d.withColumn("embedding", F.array(F.length("text").cast("float"), F.length("id").cast("float")))
    x.build(docs, tx.english_tokens(F.col("text")), by_length, lists=3)
    want = [r.vec_id for r in retrieval.cosine_top(by_length(docs), [30.0, 5.0], 10, id_col="id").collect()]
    got = [r.id for r in x.search(["zzz"], [30.0, 5.0], 10).collect()]
    assert got == want


def test_no_documents(spark, docs, tmp_path):
    x = search.CatalogIndex(spark, str(tmp_path), ("fact",))
    x.build(docs.limit(0), tx.english_tokens(F.col("text")))
    assert x.search(["a"], hash_question(["a"]), 3).count() == 0


def test_metrics_become_documents(spark, tmp_path):
    sales = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 else None, f"s{i}") for i in range(60)], "n int, kind string, serial string")
    shop = spark.createDataFrame([(1, "north"), (2, None)], "shop_id long, shop_region string")
    look = Lookup("n", "shop", "shop_id", (("region", "shop_region"),))
    metrics = [
        Metric("sale_count", "sales", "*", "count", ("kind", "serial"), None, look),
        Metric("plain", "sales", "n", "sum"),
    ]
    x = catalog.metric_documents(metrics, {"sales": sales, "shop": shop})
    assert {r.id: r.text for r in x.collect()} == {
        "sale_count": "sale count count of * in sales by kind k0 k1 k2 by serial by region north",
        "plain": "plain sum of n in sales",
    }
    index = search.CatalogIndex(spark, str(tmp_path), ("fact", "dimensions"))
    index.build(x, tx.english_tokens(F.col("text")))
    found = {r.dimension: r.score for r in found_dimensions(index, ["north"], 1).collect()}
    assert set(found) == {"kind", "serial", "region"} and len(set(found.values())) == 1


def test_a_question_finds_its_schema(spark, tmp_path):
    columns = spark.createDataFrame([("orders", "o_id", "int", 0), ("orders", "price", "double", 1), ("clients", "c_id", "int", 0), ("clients", "city", "string", 1), ("far", "x", "int", 0)], "table_name string, column_name string, data_type string, position int")
    links = spark.createDataFrame([("orders", "clients", "c_id", "c_id")], "from_table string, to_table string, from_column string, to_column string")
    index = search.CatalogIndex(spark, str(tmp_path), ("table_name",))
    index.build(catalog.column_documents(columns), tx.english_tokens(F.col("text")))
    none = spark.createDataFrame([], "table_name string, score double")
    got = {r.table_name: r for r in routing.question_schema(index, "what is the total price from orders", lambda s: hash_question(s.split()), none, columns, links, k=1).collect()}
    assert got["orders"].is_seed and got["orders"].score >= 0.95 and got["orders"].columns == ["o_id", "price"] and "clients" in got
    said = spark.range(1).select(questions.search_text(F.lit("how many from orders where city is 'Rome'")).alias("s")).first().s
    assert said.startswith("how many from orders where city is 'Rome' ") and said.endswith("Rome orders")
