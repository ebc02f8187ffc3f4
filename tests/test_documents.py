"""Chunks, hash embeddings, edits, vector tables and declared schemas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.operators import documents
from tallyforge.sources.ddl import declared


def test_chunks():
    assert documents.markdown_chunks(None) == documents.markdown_chunks(" \n") == []
    assert documents.markdown_chunks("# a\nx\n# b\ny", most=100) == ["# a\nx\n\n# b\ny"]
    assert documents.markdown_chunks("# a\nx\n# b\ny", most=6) == ["# a\nx", "# b\ny"]
    long = "z" * 50
    parts = documents.markdown_chunks(f"# h\n\n{long}", most=20, shared=5)
    assert parts[0] == "# h" and all(len(p) <= 20 for p in parts) and parts[1] + "".join(p[5:] for p in parts[2:]) == long


def test_chunks_of_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in documents.chunked(docs).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert all(got.get(r.doc_id, []) == documents.markdown_chunks(r.text) for r in docs.collect())


def test_hash_vectors(spark):
    x = documents.embedded(spark.createDataFrame([("a",), (None,), ("a",)], "text string")).collect()
    assert x[0].embedding == x[2].embedding != x[1].embedding and abs(np.linalg.norm(x[0].embedding) - 1) < 1e-5


def test_edits(spark):
    x = spark.createDataFrame([("select a from t", "select a, b from t where x"), (None, None)], "a string, b string")
    got = [[tuple(o) for o in r.ops] for r in x.select(documents.edit_operations(F.col("a"), F.col("b")).alias("ops")).collect()]
    assert got == [[("replace", "a", "a, b"), ("insert", "", "where x")], []]


def test_vector_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "id int, scope string, embedding array<float>")
    short = spark.createDataFrame([(3, "b", [1.0])], rows.schema)
    t = documents.VectorTable(spark, str(tmp_path / "v"), 2, "one")
    t.create(rows)
    with pytest.raises(Exception, match="a vector has not 2 components"):
        t.replace(F.col("id") == 1, short)
    assert t.count() == 2  # the failed version is not read
    t.replace(F.col("scope") == "b", spark.createDataFrame([(4, "b", [1.0, 1.0])], rows.schema))
    t.delete(F.col("id") == 1)
    assert [r.id for r in t.read().collect()] == [4]
    t.restore(0)
    assert sorted(r.id for r in t.read().collect()) == [1, 2]
    with pytest.raises(ValueError):
        t.restore(1)
    with pytest.raises(ValueError):
        documents.VectorTable(spark, str(tmp_path / "v"), 3, "one").read()


def test_declared_schemas():
    got = declared(
        "CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, balance DECIMAL(10, 2)); -- a note\n"
        "CREATE TABLE orders (id INT, user_id INT REFERENCES users(id), at TIMESTAMP, FOREIGN KEY (user_id) REFERENCES users (id))"
    )
    assert got["users"].schema.simpleString() == "struct<id:int,name:string,balance:decimal(10,2)>" and not got["users"].schema["name"].nullable
    assert got["orders"].keys == (("user_id", "users", "id"), ("user_id", "users", "id"))
    for bad in ("DROP TABLE x", "CREATE TABLE a (x INT); CREATE TABLE a (x INT)", "SELECT 1"):
        with pytest.raises(ValueError):
            declared(bad)


def test_versions_of_texts(spark):
    x = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("b", 1, "uno")], "item string, version int, text string")
    back = documents.rolled_back(x, "item", "version", spark.createDataFrame([("a", 1)], "item string, version int"))
    assert sorted(map(tuple, back.collect())) == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "one"), ("b", 1, "uno")]
    assert sorted(map(tuple, documents.branched(x, "item", "version", "a", 1, "c").where("item = 'c'").collect())) == [("c", 1, "one")]
    ratio = spark.createDataFrame([("a b", "a b"), ("a b", "a c"), (None, "x")], "p string, q string").select(documents.edit_ratio(F.col("p"), F.col("q")).alias("r"))
    assert [r.r for r in ratio.collect()] == [1.0, 0.5, 0.0]


def test_models_get_a_hundred_texts_at_once(spark):
    docs = spark.range(1234).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("t"), "id")).alias("text"), "id").coalesce(1)
    sized = lambda texts: [[float(len(texts)), float(len(t))] for t in texts]
    got = documents.embedded(docs, model=sized).collect()
    assert {r.embedding[0] for r in got} <= {float(n) for n in range(1, 101)} and max(r.embedding[0] for r in got) == 100
    assert all(r.embedding[1] == len(r.text or "") for r in got) and len(got) == 1234
    with pytest.raises(Exception, match="one vector for each text"):
        documents.embedded(docs, model=lambda texts: [[1.0]]).collect()


def test_alternatives(spark):
    said = ["select 1---ALTERNATIVE---```sql\nselect 2;\n```---ALTERNATIVE---  ", "select 1", "select 1 ---ALTERNATIVE--- -- Failed to generate select 2", "", None]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(questions.alternatives_of(F.col("s")).alias("a")).collect()
    assert [r.a for r in got] == [["select 1", "select 2"], [], [], [], []]
