"""Terms, rules and question places beyond what the twins show."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import questions
from tallyforge.operators import catalog, knowledge
from tallyforge.plans import formulas, validate
from tallyforge.session import register, table


def _of(spark, texts, column):
    x = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in x.orderBy("i").select(column(F.col("text"))).collect()]


def test_fuzzy_terms(spark):
    texts = ["arder", "xyz", None, "", "a" * 5000 + "rder", "ordre"]
    got = _of(spark, texts, lambda c: knowledge.term_score(knowledge.Term("border"), c))
    want = []
    for t in texts:
        x = SequenceMatcher(None, "border", t or "").ratio()
        want.append(1.0 if "border" in (t or "") else 0.5 if "bo" in (t or "") else round(x * 0.7, 3) if x >= 0.6 else 0.0)
    assert got == want and got[0] > 0


def test_all_terms_take_one_worker_a_task(spark):
    terms = [knowledge.Term(t) for t in ("border", "ordeal", "murder", "x")]
    asked = spark.createDataFrame([(1, "arder"), (2, None), (3, "arder"), (4, "Murders")], "id long, text string")
    found = knowledge.match_terms(asked, "id", "text", terms)
    assert found._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    want = [(r.id, t.name, s) for r in asked.collect() for t in terms if (s := spark.range(1).select(knowledge.term_score(t, F.lit(r.text).cast("string"))).first()[0]) >= 0.3]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 4


def test_coverage(spark):
    assert _of(spark, ["aXa", "", None, "bb"], lambda c: knowledge.coverage("a|x", c)) == [1.0, 0.0, 0.0, 0.0]


def test_question_places(spark):
    assert _of(spark, ["从订单 去年 the users table", None], questions.named_tables) == [["users"], None]
    assert _of(spark, ["a 'b c' 「d」 \"\""], questions.quoted_values) == [["b c", "d"]]
    assert _of(spark, ["本季度销售", "plain", None, "since May"], questions.speaks_of_time) == [True, False, False, True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "kind string, status string, idle_days int, score double, created timestamp")
    assert knowledge.needs_upkeep(none).first().due is False
    columns = spark.createDataFrame([], "table_name string, column_name string, data_type string, position int")
    assert catalog.keyword_scan(columns, ["orders"]).count() == 0 and catalog.search(columns, "x").count() == 0


@pytest.mark.parametrize("mode, text", [("exclude", "id: int"), ("off", "id: int\nemail: string"), ("mask", "id: int\n<pii:email>: string")])
def test_schema_text(spark, mode, text):
    x = spark.createDataFrame([("t", "id", "int", 0), ("t", "email", "string", 1)], "table_name string, column_name string, data_type string, position int")
    assert catalog.schema_text(x, mode).first().text == text


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        catalog.schema_text(spark.createDataFrame([], "table_name string, column_name string, data_type string, position int"), "other")


def test_comparison_warnings(spark, sf):
    register(spark, sf, ("orders",))
    of = lambda where: [w for w in validate.validate(spark, f"SELECT count(*) FROM orders WHERE {where}").warnings if w.startswith("type:")]
    assert of("o_orderkey > 3 AND o_totalprice > 1 AND o_orderdate >= DATE '1995-01-01' AND o_orderpriority = 'x'") == []
    assert of("o_orderpriority = 5") == ["type: o_orderpriority is string and compared as bigint"]
    assert of("CAST(o_orderpriority AS INT) = 5") == []
    assert of("o_orderpriority IN (1, 2)") == ["type: o_orderpriority is string and compared as bigint"]
    assert of("o_orderpriority BETWEEN 1 AND 2") == ["type: o_orderpriority is string and compared as bigint"]
    assert of("o_orderkey > '5'") == ["type: o_orderkey is bigint and compared as string"]
    assert of("o_orderdate BETWEEN '1995-01-01' AND '1996-01-01' AND o_orderkey IN (1, 2) AND o_totalprice = 1 AND o_orderpriority IN ('a', NULL)") == []


def test_heal(spark, sf):
    register(spark, sf, ("orders",))
    answers = iter([None, "SELECT no_column FROM orders", "SELECT count(*) FROM orders WHERE o_orderkey > 1"])
    assert validate.heal(spark, "SELEC", lambda sql, errors: next(answers)).rounds == 3
    assert validate.heal(spark, "SELEC", lambda sql, errors: "SELECT nothing_known") is None
    assert validate.heal(spark, "SELEC", lambda sql, errors: "SELECT 1").confidence == pytest.approx(0.6)


def test_lineage_and_terms(spark, sf):
    one = formulas.FormulaMetric("per_head", "sum(o_totalprice) / count(DISTINCT o_custkey)")
    found = formulas.lineage(table(spark, sf, "orders"), one)
    assert found["columns"] == ["o_custkey", "o_totalprice"] and found["files"][0].endswith("orders.parquet")
    new = formulas.from_terms([("PER_HEAD", "1"), ("b", "max(x)"), ("b", "min(x)"), ("c", "")], [one])
    assert [(m.name, m.formula) for m in new] == [("b", "max(x)")]
