import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalog, registered
from millrace.plans.asking import asked
from millrace.plans.pipeline import REGISTRY, Operator, Pipeline, check, guarded


def test_chain_rules():
    REGISTRY["_shrink"] = Operator("_shrink", "map", lambda c: c, "image", "image")
    REGISTRY["_read"] = Operator("_read", "map", lambda c: c, "multimodal", "multimodal")
    try:
        assert check(["emoji", "_shrink"]) and not check(["emoji", "_read", "_shrink"]) and check(["nothing"])
        with pytest.raises(ValueError):
            Pipeline([("emoji", {}), ("_shrink", {})])
    finally:
        del REGISTRY["_shrink"], REGISTRY["_read"]


def test_pipeline_fuses_and_reports(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "a\u3000text that is long enough"), (3, None)], "doc_id long, text string")
    chain = Pipeline([("unicode_spaces", {}), ("invisible", {}), ("by_length", {"least": 10})])
    after = chain.transform(rows)
    assert [(r.doc_id, r.text) for r in after.collect()] == [(2, "a text that is long enough")]
    assert "Exchange" not in after._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.status for r in chain.results(rows, after).collect()} == {1: "FILTERED", 2: "COMPLETED", 3: "FILTERED"}


def test_chain_keeps_failed_rows(spark):
    rows = spark.createDataFrame([(1, "<a>"), (2, "<a>a value</a>"), (3, ""), (4, "<a>1</a>")], "doc_id long, text string")
    chain = Pipeline([("xml_values", {}), ("unicode_spaces", {}), ("by_length", {"least": 6})])
    after = chain.transform(rows)
    assert {r.doc_id: (r.text, r.failed_reason and r.failed_reason.op_name) for r in after.collect()} == {1: ("", "xml_values"), 2: ("a: a value", None)}
    assert {r.doc_id: r.status for r in chain.results(rows, after).collect()} == {1: "FAILED", 2: "COMPLETED", 3: "FILTERED", 4: "FILTERED"}


def test_chain_computes_texts_once(spark):
    rows = spark.createDataFrame([(1, "a text of some length")], "doc_id long, text string")
    plan = Pipeline([("punctuation", {}), ("urls", {}), ("by_length", {})]).transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<url>") == 1


def test_asking(spark):
    def client():
        def answer(prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() if p != "none" else None for p in prompts]

        return answer

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "none"), (5, "b")], "id int, q string")
    got = {r.id: (r.answer, r.failed_reason and r.failed_reason.reason) for r in asked(rows, F.col("q"), client).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError('no')"), 3: (None, None), 4: (None, "no answer"), 5: ("B", None)}


def test_eligible_files(spark):
    tags = json.dumps([{"from_name": "topic", "to_name": "t", "type": "Choices", "values": {"choices": ["mills"]}}])
    rows = spark.createDataFrame([(1, "2024-01-05", tags), (2, None, tags), (3, "2023-01-01", tags), (4, None, None)], "id int, tags_updated_at string, tags string").withColumn("tags_updated_at", F.col("tags_updated_at").cast("timestamp"))
    ids = lambda **k: {r.id for r in rows.filter(catalog.eligible(**k)).collect()}
    assert ids(date_range=("2024-01-01", "2024-02-01")) == {1, 2, 4} and ids(label="topic", value="mills") == {1, 2, 3} and ids(label="topic") == {1, 2, 3} and ids(value="x") == set()
    with pytest.raises(ValueError):
        catalog.ratio_mix(rows, {})


def test_guarded_keeps_failed_rows(spark):
    rows = spark.createDataFrame([(1, "<a>"), (2, "<a>1</a>")], "doc_id long, text string")
    from millrace.operators.normalize import xml_values

    got = {r.doc_id: (r.text, r.failed_reason and r.failed_reason.op_name) for r in guarded(rows, "xml_values", xml_values(F.col("text"))).collect()}
    assert got == {1: ("", "xml_values"), 2: ("a: 1", None)}


def test_tags(spark):
    simple = json.dumps([{"from_name": "sentiment", "to_name": "text", "values": ["positive"]}, {"from_name": "unknown", "to_name": "text", "values": ["x"]}])
    row = spark.range(1).select(catalog.full_tags(F.lit(simple), {"sentiment": "choices"}).alias("t")).first()
    assert len(row.t) == 1 and row.t[0].type == "choices" and row.t[0]["values"] == {"choices": ["positive"]} and row.t[0].id
    full = '[{"from_name":"a","to_name":"t","type":"Choices","values":{"choices":["x","y"]}}]'
    assert [tuple(v) for v in spark.range(1).select(catalog.flat_tags(F.lit(full)).alias("v")).first().v] == [("a", "x"), ("a", "y")]
    has = spark.createDataFrame([('[{"name":"x"}]',), ('{"name":"x"}',), (None,)], "t string").select(catalog.has_tag(F.col("t"), "x").alias("h"))
    assert [r.h for r in has.collect()] == [True, False, False]


def test_tags_merge_by_precedence(spark):
    kind = "array<struct<id:string,from_name:string,to_name:string,type:string,values:map<string,array<string>>>>"
    old, new = [("1", "a", "t", "c", {"c": ["x"]}), ("2", "b", "t", "c", {"c": ["y"]})], [("2", "b", None, None, {"c": ["z"]}), (None, "a", "t", "c", {"c": ["w"]}), (None, "n", "t", "c", {"c": ["q"]})]
    (row,) = spark.createDataFrame([(old, new)], f"o {kind}, n {kind}").select(catalog.merged_tags(F.col("o"), F.col("n")).alias("m")).collect()
    assert [(t.id, t.from_name, t.to_name, t["values"]["c"]) for t in row.m] == [("1", "a", "t", ["w"]), ("2", "b", "t", ["z"]), (None, "n", "t", ["q"])]


def test_progress_and_status(spark):
    rows = spark.createDataFrame([(1, 3, 8), (0, 0, 0), (2, 0, 2)], "ok int, bad int, total int")
    p = catalog.progress(F.col("ok"), F.col("bad"), F.col("total"))
    got = [tuple(r) for r in rows.select(p[0].alias("p"), p[1].alias("r"), catalog.status_of(F.lit(False), F.col("ok"), F.col("bad")).alias("s")).collect()]
    assert got == [(12.5, 25.0, "PARTIAL_SUCCESS"), (0.0, 0.0, "FAILED"), (100.0, 100.0, "COMPLETED")]


def test_lineage(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (6, 9), (9, 10)], "a long, b long")
    assert {r.id: r.graph_id for r in catalog.lineage(spark, edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 5, 10: 5}


def test_lineage_of_all_orders(spark, sf_dir):
    """The registered query against a plain union of the edges of the whole table."""
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey") + 10_000_000).collect():
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.id: r.graph_id for r in registered.queries()["lineage_graphs"](spark, sf_dir).collect()} == {i: find(i) for i in root}


def test_evaluation_columns(spark):
    (row,) = spark.range(1).select(catalog.verdicts(F.lit("结果：Y ... 结果: N")).alias("v"), catalog.filled("{a}-{b}", a=F.lit("x"), b=F.lit(None).cast("string")).alias("f")).collect()
    assert row.v == [True, False] and row.f == "x-"
    chunks = spark.createDataFrame([(1, 10, [1.0] * 6), (1, 30, [0.0] * 6), (1, 99, [1.0])], "k int, length int, scores array<double>")
    assert {r.score for r in catalog.weighted_scores(chunks, "k").collect()} == {0.25}
