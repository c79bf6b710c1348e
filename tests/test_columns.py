import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.plans.grammar import probabilities


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


def test_passes_is_false_for_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.5,), (0.49,)], "s double")
    assert [r[0] for r in df.select(C.passes("s", 0.5)).collect()] == [False, False, True, False]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(C.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.7071067811865475, abs=1e-12)
    assert math.isnan(got[1])
    assert got[2] is None


@pytest.mark.parametrize(("level", "score"), [(5, 1.0), (3, 0.6), (1, 0.2), (7, 1.0), (0, 0.0)])
def test_level_score(spark, level, score):
    assert one(spark, C.level_score(F.lit(level))) == pytest.approx(score)


def test_judge_aggregate_defaults_and_is_not_clamped(spark):
    df = spark.createDataFrame([("{}",), ('{"aggregate_quality_level": 7}',), ("not json",)], "r string")
    assert [r[0] for r in df.select(C.judge_aggregate("r")).collect()] == [0.6, 1.4, 0.6]


def test_epsilon_golden(spark):
    want = {1: 0.49, 2: 0.4802, 3: 0.470596, 10: 0.408536403443773, 79: 0.101351454123490, 80: 0.1, 100: 0.1}
    got = {r["n"]: r["e"] for r in spark.createDataFrame([(k,) for k in want], "n int").select("n", C.epsilon("n").alias("e")).collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


@pytest.mark.parametrize(
    ("weights", "t", "want"),
    [((0.6, 0.4), 0.7, (0.640892, 0.359108)), ((0.6, 0.4), 1.2, (0.583677, 0.416323)), ((0.3, 0.3, 0.2, 0.1, 0.1), 0.9, (0.309851, 0.309851, 0.197468, 0.091415, 0.091415)), ((0.8, 0.2), 1.0, (0.8, 0.2))],
)
def test_tempered_golden(spark, weights, t, want):
    df = spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "k int, w double").withColumn("rule", F.lit("r"))
    got = [r["p"] for r in df.select("k", C.tempered("w", t, "rule").alias("p")).orderBy("k").collect()]
    assert got == pytest.approx(list(want), abs=1e-6)
    assert probabilities(list(weights), t) == pytest.approx(list(want), abs=1e-6)


def test_hash_of_objects_ignores_key_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}', "object"), ('{"b": 2, "a": 1}', "object"), ('{"b": 2, "a": 1}', "text")], "c string, k string")
    h = [r[0] for r in df.select(C.content_hash("c", "k")).collect()]
    assert h[0] == h[1] != h[2]


def test_dedup_value_falls_back_to_content(spark):
    df = spark.createDataFrame([("c", {"plant": "x"}), ("c", {"other": "x"})], "content string, metadata map<string,string>")
    assert [r[0] for r in df.select(C.dedup_value("content", "metadata", "plant")).collect()] == ["x", "c"]


def test_answers(spark):
    rows = [("1. a\n\n 2. b ",), ("```json\n[\"a\", {\"x\": 1}]\n```",), ('{"samples": [1, 2]}',), ('{"x": 1}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(C.parsed_answer("t")).collect()]
    assert got == [["1. a", "2. b"], ['"a"', '{"x":1}'], ["1", "2"], ['{"x":1}']]


def test_coerce_json(spark):
    df = spark.createDataFrame([('sure: {"a": 1} ok',), ("nothing",), ('```\n{"b": 2}\n```',)], "t string")
    assert [r[0] for r in df.select(F.to_json(C.coerce_json("t"))).collect()] == ['{"a":1}', None, '{"b":2}']


def test_placeholders_of_any_script(spark):
    assert one(spark, C.placeholders(F.lit("<ré> <a_1> < b>"))) == ["ré", "a_1"]


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 40), st.integers(1, 200))
def test_quotas_add_up(spark, n, total):
    df = spark.range(n).select(C.row_quota("id", n, total).alias("q"))
    q = [r["q"] for r in df.collect()]
    assert sum(q) == total
    assert max(q) - min(q) <= 1


def test_complexity(spark):
    df = spark.createDataFrame([(0, False), (1, False), (3, False), (4, False), (1, True)], "n int, k boolean")
    assert [r[0] for r in df.select(C.complexity("n", "k")).collect()] == ["simple", "medium", "medium", "complex", "complex"]


def test_hidden_keys_differ_between_judging_and_generating():
    assert set(C.JUDGE_HIDDEN_KEYS) - set(C.PROMPT_HIDDEN_KEYS) == {"semantic_similarity_threshold", "diversity_min", "diversity_max", "diversity_threshold", "entailment_threshold"}
    assert set(C.PROMPT_HIDDEN_KEYS) - set(C.JUDGE_HIDDEN_KEYS) == {"semantic_similarity"}
