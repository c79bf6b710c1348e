import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.providers import OfflineChat, OfflineEntailment, as_percent, classify_batch, embedding_provider, prediction
from millrace.operators import bandit, dedup, diversity, generators, metrics
from millrace.operators.orchestrate import Orchestrator, metrics_of
from millrace.operators.validators import Deduplication, Judge, Verdict, enabled, json_answer, judged_scores
from millrace.plans import catalog
from millrace.spec import Context, Feedback, Metrics, Plan, Progress, Recipe, extract_context, model_name, original_text


def samples(spark, contents, metadata=None):
    rows = [(k, c, "text", metadata[k] if metadata else {}) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "pos int, content string, content_kind string, metadata map<string,string>")


def test_dedup_has_two_scopes(spark):
    seen = spark.createDataFrame([("A",)], "c string").select(F.sha2("c", 256).alias("content_hash"))
    got = dedup.flag_repeats(samples(spark, ["A", "A", "B", "B"]), F.col("content"), "pos", seen=seen).orderBy("pos")
    assert [r["duplicate"] for r in got.collect()] == [True, True, False, True]
    assert [r["dedup_score"] for r in got.collect()] == [0.0, 0.0, 1.0, 0.0]


def test_objects_repeat_whatever_the_order_of_their_keys(spark):
    """The whole content counts for the default field, not a field of that name in the metadata."""
    rows = [
        (0, '{"a": 1, "b": {"x": 1, "y": [2]}}', "object", {}), (1, '{"b": {"y": [2], "x": 1}, "a": 1}', "object", {}), (2, '{"a": 1, "b": 3}', "object", {}),
        (3, '{"content": "x", "label": 1}', "object", {"content": "x"}), (4, '{"content": "x", "label": 2}', "object", {"content": "x"}), (5, '{"b": 3, "a": 1}', "text", {}),
    ]
    df = spark.createDataFrame(rows, "pos int, content string, content_kind string, metadata map<string,string>")
    got = Deduplication("deduplication", {}).score(df, None).orderBy("pos").collect()
    assert [r["deduplication_passed"] for r in got] == [True, False, True, True, True, True]
    by_field = Deduplication("deduplication", {"check_field": "content_id"}).score(df.withColumn("metadata", F.create_map(F.lit("content_id"), F.lit('{"q": 1}'))), None)
    assert by_field.where("deduplication_passed").count() == 2  # of kind object, and of kind text


def test_a_content_of_most_samples_is_spread(spark):
    df = spark.range(2000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content"))
    got = dedup.flag_repeats(df, F.col("content"), "pos")
    assert got.where("duplicate").count() == 666 and "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_items_are_counted_in_the_samples_that_contain_them(spark, tmp_path):
    rng = random.Random(5)
    long = [rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(1, 9) for _ in range(20_000)]
    some = lambda k, n: " ".join(long[k : k + n])
    texts = [" ".join(long), some(0, 30), some(40, 30), some(40, 30), "x" + some(100, 12) + "y", "", None, " ", "a  b", "what is the one two three", "what is the four\nfive six seven"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, some(40, 9)), (None, some(0, 30))]
    items = [some(0, 30), some(40, 9), some(100, 12), some(100, 12)[1:], some(41, 4), some(41, 3), some(41, 2), long[7], "", None, " ", " b", "is the one two three", "what is the four\nfive", "what is the", "not there", "a b c d e f g"]
    items = [(k, x) for k, x in enumerate(items)] + [(1, some(40, 9)), (1, some(0, 30)), (None, some(0, 30)), (99, some(0, 30)), (98, None)]
    want: dict = {}
    for k, x in items:
        want[k] = want.get(k, 0) + sum(x is not None and t is not None and n is not None and x in t for n, t in docs)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, catalog.QUERIES["benchmark_overlap"](spark, str(tmp_path)).collect()), key=str) == sorted(want.items(), key=str)
    few, many = ({r["item"]: r["n"] for r in dedup.containing(d, "doc_id", "text", b, "text", most).collect()} for most in (100, 0))
    assert few == many and sum(few.values()) > 20


def test_dedup_is_idempotent(spark):
    once = dedup.first_of_each(samples(spark, list("abacab")), F.col("content"), "pos")
    assert once.count() == 3
    assert dedup.first_of_each(once.drop("content_hash"), F.col("content"), "pos").count() == 3


def test_diversity(spark):
    rows = [("one", 0, [1.0, 0.0]), ("same", 0, [1.0, 2.0]), ("same", 1, [1.0, 2.0]), ("right", 0, [1.0, 0.0]), ("right", 1, [0.0, 3.0]), ("zero", 0, [0.0, 0.0]), ("zero", 1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "b string, i int, v array<double>")
    got = {r["b"]: (r["diversity"], r["passed"]) for r in diversity.gate(diversity.closed_form(v, "b", "v")).collect()}
    assert got["one"] == (1.0, True)
    assert got["same"][0] == pytest.approx(0.0, abs=1e-12) and not got["same"][1]
    assert got["right"] == (1.0, True)
    assert math.isnan(got["zero"][0]) and not got["zero"][1]
    by_pairs = {r["b"]: r["diversity"] for r in diversity.pairwise(v.where("b <> 'zero'"), "b", "i", "v").collect()}
    assert by_pairs["same"] == pytest.approx(got["same"][0], abs=1e-12)
    assert by_pairs["one"] == 1.0


def test_pairwise_diversity_counts_pairs_of_different_order_without_listing_them(spark):
    rng = random.Random(3)
    rows = [(b, rng.randrange(n) if b != "alone" else k, [rng.gauss(0.5, 1) for _ in range(3)]) for b, n in (("repeats", 5), ("alone", 40), ("one order", 1), (None, 9)) for k in range(25)]
    rows += [("repeats", 2, None), ("repeats", None, [1.0, 0.0, 0.0]), ("alone", 90, []), ("nothing", 1, None), ("zero", 1, [0.0, 0.0, 0.0]), ("zero", 2, [1.0, 0.0, 0.0]), ("zeros", 1, [0.0, 0.0, 0.0]), ("zeros", 1, [1.0, 0.0, 0.0])]
    cosine = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True)) / (math.hypot(*u) * math.hypot(*v))
    want = dict.fromkeys({r[0] for r in rows}, 1.0)
    for b in ("repeats", "alone"):
        found = [cosine(u, v) for x, i, u in rows for y, j, v in rows if x == y == b and u and v and None not in (i, j) and i < j]
        want[b] = 1 - sum(found) / len(found)
    got = {r["b"]: r["diversity"] for r in diversity.pairwise(spark.createDataFrame(rows, "b string, i int, v array<double>"), "b", "i", "v").collect()}
    assert math.isnan(got.pop("zero")) and want.pop("zero")
    assert got == pytest.approx(want, abs=1e-12)
    many = spark.range(100_000).select(F.lit("b").alias("b"), F.col("id").alias("i"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    d = diversity.pairwise(many, "b", "i", "v")
    assert " < j" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert d.first()["diversity"] == pytest.approx(1.0, abs=1e-4)


def test_reward(spark):
    rows = [("judged", k < 8, 0.8) for k in range(10)] + [("unjudged", k < 8, None) for k in range(10)] + [("none", False, 0.9)] * 5
    got = {r["b"]: r for r in metrics.batch_metrics(spark.createDataFrame(rows, "b string, accepted boolean, quality double"), "b").collect()}
    assert got["judged"]["reward"] == pytest.approx(0.64)
    assert got["unjudged"]["reward"] == 0.0
    assert (got["none"]["pass_rate"], got["none"]["mean_quality"], got["none"]["reward"]) == (0.0, None, 0.0)
    assert Metrics(0.8, 8, 0.8).reward == pytest.approx(0.64)


def test_arm_statistics_use_the_population(spark):
    log = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 0.0)], "arm string, reward double")
    got = {r["arm"]: r for r in metrics.arm_statistics(log).collect()}
    assert got["a"]["std_reward"] == 0.0
    assert got["b"]["std_reward"] == 0.5
    assert metrics.best_arm(spark.createDataFrame([("y", 0.5), ("x", 0.5)], "arm string, mean_reward double"), {"x": 1, "y": 0}).first()["arm"] == "y"


def test_validator_scores_skip(spark):
    rows = [({"j": (0.5, "{}")},), ({"j": (0.9, '{"skipped": true}')},), ({"k": (0.1, "{}")},)]
    df = spark.createDataFrame(rows, "validation_results map<string,struct<score:double,metadata:string>>").withColumn("validation_results", F.col("validation_results"))
    assert [r["score"] for r in metrics.validator_scores(df, "j").collect()] == [0.5]


class Says(OfflineChat):
    answers: list

    def __init__(self, *answers):
        super().__init__()
        self.answers = list(answers)

    def generate(self, prompt, system_prompt=None, max_tokens=None, response_format=None):
        x = self.answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


def test_judge_retries_once_and_gates_the_batch(spark):
    recipe = Recipe("d", "t", 1)
    good = '```json\n{"aggregate_quality_level": 4, "samples": [{"sample_index": 0, "quality_level": 7}, {"sample_index": 0, "quality_level": 1}]}\n```'
    judge = Judge("llm_judge", {"threshold": 0.8}, Says("criteria", "junk", good))
    verdict = judge.judge(samples(spark, ["a", "b"]), recipe)
    assert (verdict.score, verdict.passed) == (0.8, True)
    scores = [r["llm_judge_score"] for r in judged_scores(samples(spark, ["a", "b"]), verdict).orderBy("pos").collect()]
    assert scores == pytest.approx([0.2, 0.8])  # the last of two levels for one sample; the aggregate where there is none
    assert not Judge("llm_judge", {}, Says("c", "junk", "junk")).judge(samples(spark, ["a"]), recipe).passed
    assert not Judge("llm_judge", {}, Says("c")).judge(samples(spark, []), recipe).passed
    with pytest.raises(RuntimeError):
        Judge("llm_judge", {}, Says("c", RuntimeError("down"))).judge(samples(spark, ["a"]), recipe)
    fallback = Judge("llm_judge", {"quality_criteria": "be kind"}, Says(RuntimeError("down")))
    assert fallback.criteria_for(recipe) == "be kind"
    assert json_answer('{"a": 1}') == {"a": 1}


def test_two_phases(spark):
    class Fixed(Judge):
        seen_by_judge: list = []

        def judge(self, survivors, recipe):
            Fixed.seen_by_judge = sorted(r["content"] for r in survivors.collect())
            return Verdict(0.8, True, {}, {0: 5.0})

    o = Orchestrator(spark, {"deduplication": {"enabled": True}, "json_schema": {"enabled": True}})
    o.validators.append(Fixed("llm_judge", {}))
    recipe = Recipe("d", "t", 2, {"schema": {"type": "object", "required": ["a"]}})
    batch = samples(spark, ['{"b": 1}', '{"a": 1}', '{"a": 1}', '{"a": 2}', '{"b": 1}'])
    out, verdicts = o.assess(batch, recipe)
    rows = out.orderBy("pos").collect()
    assert [r["accepted"] for r in rows] == [False, True, False, True, False]
    assert Fixed.seen_by_judge == ['{"a": 1}', '{"a": 2}']
    assert rows[1]["quality_scores"] == {"deduplication": 1.0, "json_schema": 1.0, "llm_judge": 1.0}
    assert rows[3]["quality_scores"]["llm_judge"] == 0.8
    assert "llm_judge" not in rows[0]["quality_scores"]
    m = metrics_of(out, verdicts)
    assert (m.pass_rate, m.num_samples, m.mean_quality) == (0.4, 2, 0.8)
    o.remember(out)
    again, _ = o.assess(samples(spark, ['{"a": 1}', '{"b": 1}']), recipe)
    # Accepted content is known from now on; what was rejected is not.
    assert [r["deduplication_passed"] for r in again.orderBy("pos").collect()] == [False, True]


def test_accepted_and_rejected_make_the_batch(spark):
    o = Orchestrator(spark, {"deduplication": {"enabled": True}, "similarity": {"enabled": True, "threshold": 0.2}, "entailment": {"enabled": True, "threshold": 0.1}, "diversity": {"enabled": True, "threshold": 0.0}})
    out, verdicts = o.assess(samples(spark, ["a plant in the sun", "a plant in the rain", "zzz", "a plant in the sun"]), Recipe("d", "a plant in the sun and rain", 1))
    assert out.where("accepted").count() + out.where("not accepted").count() == 4
    assert set(verdicts) == {"diversity"}


def test_validators_have_a_fixed_order():
    config = {n: {"enabled": True} for n in ("llm_judge", "diversity", "deduplication", "nonsense")} | {"similarity": {"enabled": False}}
    assert [v.name for v in enabled(config)] == ["deduplication", "diversity", "llm_judge"]
    assert enabled(None) == []
    assert isinstance(enabled(config)[0], Deduplication) and enabled(config)[0].threshold == 0.99


def test_reference_hashes_skip_bad_lines(spark):
    o = Orchestrator(spark, {"deduplication": {"enabled": True}})
    o.reference_from(spark.createDataFrame([('{"content": "known"}',), ("broken",), ('{"metadata": {"content": "hidden"}}',)], "value string"), "content")
    out, _ = o.assess(samples(spark, ["known", "hidden"]), Recipe("d", "t", 1))
    assert [r["accepted"] for r in out.orderBy("pos").collect()] == [False, True]


def test_reference_file(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"plant": "cactus"}\n\nbad\n')
    o = Orchestrator(spark, {"deduplication": {"enabled": True, "check_field": "plant", "reference_file": str(tmp_path / "r.jsonl")}})
    out, _ = o.assess(samples(spark, ["a", "b"], [{"plant": "cactus"}, {"plant": "agave"}]), Recipe("d", "t", 1))
    assert [r["accepted"] for r in out.orderBy("pos").collect()] == [False, True]
    missing = Orchestrator(spark, {"deduplication": {"enabled": True, "reference_file": str(tmp_path / "none.jsonl")}})
    assert missing.assess(samples(spark, ["a"]), Recipe("d", "t", 1))[0].where("accepted").count() == 1


def context(**kw):
    return Context("d", kw.pop("task", "t"), 5, Progress(5), **kw)


def test_router():
    r = bandit.Router(seed=1)
    plan = r.route(context(), Feedback())
    assert plan.generator_arm in bandit.NAIVE_ARMS and "initial" in plan.reasoning and plan.parameters["domain"] == "d" and "generator" not in plan.parameters
    assert r.route(context(grammar_path="g"), Feedback()).generator_arm in bandit.TEMPLATER_ARMS
    tied = Feedback(arm_rewards={"naive_balanced": [0.5], "naive_conservative": [0.5]}, exploration_rate=0.0)
    assert r.route(context(), tied).generator_arm == "naive_conservative"
    explored = {r.route(context(), Feedback(arm_rewards={"naive_balanced": [1.0]}, exploration_rate=1.0)).generator_arm for _ in range(60)}
    assert explored == set(bandit.NAIVE_ARMS)
    state = Feedback()
    for _ in range(100):
        before, state = state.exploration_rate, r.adapt(state, Metrics())
        assert 0.1 <= state.exploration_rate <= before
    assert state.exploration_rate == 0.1
    assert bandit.Router(policy=bandit.StaticPolicy()).adapt(Feedback(), Metrics()).exploration_rate == 0.5


def test_arms_table(spark):
    rows = bandit.arms_table(spark).collect()
    assert len(rows) == 6 and [r["arm"] for r in rows if r["generator"] == "templater"] == ["templater_conservative", "templater_exploratory", "templater_balanced"]


def test_feedback_is_immutable():
    a = Feedback()
    b = a.after("x", Metrics(0.5, 2, 0.5))
    assert (a.iteration, a.arm_rewards) == (0, {}) and b.arm_rewards == {"x": [0.25]} and b.generated_so_far == 2
    assert b.statistics()["x"] == {"mean_reward": 0.25, "std_reward": 0.0, "count": 1}


def test_context_and_texts():
    assert extract_context(Recipe("d", "t", 1)).complexity_level == "simple"
    assert extract_context(Recipe("d", "t", 1, {"knowledge_base": 1})).complexity_level == "complex"
    assert extract_context(Recipe("d", "t", 1, {"examples": [1]})).has_examples
    assert original_text(Recipe("task_rewrite", "t", 1, {"examples": [{"input": "i"}]})) == "i"
    assert original_text(Recipe("d", {"original_input": "o", "expected_output": "e"}, 1)) == "o"
    assert model_name("cohere/x/y") == ("cohere", "x/y") and model_name("m") == ("openai", "m")
    with pytest.raises(ValueError):
        Recipe("d", "t", 0)


def test_parsing_of_answers():
    assert generators.parse_answer('["a", {"x": 1}]') == ["a", {"x": 1}]
    assert generators.parse_answer('{"samples": [1, 2]}') == [1, 2]
    assert generators.parse_answer("[{'x': 'y'}]") == [{"x": "y"}]
    assert generators.parse_answer("1. a\n\n 2. b ") == ["1. a", "2. b"]
    assert generators.json_in('sure: {"a": 1} ok') == {"a": 1}
    with pytest.raises(ValueError):
        generators.json_in("nothing here")


def test_naive_generator(spark):
    plan = Plan(3, "naive_balanced", {"temperature": 0.7, "domain": "d"}, 0)
    rows = generators.NaiveGenerator(spark, context(), plan).generate().collect()
    assert len(rows) == 3 and rows[0]["lineage"]["num_of_evolutions"] == 1 and "content" in rows[0]["metadata"]
    with pytest.raises(ValueError):
        generators.NaiveGenerator(spark, context(), plan, chat=lambda **k: Says("{}", '["one"]')).generate()
    with pytest.raises(ValueError):
        generators.NaiveGenerator(spark, context(), plan, chat=lambda **k: Says("{}", "[1, 2, 3]")).generate()
    a = generators.NaiveGenerator(spark, context(), plan)
    b = generators.NaiveGenerator(spark, context().at(1, 1, 2), plan)
    assert a.same_ask() == b.same_ask() != generators.NaiveGenerator(spark, context(), Plan(4, "naive_balanced", {}, 0)).same_ask()
    assert a.about()["generator"] == "naive"
    asked = generators.Ask.planned_by({"prompt": "p", "schema": {}})
    assert (asked.role, asked.request) == (generators.ROLE, "p") and generators.Ask.planned_by({"user_prompt": "u", "system_prompt": "s"}).role == "s"
    composed = generators.NaiveGenerator(spark, context(), plan, chat=lambda **k: Says("no JSON", '["a", "b", "c"]'))
    assert not composed.ask.planned and "3 samples" in composed.ask.request and composed.ask.shape["properties"]["samples"]["minItems"] == 3
    with pytest.raises(ValueError):
        generators.generator_for("rag_llm")
    with pytest.raises(ValueError):
        generators.generator_for("nonsense")


def test_providers():
    e = OfflineEntailment()
    p = e.classify("a cat sat", "a cat")
    assert sum(p.values()) == pytest.approx(1) and prediction(e, "a cat sat", "a cat") == "entailment"
    assert as_percent({"x": 0.12345}) == {"x": 12.3}
    assert len(classify_batch(e, ["a"], ["b"])) == 1
    with pytest.raises(ValueError):
        classify_batch(e, ["a"], [])
    with pytest.raises(ValueError):
        embedding_provider("nobody/x")
    v = embedding_provider("offline/x").embed(["same", "same", "else"])
    assert v[0] == v[1] != v[2]
