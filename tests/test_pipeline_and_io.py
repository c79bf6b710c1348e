import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.cli import main
from millrace.loop import Pipeline
from millrace.operators.bandit import Router
from millrace.sources import tables
from millrace.sources.recipes import load_grammar, load_recipe
from millrace.sources.training import write_training_files
from millrace.spec import Recipe
from millrace.streaming.dedup import commit_batches, first_seen, reward_windows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_recipes(tmp_path):
    r = load_recipe(f"{ROOT}/recipes/gear_reviews.yaml")
    assert r.constraints["grammar_path"].endswith("gear_reviews.yaml")
    assert r.constraints["schema"]["_derived_from_grammar"] and r.constraints["schema"]["properties"]["rating"] == {"type": "integer", "enum": [2, 5]}
    with pytest.raises(FileNotFoundError):
        load_recipe(tmp_path / "none.yaml")
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        load_recipe(tmp_path / "list.yaml")
    with pytest.raises(ValueError):
        load_grammar(f"{ROOT}/recipes/direct.yaml")
    (tmp_path / "odd.yaml").write_text("domain: d\ntask_input: t\nnum_samples: 1\nrouter_config: {epsilon_start: 0.3}\ngrammar: {start: x}\n")
    odd = load_recipe(tmp_path / "odd.yaml")  # a grammar without rules leaves the recipe without a schema
    assert "schema" not in odd.constraints and not hasattr(odd, "router_config")


def test_templater_run_through_the_cli(spark, tmp_path, capsys):
    result = main(["--config", f"{ROOT}/recipes/gear_reviews.yaml", "--output", str(tmp_path), "--save-state"], spark)
    lines = [json.loads(x) for x in (tmp_path / "accepted_samples.jsonl").read_text().splitlines()]
    assert len(lines) == 6 == len(result.accepted)
    assert set(lines[0]) == {"id", "content", "lineage", "metadata", "quality_scores"} and lines[0]["lineage"]["generator"] == "templater"
    state = json.loads((tmp_path / "feedback_state.json").read_text())
    assert state["iteration"] == result.state.iteration and state["exploration_rate"] < 0.5
    assert "accepted 6" in capsys.readouterr().out


def test_failing_generation_costs_iterations_and_teaches_nothing(spark):
    def broken(**_):
        raise RuntimeError("no model")

    result = Pipeline(spark, {}, Router(seed=0), broken).run(Recipe("d", "t", 2), max_iterations=3)
    assert result.accepted == [] and result.state.iteration == 0 and result.state.exploration_rate == 0.5


def test_surplus_is_cut_and_reward_is_zero_without_a_judge(spark):
    result = Pipeline(spark, {"deduplication": {"enabled": True}}, Router(5, seed=0)).run(Recipe("d", "t", 3))
    assert len(result.accepted) == 3 and result.rejected == [] and result.state.generated_so_far == 5
    assert result.rewards().first()["reward"] == 0.0
    again = Pipeline(spark, {"deduplication": {"enabled": True}}, Router(5, seed=0)).run(Recipe("d", "t", 3))
    assert [r["content"] for r in again.accepted] == [r["content"] for r in result.accepted]


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_batch_runs(spark, tmp_path, kind):
    rows = [("a, b", "x", 1), ('quote "q"', "y", 2), ("c", "z", 3)]
    path = tmp_path / f"in.{kind}"
    if kind == "csv":
        path.write_text('text,label,n\n"a, b",x,1\n"quote ""q""",y,2\nc,z,3\n')
    else:
        path.write_text("\n".join(json.dumps(dict(zip(("text", "label", "n"), r, strict=True))) for r in rows) + "\n\n")
    recipe = Recipe("text_classification", {"input_file": str(path), "input_column": "text", "output_column": "label"}, 4, output_path=str(tmp_path / "out"))
    result = Pipeline(spark, {}, Router(2, seed=0)).run(recipe)
    assert len(result.accepted) == 4
    assert sorted((r["row_idx"], r["original_input"], r["expected_output"]) for r in result.accepted) == [(0, "a, b", "x"), (0, "a, b", "x"), (1, 'quote "q"', "y"), (2, "c", "z")]
    if kind == "csv":
        out = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
        assert out.columns == ["uuid", "text", "label", "n", "metadata"]
        assert {r["label"] for r in out.collect()} == {"x", "y", "z"} and json.loads(out.first()["metadata"])["lineage"]["generator"] == "naive"
    else:
        out = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
        assert len(out) == 4 and out[0]["metadata"]["expected_output"] in "xyz" and out[0]["uuid"]


def test_readers_refuse(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.detect_format("x.parquet")
    assert tables.detect_format("X.NDJSON") == "jsonl"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n\nnot json\n')
    with pytest.raises(ValueError, match="line 3"):
        tables.read_json_lines(spark, str(bad))
    part = tmp_path / "part.jsonl"
    part.write_text('{"a": 1, "b": 2}\n{"a": 1}\n')
    task = {"input_file": str(part), "input_column": "a", "output_column": "b"}
    with pytest.raises(ValueError, match="'b'"):
        tables.read_batch(spark, Recipe("d", task, 1))
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="'z'"):
        tables.read_batch(spark, Recipe("d", {"input_file": str(tmp_path / "c.csv"), "input_column": "z", "output_column": "b"}, 1))
    with pytest.raises(ValueError):
        tables.with_quotas(spark.createDataFrame([], "row_idx long"), 3)
    assert tables.read_reference(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_quotas(spark):
    rows = spark.range(3).withColumnRenamed("id", "row_idx")
    assert [r["quota"] for r in tables.with_quotas(rows, 10).orderBy("row_idx").collect()] == [4, 3, 3]
    assert [r["quota"] for r in tables.with_quotas(rows, 2).orderBy("row_idx").collect()] == [1, 1]


def test_stream_commits_each_content_once(spark, tmp_path):
    source = tmp_path / "in"
    for k, texts in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(k * 10 + i, t) for i, t in enumerate(texts)], "pos long, content string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("pos long, content string").option("maxFilesPerTrigger", 1).json(str(source))
    q = commit_batches(stream, "content", "pos", str(tmp_path / "log"), str(tmp_path / "sink"), str(tmp_path / "cp"), accept=lambda df: df.where("content <> 'c'"))
    q.awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["a", "b"]


def test_stream_plans(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.0)], "t long, c string, v double").select(F.timestamp_seconds("t").alias("t"), "c", "v").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("t timestamp, c string, v double").parquet(str(tmp_path / "s"))
    for name, plan, mode in (("first_seen", first_seen(stream, "c", "t"), "append"), ("windows", reward_windows(stream, "t", "c", "v"), "complete")):
        q = plan.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == 1


def test_training_files(spark, tmp_path):
    rows = [(f"s{k}", json.dumps({"text": f"t{k}", "label": "ab"[k % 2]}), "object", {}) for k in range(60)] + [("p", "plain", "text", {"label": "a"}), ("q", "none", "text", {}), ("r", '{"label": "a"}', "object", {})]
    about = write_training_files(spark.createDataFrame(rows, "sample_id string, content string, content_kind string, metadata map<string,string>"), str(tmp_path / "out"), evaluated=2500)
    held = {name: [tuple(r) for r in spark.read.schema("text string, label string").json(about[name]["path"]).collect()] for name in about}
    assert sorted(held["train"] + held["evaluate"]) == sorted([(f"t{k}", "ab"[k % 2]) for k in range(60)] + [("plain", "a")])
    assert all(about[n]["rows"] == len(held[n]) > 0 and sum(about[n]["labels"].values()) == len(held[n]) for n in about)
    assert json.loads(spark.read.text(f"{tmp_path}/out/about").first()[0]) == about


def test_ordered_index(spark):
    rows = [(k * 37 % 101,) for k in range(101)] + [(None,), (5,), (5,)]
    got = tables.ordered_index(spark.createDataFrame(rows, "k long").repartition(5), "k").orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(len(rows)))
    assert [r["k"] for r in got] == sorted((r[0] for r in rows), key=lambda v: (v is not None, v or 0))
    assert tables.ordered_index(spark.createDataFrame([], "k long"), "k").count() == 0
