"""The registered queries of the curation engine and their SQL equivalents.

Each query applies one operator of the package to whole tables. Doubles are rounded to six decimals on both sides, since sums of doubles depend
on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import jsonschema
from millrace.operators import bandit, dedup, diversity, metrics, validators
from millrace.operators.orchestrate import Orchestrator
from millrace.plans import grammar as G
from millrace.sources.tables import metadata_record, ordered_index
from millrace.spec import Recipe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(C.col(c), 6)


# Deduplication


@query("SELECT doc_id, source, sha256(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_exact(spark, sf):
    return dedup.first_of_each(read(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id", "source", "content_hash")


@query(
    "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS dedup_score, "
    "row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS dedup_passed FROM documents"
)
def dedup_flags(spark, sf):
    return dedup.flag_repeats(read(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id", "dedup_score", "dedup_passed")


@query("SELECT doc_id, row_number() OVER (PARTITION BY coalesce(lang || ',' || source, text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def dedup_by_field(spark, sf):
    d = read(spark, sf, "documents").withColumn("metadata", F.create_map(F.lit("field"), F.concat("lang", F.lit(","), "source")))
    return dedup.flag_repeats(d, C.dedup_value("text", "metadata", "field"), "doc_id").select("doc_id", "duplicate")


@query(
    "SELECT d.doc_id FROM documents d WHERE d.text NOT IN (SELECT text FROM benchmark) AND NOT EXISTS "
    "(SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND d.doc_id % 2 = 1 AND o.text = d.text)"
)
def dedup_reference_anti(spark, sf):
    """Against the benchmark, and the odd half of the documents against the even half."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    left = dedup.against_reference(d, read(spark, sf, "benchmark"), "text")
    even, odd = left.where("doc_id % 2 = 0"), left.where("doc_id % 2 = 1")
    return even.select("doc_id").unionByName(dedup.against_reference(odd, d.where("doc_id % 2 = 0"), "text").select("doc_id"))


@query("SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def benchmark_overlap(spark, sf):
    """How many documents contain each item; the rows of one item_id are summed."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    found = dedup.containing(read(spark, sf, "documents"), "doc_id", "text", b, "item")
    return b.join(found, "item", "left").groupBy("item_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))


@query(
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY d.source, d.text ORDER BY d.doc_id) > 1 AS dup FROM documents d LEFT JOIN labels l USING (doc_id)) "
    "SELECT DISTINCT sha256(text) AS content_hash FROM f WHERE NOT dup AND coalesce(toxic = 0, false)"
)
def dedup_commit(spark, sf):
    """The hashes that a batch (a source) commits: of samples that are new and accepted; a rejected first sample commits nothing."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    flagged = dedup.flag_repeats(d, F.col("text"), "doc_id", "source")
    return dedup.commit(flagged.where(F.col("dedup_passed") & F.coalesce(F.col("toxic") == 0, F.lit(False))))


@query(
    "SELECT event_id, row_number() OVER (PARTITION BY json_extract_string(props, '$.k'), event_type, user_id % 20 ORDER BY event_id) = 1 AS passed FROM events"
)
def dedup_objects(spark, sf):
    """The deduplication validator on objects whose keys come in two orders; a ``content`` field in the metadata says nothing."""
    k = F.get_json_object("props", "$.k")
    e = read(spark, sf, "events").withColumn("m", F.to_json(F.struct(F.col("event_type").alias("type"), (F.col("user_id") % 20).alias("user"))))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "more": '), "m", F.lit("}"))).otherwise(F.concat(F.lit('{"more": '), "m", F.lit(',"k":'), k, F.lit("}")))
    samples = e.select(F.col("event_id").alias("pos"), text.alias("content"), F.lit("object").alias("content_kind"), F.create_map(F.lit("content"), F.lit("same")).alias("metadata"))
    scored = validators.Deduplication("deduplication", {}).score(samples, None)
    return scored.select(F.col("pos").alias("event_id"), F.col("deduplication_passed").alias("passed"))


# JSON Schema

PROPS_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 50}}}


@query(
    "SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AS passed, "
    "CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events"
)
def json_schema_props(spark, sf):
    ok, _ = jsonschema.validate(F.col("props"), PROPS_SCHEMA)
    return read(spark, sf, "events").select("event_id", ok.alias("passed")).withColumn("score", F.when(F.col("passed"), 1.0).otherwise(0.0))


@query(
    "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) > 80 AS large, json_exists(props, '$.missing') AS present FROM events) "
    "SELECT event_id, CASE WHEN NOT present THEN 'root' WHEN large THEN 'k' END AS error_path, CASE WHEN NOT present THEN 'required' WHEN large THEN 'maximum' END AS keyword FROM e"
)
def json_required_fields(spark, sf):
    schema = {"type": "object", "required": ["k", "missing"], "properties": {"k": {"type": "integer", "maximum": 80}}}
    _, error = jsonschema.validate(F.col("props"), schema)
    return read(spark, sf, "events").select("event_id", error.alias("e")).select("event_id", F.col("e.path").alias("error_path"), F.col("e.keyword").alias("keyword"))


@query(
    "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events) SELECT event_id, "
    "(k % 2 = 0 OR k > 90) AND NOT (k % 3 = 0) AND (event_type <> 'click' OR k >= 10) AS passed FROM e"
)
def json_schema_composed(spark, sf):
    """Composed schemas: anyOf, not, if/then, references and patternProperties."""
    schema = {
        "$defs": {"even": {"multipleOf": 2}},
        "patternProperties": {"^k$": {"anyOf": [{"$ref": "#/$defs/even"}, {"exclusiveMinimum": 90}], "not": {"multipleOf": 3}}},
        "if": {"properties": {"type": {"const": "click"}}},
        "then": {"properties": {"k": {"minimum": 10}}},
    }
    content = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "type": "'), "event_type", F.lit('"}'))
    ok, _ = jsonschema.validate(content, schema)
    return read(spark, sf, "events").select("event_id", ok.alias("passed"))


# Similarity, diversity, entailment


def _anchored(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "label", C.as_double("embedding").alias("v"))
    anchor = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("anchor"))
    return v.join(anchor, "label").select("vec_id", "label", C.cosine("v", "anchor").alias("score"))


_COS = (
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT label, arg_min(v, vec_id) AS anchor FROM v GROUP BY label), "
    "s AS (SELECT vec_id, v.label, list_cosine_similarity(v.v, a.anchor) AS score FROM v JOIN a ON v.label = a.label) "
)


@query(_COS + "SELECT vec_id, label, round(score, 6) AS similarity FROM s")
def cosine_to_anchor(spark, sf):
    return _anchored(spark, sf).select("vec_id", "label", r6("score").alias("similarity"))


@query(_COS + "SELECT label, count(*) AS n_passed FROM s WHERE score >= 0.3 GROUP BY label")
def similarity_filter(spark, sf):
    return _anchored(spark, sf).where(C.passes("score", 0.3)).groupBy("label").agg(F.count("*").alias("n_passed"))


_DIVERSITY = (
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) "
    "SELECT label, round(coalesce(1 - m, 1.0), 6) AS diversity FROM (SELECT label FROM v GROUP BY label) LEFT JOIN "
    "(SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS m FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label) USING (label)"
)


@query(_DIVERSITY)
def pairwise_diversity(spark, sf):
    """Over all pairs of a batch with different ids, without listing them; ``diversity_closed_form`` takes all its rows for different."""
    return diversity.pairwise(read(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("label", r6("diversity").alias("diversity"))


@query(_DIVERSITY)
def diversity_closed_form(spark, sf):
    return diversity.closed_form(read(spark, sf, "embeddings"), "label", "embedding").select("label", r6("diversity").alias("diversity"))


@query(
    "WITH p AS (SELECT doc_id, (n_chars % 101) / 100.0::DOUBLE AS f, (n_chars % 97) / 96.0::DOUBLE AS b FROM documents) "
    "SELECT doc_id, round(least(f, b), 6) AS score, f >= 0.5 AND b >= 0.5 AS passed FROM p"
)
def entailment_bidirectional(spark, sf):
    """Both directions and their minimum, on stand-in probabilities taken from the length."""
    p = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 101 / F.lit(100.0)).alias("f"), (F.col("n_chars") % 97 / F.lit(96.0)).alias("b"))
    return p.select("doc_id", r6(C.entailment_score("f", "b")).alias("score"), (C.passes("f", 0.5) & C.passes("b", 0.5)).alias("passed"))


# Judging


@query("SELECT doc_id, greatest(0.0, least(1.0, (quality * 4 + 1 + toxic * 3) / 5.0::DOUBLE)) AS score FROM labels")
def judge_scale(spark, sf):
    return read(spark, sf, "labels").select("doc_id", C.level_score(F.col("quality") * 4 + 1 + F.col("toxic") * 3).alias("score"))


@query(
    "WITH d AS (SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)), b AS (SELECT source, avg(quality * 4 + 1) / 5 AS aggregate FROM d GROUP BY source) "
    "SELECT doc_id, round(aggregate, 6) AS aggregate, round((quality * 4 + 1) / 5.0::DOUBLE, 6) AS sample_score, aggregate >= 0.875 AS passed FROM d JOIN b USING (source)"
)
def judge_batch_gate(spark, sf):
    """The batch's aggregate decides for all its samples; their own levels only score them."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("doc_id", "source", (F.col("quality") * 4 + 1).alias("level"))
    b = d.groupBy("source").agg((F.avg("level") / C.TOP_LEVEL).alias("aggregate"))
    return d.join(b, "source").select("doc_id", r6("aggregate").alias("aggregate"), r6(C.level_score("level")).alias("sample_score"), C.passes("aggregate", 0.875).alias("passed"))


@query(
    "WITH f AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source, d.text ORDER BY d.doc_id) = 1 AS is_new, l.toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), "
    "s AS (SELECT *, is_new AND coalesce(toxic = 0, false) AS sample_ok FROM f), b AS (SELECT source, avg(quality) >= 0.85 AS batch_ok FROM s WHERE sample_ok GROUP BY source) "
    "SELECT doc_id, sample_ok, sample_ok AND coalesce(batch_ok, true) AS accepted FROM s LEFT JOIN b USING (source)"
)
def two_phase_filter(spark, sf):
    """Sample validators on everything; the batch validator on what passed them; a batch without a verdict passes."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    s = dedup.flag_repeats(d, F.col("text"), "doc_id", "source")
    s = s.select("doc_id", "source", "quality", (F.col("dedup_passed") & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("sample_ok"))
    b = s.where("sample_ok").groupBy("source").agg(C.passes(F.avg("quality"), 0.85).alias("batch_ok"))
    return s.join(b, "source", "left").select("doc_id", "sample_ok", (F.col("sample_ok") & F.coalesce("batch_ok", F.lit(True))).alias("accepted"))


@query(
    "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, user_id % 20 AS u FROM events), "
    "f AS (SELECT event_id, k, row_number() OVER (PARTITION BY k, event_type, u ORDER BY event_id) = 1 AS is_new FROM e) "
    "SELECT event_id, is_new AND k >= 50 AS accepted, CASE WHEN is_new THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS deduplication, CASE WHEN k >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS json_schema FROM f"
)
def orchestrated_batch(spark, sf):
    """The orchestrator with two sample validators on one batch of objects: verdicts and scores."""
    content = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", (F.col("user_id") % 20).alias("u")))
    samples = read(spark, sf, "events").select(F.col("event_id").alias("pos"), content.alias("content"), F.lit("object").alias("content_kind"), F.create_map().cast("map<string,string>").alias("metadata"))
    recipe = Recipe("events", "Collect events.", 1, {"schema": PROPS_SCHEMA})
    out, _ = Orchestrator(spark, {"deduplication": {"enabled": True}, "json_schema": {"enabled": True}}).assess(samples, recipe)
    return out.select(F.col("pos").alias("event_id"), "accepted", *[F.col("quality_scores")[n].alias(n) for n in ("deduplication", "json_schema")])


@query(
    "SELECT doc_id, round(CASE doc_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.6 ELSE (quality * 4 + 1 + toxic * 3) / 5.0 END::DOUBLE, 6) AS aggregate FROM labels"
)
def judge_answers(spark, sf):
    """Batch levels read from a judge's answers: unreadable, without a level, in a code fence, and in chatter; not clamped."""
    level = (F.col("quality") * 4 + 1 + F.col("toxic") * 3).cast("string")
    made = F.concat(F.lit('{"reasoning": "so", "aggregate_quality_level": '), level, F.lit(', "samples": []}'))
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, "nothing").when(k == 1, '{"samples": []}').when(k == 2, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), made, F.lit(" ok?")))
    return read(spark, sf, "labels").select("doc_id", r6(C.judge_aggregate(F.to_json(C.coerce_json(answer)))).alias("aggregate"))


# Metrics and rewards

_METRICS = (
    "WITH f AS (SELECT d.source, row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) = 1 AS is_new, l.toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), "
    "s AS (SELECT source, quality, is_new AND coalesce(toxic = 0, false) AS ok FROM f), m AS (SELECT source, count(*) FILTER (ok) / count(*)::DOUBLE AS pass_rate, "
    "avg(quality) FILTER (ok) AS mean_quality, count(*) FILTER (ok) AS num_samples FROM s GROUP BY source) "
)


def _metrics(spark, sf):
    d = dedup.flag_repeats(read(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id", "source", "dedup_passed")
    s = d.join(read(spark, sf, "labels"), "doc_id", "left").withColumn("accepted", F.col("dedup_passed") & F.coalesce(F.col("toxic") == 0, F.lit(False)))
    return metrics.batch_metrics(s, "source")


@query(_METRICS + "SELECT source, round(pass_rate, 6) AS pass_rate, round(mean_quality, 6) AS mean_quality, num_samples FROM m")
def batch_metrics(spark, sf):
    return _metrics(spark, sf).select("source", r6("pass_rate").alias("pass_rate"), r6("mean_quality").alias("mean_quality"), "num_samples")


@query(_METRICS + "SELECT source, round(pass_rate, 6) AS pass_rate, round(mean_quality, 6) AS mean_quality, round(pass_rate * coalesce(mean_quality, 0), 6) AS reward FROM m")
def composite_reward(spark, sf):
    """Duplicates dropped, labelled non-toxic kept (no label: rejected): pass rate, mean quality and reward per source."""
    return _metrics(spark, sf).select("source", *[r6(c).alias(c) for c in ("pass_rate", "mean_quality", "reward")])


@query("SELECT event_type AS arm, round(avg(value), 6) AS mean_reward, round(stddev_pop(value), 6) AS std_reward, count(*) AS count FROM events GROUP BY event_type")
def arm_statistics(spark, sf):
    s = metrics.arm_statistics(read(spark, sf, "events"), "event_type", "value")
    return s.select("arm", r6("mean_reward").alias("mean_reward"), r6("std_reward").alias("std_reward"), "count")


@query(
    "WITH a AS (SELECT event_type AS arm, round(avg(value), 1) AS mean_reward FROM events GROUP BY event_type), o AS (SELECT arm, row_number() OVER (ORDER BY arm DESC) - 1 AS k FROM a) "
    "SELECT arm, mean_reward FROM a JOIN o USING (arm) ORDER BY mean_reward DESC, k LIMIT 1"
)
def best_arm(spark, sf):
    """The largest mean, of equal ones the first in the arms' own order (here: names descending)."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("arm"), "value")
    names = sorted((r["arm"] for r in e.select("arm").distinct().collect()), reverse=True)  # one row per arm
    s = e.groupBy("arm").agg(F.round(F.avg("value"), 1).alias("mean_reward"))
    return metrics.best_arm(s, {n: k for k, n in enumerate(names)}).select("arm", "mean_reward")


@query(
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM events"
)
def arm_running_mean(spark, sf):
    """What each arm had earned on average before a reward; one run per user."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, sf, "events").select("event_id", r6(F.avg("value").over(w)).alias("mean_before"))


@query("SELECT event_type AS arm, count(*) AS count FROM events GROUP BY event_type")
def arm_counts(spark, sf):
    return metrics.arm_counts(read(spark, sf, "events"), "event_type")


@query("SELECT CAST(range AS BIGINT) AS n, round(greatest(0.1, 0.5 * pow(0.98, range)), 9) AS epsilon FROM range(101)")
def epsilon_schedule(spark, sf):
    return spark.range(101).select(F.col("id").alias("n"), F.round(C.epsilon(F.col("id").cast("double")), 9).alias("epsilon"))


# Choice


def _weights(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("weight"))


_PROBABILITY = (
    "WITH w AS (SELECT p_brand, p_type, count(*) AS weight FROM part GROUP BY ALL), l AS (SELECT *, ln(weight + 1e-10) / 0.7 AS s FROM w), "
    "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY p_brand)) AS x FROM l), p AS (SELECT *, x / sum(x) OVER (PARTITION BY p_brand) AS probability FROM e) "
)


@query(_PROBABILITY + "SELECT p_brand, p_type, round(probability, 6) AS probability FROM p")
def temperature_softmax(spark, sf):
    return _weights(spark, sf).select("p_brand", "p_type", r6(C.tempered("weight", 0.7, "p_brand")).alias("probability"))


@query(
    _PROBABILITY + ", c AS (SELECT p_brand, p_type, sum(probability) OVER (PARTITION BY p_brand ORDER BY p_type) AS hi, "
    "coalesce(sum(probability) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM p), "
    "d AS (SELECT p_partkey, p_brand, (p_partkey * 7919 % 10007 + 0.5) / 10007.0::DOUBLE AS u FROM part) "
    "SELECT p_partkey, c.p_type AS chosen FROM d JOIN c ON d.p_brand = c.p_brand AND u >= lo AND u < hi"
)
def weighted_choice_cdf(spark, sf):
    """One weighted option of its rule for every row, by the inverse of the cumulated probabilities."""
    p = _weights(spark, sf).select("p_brand", F.col("p_type").alias("chosen"), C.tempered("weight", 0.7, "p_brand").alias("p"))
    w = Window.partitionBy("p_brand").orderBy("chosen")
    c = p.withColumn("hi", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("lo", F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    u = read(spark, sf, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 10007 + 0.5).cast("double") / F.lit(10007.0)).alias("u"))
    return u.join(c, "p_brand").where("u >= lo AND u < hi").select("p_partkey", "chosen")


# Input rows


@query(
    "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), "
    "q AS (SELECT c_custkey, 1000 // n + CASE WHEN i < 1000 % n THEN 1 ELSE 0 END AS quota FROM r) SELECT c_custkey, CAST(quota AS BIGINT) AS quota FROM q WHERE quota > 0"
)
def row_quota(spark, sf):
    c = read(spark, sf, "customer")
    n = c.count()
    return ordered_index(c.select("c_custkey"), "c_custkey").withColumn("quota", C.row_quota("row_idx", n, 1000)).where("quota > 0").select("c_custkey", "quota")


@query(
    "SELECT o_orderkey, c_name, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"
)
def row_spec_join(spark, sf):
    """Samples (orders) joined back to their input rows (customers)."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return o.join(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_name", "c_mktsegment", "o_orderstatus")


@query("SELECT doc_id FROM documents ORDER BY md5('run|' || doc_id), doc_id LIMIT 25")
def surplus_topk(spark, sf):
    """The samples kept of a surplus: the first by a hash, the same on every run."""
    return read(spark, sf, "documents").orderBy(F.md5(F.concat(F.lit("run|"), F.col("doc_id").cast("string"))), "doc_id").limit(25).select("doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 0 AND quality = 1, false)")
def rejected_complement(spark, sf):
    """What is rejected is what isn't accepted, by one flag; missing labels are rejected."""
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.where(~F.coalesce((F.col("toxic") == 0) & (F.col("quality") == 1), F.lit(False))).select("doc_id")


# Parsing


@query(
    "SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n_items, sha256(string_agg(x, chr(10) ORDER BY i)) AS items_sha256 FROM (SELECT conv_id, turn, i, regexp_replace(p[i], '^\\s+|\\s+$', '', 'g') AS x "
    "FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations), range(1, len(p) + 1) t(i)) WHERE x <> '' GROUP BY conv_id, turn"
)
def parse_llm_output(spark, sf):
    """Answers that aren't JSON: their stripped, non-blank lines."""
    items = C.answer_lines("text")
    return read(spark, sf, "conversations").where(F.size(items) > 0).select("conv_id", "turn", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, "\n"), 256).alias("items_sha256"))


@query(
    "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS n_items, CASE turn % 3 WHEN 0 THEN '\"' || role || '\"' WHEN 1 THEN '{\"turn\":' || turn || '}' ELSE '1' END AS first_item FROM conversations"
)
def parsed_answers(spark, sf):
    """Answers that are JSON: a list, one object in a fence, and the list under ``samples``."""
    turn, k = F.col("turn").cast("string"), F.col("turn") % 3
    answer = F.when(k == 0, F.concat(F.lit('["'), "role", F.lit('", 2]'))).when(k == 1, F.concat(F.lit('```json\n{"turn": '), turn, F.lit("}\n```"))).otherwise('{"samples": [1, {"a": 2}, "x"]}')
    c = read(spark, sf, "conversations").select("conv_id", "turn", C.parsed_answer(answer).alias("items"))
    return c.select("conv_id", "turn", F.size("items").alias("n_items"), F.get("items", F.lit(0)).alias("first_item"))


@query("SELECT event_id, CAST(CASE WHEN event_type IN ('min_length', 'grammar_path') THEN 0 ELSE 1 END + 1 AS BIGINT) AS n_kept FROM events")
def constraint_filter(spark, sf):
    """Constraints without the keys that only configure checks."""
    m = F.create_map(F.lit("grammar_path"), F.lit("x"), F.lit("max_tokens"), F.lit("9"), F.lit("tone"), F.col("props"), F.concat(F.lit("c_"), F.col("event_type")), F.col("props"))
    return read(spark, sf, "events").select("event_id", F.size(C.hidden_removed(m)).cast("long").alias("n_kept"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([\\p{L}\\p{N}_]+)>', 1)) AS tag FROM pages) GROUP BY tag")
def grammar_placeholders(spark, sf):
    return read(spark, sf, "pages").select(F.explode(C.placeholders("html")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "WITH o AS (SELECT p_brand AS rule, p_partkey AS option_idx, CASE WHEN p_size % 7 <> 0 THEN p_name END AS template, CASE WHEN p_size % 5 = 0 THEN p_type END AS llm_fill, "
    "CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 0.0 ELSE p_retailprice END AS weight FROM part) "
    "SELECT rule, option_idx, 'body' AS violation FROM o WHERE (template IS NULL) = (llm_fill IS NULL) UNION ALL SELECT rule, option_idx, 'weight_missing' FROM o WHERE weight IS NULL "
    "UNION ALL SELECT rule, option_idx, 'weight_not_positive' FROM o WHERE weight <= 0 UNION ALL SELECT 'start', -1, 'no_start_rule' WHERE NOT EXISTS (SELECT 1 FROM o WHERE rule = 'start')"
)
def grammar_violations(spark, sf):
    size = F.col("p_size")
    o = read(spark, sf, "part").select(
        F.col("p_brand").alias("rule"),
        F.col("p_partkey").alias("option_idx"),
        F.when(size % 7 != 0, F.col("p_name")).alias("template"),
        F.when(size % 5 == 0, F.col("p_type")).alias("llm_fill"),
        F.when(size % 11 == 0, None).when(size % 13 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("weight"),
    )
    return G.relation_violations(o, "start").withColumn("option_idx", F.col("option_idx").cast("long"))


@query("SELECT unnest(['a', 'b']) AS field")
def schema_merge_required(spark, sf):
    """Required fields of merged templates: those that all of them have."""
    templates = ['{"a": "<x>", "b": "<y>", "c": 1}', '{"b": "<y>", "a": "<z>"}', '{"d": true, "a": "k", "b": "<y>"}']
    schema = G.merged([G.value_schema(G.template_object(t)) for t in templates])
    return spark.createDataFrame([(f,) for f in schema["required"]], "field string")


@query(
    "SELECT doc_id, '{' || coalesce('\"original_input\":\"' || source || '\",', '') || coalesce('\"expected_output\":\"' || lang || '\",', '') || '\"lineage\":{\"generator\":\"naive\",\"generator_parameters\":\"{}\",\"num_of_evolutions\":1},"
    "\"quality_scores\":{' || coalesce('\"llm_judge\":' || quality || '.0', '') || '},\"timestamp\":\"2000-01-01T00:00:00\"}' AS record FROM documents LEFT JOIN labels USING (doc_id)"
)
def export_rows(spark, sf):
    """Documents as exported records: JSON text with lineage and scores."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    lineage = F.struct(F.lit("naive").alias("generator"), F.lit("{}").alias("generator_parameters"), F.lit(None).cast("string").alias("original_sample"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("num_of_evolutions"))
    s = d.select(
        "doc_id",
        F.col("source").alias("original_input"),
        F.col("lang").alias("expected_output"),
        lineage.alias("lineage"),
        F.map_filter(F.create_map(F.lit("llm_judge"), F.col("quality").cast("double")), lambda k, v: v.isNotNull()).alias("quality_scores"),
        F.create_map(F.lit("timestamp"), F.lit("2000-01-01T00:00:00")).alias("metadata"),
    )
    return metadata_record(s).select("doc_id", F.to_json("record").alias("record"))


@query("SELECT unnest(['text', 'label', 'rating']) AS field, unnest([true, true, true]) AS required, unnest(['string', 'string', 'integer']) AS type, unnest([0, 2, 3]) AS n_values")
def derived_schema(spark, sf):
    """The schema that a grammar's templates imply: fields, types and the values that rules of plain texts can take."""
    schema = G.derive_schema(G.Grammar(SAMPLE_GRAMMAR))
    rows = [(k, k in schema["required"], v["type"], len(v.get("enum", []))) for k, v in schema["properties"].items()]
    return spark.createDataFrame(rows, "field string, required boolean, type string, n_values int")


# Without SQL


SAMPLE_GRAMMAR = {
    "start": "review",
    "rules": {
        "review": [{"template": '{"text": "<body>", "label": "<label>", "rating": <rating>}', "weight": 1.0}],
        "body": [{"template": "good <item>", "weight": 0.5}, {"template": "poor <item>", "weight": 0.3}, {"llm_fill": "a sentence", "weight": 0.2}],
        "item": [{"template": "fins", "weight": 0.7}, {"template": "mask and <item>", "weight": 0.3}],
        "label": [{"template": "positive", "weight": 0.6}, {"template": "negative", "weight": 0.4}],
        "rating": [{"template": "5", "weight": 0.3}, {"template": "3", "weight": 0.3}, {"template": "1", "weight": 0.4}],
    },
}


@query()
def grammar_sample(spark, sf):
    """2000 seeded expansions, made where the rows are."""
    return G.sample_many(spark, SAMPLE_GRAMMAR, 2000, lambda prompt: "filled", 0.9, 10, 5)


@query()
def bandit_loop(spark, sf):
    """The adaptive loop on the offline provider: its log of rewards."""
    from millrace.loop import Pipeline

    recipe = Recipe("text_generation", "Describe a plant.", 12, {}, {"deduplication": {"enabled": True}, "llm_judge": {"enabled": True, "threshold": 0.4}})
    return Pipeline(spark, recipe.validators, bandit.Router(5, seed=3)).run(recipe, max_iterations=6).rewards()
