"""Column expressions of the curation engine. All run inside Catalyst; none needs Python on the executors.

Two habits run through them. A score passes a threshold only if it is a number: Spark orders NaN above everything, so ``passes`` tests for it.
Divisions are ``try_divide``: under ANSI rules a zero divisor would stop the query.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# The judge's scale, its default level, and the exploration schedule.
TOP_LEVEL = 5.0
DEFAULT_LEVEL = 3.0
EPSILON_START, EPSILON_FLOOR, EPSILON_DECAY = 0.5, 0.1, 0.98
WEIGHT_FLOOR = 1e-10

# Constraint keys that configure checks and so stay out of prompts, for judging and for generating.
JUDGE_HIDDEN_KEYS = (
    "semantic_similarity_min",
    "semantic_similarity_max",
    "semantic_similarity_threshold",
    "similarity_threshold",
    "diversity_min",
    "diversity_max",
    "diversity_threshold",
    "entailment_threshold",
    "quality_threshold",
    "uniqueness_threshold",
    "min_length",
    "max_length",
    "min_tokens",
    "max_tokens",
    "embedding_model",
    "maintain_label_distribution",
    "label_distribution",
    "min_diversity",
    "max_repetition_rate",
    "grammar_path",
)
PROMPT_HIDDEN_KEYS = (
    "semantic_similarity",
    "semantic_similarity_min",
    "semantic_similarity_max",
    "similarity_threshold",
    "min_length",
    "max_length",
    "min_tokens",
    "max_tokens",
    "embedding_model",
    "quality_threshold",
    "uniqueness_threshold",
    "maintain_label_distribution",
    "label_distribution",
    "min_diversity",
    "max_repetition_rate",
    "grammar_path",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def passes(score: Column | str, threshold: float) -> Column:
    """score >= threshold, false for NaN and for null."""
    s = col(score).cast("double")
    return F.coalesce(~F.isnan(s) & (s >= F.lit(float(threshold))), F.lit(False))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def canonical_json(text: Column | str) -> Column:
    """A JSON object with its keys sorted at every level, as one text for all of its spellings; other texts as they are. A variant holds an object's fields by name."""
    c = col(text)
    v = F.when(F.ltrim(c).startswith("{"), F.try_parse_json(c))
    return F.coalesce(F.to_json(v), c)


def content_hash(content: Column | str, kind: Column | str | None = None) -> Column:
    """SHA-256 of a text; of values of kind ``object`` in their canonical form, so that key order doesn't matter."""
    c = col(content)
    return F.sha2(c if kind is None else F.when(col(kind) == "object", canonical_json(c)).otherwise(c), 256)


def dedup_value(content: Column | str, metadata: Column | str, field: str) -> Column:
    """metadata[field], or the content where that key is missing. The field ``content`` is the whole content, whatever the metadata hold."""
    if field == "content":
        return col(content)
    return F.when(F.map_contains_key(col(metadata), F.lit(field)), F.coalesce(col(metadata)[field], F.lit(""))).otherwise(col(content))


def as_double(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """dot / (|a| |b|); NaN for a zero vector, null for a null one."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(float("nan"))))


def unit(a: Column | str) -> Column:
    size = norm(a)
    return F.transform(as_double(a), lambda x: F.try_divide(x, size))


def level_score(level: Column | str) -> Column:
    """A judged level on 0..1, clamped; null for null, which least and greatest alone would pass over."""
    score = col(level).cast("double") / TOP_LEVEL
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def judge_aggregate(response: Column | str) -> Column:
    """The judge's own batch level over the top of its scale: taken from the response, not clamped, level 3 where it is missing."""
    v = F.try_parse_json(col(response))
    return F.coalesce(F.try_variant_get(v, "$.aggregate_quality_level", "double"), F.lit(DEFAULT_LEVEL)) / TOP_LEVEL


def entailment_score(forward: Column | str, backward: Column | str) -> Column:
    f, b = col(forward), col(backward)
    return F.when(f.isNotNull() & b.isNotNull(), F.least(f, b))


def epsilon(adaptations: Column | str, start: float = EPSILON_START, decay: float = EPSILON_DECAY, floor: float = EPSILON_FLOOR) -> Column:
    """Exploration rate after so many adaptations, in closed form."""
    return F.greatest(F.lit(floor), F.lit(start) * F.pow(F.lit(decay), col(adaptations)))


def tempered(weight: Column | str, temperature: float, rule: Column | str) -> Column:
    """Probabilities of a rule's options: weights to the power 1 / temperature, normalised; stable for small temperatures."""
    over = Window.partitionBy(col(rule))
    w = col(weight).cast("double")
    if temperature == 1.0:
        return w / F.sum(w).over(over)
    scaled = F.log(w + F.lit(WEIGHT_FLOOR)) / F.lit(float(temperature))
    power = F.exp(scaled - F.max(scaled).over(over))
    return power / F.sum(power).over(over)


def complexity(n_constraints: Column | str, has_knowledge_base: Column | str) -> Column:
    n = col(n_constraints)
    return F.when(n == 0, "simple").when((n > 3) | col(has_knowledge_base), "complex").otherwise("medium")


def without_fences(text: Column | str) -> Column:
    """A model's answer without the code fence around it."""
    s = strip(text)
    inner = F.regexp_replace(F.regexp_replace(s, r"^```(?:json|JSON)?", ""), r"```$", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def coerce_json(text: Column | str) -> Column:
    """The JSON value in a model's answer, or else the widest braces in it; null if neither parses."""
    s = without_fences(text)
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(F.regexp_extract(s, r"(?s)\{.*\}", 0)))


def answer_lines(text: Column | str) -> Column:
    """An answer that isn't JSON: its lines that aren't blank, stripped; numbering stays."""
    lines = F.split(without_fences(text), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def parsed_answer(text: Column | str) -> Column:
    """Items of an answer as strings: a JSON list, the list under ``samples``, one JSON value, or else its lines."""
    s = without_fences(text)
    v = F.try_parse_json(s)
    as_list = F.coalesce(F.try_variant_get(v, "$.samples", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.when(v.isNull(), answer_lines(text)).otherwise(F.transform(as_list, lambda x: F.to_json(x)))


def placeholders(template: Column | str) -> Column:
    """Rule names in angle brackets; word characters of any script."""
    return F.regexp_extract_all(col(template), F.lit(r"(?U)<(\w+)>"), F.lit(1))


def hidden_removed(constraints: Column | str, keys: tuple[str, ...] = JUDGE_HIDDEN_KEYS) -> Column:
    return F.map_filter(col(constraints), lambda k, v: ~k.isin(*keys))


def row_quota(row_idx: Column | str, n_rows: Column | int, total: int) -> Column:
    """How many of ``total`` samples row ``row_idx`` gets: equal shares, one more for the first rows."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    share = F.floor(F.lit(total) / n)
    return (share + F.when(col(row_idx) < F.lit(total) - share * n, 1).otherwise(0)).cast("long")
