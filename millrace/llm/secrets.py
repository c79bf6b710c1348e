"""Secret scan with corpus-wide ownership frequency. Native: DataFrame functions only, no Python on the executors.

Candidates come from three fixed patterns (``BASE``) and from long mixed tokens that no base span overlaps (``token``). Every candidate's
value is hashed; hashes are then aggregated over the whole corpus by distinct repositories and owners. A value that many owners hold is a
copied example; one that stays with a few owners looks live, however many repositories (documents) they hold it in: copies within an owner say
nothing about who else has it. Base spans are always reported; a ``token`` span is
added only where its value is owner-specific.

Defined cases: null and empty texts have no spans; a null owner counts as one owner of its own; repeated rows are reported once each and
count as one repository; matches of one kind never overlap, those of several kinds may and are all reported, in order of start and then of
kind; texts are read whole, and the cost of a text grows with its length and its matches, not with their square; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, only, table, unwrapped, whole_rows

QUERY = "op9_secret_ownership"


def either_case(letters: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in letters)


# The base patterns and the least lengths of what they must hold.
NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = f"""({NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{28,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "token")
#: Elements that are added up at once where sums run along an array, and code points of a text that are sought through at once.
RUN, STRETCH = 64, 1024

SALTS = 64
#: Marked rows that are broadcast at most (about 150 bytes each); more are joined by shuffling.
MOST_BROADCAST = 200_000
MAX_OWNERS = 2


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def before(values: Column, add, zero: Column, depth: int = 2) -> Column:
    """For each element of a non-empty array what ``add`` (associative) makes of all elements before it.

    Runs of RUN elements are added up first, and runs of runs, so the cost grows with the elements, not with their square.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, add)

    def by_run(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda r: total(F.slice(v, r * RUN + 1, F.lit(RUN))))
        run = lambda i: F.floor(i / RUN).cast("int")
        return let(before(sums, add, zero, depth - 1), lambda s: F.transform(v, lambda x, i: add(F.get(s, run(i)), total(F.slice(v, run(i) * RUN + 1, i % RUN)))))

    return let(values, by_run if depth else lambda v: F.transform(v, lambda x, i: total(F.slice(v, F.lit(1), i))))


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def found(text: Column, pattern: str, value_group: int, kind: int) -> Column:
    """The leftmost matches that don't overlap, as structs of start, kind, end (code points, end exclusive) and value.

    The pieces between matches and the matches alternate, so adding up their lengths gives each match's place.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))

    def placed(hits: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("p"), hits.alias("w"), values.alias("v"))
        steps = F.transform(zipped, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["w"]).alias("width"), x["v"].alias("v")))

        def laid(steps: Column) -> Column:
            starts = before(F.transform(steps, lambda x: x["gap"] + x["width"]), plus, F.lit(0))
            at = F.arrays_zip(steps.alias("x"), starts.alias("s"))
            start = lambda y: y["s"] + y["x"]["gap"]
            return F.transform(at, lambda y: F.struct(start(y).alias("start"), F.lit(kind).alias("kind"), (start(y) + y["x"]["width"]).alias("end"), y["x"]["v"].alias("value")))

        return let(steps, laid)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return let(whole, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps: of all spans in order, no base span before a token ends behind its start, none after it starts before its end."""
    token = len(KINDS) - 1
    far = F.lit(1 << 30)

    def kept(spans: Column) -> Column:
        ends = before(F.transform(spans, lambda x: F.when(x["kind"] < token, x["end"]).otherwise(0)), larger, F.lit(0))
        starts = F.reverse(before(F.transform(F.reverse(spans), lambda x: F.when(x["kind"] < token, x["start"]).otherwise(far)), smaller, far))
        seen = F.arrays_zip(spans.alias("x"), ends.alias("e"), starts.alias("s"))
        free = F.filter(seen, lambda y: (y["x"]["kind"] == token) & (y["e"] <= y["x"]["start"]) & (y["s"] >= y["x"]["end"]))
        return F.transform(free, lambda y: y["x"])

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(base, tokens)), kept)).otherwise(tokens)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Each row's candidates: rid, id, owner, base and extra (arrays of spans with values)."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{owner_col}`").alias("owner"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    t = F.col("t")
    d = d.select(
        "id",
        "owner",
        F.filter(found(t, ASSIGN, 2, 0), lambda x: F.length(x["value"]) >= LEAST_ASSIGNED).alias("assign"),
        found(t, ACCESS, 0, 1).alias("access"),
        found(t, "(?<![0-9a-f])" + HEX, 0, 2).alias("hex"),
        F.filter(
            found(t, "(?<![A-Za-z0-9+/_=-])" + TOKEN, 0, 3),
            lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"),
        ).alias("token"),
    )
    d = d.withColumn("base", F.concat("assign", "access", "hex"))
    return d.select(F.monotonically_increasing_id().alias("rid"), "id", "owner", F.size("assign").alias("a"), F.size("access").alias("c"), F.size("hex").alias("h"), "base", apart(F.col("token"), F.col("base")).alias("extra"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners over distinct (hash, owner, id): each step sums before it shuffles, so a hot value stays small."""
    own = candidates.groupBy("hash", "owner", "id").agg(F.lit(1).alias("one"))
    own = own.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return own.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int | None = None
) -> DataFrame:
    """Per row: id, base and spans (arrays of start, kind, end, value), counts by kind, n_live and n_copied. Owners decide alone unless ``max_repositories`` is given."""
    seen = materialize(scan(docs, id_col, text_col, owner_col), "secrets")
    each = seen.where(F.size("base") + F.size("extra") > 0).select("rid", "id", "owner", F.explode(F.concat("base", "extra")).alias("x"))
    each = each.select("rid", "id", "owner", "x", F.sha2(F.col("x.value"), 256).alias("hash"), F.pmod(F.col("rid"), F.lit(SALTS)).alias("salt"))
    # A value's verdict goes back to its rows by (hash, salt), of which a value has at most SALTS: no task gets all rows of a hot value.
    places = each.select("hash", "salt").distinct().join(ownership(each), "hash")
    told = each.join(places, ["hash", "salt"]).withColumn("live", F.col("n_owners") <= max_owners)
    if max_repositories is not None:
        told = told.withColumn("live", F.col("live") & (F.col("n_repositories") <= max_repositories))
    by_row = told.groupBy("rid").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.collect_list(F.when(F.col("live") & (F.col("x.kind") == 3), F.col("x"))).alias("added"),
    )
    empty = F.array().cast(seen.schema["base"].dataType)
    return seen.join(by_row, "rid", "left").select(
        "id",
        "base",
        F.concat("base", F.coalesce("added", empty)).alias("spans"),
        *[F.col(k).cast("long").alias(n) for k, n in (("a", "n_assign"), ("c", "n_access"), ("h", "n_hex"))],
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_live", "n_copied")],
    )


def masked_text(text: Column, cuts: Column, mask: str) -> Column:
    """``text`` with each run of overlapping cuts (start, end; in order, at least one) replaced by a mask for each cut that starts outside those before.

    The text is cut into stretches first, so that each part kept is sought within its own stretches.
    """

    def part(stretches: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / STRETCH).cast("int"), F.floor(end / STRETCH).cast("int")
        some = F.array_join(F.slice(stretches, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(some, start - first * STRETCH + 1, end - start)).otherwise("")

    def joined(c: Column) -> Column:
        seen = F.arrays_zip(c.alias("x"), before(F.transform(c, lambda x: x["end"]), larger, F.lit(0)).alias("e"))
        outside = F.filter(seen, lambda y: y["x"]["start"] >= y["e"])
        end = F.array_max(F.transform(c, lambda x: x["end"]))
        return let(
            F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)),
            lambda s: F.concat(F.array_join(F.transform(outside, lambda y: F.concat(part(s, y["e"], y["x"]["start"]), F.lit(mask))), ""), part(s, end, F.length(text))),
        )

    return let(cuts, joined)


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """``documents`` (doc_id, text, source, n_chars and any others) with every reported span replaced by ``mask``; n_chars follows. Rows are kept, other columns unchanged.

    The verdicts are joined by distinct (doc_id, text), so repeated rows stay as many as they were.
    """
    spans = scan_secrets(only(docs, "doc_id", "text", "source").withColumn("key", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))), "key")
    marks = spans.where(F.size("spans") > 0).groupBy("id").agg(F.first("spans").alias("spans"))
    cut = F.transform(F.array_sort("spans"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    marks = materialize(marks.select(F.col("id.doc_id").alias("_id"), F.col("id.t").alias("_t"), cut.alias("cuts")), "secret-marks")
    side = F.broadcast(marks) if marks.count() <= MOST_BROADCAST else marks
    rows = whole_rows(docs, id=F.col("doc_id"), text=F.coalesce("text", F.lit("")), hash=F.sha2(F.coalesce("text", F.lit("")), 256))
    masked = masked_text(F.col("text"), F.col("cuts"), mask)
    joined = rows.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_t")), "left")
    joined = joined.withColumn("new", F.when(F.col("cuts").isNotNull(), masked))
    changed = {"text": F.coalesce("new", F.col("row")["text"]), "n_chars": F.coalesce(F.length("new").cast("long"), F.col("row")["n_chars"])}
    return unwrapped(joined, docs.columns, **changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan_secrets(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return r.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied"
    )


def _sql_spans(name: str, pattern: str, group: int, kind: int, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len({name}_w) + 1), lambda i: {{'start': CAST(list_sum(list_transform({name}_p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({name}_w[1:i-1], lambda x: length(x))), 0) AS BIGINT),
      'kind': {kind}, 'width': length({name}_w[i]), 'value': regexp_extract({name}_w[i], '^(?:{p})$', {group})}}), lambda x: {keep})"""


def _oracle() -> str:
    q = lambda p: p.replace("'", "''")
    parts = {"a": ASSIGN, "c": ACCESS, "h": HEX, "k": TOKEN}
    cut = ", ".join(f"string_split_regex(t, '{q(p)}') AS {n}_p, regexp_extract_all(t, '{q(p)}', 0) AS {n}_w" for n, p in parts.items())
    text = lambda x: f"coalesce(array_to_string(list_transform(list_sort({x}), lambda x: ['assign','access','hex','token'][x.kind + 1] || ':' || x.start || ':' || (x.start + x.width)), ','), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, source, {cut} FROM d),
f AS (SELECT rid, doc_id, source, {_sql_spans('a', ASSIGN, 2, 0, f'length(x.value) >= {LEAST_ASSIGNED}')} AS a, {_sql_spans('c', ACCESS, 0, 1)} AS c, {_sql_spans('h', HEX, 0, 2)} AS h,
  {_sql_spans('k', TOKEN, 0, 3, "regexp_matches(x.value, '[0-9]') AND regexp_matches(x.value, '[a-z]') AND regexp_matches(x.value, '[A-Z]')")} AS k FROM s),
g AS (SELECT *, list_concat(list_concat(a, c), h) AS base FROM f),
e AS (SELECT *, list_filter(k, lambda x: len(list_filter(base, lambda b: b.start < x.start + x.width AND x.start < b.start + b.width)) = 0) AS extra FROM g),
u AS (SELECT rid, doc_id, source, unnest(list_concat(base, extra)) AS x FROM e),
v AS (SELECT rid, doc_id, source, x, sha256(x.value) AS hash FROM u),
o AS (SELECT hash, count(DISTINCT coalesce(source, chr(0))) AS w FROM (SELECT DISTINCT hash, source, doc_id FROM v) GROUP BY hash),
j AS (SELECT rid, x, w <= {MAX_OWNERS} AS live FROM v JOIN o USING (hash)),
b AS (SELECT rid, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, list(x) FILTER (live AND x.kind = 3) AS added FROM j GROUP BY rid)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(c) AS BIGINT) AS n_access, CAST(len(h) AS BIGINT) AS n_hex, sha256({text('base')}) AS base_sha256,
  {text('list_concat(base, coalesce(added, []))')} AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM e LEFT JOIN b USING (rid)"""


ORACLE_SQL = _oracle()
