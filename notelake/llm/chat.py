"""Chat formatting: tool-call linking with DataFrame functions only.

Calls and results meet in a hash join by conversation and identifier; the order follows dependencies (a call may name one call of its conversation that it comes after), whose depths
are found by pointer doubling, so a chain of n calls takes log2 n joins; arguments are validated against tool schemas; pairs are serialised as canonical JSON (sorted keys,
no spaces, one form for equal numbers). One row per call and per orphan result: long conversations stay dealt out, ordered by (level, turn, call_id), and are never gathered in one row.

Defined cases: identifiers hold within their conversation; rows with a null conv_id or call_id link with nothing and are ``unidentified``; of repeated calls or results with one identifier the
least (turn, content) counts, others get status ``duplicate``; results without a call are ``orphan``, calls without a result ``unanswered``; a dependency that names no call is dropped
(``dangling`` true); calls in or behind a dependency cycle get level null and ``cycle``; malformed arguments, or ones that are not an object, serialise as null and are invalid; a tool without
schema is invalid. Integers are numbers without a fraction, however written (5.0, 5e0). Other columns of the input are left out; empty tables give an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import parsed
from ..functions.text import let
from .common import dropped, stage, table


@dataclass(frozen=True)
class Param:
    """A parameter of a tool: its JSON type (string, integer, number, boolean), whether it has to be there, and allowed strings."""

    name: str
    kind: str
    required: bool = True
    among: tuple[str, ...] = ()


TOOLS: dict[str, tuple[Param, ...]] = {
    "search": (Param("query", "string"), Param("limit", "integer")),
    "summarise": (Param("text", "string"), Param("ratio", "number", required=False)),
    "translate": (Param("text", "string"), Param("target", "string", among=("en", "fr"))),
}
NUMERIC = "BIGINT|DOUBLE|FLOAT|DECIMAL.*"
#: What Spark calls the types of JSON values, as a pattern.
KINDS = {"string": "STRING", "integer": NUMERIC, "number": NUMERIC, "boolean": "BOOLEAN"}
#: Identifiers hold within a conversation.
KEY = ["conv_id", "call_id"]
#: Canonical numbers are written out up to this many digits before the point and zeros behind it.
MOST_DIGITS, MOST_ZEROS = 40, 6
#: Tokens of JSON text that together are all of it: strings, numbers, what is between them.
TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+|-'


def number_text(c: Column) -> Column:
    """The one form of a JSON number: digits without needless zeros, a point only for fractions, an exponent only for very large and very small ones."""
    part = lambda p: F.regexp_extract(c, p, 1)
    digits = F.ltrim(F.concat(part(r"^-?([0-9]+)"), part(r"\.([0-9]+)")), F.lit("0"))
    power = F.coalesce(part(r"[eE]([+-]?[0-9]+)$").try_cast("int"), F.lit(0)) - F.length(part(r"\.([0-9]+)"))

    def written(x: Column) -> Column:  # value = d * 10 ** k
        d, k, sign = x["d"], x["k"], x["sign"]
        n = F.length(d)
        tail = lambda at: F.substring(d, at, n)
        exponent = n + k - 1
        plain = F.concat(sign, d, F.repeat(F.lit("0"), k))
        middle = F.concat(sign, F.substring(d, F.lit(1), n + k), F.lit("."), tail(n + k + 1))
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -(n + k)), d)
        power_of = F.concat(sign, F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), tail(F.lit(2)))).otherwise(""), F.when(exponent >= 0, "e+").otherwise("e"), exponent.cast("string"))
        return F.when(n == 0, "0").when((k >= 0) & (n + k <= MOST_DIGITS), plain).when((k < 0) & (n + k > 0), middle).when((k < 0) & (n + k > -MOST_ZEROS), small).otherwise(power_of)

    short = lambda x: F.struct(F.rtrim(x["d"], F.lit("0")).alias("d"), (x["k"] + F.length(x["d"]) - F.length(F.rtrim(x["d"], F.lit("0")))).alias("k"), x["sign"].alias("sign"))
    return let(let(F.struct(digits.alias("d"), power.alias("k"), F.when(c.startswith("-"), "-").otherwise("").alias("sign")), short), written)


def canonical(c: Column) -> Column:
    """JSON text that Spark has written (sorted keys, no spaces) with every number in its one form."""
    tokens = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    return F.when(c.rlike("[0-9][.eE]|[0-9]{39}"), F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), number_text(t)).otherwise(t)), "")).otherwise(c)


def json_string(c: Column) -> Column:
    """A string as JSON, null as null."""
    wrapped = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def errors(tool: Column, arguments: Column, tools: dict[str, tuple[Param, ...]] = TOOLS) -> Column:
    """Sorted errors of JSON arguments against the tool's schema: malformed, unknown_tool, or missing:, type:, value: and unknown: with a parameter."""
    value_of = parsed(arguments)
    is_object = F.schema_of_variant(value_of).startswith("OBJECT")
    out = F.array(F.lit("unknown_tool"))
    for name, params in sorted(tools.items()):
        checks = []
        for p in params:
            value = F.try_variant_get(value_of, f"$.{p.name}", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | (kind == "VOID")
            wrong = ~kind.rlike(f"^({KINDS[p.kind]})$")
            if p.kind == "integer":
                wrong = wrong | (kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") & ~number_text(F.try_variant_get(value_of, f"$.{p.name}", "string")).rlike(r"^-?[0-9]+$|e\+"))
            if p.required:
                checks.append(F.when(absent, F.lit(f"missing:{p.name}")))
            checks.append(F.when(~absent & wrong, F.lit(f"type:{p.name}")))
            if p.among:
                checks.append(F.when(~absent & ~wrong & ~F.try_variant_get(value_of, f"$.{p.name}", "string").isin(*p.among), F.lit(f"value:{p.name}")))
        unknown = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*(F.lit(p.name) for p in params))), lambda k: F.concat(F.lit("unknown:"), k))
        out = F.when(tool == name, F.array_sort(F.concat(F.array_compact(F.array(*checks)), F.coalesce(unknown, F.array().cast("array<string>"))))).otherwise(out)
    return F.when(F.coalesce(is_object, F.lit(False)), out).otherwise(F.array(F.lit("malformed")))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, dangling) of ``calls(conv_id, call_id, after)``, unique by conversation and identifier: how many calls come before it in its chain; null in or behind a cycle."""
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("after")).alias("up")
    now = stage(calls.select(*KEY, "after").join(ids, ["conv_id", "after"], "left").select(*KEY, up, (F.col("after").isNotNull() & F.col("there").isNull()).alias("dangling"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("level")), "depths")
    total, waiting = now.agg(F.count("*"), F.count("up")).first()
    for _ in range(max(1, total).bit_length() + 1):
        if not waiting:
            break
        far = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"))
        then = stage(now.join(far, ["conv_id", "up"], "left").select(*KEY, F.col("up2").alias("up"), "dangling", (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level")), "depths")
        dropped(now)
        now, waiting = then, then.agg(F.count("up")).first()[0]
    return now.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"), "dangling")


def first_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """The least row of each conversation and identifier, whole."""
    return rows.groupBy(*KEY).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in (*order, *KEY)])).alias("x")).select(*KEY, "x.*")


def spare(rows: DataFrame, kept: DataFrame, same: Column) -> DataFrame:
    """Rows but for one of those that ``same`` says are ``kept`` (unique by conversation and identifier), with ``here``: whether anything was kept under their identifier."""
    counted = rows.groupBy(rows.columns).agg(F.count("*").alias("times")).join(kept, KEY, "left")
    left = counted.withColumn("here", F.col("kept").isNotNull()).withColumn("times", F.col("times") - F.when(F.col("here") & same, 1).otherwise(0)).where("times > 0")
    return left.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, tuple[Param, ...]] = TOOLS) -> DataFrame:
    """Pairs of ``calls(conv_id, turn, call_id, after, name, arguments)`` and ``results(conv_id, turn, call_id, content)``.

    A row: conv_id, call_id, level, turn, result_turn, name, status (ok, invalid, unanswered, cycle, duplicate, orphan, unidentified), dangling, errors, json."""
    calls = calls.select("conv_id", "turn", "call_id", "after", "name", "arguments")
    results = results.select("conv_id", "turn", "call_id", "content")
    named = "conv_id is not null and call_id is not null"
    one = stage(first_of(calls.where(named), ["turn", "arguments"]), "calls")
    answer = stage(first_of(results.where(named), ["turn", "content"]), "answers")
    linked = one.join(depths(one), KEY).join(answer.select(*KEY, F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered")), KEY, "left").withColumn("errors", errors(F.col("name"), F.col("arguments"), tools))
    arguments = F.coalesce(F.when(F.coalesce(F.schema_of_variant(parsed(F.col("arguments"))).startswith("OBJECT"), F.lit(False)), canonical(F.to_json(parsed(F.col("arguments"))))), F.lit("null"))
    call = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("name")), F.lit("}"))
    reply = lambda: F.concat(F.lit('{"content":'), json_string(F.col("content")), F.lit(',"id":'), json_string(F.col("call_id")), F.lit("}"))
    status = F.when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    columns = ["conv_id", "call_id", "level", "turn", "result_turn", "name", "status", "dangling", "errors", "json"]
    pairs = linked.withColumn("status", status).withColumn("json", F.concat(F.lit('{"call":'), call, F.lit(',"result":'), F.when(F.col("answered"), reply()).otherwise("null"), F.lit("}"))).select(columns)

    none = {"level": "bigint", "result_turn": "bigint", "name": "string", "errors": "array<string>", "turn": "bigint"}
    nulls = lambda df, *names: functools.reduce(lambda d, n: d.withColumn(n, F.lit(None).cast(none[n])), names, df)
    # repeats: all but one of the rows of an identifier; orphans: results whose identifier no call has; rows without identifier meet nothing and stay out of the joins
    fields = ["turn", "name", "arguments"]
    kept = one.select(*KEY, F.struct(*fields).alias("kept"))
    plain = [*KEY, *fields]
    more = spare(calls.where(named).select(plain), kept, F.struct(*fields).eqNullSafe(F.col("kept"))).withColumn("status", F.lit("duplicate")).select(*plain, "status")
    more = more.unionByName(calls.where(f"not ({named})").select(*plain, F.lit("unidentified").alias("status")))
    more = nulls(more.withColumn("dangling", F.lit(False)).withColumn("json", F.concat(F.lit('{"call":'), call, F.lit(',"result":null}'))), "level", "result_turn", "errors").select(columns)
    plain = [*KEY, "turn", "content"]
    lost = spare(results.where(named).select(plain), answer.select(*KEY, F.struct("turn", "content").alias("kept")).join(one.select(KEY), KEY, "left_semi"), F.struct("turn", "content").eqNullSafe(F.col("kept")))
    lost = lost.withColumn("status", F.when(F.col("here"), "duplicate").otherwise("orphan")).select(*plain, "status")
    lost = lost.unionByName(results.where(f"not ({named})").select(*plain, F.lit("unidentified").alias("status")))
    lost = lost.withColumn("dangling", F.lit(False)).withColumn("json", F.concat(F.lit('{"call":null,"result":'), reply(), F.lit("}")))
    lost = nulls(lost.withColumn("result_turn", F.col("turn")), "level", "name", "errors", "turn").select(columns)
    return pairs.unionByName(more).unionByName(lost)


#: Tool traffic derived from plain conversations, which hold none: each user turn calls a tool, each assistant turn answers the turn before it. Arguments vary, some badly; identifiers
#: come again in every conversation; some calls have none, repeat an earlier call's or come after themselves.
CALLS_SQL = """
SELECT conv_id, turn, CASE WHEN length(text) % 19 = 0 THEN NULL WHEN length(text) % 29 = 0 AND turn >= 2 THEN concat('call_', turn - 2) ELSE concat('call_', turn) END AS call_id,
  CASE WHEN length(text) % 31 = 0 THEN concat('call_', turn) WHEN length(text) % 2 = 0 THEN concat('call_', turn - 2) END AS after,
  CASE (conv_id + turn) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE CASE WHEN length(text) % 17 = 0 THEN 'shout' ELSE 'summarise' END END AS name,
  CASE (conv_id + turn) % 3
    WHEN 0 THEN CASE WHEN length(text) % 7 = 0 THEN concat('{{ "query" : ', {q}, ', "limit" : "', length(text), '" }}') WHEN length(text) % 11 = 0 THEN concat('{{"limit":', length(text), '}}') ELSE concat('{{"query":', {q}, ',"limit":', length(text), CASE length(text) % 4 WHEN 0 THEN '.0' WHEN 1 THEN '.5' WHEN 2 THEN 'e2' ELSE '' END, '}}') END
    WHEN 1 THEN CASE WHEN length(text) % 5 = 0 THEN concat('{{"tone":"dry","text":', {q}, ',"target":"fr"}}') ELSE concat('{{"text":', {q}, ',"target":"', CASE WHEN length(text) % 3 = 0 THEN 'xx' ELSE 'en' END, '"}}') END
    ELSE CASE WHEN length(text) % 13 = 0 THEN '{{"text":' ELSE concat('{{"text":', {q}, ',"ratio":', CASE length(text) % 3 WHEN 0 THEN '0.250' WHEN 1 THEN '25e-2' ELSE '1.0' END, '}}') END
  END AS arguments
FROM {table} WHERE role = 'user' AND text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL
"""


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from all ``conversations``, linked, ordered, validated and serialised; -1 stands for missing turns and levels, '-' for missing identifiers."""
    talk = table(spark, sf_dir, "conversations")
    sql = CALLS_SQL.format(q="substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)", table="TALK")
    said = spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("TALK", "{talk}"), talk=talk)
    answers = talk.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    numbers = {c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("level", "turn", "result_turn")}
    return link_tool_calls(said, answers).withColumns(numbers | {"errors": F.concat_ws(",", "errors"), "call_id": F.coalesce("call_id", F.lit("-"))})


OP1_SQL = (
    "WITH RECURSIVE said AS ("
    + CALLS_SQL.format(q="to_json(text)::VARCHAR", table="conversations")
    + r"""), given AS (SELECT conv_id, turn, concat('call_', turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, arguments) AS k FROM said
), calls AS (SELECT * FROM placed WHERE k = 1 AND conv_id IS NOT NULL AND call_id IS NOT NULL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content) AS k FROM given
), results AS (SELECT * FROM ranked WHERE k = 1 AND conv_id IS NOT NULL AND call_id IS NOT NULL
), up AS (SELECT c.conv_id, c.call_id, p.call_id AS up, c.after IS NOT NULL AND p.call_id IS NULL AS dangling FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.after
), r AS (SELECT conv_id, call_id, 0::BIGINT AS level FROM up WHERE up IS NULL UNION ALL SELECT u.conv_id, u.call_id, r.level + 1 FROM up u JOIN r ON u.conv_id = r.conv_id AND u.up = r.call_id
), d AS (SELECT up.conv_id, up.call_id, dangling, coalesce(level, -1) AS level FROM up LEFT JOIN r USING (conv_id, call_id)
), j AS (SELECT *, CASE WHEN json_valid(arguments) THEN arguments::JSON END AS a FROM placed
), v AS (SELECT *, CASE WHEN json_type(a, '$.limit') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN (a ->> '$.limit')::DOUBLE END AS lim, (a ->> '$.ratio')::DOUBLE AS ratio FROM j
), e AS (
  SELECT *, CASE WHEN a IS NULL THEN 'malformed' WHEN name = 'shout' THEN 'unknown_tool' ELSE array_to_string(list_sort(list_filter([
    CASE WHEN name = 'search' AND NOT coalesce(json_exists(a, '$.query'), false) THEN 'missing:query' END,
    CASE WHEN name = 'search' AND (json_type(a, '$.limit') = 'VARCHAR' OR lim <> floor(lim)) THEN 'type:limit' END,
    CASE WHEN name = 'translate' AND json_exists(a, '$.tone') THEN 'unknown:tone' END,
    CASE WHEN name = 'translate' AND a ->> '$.target' NOT IN ('en', 'fr') THEN 'value:target' END], lambda x: x IS NOT NULL)), ',') END AS errors,
    CASE WHEN a IS NULL THEN 'null' WHEN name = 'search' THEN concat('{"limit":', CASE WHEN lim IS NULL THEN (a -> '$.limit')::VARCHAR WHEN lim = floor(lim) THEN lim::BIGINT::VARCHAR ELSE lim::VARCHAR END, CASE WHEN json_exists(a, '$.query') THEN concat(',"query":', a -> '$.query') ELSE '' END, '}')
      WHEN name = 'translate' THEN concat('{"target":', a -> '$.target', ',"text":', a -> '$.text', CASE WHEN json_exists(a, '$.tone') THEN ',"tone":"dry"' ELSE '' END, '}')
      ELSE concat('{"ratio":', CASE WHEN ratio = 1 THEN '1' ELSE '0.25' END, ',"text":', a -> '$.text', '}') END AS canon
  FROM v
), c AS (SELECT *, concat('{"arguments":', canon, ',"id":', CASE WHEN call_id IS NULL THEN 'null' ELSE concat('"', call_id, '"') END, ',"name":"', name, '"}') AS call FROM e
)
SELECT c.conv_id, c.call_id, d.level, c.turn, coalesce(r.turn, -1) AS result_turn, c.name, CASE WHEN d.level < 0 THEN 'cycle' WHEN c.errors <> '' THEN 'invalid' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status, d.dangling, c.errors,
  concat('{"call":', c.call, ',"result":', CASE WHEN r.call_id IS NULL THEN 'null' ELSE concat('{"content":', coalesce(to_json(r.content)::VARCHAR, 'null'), ',"id":"', c.call_id, '"}') END, '}') AS json
FROM c JOIN d ON d.conv_id = c.conv_id AND d.call_id = c.call_id LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id WHERE c.k = 1
UNION ALL
SELECT conv_id, coalesce(call_id, '-'), -1, turn, -1, name, CASE WHEN call_id IS NULL THEN 'unidentified' ELSE 'duplicate' END, false, '', concat('{"call":', call, ',"result":null}') FROM c WHERE call_id IS NULL OR k > 1
UNION ALL
SELECT g.conv_id, coalesce(g.call_id, '-'), -1, -1, g.turn, NULL, CASE WHEN g.conv_id IS NULL OR g.call_id IS NULL THEN 'unidentified' WHEN c.call_id IS NULL THEN 'orphan' ELSE 'duplicate' END, false, '',
  concat('{"call":null,"result":{"content":', coalesce(to_json(g.content)::VARCHAR, 'null'), ',"id":', CASE WHEN g.call_id IS NULL THEN 'null' ELSE concat('"', g.call_id, '"') END, '}}')
FROM ranked g LEFT JOIN calls c ON c.conv_id = g.conv_id AND c.call_id = g.call_id WHERE g.conv_id IS NULL OR g.call_id IS NULL OR c.call_id IS NULL OR g.k > 1
"""
)
