"""Model responses: fenced JSON blocks, validated without failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

#: What the application tells a learner.
UNABLE = "Unable to evaluate answer. Please try again."
BROKEN = "Error evaluating answer. Please try again."
UNEXPLAINED = "No explanation provided."
RIGHT = "Correct! This answer demonstrates understanding of the concept."
WRONG = "Incorrect. The correct answer was: "
#: Fixed value: a block of JSON in a model's answer.
FENCED = r"```json\s*([\s\S]*?)\s*```"


def fenced(c: Column) -> Column:
    """The first ```json block; null without one."""
    return F.when(c.rlike(FENCED), F.regexp_extract(c, FENCED, 1))


def parsed(c: Column) -> Column:
    """A JSON text as a variant, null unless all of it is one value: Spark's parser by itself stops behind the first value."""
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    return F.when(alone, F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))), "$.v", "variant"))


def variant(c: Column) -> Column:
    """The fenced block as a variant; null where it is missing or malformed."""
    return parsed(fenced(c))


def kind(v: Column) -> Column:
    """What a value is: string, number, boolean, array, object; null for JSON null and absent ones."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "string").when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str) -> Column:
    """A string, null for values of other kinds."""
    return F.when(kind(at(v, path)) == "string", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) == "number", F.try_variant_get(v, path, "double"))


def elements(rows: DataFrame, v: str, keep: list[str], path: str = "$") -> DataFrame:
    """One row per element of an array in variant column ``v``: the kept columns, pos, value."""
    held = rows.select(*keep, F.try_variant_get(v, path, "array<variant>").alias("_a"))
    return held.select(*keep, F.posexplode("_a").alias("pos", "value"))


def scores(responses: DataFrame, response: str = "response", keep: list[str] | None = None) -> DataFrame:
    """Valid (note_path, score clamped to 0..100, reason) items of model responses, with their position."""
    keep = keep or []
    items = elements(responses.withColumn("_v", variant(F.col(response))), "_v", keep)
    fields = items.select(*keep, "pos", text_at(F.col("value"), "$.notePath").alias("note_path"), number_at(F.col("value"), "$.score").alias("score"), text_at(F.col("value"), "$.reason").alias("reason"))
    return fields.where("note_path is not null and score is not null and reason is not null").withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(100.0)))


def source_paths(asked: DataFrame, notes: DataFrame, source: str = "sourceNotePath") -> DataFrame:
    """(source, path) of the distinct sources of ``asked``: the first of notes(place, path) that equals it or ends with it.

    A path has one suffix for each length that occurs among sources, so equal suffixes meet in a join by value."""
    wanted = asked.where(F.col(source) != "").select(F.col(source).alias("_s")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("_s")).alias("_l"))  # one row; at most as many numbers as the longest path has characters
    size = F.length("path")
    held = notes.where("path is not null").select("place", "path").crossJoin(F.broadcast(lengths))
    ends = held.select("place", "path", F.explode(F.filter("_l", lambda n: n <= size)).alias("_n")).select("place", "path", F.substring("path", F.length("path") - F.col("_n") + 1, F.col("_n")).alias("_s"))
    return ends.join(wanted, "_s", "left_semi").groupBy("_s").agg(F.min(F.struct("place", "path")).alias("_b")).select(F.col("_s").alias(source), F.col("_b.path").alias("source"))


def questions(responses: DataFrame, response: str, keep: list[str], notes: Column | DataFrame) -> DataFrame:
    """Valid questions of model responses; ``notes``: known paths in order, as an array where they are few, else as a table notes(place, path). A source is the first path that equals it or ends with it."""
    few = isinstance(notes, Column)
    rows = responses.withColumn("_v", variant(F.col(response))).withColumn("_n", notes if few else F.lit(None).cast("array<string>"))
    items = elements(rows, "_v", [*keep, "_n"], "$.questions")
    q = items.select(*keep, "_n", "pos", *[text_at(F.col("value"), f"$.{n}").alias(n) for n in ("type", "text", "sourceNotePath")], F.try_variant_get("value", "$.options", "array<string>").alias("options"), number_at(F.col("value"), "$.correctAnswer").alias("correct_answer"))
    if few:
        q = q.withColumn("source", F.get(F.filter("_n", lambda p: (p == F.col("sourceNotePath")) | p.endswith(F.col("sourceNotePath"))), F.lit(0)))
    else:
        q = q.join(source_paths(q, notes), "sourceNotePath", "left")
    choice = (F.col("type") == "multiple-choice") & (F.size("options") == 4) & F.col("correct_answer").between(0, 3)
    good = (F.col("text") != "") & (F.col("sourceNotePath") != "") & F.col("source").isNotNull() & (choice | (F.col("type") == "open-ended"))
    only = lambda c: F.when(F.col("type") == "multiple-choice", F.col(c))
    return q.where(F.coalesce(good, F.lit(False))).select(*keep, "pos", "type", "text", F.col("source").alias("source_note_path"), only("options").alias("options"), only("correct_answer").alias("correct_answer"))


def goal_draft(c: Column) -> Column:
    """struct<name, description, deadline, milestones>, trimmed; null if anything is missing, empty or of another type."""
    v = variant(c)
    parts = {n: text_at(v, f"$.{n}") for n in ("name", "description", "deadline")}
    raw = F.try_variant_get(v, "$.milestones", "array<variant>")
    stones = F.transform(raw, lambda m: F.when(F.schema_of_variant(m) == "STRING", m.cast("string")))
    good = (F.size(raw) > 0) & F.forall(stones, lambda m: m.isNotNull())
    for p in parts.values():
        good = good & (p != "")
    return F.when(good, F.struct(*[trim(p).alias(n) for n, p in parts.items()], F.transform(stones, trim).alias("milestones")))


def evaluation(c: Column) -> Column:
    """struct<is_correct, explanation> of an evaluation response; anything unusable is incorrect."""
    v, block = variant(c), fenced(c)
    flag, k = F.try_variant_get(v, "$.isCorrect", "string"), kind(at(v, "$.isCorrect"))
    truthy = F.coalesce((k == "boolean") & (flag == "true") | (k == "number") & (F.try_variant_get(v, "$.isCorrect", "double") != 0) | (k == "string") & (flag != "") | k.isin("array", "object"), F.lit(False))
    said = text_at(v, "$.explanation")
    why = F.when(block.isNull(), UNABLE).when(v.isNull(), BROKEN).when(F.coalesce(said, F.lit("")) == "", UNEXPLAINED).otherwise(said)
    return F.struct(truthy.alias("is_correct"), why.alias("explanation"))


def grade(answer: Column, correct: Column, options: Column) -> Column:
    """struct<is_correct, explanation> of a multiple-choice answer."""
    right = F.coalesce(answer == correct, F.lit(False))
    return F.struct(right.alias("is_correct"), F.when(right, RIGHT).otherwise(F.concat(F.lit(WRONG), F.get(options, correct.cast("int")))).alias("explanation"))
