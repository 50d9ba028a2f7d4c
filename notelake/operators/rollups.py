"""Roll-ups of goals, conversations and quiz sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import progress, session_band
from ..functions.text import last_index, round_half_up, trim
from ..session import dealt
from .mentions import mentions


#: What an answer belongs to.
KEY = ["session_id", "question_id"]


def _stacked(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, to be grouped by KEY: one shuffle and one grouping, where joins would sort each side and hold them all at once."""
    return dealt(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), *KEY)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows that can meet others: a null key equals none."""
    return rows.where(" and ".join(f"{c} is not null" for c in KEY))


def _mark() -> Column:
    """Right 1, wrong 0, answered without a verdict -1."""
    return F.coalesce(F.col("is_correct").cast("int"), F.lit(-1))


def quiz_scores(questions: DataFrame, answers: DataFrame, submitted: DataFrame | None = None) -> DataFrame:
    """Per session: total, answered, correct, incorrect (unanswered count as such), score over all questions, completed, band. Keys: session_id, question_id.

    With ``submitted`` as if its ``new_answers`` were among the answers."""
    rows = [questions.select(*KEY, F.lit(1).alias("_n")), _keyed(answers).select(*KEY, _mark().alias("_had"))]
    rows += [_keyed(submitted).select(*KEY, _mark().alias("_new"))] if submitted is not None else []
    new = [F.max("_new")] if submitted is not None else []
    one = _stacked(*rows).groupBy(*KEY).agg(F.sum("_n").alias("_n"), F.coalesce(F.max("_had"), *new, F.lit(-1)).alias("_mark")).where("_n > 0")
    n = lambda rows: F.sum(F.when(rows, F.col("_n")).otherwise(0))
    out = dealt(one, "session_id").groupBy("session_id").agg(F.sum("_n").alias("total"), n(F.col("_mark") >= 0).alias("answered"), n(F.col("_mark") == 1).alias("correct"))
    score = round_half_up(F.col("correct") * 100 / F.col("total"))
    return out.withColumns({"incorrect": F.col("total") - F.col("correct"), "score": score, "completed": F.col("answered") == F.col("total"), "band": session_band(score)})


def first_unanswered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per session the ordinal of the first question without answer; the number of questions when there is none."""
    open_ = questions.join(answers.select("session_id", "question_id").distinct(), ["session_id", "question_id"], "left_anti").groupBy("session_id").agg(F.min("ordinal").alias("first"))
    total = questions.groupBy("session_id").agg(F.count("*").alias("n"))
    return total.join(open_, "session_id", "left").select("session_id", F.coalesce("first", "n").alias("position"))


def new_answers(submitted: DataFrame, answers: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Submitted answers to questions that have none yet: repeats change nothing. Of several to one question a right one stays, else a wrong one. With ``questions`` only answers to those."""
    rest = [c for c in submitted.columns if c not in KEY]
    rows = [submitted.select(*KEY, *rest, _mark().alias("_new")), _keyed(answers).select(*KEY, F.lit(True).alias("_had"))]
    rows += [_keyed(questions).select(*KEY, F.lit(True).alias("_asked"))] if questions is not None else []
    asked = [F.max("_asked").alias("_asked")] if questions is not None else []
    one = _stacked(*rows).groupBy(*KEY).agg(F.max("_new").alias("_new"), F.max("_had").alias("_had"), *asked, *[F.max_by(c, "_new").alias(c) for c in rest])
    fit = one.where("_new is not null and _had is null" + (" and _asked" if asked else ""))
    return fit.select([F.col(f.name).cast(f.dataType) if f.name in KEY else f.name for f in submitted.schema])


def goal_progress(milestones: DataFrame) -> DataFrame:
    """Per goal: done, total, percent (null without milestones), all_completed."""
    out = milestones.groupBy("goal_id").agg(F.count_if("completed").alias("done"), F.count("milestone_id").alias("total"))
    return out.withColumns({"percent": round_half_up(progress(F.col("done"), F.col("total"))), "all_completed": (F.col("done") == F.col("total")) & (F.col("total") > 0)})


def topic(first_message: Column, most: int = 50) -> Column:
    """The first user message, cut at a space where it is long."""
    text = trim(first_message)
    at = last_index(text, " ", F.lit(most))
    cut = F.when(at > 20, F.substring(text, F.lit(1), at.cast("int"))).otherwise(F.substring(text, 1, most))
    return F.when(text.isNull(), "New Discussion").when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def conversation_list(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, topic, first and last place, last content. ``messages(conversation_id, seq, role, content)``."""
    user = F.when(F.col("role") == "user", F.col("content"))
    out = messages.groupBy("conversation_id").agg(
        F.count("*").alias("messages"),
        F.min_by(user, F.when(F.col("role") == "user", F.col("seq"))).alias("first_user"),
        F.max("seq").alias("last_seq"),
        F.max_by("content", "seq").alias("last_content"),
        F.max_by("role", "seq").alias("last_role"),
    )
    return out.select("conversation_id", "messages", topic(F.col("first_user")).alias("topic"), "last_seq", "last_role", "last_content")


def message_sources(answers: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """(answer_id, path) of answers(answer_id, key, text) that hold the path or (case aside) the base name of one of the notes(key, path) under the same key: a conversation, or its goal."""
    return mentions(answers, notes, key)


def prompt_context(notes: DataFrame, key: str, path: str, content: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """Per key the notes' texts in path order as one context."""
    return notes.groupBy(key).agg(F.expr(f"listagg(concat('## ', {path}, '\n\n', {content}), '{separator}') within group (order by {path})").alias("context"))


def add_notes(goals: DataFrame, paths: Column) -> DataFrame:
    return goals.withColumn("notes_paths", F.array_union(F.coalesce("notes_paths", F.array().cast("array<string>")), paths))


def remove_notes(goals: DataFrame, paths: Column) -> DataFrame:
    """Repeats of kept paths stay."""
    return goals.withColumn("notes_paths", F.filter(F.coalesce("notes_paths", F.array().cast("array<string>")), lambda p: ~F.array_contains(paths, p)))


def goal_errors(name: Column, description: Column, deadline: Column, milestones: Column) -> Column:
    """What keeps a goal from being created, in order."""
    blank = lambda c: F.coalesce(trim(c) == "", F.lit(True))
    return F.array_compact(
        F.array(
            F.when(blank(name), "name"),
            F.when(F.length(name) > 200, "name too long"),
            F.when(name.rlike(r"[\x00-\x1F\x7F]"), "control characters"),
            F.when(blank(description), "description"),
            F.when(blank(deadline), "deadline"),
            F.when(F.coalesce(F.size(milestones), F.lit(0)) < 1, "milestones"),
        )
    )


def goal_id_ok(c: Column) -> Column:
    return F.coalesce((trim(c) != "") & ~c.rlike(r"[/\\]") & ~c.contains(".."), F.lit(False))


def complete_all(milestones: Column) -> Column:
    return F.transform(milestones, lambda m: m.withField("completed", F.lit(True)))


def toggle(milestones: Column, which: str) -> Column:
    return F.transform(milestones, lambda m: F.when(m["id"] == which, m.withField("completed", ~m["completed"])).otherwise(m))


def sanitized_goal_name(c: Column) -> Column:
    """From the plan documents: path characters and ``..`` out, trimmed, 100 characters."""
    return F.substring(trim(F.replace(F.regexp_replace(c, r'[/\\:*?"<>|]', ""), F.lit(".."), F.lit(""))), 1, 100)
