"""Prompts and request bodies. The wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = {
    "relevance": "Rate how useful each note is for the learner's goal from 0 to 100. Reply with a json block: a list of objects with notePath, score and reason.",
    "brainstorm": "Help the learner to shape one goal. When it is clear, reply with a json block that has name, description, deadline and milestones.",
    "discuss": "Discuss the learner's notes. Say which notes an answer rests on by their paths.",
    "questions": "Write questions about the notes. Reply with a json block with the list questions: type, text, sourceNotePath and, for multiple-choice, four options and correctAnswer.",
    "evaluate": "Judge the learner's answer by the note. Reply with a json block with isCorrect and explanation.",
}
MODEL, MOST_TOKENS, TEMPERATURE = "default", 4096, 0.7


def question_prompt(goal: Column, context: Column, number: Column) -> Column:
    return F.concat(F.lit("Goal: "), goal, F.lit("\nQuestions: "), number.cast("string"), F.lit("\n\n"), context)


def evaluation_prompt(question: Column, source: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nNote:\n"), source, F.lit("\nAnswer: "), answer)


def discussion_prompt(goal: Column, description: Column, milestones: Column, context: Column) -> Column:
    """The system message of a discussion: its rule, the goal with its milestones (an array of texts), and the notes as one context; parts that are missing are left out."""
    stones = F.when(F.size(milestones) > 0, F.concat(F.lit("Milestones:\n"), F.array_join(F.transform(milestones, lambda m: F.concat(F.lit("- "), m)), "\n")))
    notes = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Notes:\n\n"), context))
    return F.concat_ws("\n\n", F.lit(SYSTEM["discuss"]), F.concat(F.lit("Goal: "), goal), description, stones, notes)


def brainstorm_prompt(today: Column, known: Column) -> Column:
    """The system message of a brainstorm: its rule, the date that deadlines are after, and the names of goals there are already (an array, null for none)."""
    have = F.when(F.size(known) > 0, F.concat(F.lit("Goals so far: "), F.array_join(known, "; ")))
    return F.concat_ws("\n\n", F.lit(SYSTEM["brainstorm"]), F.concat(F.lit("Today: "), today.cast("string")), have)


def request_bodies(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, system, messages, model, max_tokens, temperature) of messages(key, seq, role, content): system messages are joined by blank lines, the others stay in order; option columns of the input win over defaults."""
    said = F.when(F.col("role") != "system", F.struct("seq", "role", "content"))
    out = messages.groupBy(key).agg(
        F.expr("listagg(content, '\n\n') within group (order by seq) filter (where role = 'system')").alias("system"),
        F.array_sort(F.collect_list(said)).alias("_m"),
        *[F.max(c).alias(f"_{c}") for c in ("model", "max_tokens", "temperature") if c in messages.columns],
    )
    option = lambda c, default: F.coalesce(F.col(f"_{c}"), F.lit(default)) if c in messages.columns else F.lit(default)
    return out.select(key, "system", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), option("model", MODEL).alias("model"), option("max_tokens", MOST_TOKENS).alias("max_tokens"), option("temperature", TEMPERATURE).alias("temperature"))
