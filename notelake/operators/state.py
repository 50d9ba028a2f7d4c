"""What the application does to goals, conversations and quiz sessions: each a function from tables to tables. Times and identifiers are given or follow from keys, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_id
from .rollups import goal_errors, new_answers, quiz_scores, topic


def milestone_rows(goals: DataFrame, texts: str = "milestones") -> DataFrame:
    """(goal_id, milestone_id, content, order, completed) of milestone texts: places are the order, none is completed."""
    rows = goals.select("goal_id", F.posexplode(texts).alias("order", "content"))
    return rows.select("goal_id", entity_id("milestone", F.col("goal_id"), F.col("order")).alias("milestone_id"), "content", "order", F.lit(False).alias("completed"))


def milestone_list(milestones: DataFrame) -> DataFrame:
    """(goal_id, milestones): a goal's milestones by their order."""
    item = F.struct("order", "milestone_id", "content", "completed")
    return milestones.groupBy("goal_id").agg(F.array_sort(F.collect_list(item)).alias("milestones"))


def create_goals(drafts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Goals and milestones of valid drafts(draft_id, name, description, deadline, milestones, notes_paths), and the others with their errors."""
    known = drafts.withColumn("errors", goal_errors(F.col("name"), F.col("description"), F.col("deadline"), F.col("milestones")))
    good = known.where(F.size("errors") == 0).withColumn("goal_id", entity_id("goal", F.col("draft_id")))
    paths = F.coalesce("notes_paths", F.array().cast("array<string>"))
    goals = good.select("goal_id", "name", "description", "deadline", paths.alias("notes_paths"), F.lit("active").alias("status"), now.alias("created_at"), now.alias("updated_at"))
    return goals, milestone_rows(good), known.where(F.size("errors") > 0).select("draft_id", "errors")


def complete_goals(goals: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Goals of done(goal_id) become completed; their milestones stay as they are."""
    hit = goals.join(done.select("goal_id").distinct().withColumn("_d", F.lit(True)), "goal_id", "left")
    return hit.withColumn("status", F.when(F.col("_d"), "completed").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_d"), now).otherwise(F.col("updated_at"))).select(goals.columns)


def set_milestones(milestones: DataFrame, goals: DataFrame) -> DataFrame:
    """Milestones with those of goals(goal_id, milestones: texts) replaced."""
    return milestones.join(goals.select("goal_id").distinct(), "goal_id", "left_anti").unionByName(milestone_rows(goals).select(milestones.columns))


def readable_notes(goals: DataFrame, notes: DataFrame) -> DataFrame:
    """(goal_id, place, path, content) of each goal's notes that exist, in its order; paths without a note are left out."""
    paths = goals.select("goal_id", F.posexplode("notes_paths").alias("place", "path"))
    return paths.join(notes.select("path", "content"), "path").select("goal_id", "place", "path", "content")


def goal_counts(goals: DataFrame, messages: DataFrame, questions: DataFrame) -> DataFrame:
    """(goal_id, notes, messages, questions) of goals(goal_id, notes_paths), messages(goal_id, ...) and questions(goal_id, ...)."""
    n = lambda df, name: df.groupBy("goal_id").agg(F.count("*").alias(name))
    out = goals.select("goal_id", F.coalesce(F.size("notes_paths"), F.lit(0)).cast("bigint").alias("notes")).join(n(messages, "messages"), "goal_id", "left").join(n(questions, "questions"), "goal_id", "left")
    return out.fillna(0, ["messages", "questions"])


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    """A list as it is shown: by time, newest first, then by key."""
    return rows.orderBy(F.desc(at), key)


def toggled(chosen: Column, path: Column) -> Column:
    """A selection with a path added if it was not in it, else removed."""
    return F.when(F.array_contains(chosen, path), F.array_remove(chosen, path)).otherwise(F.concat(chosen, F.array(path)))


# --- conversations: (conversation_id, goal_id, topic, created_at) and (conversation_id, seq, role, content, sources, timestamp) ---


def create_conversations(new: DataFrame, now: Column) -> DataFrame:
    """Conversations of new(request_id, goal_id, topic or null)."""
    return new.select(entity_id("conv", F.col("goal_id"), F.col("request_id")).alias("conversation_id"), "goal_id", F.coalesce("topic", F.lit("New Discussion")).alias("topic"), now.alias("created_at"))


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages with new(conversation_id, place, role, content, sources, timestamp) behind the last of their conversation, in their order."""
    last = messages.groupBy("conversation_id").agg(F.max("seq").alias("_last"))
    step = F.row_number().over(Window.partitionBy("conversation_id").orderBy("place"))
    put = new.withColumn("_step", step).join(last, "conversation_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(-1)) + F.col("_step")).cast("bigint"))
    return messages.unionByName(put.select(messages.columns))


def retopic(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations that have no topic of their own yet with that of their first user message."""
    user = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "seq").alias("_first"))
    own = F.col("topic") != "New Discussion"
    return conversations.join(user, "conversation_id", "left").withColumn("topic", F.when(own | F.col("_first").isNull(), F.col("topic")).otherwise(topic(F.col("_first")))).select(conversations.columns)


def save_exchanges(conversations: DataFrame, messages: DataFrame, exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after finished exchanges(conversation_id, question, content, sources, timestamp): two messages more, a topic on the first exchange. Exchanges are at most one a conversation."""
    none = F.lit(None).cast("array<string>")
    asked = exchanges.select("conversation_id", F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content"), none.alias("sources"), "timestamp")
    told = exchanges.select("conversation_id", F.lit(1).alias("place"), F.lit("assistant").alias("role"), "content", "sources", "timestamp")
    now = append_messages(messages, asked.unionByName(told))
    return retopic(conversations, now), now


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(t.join(gone.select("conversation_id").distinct(), "conversation_id", "left_anti") for t in (conversations, messages))


def reset_conversations(conversations: DataFrame, messages: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of which(conversation_id) without messages and with the topic they started with."""
    hit = conversations.join(which.select("conversation_id").distinct().withColumn("_r", F.lit(True)), "conversation_id", "left")
    return hit.withColumn("topic", F.when(F.col("_r"), "New Discussion").otherwise(F.col("topic"))).select(conversations.columns), messages.join(which.select("conversation_id").distinct(), "conversation_id", "left_anti")


# --- quiz sessions: (session_id, goal_id, created_at, completed_at, score), (session_id, question_id, ordinal, ...), (session_id, question_id, is_correct, ...) ---


def create_sessions(new: DataFrame, questions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions of new(request_id, goal_id) and their questions(request_id, pos, type, text, ...) with ids and ordinals."""
    ids = new.select("request_id", "goal_id", entity_id("qa", F.col("goal_id"), F.col("request_id")).alias("session_id"))
    sessions = ids.select("session_id", "goal_id", now.alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("bigint").alias("score"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    rows = questions.join(ids.select("request_id", "session_id"), "request_id").withColumn("ordinal", place)
    rest = [c for c in questions.columns if c not in ("request_id", "pos")]
    return sessions, rows.select("session_id", entity_id("q", F.col("session_id"), F.col("ordinal")).alias("question_id"), "ordinal", *rest)


def submit_answers(sessions: DataFrame, questions: DataFrame, answers: DataFrame, submitted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions and answers after submitted(session_id, question_id, is_correct, ...): answered questions keep their answer, questions of other sessions are no questions; a session whose questions are all answered gets its score and time."""
    every = answers.unionByName(new_answers(submitted, answers, questions).select(answers.columns))
    done = quiz_scores(questions, answers, submitted).where("completed").select("session_id", F.col("score").alias("_s"))
    out = sessions.join(done, "session_id", "left")
    return out.withColumns({"completed_at": F.when(F.col("_s").isNotNull(), F.coalesce("completed_at", now)).otherwise(F.col("completed_at")), "score": F.coalesce("score", "_s")}).select(sessions.columns), every


def question_status(questions: DataFrame, answers: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(session_id, question_id, ordinal, is_current, is_answered, is_correct): the current question is that of at(session_id, ordinal), else the first without an answer."""
    one = answers.groupBy("session_id", "question_id").agg(F.max("is_correct").alias("_c"))
    rows = questions.select("session_id", "question_id", "ordinal").join(one.withColumn("_a", F.lit(True)), ["session_id", "question_id"], "left")
    cursor = at.select("session_id", F.col("ordinal").alias("_at")) if at is not None else rows.where("_a is null").groupBy("session_id").agg(F.min("ordinal").alias("_at"))
    rows = rows.join(cursor, "session_id", "left")
    return rows.select("session_id", "question_id", "ordinal", F.coalesce(F.col("ordinal") == F.col("_at"), F.lit(False)).alias("is_current"), F.coalesce("_a", F.lit(False)).alias("is_answered"), F.coalesce("_c", F.lit(False)).alias("is_correct"))


def neighbours(questions: DataFrame) -> DataFrame:
    """Each question with the one before and the one behind it, null at either end."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    return questions.withColumns({"previous_id": F.lag("question_id").over(w), "next_id": F.lead("question_id").over(w)})


def delete_sessions(sessions: DataFrame, questions: DataFrame, answers: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sessions of gone(session_id)."""
    which = gone.select("session_id").distinct()
    return tuple(t.join(which, "session_id", "left_anti").select(t.columns) for t in (sessions, questions, answers))


def finish_goals(goals: DataFrame, milestones: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What the completion button does, in one step: goals of done(goal_id) become completed and all their milestones with them."""
    which = done.select("goal_id").distinct().withColumn("_d", F.lit(True))
    marked = milestones.join(which, "goal_id", "left").withColumn("completed", F.coalesce("_d", F.lit(False)) | F.col("completed"))
    return complete_goals(goals, done, now), marked.select(milestones.columns)
