"""Spaced repetition and question selection, from the specification documents."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days to the next review by streak, weights of a note's score.
INTERVALS = (1, 3, 7, 14, 30, 60, 120)
WEIGHTS = {"spaced": 0.35, "richness": 0.20, "recency": 0.15, "variety": 0.15, "struggle": 0.15}
DAY = 86_400_000_000


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(float(DAY))


def note_history(answers: DataFrame) -> DataFrame:
    """Per note of answers(note_id, event_id, ts, correct): first and last time, count, correct, current streak, last ten times. One grouped pass: the streak counts what follows the last wrong answer."""
    when = F.struct("ts", "event_id")
    wrong = answers.groupBy("note_id").agg(F.max(F.when(~F.col("correct"), when)).alias("w"))
    out = answers.join(wrong, "note_id").groupBy("note_id").agg(
        F.min("ts").alias("first_quizzed"),
        F.max("ts").alias("last_quizzed"),
        F.count("*").alias("quiz_count"),
        F.count_if("correct").alias("correct_count"),
        F.count_if(F.col("w").isNull() | (when > F.col("w"))).alias("streak"),
    )
    recent = answers.withColumn("_r", F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("_r <= 10")
    return out.join(recent.groupBy("note_id").agg(F.array_sort(F.collect_list("ts")).alias("recent")), "note_id")


def interval(streak: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, INTERVALS)), F.least(streak, F.lit(len(INTERVALS) - 1)).cast("int") + 1)


def is_due(last: Column, streak: Column, now: Column) -> Column:
    return last.isNull() | (days_between(now, last) >= interval(streak))


def worth_asking(words: Column, tags: Column, wanted: list[str] | None = None) -> Column:
    """Notes of a hundred words or more that have one of the wanted tags, if any are wanted."""
    return (words >= 100) & (F.arrays_overlap(tags, F.array(*map(F.lit, wanted))) if wanted else F.lit(True))


def should_quiz(last: Column, streak: Column, now: Column) -> Column:
    """Neither mastered and fresh nor asked within a day."""
    days = days_between(now, last)
    return last.isNull() | ~(((streak > 5) & (days < 14)) | (days < 1))


def spaced_score(last: Column, streak: Column, now: Column) -> Column:
    over = days_between(now, last) - interval(streak)
    return F.when(last.isNull(), 1.0).when(over > 30, 0.95).when(over > 7, 0.85).when(over > 0, 0.70).when(over > -3, 0.50).otherwise(0.20)


def richness(headings: Column, words: Column) -> Column:
    return F.least(F.lit(1.0), headings * F.lit(0.15)) * F.lit(0.6) + F.least(F.lit(1.0), words / F.lit(1000.0)) * F.lit(0.4)


def recency(modified: Column, now: Column) -> Column:
    days = days_between(now, modified)
    return F.when(days < 7, 1.0).when(days < 30, 0.7).when(days < 90, 0.5).otherwise(0.1)


def variety(count: Column) -> Column:
    return F.when(count == 0, 1.0).when(count <= 2, 0.9).when(count <= 5, 0.7).when(count <= 10, 0.5).otherwise(0.2)


def struggle(count: Column, correct: Column) -> Column:
    share = F.try_divide(correct.cast("double"), count.cast("double"))
    return F.when(count == 0, 0.5).when(share < 0.3, 1.0).when(share < 0.5, 0.8).when(share < 0.7, 0.5).otherwise(0.1)


def cold_start(headings: Column, inlinks: Column, modified: Column, now: Column, jitter: Column | None = None) -> Column:
    """Score of a note never asked about; jitter (0 to 0.2) only where given, so that results repeat."""
    structure, popularity = F.least(F.lit(1.0), headings * F.lit(0.15)), F.least(F.lit(1.0), inlinks / F.lit(10.0))
    return 0.25 * structure + 0.25 * popularity + 0.3 * recency(modified, now) + (0.2 * jitter if jitter is not None else F.lit(0.0))


def total(spaced: Column, rich: Column, recent: Column, varied: Column, hard: Column) -> Column:
    return spaced * WEIGHTS["spaced"] + rich * WEIGHTS["richness"] + recent * WEIGHTS["recency"] + varied * WEIGHTS["variety"] + hard * WEIGHTS["struggle"]


def sample(scored: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n notes: 40 % from the best third, 35 % from the middle, 25 % from the rest, weighted by score without replacement (exponential keys from a seeded hash)."""
    cuts = scored.select(F.percentile_approx("score", [2 / 3, 1 / 3], 10_000).alias("c"))
    banded = scored.crossJoin(F.broadcast(cuts)).withColumn("band", F.when(F.col("score") >= F.col("c")[0], 0).when(F.col("score") >= F.col("c")[1], 1).otherwise(2)).drop("c")
    unit = (F.xxhash64("note_id", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 1) / float(1 << 53)
    key = F.log(unit) / F.greatest("score", F.lit(1e-9))
    first, second = round(n * 0.40), round(n * 0.35)
    keyed = banded.withColumn("_k", key)
    # a bounded heap a task and band instead of a sort of each band in one task
    best = [keyed.where(F.col("band") == b).orderBy(F.desc("_k"), "note_id").limit(k) for b, k in enumerate((first, second, n - first - second))]
    return functools.reduce(DataFrame.unionByName, best).drop("_k")


#: How many questions of each format a quiz has.
MIX = {"multiple-choice": 4, "true-false": 2, "fill-blank": 2, "open-ended": 2}


def question_mix(questions: DataFrame, mix: dict[str, int] | None = None) -> DataFrame:
    """Per quiz the best questions of each format by quality, then the best of the rest up to the total. questions(quiz_id, question_id, format, quality)."""
    mix = mix or MIX
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mix.items() for x in kv]), F.col("format")), F.lit(0))
    first = F.row_number().over(Window.partitionBy("quiz_id", "format").orderBy(F.desc("quality"), "question_id"))
    ranked = questions.withColumn("_extra", first > quota)
    place = F.row_number().over(Window.partitionBy("quiz_id").orderBy("_extra", F.desc("quality"), "question_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= sum(mix.values())).withColumnRenamed("_extra", "backfill")


def stale_questions(cache: DataFrame, notes: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached questions that are over age or whose note has another hash."""
    fresh = cache.where(days_between(now, F.col("created_at")) < days).join(notes.select("note_id", "content_hash"), ["note_id", "content_hash"], "left_semi")
    return cache.join(fresh.select("question_id"), "question_id", "left_anti")


def merge_events(local: DataFrame, remote: DataFrame, key: str = "event_id") -> DataFrame:
    """Union of two logs, one row per id, the local one where both have it; readers order it by time where they need to."""
    both = local.withColumn("_p", F.lit(0)).unionByName(remote.withColumn("_p", F.lit(1)))
    cols = [c for c in local.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*cols), "_p").alias("x")).select(key, "x.*")


def orphans(history: DataFrame, notes: DataFrame) -> DataFrame:
    """History of notes that are gone."""
    return history.join(notes.select("note_id"), "note_id", "left_anti")


def modified_within(notes: DataFrame, now: Column, days: int, ts: str = "modified_at") -> DataFrame:
    return notes.where((days_between(now, F.col(ts)) <= days) & (days_between(now, F.col(ts)) >= 0))


def usage_by_day(usage: DataFrame, budget: int) -> DataFrame:
    """Tokens per day of usage(ts, tokens), running total, whether the day kept to its budget. Days are few, so the running sum is one small task."""
    daily = usage.groupBy(F.to_date("ts").alias("day")).agg(F.sum("tokens").cast("bigint").alias("tokens"))
    return daily.withColumns({"cumulative": F.sum("tokens").over(Window.orderBy("day")), "within_budget": F.col("tokens") <= budget})


def search_notes(notes: DataFrame, words: str) -> DataFrame:
    """Notes whose title holds the words, case aside, or that have them as a tag."""
    return notes.where(F.lower("title").contains(words.lower()) | F.array_contains("tags", words) | F.array_contains("tags", "#" + words))


def days_left(deadline: Column, today: Column) -> Column:
    return F.datediff(deadline, today)
