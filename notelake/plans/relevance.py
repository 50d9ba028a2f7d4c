"""Relevance search: filters, preparation, cache, embedding, top-k, rerank; and the variant without embeddings."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import select
from ..functions.json import scores as json_scores
from ..functions.markdown import prepare
from ..functions.scores import note_band, to_score
from ..functions.text import content_hash, estimate_tokens, preview, truncate, was_truncated
from ..operators.cache import EmbeddingCache, split
from ..operators.search import top_k
from ..session import dropped, stage
from .prompts import SYSTEM
from .providers import ChatProvider, EmbeddingProvider, chat, embed

#: Told (phase, current, total, message) on the driver, while jobs run by a thread that follows them.
Progress = Callable[[str, int, int, str], None]
REASON = "Selected by embedding similarity"
#: What stands before the parts of a goal's text.
GOAL, DESCRIPTION, MILESTONES = "Learning Goal: ", "Description: ", "Milestones: "


def query_text(name: Column, description: Column, milestones: Column) -> Column:
    """The text that a goal is embedded by; milestones only where there are any."""
    head = F.concat(F.lit(GOAL), name, F.lit("\n" + DESCRIPTION), description)
    return F.when(F.size(milestones) > 0, F.concat(head, F.lit("\n" + MILESTONES), F.array_join(milestones, ", "))).otherwise(head)


def silent(phase: str, current: int, total: int, message: str) -> None:
    """Progress that nobody follows."""


@contextlib.contextmanager
def followed(value: Callable[[], int], told: Callable[[int], None], every: float = 0.1):
    """While the body runs, ``told`` hears of every new value: of counters that running tasks of a job move on."""
    ended, last = threading.Event(), value()

    def follow() -> None:
        nonlocal last
        while not ended.wait(every):
            if (now := value()) != last:
                last = now
                told(now)

    thread = threading.Thread(target=follow, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()


@dataclass(frozen=True)
class Draft:
    name: str
    description: str
    milestones: list[str] = field(default_factory=list)

    def text(self) -> str:
        lines = [GOAL + self.name, DESCRIPTION + self.description]
        return "\n".join(lines + ([MILESTONES + ", ".join(self.milestones)] if self.milestones else []))


def prepared(notes: DataFrame, limit: int = 8191) -> DataFrame:
    """(path, content, text, content_hash, estimated_tokens, was_truncated); the hash is the original content's, so that every edit counts."""
    rows = notes.select("path", "content", truncate(prepare(F.col("content")), limit).alias("text"))
    return rows.select("*", content_hash(F.col("content")).alias("content_hash"), estimate_tokens(F.col("text")).alias("estimated_tokens"), was_truncated(F.col("text")).alias("was_truncated"))


def indexed(notes: DataFrame, cached: DataFrame, limit: int = 8191) -> DataFrame:
    """Staged (path, content_hash, from_cache, embedding of hits, text and estimated_tokens of misses, preview): originals are hashed and looked up first, only what the cache misses is prepared."""
    known = split(notes.select("path", "content", content_hash(F.col("content")).alias("content_hash")), cached)
    miss = ~F.col("from_cache")
    rows = known.withColumn("text", F.when(miss, truncate(prepare(F.col("content")), limit)))
    return stage(rows.select("path", "content_hash", "from_cache", "embedding", "text", F.when(miss, estimate_tokens(F.col("text"))).alias("estimated_tokens"), preview(F.col("content")).alias("preview")), "ready")


def vectors_of(ready: DataFrame, provider: EmbeddingProvider, progress: Progress | None = None, live: bool = False) -> tuple[DataFrame, DataFrame]:
    """(path, content_hash, embedding, from_cache, token_count) of indexed notes, hits from the cache, misses from the provider; and what the provider answered, staged, so that no later action or retried stage asks, and pays, again. ``live``: progress also hears of notes as tasks end."""
    said = progress or silent
    total, misses = ready.agg(F.count("*"), F.count_if(~F.col("from_cache"))).first()
    said("indexing", total - misses, total, "notes found in the cache")
    none = F.lit(None).cast("int").alias("token_count")
    done = ready.sparkSession.sparkContext.accumulator(0) if live else None
    with followed(lambda: min(done.value, misses), lambda n: said("indexing", total - misses + n, total, "indexing notes")) if live else contextlib.nullcontext():
        fresh = stage(embed(ready.where("not from_cache"), provider, None, done), "fresh")
    said("indexing", total, total, "notes indexed")
    hits = ready.where("from_cache").select("path", "content_hash", "embedding", "from_cache", none)
    return hits.unionByName(fresh.select("path", "content_hash", "embedding", F.lit(False).alias("from_cache"), "token_count")), fresh


def embedded(notes: DataFrame, cached: DataFrame, provider: EmbeddingProvider, progress: Progress | None = None, live: bool = False) -> DataFrame:
    """(path, content_hash, embedding, from_cache, token_count): hits from the cache, misses from the provider; each step is worked out once and written."""
    return vectors_of(indexed(notes, cached), provider, progress, live)[0]


def merged(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates(path, similarity, preview) with model scores(note_path, score, reason, pos) where given (the last of repeats), else by similarity; unscored ones stay."""
    last = scores.groupBy("note_path").agg(F.max_by(F.struct("score", "reason"), "pos").alias("m"))
    joined = candidates.join(last, candidates["path"] == last["note_path"], "left")
    return joined.select("path", F.coalesce("m.score", to_score(F.col("similarity")).cast("double")).alias("score"), F.coalesce("m.reason", F.lit(REASON)).alias("reason"), "preview")


def by_model_only(notes: DataFrame, scores: DataFrame) -> DataFrame:
    """Notes that the model scored; unscored ones vanish, repeats repeat."""
    return notes.join(scores, notes["path"] == scores["note_path"]).select("path", "score", "reason", preview(F.col("content")).alias("preview"))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), "path")


def autoselected(rows: DataFrame, least: float = 70) -> DataFrame:
    return rows.where(F.col("score") >= least)


def rerank_request(candidates: DataFrame, draft: Draft) -> DataFrame:
    """One request (request_id, system, messages) with the top candidates(path, similarity, preview), best first; none without candidates."""
    one = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.col("preview"))
    text = F.expr("listagg(_t, '\n\n') within group (order by similarity desc, path)")
    held = candidates.withColumn("_t", one).agg(F.count("*").alias("n"), text.alias("notes")).where("n > 0")
    asked = F.concat(F.lit(draft.text() + "\n\nNotes:\n\n"), F.col("notes"))
    return held.select(F.lit(0).alias("request_id"), F.lit(SYSTEM["relevance"]).alias("system"), F.array(F.struct(F.lit("user").alias("role"), asked.alias("content"))).alias("messages"))


def score_notes(notes: DataFrame, cached: DataFrame | EmbeddingCache, provider: EmbeddingProvider, draft: Draft, include: list[str] | None = None, exclude: list[str] | None = None, k: int = 40, model: ChatProvider | None = None, progress: Progress | None = None, now: Column | None = None, live: bool = False) -> DataFrame:
    """The relevance search: path, score, reason, preview, band; best first.

    Include and exclude globs, preparation, cache, provider, top k by cosine; with a chat ``model`` its scores and reasons replace those of the candidates it names. A cache object gets what the
    provider answered; ``progress(phase, current, total, message)`` is called on the driver at every phase, and with ``live`` while notes are embedded. Without notes the result is empty and nobody is asked."""
    said = progress or silent
    chosen = select(notes, include or [], exclude or [])
    writable = isinstance(cached, EmbeddingCache)
    ready = indexed(chosen, cached.get() if writable else cached)
    vectors, fresh = vectors_of(ready, provider, progress, live)
    if writable:
        made = vectors.where("not from_cache")
        if made.head(1):
            cached.set(made.withColumn("created_at", F.current_timestamp() if now is None else now))
    said("searching", 0, 1, "embedding the goal")
    query = provider.embed([draft.text()])[0][0]
    best = stage(top_k(vectors, query, k, "path").join(ready.select("path", "preview"), "path"), "candidates")
    dropped(ready, fresh)
    said("searching", 1, 1, "notes found")
    if model is None:
        found = best.select("path", to_score(F.col("similarity")).cast("double").alias("score"), F.lit(REASON).alias("reason"), "preview")
    else:
        said("explaining", 0, k, "asking the model")
        answer = stage(chat(rerank_request(best, draft), model, "request_id"), "answer")
        found = merged(best, json_scores(answer))
        said("explaining", k, k, "scores given")
    return ranked(found.withColumn("band", note_band(F.col("score"))))


def note_context(path: Column, text: Column) -> Column:
    """One note as part of a prompt."""
    return F.concat(F.lit("### "), path, F.lit("\n"), text)
