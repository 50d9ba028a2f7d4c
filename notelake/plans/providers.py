"""Embedding and chat providers behind protocols; remote calls happen in batches on the executors, with retries. An offline provider is built in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.numbering import numbered
from ..session import prepared
from ..streaming.limits import Limiter

#: Models, their dimensions and prices.
MODELS = [
    ("voyage", "voyage-3.5-lite", 1024, 0.02),
    ("voyage", "voyage-3.5", 1024, 0.06),
    ("openai", "text-embedding-3-small", 1536, 0.02),
    ("openai", "text-embedding-3-large", 3072, 0.13),
]
DEFAULT_COST, DEFAULT_DIMENSIONS = 0.02, 1536


class EmbeddingProvider(Protocol):
    """Picklable; ``embed`` returns a vector and a token count (None: not reported) per text, in order."""

    batch_size: int

    def embed(self, texts: list[str]) -> list[tuple[list[float], int | None]]: ...


class ChatProvider(Protocol):
    def chat(self, messages: list[dict]) -> str: ...


class OfflineEmbeddings:
    """Unit vectors from hashed words: deterministic, for tests and dry runs."""

    def __init__(self, dimensions: int = 64, batch_size: int = 128):
        self.dimensions, self.batch_size = dimensions, batch_size

    def embed(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.dimensions] += 1.0 if h[4] & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append(([x / n for x in v], len(t.split())))
        return out


class LetterEmbeddings:
    """Unit vectors of how often each of the letters stands in a text: simple enough to be worked out in SQL, for dry runs and comparisons."""

    def __init__(self, letters: str = "etaoinsr", batch_size: int = 128):
        self.letters, self.batch_size = letters, batch_size

    def embed(self, texts):
        out = []
        for t in texts:
            v = [float(t.count(c)) for c in self.letters]
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append(([x / n for x in v], None))
        return out


class ScriptedChat:
    """Answers every request with what a function makes of its last message."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def chat(self, messages):
        return self.answer(messages[-1]["content"])


def embed_one(provider: EmbeddingProvider, text: str) -> list[float] | None:
    """The vector of one text, None for a blank one."""
    return with_retries(lambda: provider.embed([text]))[0][0] if text.strip() else None


def retryable(error: Exception) -> bool:
    """429 and server errors, and whatever speaks of the network; client errors never."""
    status = getattr(error, "status", None)
    if status is not None:
        return status == 429 or status >= 500
    return "network" in str(error).lower()


def with_retries(call: Callable, attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The result of a call, tried again after base * 2 ** attempt seconds while its error is worth it."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as e:
            if attempt + 1 == attempts or not retryable(e):
                raise
            sleep(base * 2**attempt)


def mapped_error(status: int | None) -> str:
    return {401: "invalid API key", 403: "access denied", 404: "not found", 429: "rate limit exceeded"}.get(status or 0, "server error" if status and status >= 500 else "request failed")


def embed(rows: DataFrame, provider: EmbeddingProvider, parallelism: int | None = None, done: Accumulator | None = None) -> DataFrame:
    """(path, content_hash, embedding, token_count) of prepared rows(path, content_hash, text, estimated_tokens); blank texts give no row.

    Batches are cut over the whole input: rows are numbered first, then a batch's rows come together in one task, so that the provider is called ceil(rows / batch_size) times, but for retries. A task holds one batch.
    ``done`` counts texts as tasks end."""
    prepared(rows.sparkSession)
    rows = rows.where(~is_blank(F.col("text"))).select("path", "content_hash", "text", "estimated_tokens")
    rows = numbered(rows, "_row").withColumn("_batch", F.floor(F.col("_row") / provider.batch_size))
    # a stated number, so that adaptive execution does not put few, slow calls into one task
    rows = rows.repartition(parallelism or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_batch").sortWithinPartitions("_batch", "_row")

    def answered(part: pd.DataFrame) -> pd.DataFrame:
        got = with_retries(lambda: provider.embed(part["text"].tolist()))
        if len(got) != len(part):
            raise ValueError("the provider answered another number of texts")
        tokens = [int(e) if n is None else int(n) for (_, n), e in zip(got, part["estimated_tokens"], strict=True)]
        if done is not None:
            done.add(len(part))
        return pd.DataFrame({"path": part["path"].values, "content_hash": part["content_hash"].values, "embedding": [v for v, _ in got], "token_count": tokens})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            for batch, part in f.groupby("_batch", sort=True):
                if held and held[0]["_batch"].iloc[0] != batch:
                    yield answered(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield answered(pd.concat(held))

    return rows.mapInPandas(run, "path string, content_hash string, embedding array<float>, token_count int")


def chat(requests: DataFrame, provider: ChatProvider, key: str, attempts: int = 3, base: float = 1.0, most: int | None = None, seconds: float = 60.0, tasks: int = 1) -> DataFrame:
    """(key, response, error) of requests(key, system, messages): one call a row, with retries; a failed call is a message, not a failed query.

    With ``most``, no more calls than that are made in any ``seconds``, retries included: requests go to ``tasks`` tasks, each of which waits for one of its most / tasks slots before a call."""
    prepared(requests.sparkSession)
    kind = dict(requests.dtypes)[key]
    if most is not None:
        if most < tasks:
            raise ValueError("every task needs a slot")
        requests = requests.repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Limiter(most // tasks, seconds) if most is not None else None

        def ask(said: list[dict]) -> str:
            if slots:
                slots.wait()
            return provider.chat(said)

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                said = [{"role": "system", "content": r.system}] * bool(r.system) + [{"role": m["role"], "content": m["content"]} for m in r.messages]
                try:
                    out.append((with_retries(lambda m=said: ask(m), attempts, base), None))
                except Exception as e:
                    out.append((None, mapped_error(getattr(e, "status", None))))
            yield pd.DataFrame({key: f[key].values, "response": [a for a, _ in out], "error": [b for _, b in out]})

    return requests.select(key, "system", "messages").mapInPandas(run, f"{key} {kind}, response string, error string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "provider string, model string, dims int, usd_per_mtok double")


def priced(usage: DataFrame) -> DataFrame:
    """usage(model, tokens, ...) with price, dimensions (defaults for unknown models) and cost."""
    known = F.broadcast(models(usage.sparkSession).select("model", "dims", "usd_per_mtok"))  # a literal table of a few rows
    out = usage.join(known, "model", "left").withColumn("usd_per_mtok", F.coalesce("usd_per_mtok", F.lit(DEFAULT_COST))).withColumn("dims", F.coalesce("dims", F.lit(DEFAULT_DIMENSIONS)))
    return out.withColumn("cost", F.col("tokens") / 1_000_000 * F.col("usd_per_mtok"))
