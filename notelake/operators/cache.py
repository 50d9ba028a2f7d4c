"""The embedding cache: one Parquet table keyed by path, provider and model, dealt into partitions by path; content hashes decide what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, replace_partitions

SCHEMA = "path string, content_hash string, embedding array<float>, provider string, model string, created_at timestamp, token_count int"
#: Partitions of a new cache; a write rewrites those that hold its paths. A parameter of the cache, to be chosen once for a table.
PARTITIONS = 64


class EmbeddingCache:
    """Reads and writes a cache table for one provider and model; entries of others are never returned."""

    def __init__(self, spark: SparkSession, location: str, provider: str, model: str, partitions: int = PARTITIONS):
        self.spark, self.location, self.provider, self.model, self.partitions = spark, location, provider, model, partitions

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.partitions)).cast("int").alias("part")

    def _all(self) -> DataFrame:
        if not exists(self.spark, self.location):
            return self.spark.createDataFrame([], SCHEMA + ", part int")
        return self.spark.read.schema(SCHEMA + ", part int").parquet(self.location)

    def _mine(self) -> Column:
        return (F.col("provider") == self.provider) & (F.col("model") == self.model)

    def _replace(self, parts: DataFrame, rows: DataFrame) -> None:
        """The touched partitions (column part) with new rows; a partition left without rows keeps a row of nobody's, so that it is replaced too."""
        none = parts.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self._all().schema if f.name != "part"], "part").distinct()
        replace_partitions(rows.unionByName(none), self.location, "part")

    def get(self) -> DataFrame:
        return self._all().where(self._mine()).drop("part")

    def has(self, paths: DataFrame) -> DataFrame:
        """Paths with an entry."""
        return paths.join(self.get().select("path"), "path", "left_semi")

    def set(self, rows: DataFrame) -> None:
        """Upsert (path, content_hash, embedding, token_count, created_at); the latest of a path wins."""
        new = rows.select("path", "content_hash", "embedding", F.lit(self.provider).alias("provider"), F.lit(self.model).alias("model"), "created_at", F.col("token_count").cast("int").alias("token_count"), self._part())
        parts = new.select("part").distinct()
        every = self._all().where("path is not null").join(F.broadcast(parts), "part", "left_semi").unionByName(new)  # at most PARTITIONS rows are broadcast
        best = every.groupBy("path", "provider", "model", "part").agg(F.max_by(F.struct("content_hash", "embedding", "created_at", "token_count"), F.struct("created_at", "content_hash")).alias("x"))
        self._replace(parts, best.select("path", "x.content_hash", "x.embedding", "provider", "model", "x.created_at", "x.token_count", "part"))

    def invalidate(self, paths: DataFrame) -> None:
        parts = paths.select(self._part()).distinct()
        gone = paths.select("path", F.lit(self.provider).alias("provider"), F.lit(self.model).alias("model"))
        self._replace(parts, self._all().where("path is not null").join(F.broadcast(parts), "part", "left_semi").join(gone, ["path", "provider", "model"], "left_anti"))

    def clear(self) -> None:
        if exists(self.spark, self.location):
            self._replace(self._all().where(self._mine()).select("part").distinct(), self._all().where(~self._mine()))

    def paths(self) -> DataFrame:
        return self.get().select("path")

    def stats(self) -> DataFrame:
        """Entries, their tokens, and partitions that hold any."""
        return self._all().where(self._mine()).agg(F.count("*").alias("entries"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.countDistinct("part").alias("chunks"))


def split(prepared: DataFrame, cached: DataFrame) -> DataFrame:
    """Every prepared note with from_cache and, on a hit, the stored embedding."""
    held = cached.select("path", "content_hash", "embedding", F.lit(True).alias("hit"))
    return prepared.join(held, ["path", "content_hash"], "left").withColumn("from_cache", F.coalesce("hit", F.lit(False))).drop("hit")


def changed(prepared: DataFrame, cached: DataFrame) -> DataFrame:
    """Notes to embed: no entry with their path and hash."""
    return prepared.join(cached, ["path", "content_hash"], "left_anti")


def stats(rows: DataFrame, batch: int, usd_per_million: float) -> DataFrame:
    """Hits, misses, notes, tokens of misses, API calls and cost of ``rows(from_cache, estimated_tokens)``."""
    miss = ~F.col("from_cache")
    out = rows.agg(F.count_if("from_cache").alias("hits"), F.count_if(miss).alias("misses"), F.count("*").alias("notes"), F.coalesce(F.sum(F.when(miss, F.col("estimated_tokens"))), F.lit(0)).alias("tokens"))
    return out.withColumn("api_calls", F.ceil(F.col("misses") / batch).cast("bigint")).withColumn("cost", F.col("tokens") / 1_000_000 * F.lit(usd_per_million))
