"""Markdown trees as tables, and a JSON key-value store as a folder of Parquet or JSON values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linkgraph import basename, folder
from ..session import exists, replace_partitions

HIDDEN = r"(^|/)(\.[^/]*|node_modules)(/|\z)"


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """notes(path, basename, folder, modified_at, created_at, content) of all *.md under ``root``, hidden entries and node_modules left out at every level. Spark knows no birth time: created_at is null."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    base = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    path = F.url_decode(F.replace(F.substring_index("file_path", base, -1), F.lit("+"), F.lit("%2B")))
    rows = raw.select(path.alias("path"), F.col("file_modification_time").alias("modified_at"), F.col("value").alias("content"))
    return rows.where(~F.col("path").rlike(HIDDEN)).select("path", basename(F.col("path")).alias("basename"), folder(F.col("path")).alias("folder"), "modified_at", F.lit(None).cast("timestamp").alias("created_at"), "content")


def existing(paths: DataFrame, notes: DataFrame) -> DataFrame:
    """Paths that are notes."""
    return paths.join(notes.select("path"), "path", "left_semi")


def write_notes(notes: DataFrame, location: str, by: str | None = None) -> None:
    """A notes table, partitioned by a column so that rewriting one value leaves others alone."""
    w = notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).parquet(location)


def create(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Notes with new ones; paths that exist stay as they are."""
    return table.unionByName(rows.join(table.select("path"), "path", "left_anti"), allowMissingColumns=True)


def modify(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Content replaced by rows(path, content); a path that is missing is an error when the rows are read."""
    new = rows.select("path", F.col("content").alias("_c"), F.lit(True).alias("_n"))
    joined = table.withColumn("_t", F.lit(True)).join(new, "path", "full_outer")
    content = F.when(F.col("_t").isNull(), F.raise_error(F.concat(F.lit("no such note: "), "path")).cast("string")).when(F.col("_n"), F.col("_c")).otherwise(F.col("content"))
    return joined.withColumn("content", content).select(table.columns)


def delete(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path"), "path", "left_anti")


def delete_folder(table: DataFrame, name: str) -> DataFrame:
    return table.where(~F.col("path").startswith(name.rstrip("/") + "/"))


class KeyValueStore:
    """JSON values by key as a Parquet table (key, value), dealt into partitions by key, of which a write rewrites one; values that are not JSON read as null."""

    def __init__(self, spark: SparkSession, location: str, partitions: int = 64):
        self.spark, self.location, self.partitions = spark, location, partitions

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.partitions)).cast("int").alias("part")

    def _all(self) -> DataFrame:
        kind = "key string, value string, part int"
        return self.spark.read.schema(kind).parquet(self.location).where("key is not null") if exists(self.spark, self.location) else self.spark.createDataFrame([], kind)

    def entries(self) -> DataFrame:
        """(key, value) with values that are no JSON as null."""
        return self._all().select("key", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("value"))

    def read(self, key: str):
        """The value as a Python object, None where it is missing or corrupt."""
        row = self._all().where((F.col("key") == key) & (F.col("part") == self._part_of(key))).first()
        try:
            return None if row is None else json.loads(row.value)
        except ValueError:
            return None

    def _part_of(self, key: str) -> int:
        return self.spark.range(1).select(F.lit(key).alias("key")).select(self._part()).first()[0]

    def put(self, rows: DataFrame) -> None:
        """Upsert rows(key, value), one for each key."""
        new = rows.select("key", "value", self._part())
        self._replace(new.select("part").distinct(), new.select("key"), new)

    def remove(self, keys: DataFrame) -> None:
        self._replace(keys.select(self._part()).distinct(), keys.select("key"), None)

    def _replace(self, parts: DataFrame, gone: DataFrame, new: DataFrame | None) -> None:
        rows = self._all().join(F.broadcast(parts), "part", "left_semi").join(gone, "key", "left_anti").select("key", "value", "part")  # at most so many rows as partitions are broadcast
        none = parts.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "part")  # a partition without rows is replaced too
        replace_partitions((rows.unionByName(new) if new is not None else rows).unionByName(none), self.location, "part")

    def write(self, key: str, value) -> None:
        self.put(self.spark.createDataFrame([(key, json.dumps(value, ensure_ascii=False))], "key string, value string"))

    def delete(self, key: str) -> None:
        self.remove(self.spark.createDataFrame([(key,)], "key string"))

    def exists(self, key: str) -> bool:
        return bool(self._all().where((F.col("key") == key) & (F.col("part") == self._part_of(key))).head(1))

    def keys(self) -> DataFrame:
        return self._all().select("key")

    def clear(self) -> None:
        self.remove(self.keys())


def readable(paths: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes of ``paths(path)``; one that does not exist is an error when the rows are read."""
    there = notes.withColumn("_there", F.lit(True))
    found = paths.join(there, "path", "left")
    missing = F.raise_error(F.concat(F.lit("no such note: "), F.coalesce("path", F.lit("null")))).cast("boolean")
    return found.where(F.coalesce("_there", missing)).select(notes.columns)
