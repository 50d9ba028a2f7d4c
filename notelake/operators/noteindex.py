"""Search of notes by an index of grams: titles by what they hold, tags by name, kept up to date by mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, exists, replace_partitions, stage
from .review import search_notes

#: Characters of the longest grams; words of fewer are looked up as they are.
GRAM = 3
SCHEMA = "gram string, path string, title string, tags array<string>, part int"


def grams(text: Column) -> Column:
    """Distinct runs of 1 to GRAM characters."""

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(runs, range(1, GRAM + 1)))))


def asked(words: str) -> list[str]:
    """The grams that a title with the words has to have: the longest ones."""
    low = words.lower()
    return sorted({low[i : i + GRAM] for i in range(max(1, len(low) - GRAM + 1))}) if low else []


class NoteIndex:
    """Postings (gram, note) of notes(path, title, tags) as a Parquet table dealt into partitions by path, sorted by gram within: a mutation rewrites the partitions of its notes, a search reads the row groups of its grams.

    A tag is a posting of its own (``#`` in front, as no title's gram is longer than GRAM). Searches return the rows of ``search_notes``: candidates have all grams of the words and are verified. Notes without a path are left out; a path names one note."""

    def __init__(self, spark: SparkSession, location: str, partitions: int = 16):
        self.spark, self.location, self.partitions = spark, location, partitions

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.partitions)).cast("int").alias("part")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.location) if exists(self.spark, self.location) else self.spark.createDataFrame([], SCHEMA)

    def put(self, notes: DataFrame) -> None:
        """Add notes, or replace those there are."""
        new = notes.where("path is not null").select("path", "title", F.col("tags").cast("array<string>").alias("tags"), self._part())
        tags = F.transform(F.coalesce(F.array_compact("tags"), F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t))
        keys = F.array_distinct(F.concat(F.coalesce(grams(F.lower("title")), F.array().cast("array<string>")), tags, F.array(F.lit(""))))  # every note has the empty gram
        self._replace(new.select("path", "part").distinct(), new.select(F.explode(keys).alias("gram"), "path", "title", "tags", "part"))

    def remove(self, paths: DataFrame) -> None:
        self._replace(paths.where("path is not null").select("path", self._part()).distinct(), None)

    def _replace(self, gone: DataFrame, new: DataFrame | None) -> None:
        parts = gone.select("part").distinct()
        kept = self._all().where("path is not null").join(F.broadcast(parts), "part", "left_semi").join(gone.select("path"), "path", "left_anti").select("gram", "path", "title", "tags", "part")  # at most as many rows as partitions are broadcast
        none = parts.select(*[F.lit(None).cast(t).alias(n) for n, t in (("gram", "string"), ("path", "string"), ("title", "string"), ("tags", "array<string>"))], "part")  # a partition without notes is replaced too
        rows = kept.unionByName(new) if new is not None else kept
        held = stage(rows.unionByName(none), "postings")
        replace_partitions(held.repartition("part").sortWithinPartitions("part", "gram"), self.location, "part")
        dropped(held)

    def search(self, words: str) -> DataFrame:
        """(path, title, tags) of the notes whose title holds the words, case aside, or that have them as a tag."""
        rows, found = self._all(), asked(words)
        named = rows.where(F.col("gram").isin(f"tag:{words}", f"tag:#{words}")).select("path", "title", "tags")
        if found:
            # a note is a row for each gram; those that lack one of the words' grams are left before any is compared
            titled = rows.where(F.col("gram").isin(found)).groupBy("path").agg(F.count("*").alias("n"), F.first("title").alias("title"), F.first("tags").alias("tags")).where(F.col("n") == len(found)).select("path", "title", "tags")
        else:
            titled = rows.where("gram = ''").select("path", "title", "tags")
        return search_notes(titled.unionByName(named).dropDuplicates(["path"]), words)
