"""The link graph: resolving wiki links to notes, counts, backlinks and tags. ``notes(seq, path, content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import links, tags


def basename(c):
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^/.]+\z", "")


def folder(c):
    return F.regexp_replace(c, r"/?[^/]*\z", "")


def resolve(raw: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, link, target) of ``raw(source, link)``: by path, then path with .md, then base name (the shortest path, then the first listed); others dropped."""
    paths = notes.select(F.col("path").alias("p")).distinct()
    names = notes.groupBy(basename(F.col("path")).alias("b")).agg(F.min_by("path", F.struct(F.length("path"), "seq")).alias("by_name"))
    wanted = raw.select("link").distinct()
    found = wanted.join(paths.toDF("exact"), F.col("link") == F.col("exact"), "left").join(paths.toDF("with_md"), F.concat("link", F.lit(".md")) == F.col("with_md"), "left").join(names, F.col("link") == F.col("b"), "left")
    return raw.join(found.select("link", F.coalesce("exact", "with_md", "by_name").alias("target")).where("target is not null"), "link").select("source", "link", "target")


def raw_links(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("source"), F.explode(links(F.col("content"))).alias("link"))


def resolved(notes: DataFrame) -> DataFrame:
    """(source, target, n): links of one note are distinct, so n counts spellings."""
    return resolve(raw_links(notes), notes).groupBy("source", "target").agg(F.count("*").alias("n"))


def backlinks(edges: DataFrame, target: str | None = None) -> DataFrame:
    """(target, source) of resolved links, of one note or of all."""
    found = edges.select("target", "source").distinct()
    return found if target is None else found.where(F.col("target") == target)


def inlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.count_distinct("source").alias("n_sources"), F.sum("n").alias("n_links"))


def all_tags(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode(tags(F.col("content"))).alias("tag")).distinct()
