"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is 10 consecutive words of a benchmark item, or all words of an item that has fewer. A
document's words inside any occurrence of a window are hit.

Of each run of 10 words the least hash of its six 5-grams is kept: its fingerprint depends on those words alone, so every shared window has the same fingerprint on both sides (the guarantee
of winnowing with k = 5 and six grams a window). Steps:

1. the benchmark's distinct windows with their fingerprints, and a bit map of these of at most 2 MB;
2. documents' fingerprints, by array functions within the row; those outside the bit map are left at once, the others are exploded with their window: hits are extended to the whole window;
3. a join by fingerprint and window, both plain shuffles, so that adaptive execution can split a passage that a third of all documents hold;
4. overlapping windows become spans, by text: copies of a text share their spans, and rows meet them by two 64-bit hashes of the text.

Items of fewer than 10 words have a window length of their own, with all its grams in one fingerprint; documents are read once for each length that occurs (10 at most).

null, empty texts and texts without words have no words and no spans; an item without words has no windows. Items with a null item_id mark words and are not named. Repeated rows and rows with
a null doc_id are rows of their own; repeated items are one. Windows that are no longer than one word are compared like all others. Extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, prepared, stage, table

#: Words of a window, and of the grams whose least hash is its fingerprint.
WINDOW, GRAM = 10, 5
#: 64-bit words of the bit map of fingerprints, at most (2 MB); a full map only costs work.
MOST_CELLS, LEAST_CELLS = 1 << 18, 1 << 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: what stands between words once A-Z are lower-cased; and a word in a text as it is.
BETWEEN, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; ``lower`` is quick but knows more letters than A-Z, so it is for ASCII texts."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, BETWEEN), "")


def fingerprinted(rows: DataFrame, size: int) -> DataFrame:
    """Rows with ``words`` and, as ``prints``, the fingerprint of each run of ``size`` words: the least hash of its grams."""
    gram = min(GRAM, size)
    later = lambda c, i, n: [F.get(F.col(c), i + k) for k in range(1, n)]
    out = rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    if gram > 1:
        out = out.withColumn("_h", F.transform("_h", lambda x, i: F.xxhash64(x, *later("_h", i, gram))))
    if size > gram:
        out = out.withColumn("_h", F.transform("_h", lambda x, i: F.least(x, *later("_h", i, size - gram + 1))))
    starts = F.greatest(F.size("words") - F.lit(size - 1), F.lit(0))
    return out.withColumn("prints", F.slice("_h", F.lit(1), starts)).drop("_h")


def windows(rows: DataFrame, size: int, keys: list[str], cells: DataFrame | None = None, number: int = 0) -> DataFrame:
    """(keys, size, start, print, window) of every run of ``size`` words of rows(keys, words), or of those whose fingerprint the bit map ``cells`` of ``number`` words has."""
    made = fingerprinted(rows.select(*keys, "words"), size)
    if cells is not None:
        made = made.crossJoin(F.broadcast(cells))  # one row of at most MOST_CELLS numbers
    # the outer form: for the inner one Spark would infer a filter on the fingerprints and work them out once more, within themselves
    each = made.select(*keys, "words", *(["cells"] if cells is not None else []), F.posexplode_outer("prints").alias("start", "print")).where("print is not null")
    if cells is not None:
        each = each.where(F.expr(f"(shiftrightunsigned(cells[cast(shiftrightunsigned(print, 6) & {number - 1} as int)], cast(print & 63 as int)) & 1L) = 1L"))
    return each.select(*keys, F.lit(size).alias("size"), F.col("start").cast("bigint").alias("start"), "print", F.array_join(F.slice("words", F.col("start") + 1, F.lit(size)), " ").alias("window"))


def bit_map(prints: DataFrame) -> tuple[DataFrame, int]:
    """One row with ``cells``, an array of 64-bit words that has the bit of each fingerprint set, as a staged table; and their number, from the number of rows, within bounds."""
    number = 1 << max(LEAST_CELLS.bit_length() - 1, min(MOST_CELLS.bit_length() - 1, (prints.count() // 4).bit_length()))
    bits = prints.select(F.expr(f"shiftrightunsigned(print, 6) & {number - 1}").alias("id"), F.expr("shiftleft(1L, cast(print & 63 as int))").alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    every = prints.sparkSession.range(number).join(bits, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))
    one = every.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("x"))  # bounded by MOST_CELLS
    return stage(one.select(F.transform("x", lambda x: x["b"]).alias("cells")), "cells"), number


def passages(benchmark: DataFrame) -> DataFrame:
    """(size, print, window, item_id) of the distinct windows of benchmark(item_id, text), as a staged table."""
    items = stage(benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # at most WINDOW numbers
    parts = [windows(items if n == WINDOW else items.where(F.size("words") == n), n, ["item_id"]) for n in sorted(lengths)]
    if not parts:
        parts = [windows(items, WINDOW, ["item_id"])]
    out = stage(reduce(DataFrame.unionAll, parts).select("size", "print", "window", "item_id").distinct(), "passages")
    dropped(items)
    return out


def spans_of(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans: array<struct<start, length>> in order) of hits(keys, start, size), overlapping and adjacent ones as one."""
    by = Window.partitionBy(*keys).orderBy("start", "size")
    upto = F.max(F.col("start") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_upto"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    one = hits.withColumn("_upto", upto).withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length")))).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs(doc_id, text): spans of hit words, and the item_ids (as strings, sorted) of benchmark(item_id, text) whose windows occur."""
    prepared(docs.sparkSession)
    wanted = passages(benchmark)
    cells, number = bit_map(wanted.select("print").distinct())
    lengths = [r[0] for r in wanted.select("size").distinct().collect()]  # at most WINDOW numbers
    # windows of the same items are one class, so that documents meet sets of items and not each window's items
    item = F.col("item_id")
    classed = wanted.groupBy("size", "print", "window").agg(F.bit_xor(F.xxhash64(item)).alias("c1"), F.bit_xor(F.xxhash64(F.lit(1), item)).alias("c2"))
    classed = stage(classed, "windows")
    sample = classed.groupBy("c1", "c2").agg(F.min(F.struct("size", "print", "window")).alias("w"))
    named = stage(sample.select("c1", "c2", "w.*").join(wanted, ["size", "print", "window"]).where("item_id is not null").select("c1", "c2", F.col("item_id").cast("string").alias("item_id")), "named")
    # a text's two hashes stand for it; rows without text get a place of their own, so that they do not meet in one task
    digest = [F.coalesce(F.xxhash64(F.lit(k), F.when(F.col("text").isNotNull(), F.col("text"))), F.lit(0)) for k in (1, 2)]
    texts = docs.where("text is not null").select(digest[0].alias("d1"), digest[1].alias("d2"), words_of(F.col("text")).alias("words"))
    found = [windows(texts, n, ["d1", "d2"], cells, number).join(classed.where(F.col("size") == n).drop("size"), ["print", "window"]).select("d1", "d2", "start", "size", "c1", "c2") for n in sorted(lengths)]
    each = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"), *[F.when(F.col("text").isNull(), F.xxhash64(F.lit(k), F.rand(7))).otherwise(d).alias(n) for k, d, n in zip((3, 4), digest, ("d1", "d2"), strict=True)])
    none = [F.array().cast("array<struct<start:bigint,length:bigint>>"), F.array().cast("array<string>")]
    if not found:
        dropped(wanted, cells, classed, named)
        return each.select("doc_id", "n_words", none[0].alias("spans"), none[1].alias("items"))
    hits = stage(reduce(DataFrame.unionAll, found), "hits")
    spans = spans_of(hits.select("d1", "d2", "start", "size").distinct(), ["d1", "d2"])
    items = hits.select("d1", "d2", "c1", "c2").distinct().join(named, ["c1", "c2"]).select("d1", "d2", "item_id").distinct()
    items = items.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    # written, so that both sides of the last join are plain shuffles and a text of very many copies can be split
    told = stage(spans.join(items, ["d1", "d2"], "left"), "told")
    dropped(wanted, cells, classed, named, hits)
    return each.join(told, ["d1", "d2"], "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """Rows of ``docs`` of whose words at most the share ``most`` is hit; rows of one doc_id go together, rows without doc_id stay, as no decision can name them."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["length"])
    gone = contamination(docs, benchmark).where(hit > F.lit(most) * F.col("n_words")).where("doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(stage(gone, "gone"), "doc_id", "left_anti").select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of ``documents`` that lie in windows of ``benchmark``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), wi AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)
), wd AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM wi) WHERE len(ws) >= k)
), hit AS (SELECT DISTINCT doc_id, item_id, k, i FROM wd JOIN wi USING (k, win)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.j, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
