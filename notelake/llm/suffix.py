"""Deduplication by sparse suffix arrays.

A passage repeats when 50 consecutive words (byte for byte, white space aside) occur at two places. Of all suffixes only those at minimisers are kept: of each
50-word window, the place of its least 10-word hash, which depends on the window's content alone, so equal windows keep equal suffixes. Suffixes whose
10 words occur once are dropped; the others are sorted (their words behind the minimiser), neighbours' common prefixes cut the order into intervals for
every length, and within an interval equal words to the left extend the match. Each window is then matched with its first occurrence in the order
(doc_id, place), and adjacent windows with the same source and distance become one span.

Suffixes that occur more than HOT times would fill one task; their windows are compared by hashes of all 50 words instead: occurrences are dealt into parts at random, each part
knows its distinct windows and their first occurrences, and only these meet across parts; results are the same. Documents with the same words are one class and are searched once. The result has one row per span that repeats an earlier place: documents
without repeats do not appear. Words are compared by 64-bit hashes, each word of a window by its own.

null, empty and short texts (under 50 words) never match. Rows with a null doc_id are left out. Repeated rows (same doc_id, same text) are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, mapped, partitions, prepared, released, slices, stage, table, utf8
from .filters import passed
from .kernels import U, gram_hashes, mix, word_hashes, words

LENGTH, GRAM = 50, 10
#: Starts of windows over which a minimiser is taken, and words of a window beside the minimiser.
SPREAD = LENGTH - GRAM
#: Occurrences of one suffix that are sorted together, and rows that are sorted at once, about: 10 MB of words around them.
HOT = CHUNK = 20_000
#: Occurrences of hot suffixes whose windows are told apart in one task before they meet those of others.
PART = 500
MATCH = "doc_id bigint, low bigint, high bigint, source bigint, distance bigint"


def minimisers(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window (by its first word, in ``starts``) the place of its least gram, the leftmost of equals."""
    at, width = np.arange(len(grams)), 1
    while 2 * width <= SPREAD + 1:
        left, right = at[:-width], at[width:]
        at, width = np.where(grams[left] <= grams[right], left, right), 2 * width
    left, right = at[starts], at[starts + SPREAD + 1 - width]
    return np.where(grams[left] <= grams[right], left, right)


def window_starts(first: np.ndarray) -> np.ndarray:
    """First words of all windows of texts whose word bounds are ``first``."""
    count = np.maximum(np.diff(first) - LENGTH + 1, 0)
    return np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def outlines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, class, keys, places): a fingerprint of the word sequence, and the minimisers with their hashes."""

    def kernel(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column("text"))
        starts, ends, first = words(data, offsets)
        h, n = word_hashes(data, starts, ends), np.diff(first)
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        total = np.concatenate([[U(0)], np.cumsum(mix(h + mix(place.astype(np.uint64))), dtype=np.uint64)])
        grams, starts = gram_hashes(h, GRAM), window_starts(first)
        at = np.unique(minimisers(grams, starts)) if len(starts) else starts
        cut = pa.array(np.searchsorted(at, first), pa.int32())
        owner = np.searchsorted(first, at, "right") - 1
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": n,
            "class": mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(np.uint64)).view(np.int64),
            "keys": pa.ListArray.from_arrays(cut, pa.array(grams[at].view(np.int64) if len(at) else np.zeros(0, np.int64))),
            "places": pa.ListArray.from_arrays(cut, pa.array((at - first[owner]).astype(np.int32) if len(at) else np.zeros(0, np.int32))),
        }

    return mapped(docs, kernel, "doc_id bigint, n_words bigint, class bigint, keys array<bigint>, places array<int>", "text")


def suffixes(texts: DataFrame) -> DataFrame:
    """Repeated suffixes of ``texts(doc_id, text, places, hot)`` (places in order).

    A row: key, doc_id, place, low and high (how far left of the minimiser its windows begin), left and right (64-bit word hashes, outward from the minimiser). Of hot
    suffixes, a row with the place of its first window as place, the windows' hashes one after the other as left, and low null."""

    def kernel(batch: pa.RecordBatch) -> dict | None:
        data, offsets = utf8(batch.column("text"))
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        grams, starts = gram_hashes(h, GRAM), window_starts(first)
        if not len(starts):
            return None
        at = minimisers(grams, starts)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        size = np.diff(np.append(new, len(at)))
        spot, begin = at[new], starts[new]
        owner = np.searchsorted(first, begin, "right") - 1
        wanted, hot = {}, {}
        for i, (p, q) in enumerate(zip(batch.column("places"), batch.column("hot"), strict=True)):
            p, q = p.values.to_numpy() + first[i], q.values.to_numpy(zero_copy_only=False)
            wanted[i], hot[i] = p, p[q]
        named = np.isin(spot, np.concatenate([*wanted.values()])) if wanted else np.zeros(len(spot), bool)
        is_hot = np.isin(spot, np.concatenate([*hot.values()])) if hot else named
        ids = np.asarray(batch.column("doc_id"))
        plain = np.flatnonzero(named & ~is_hot)
        high = spot[plain] - begin[plain]
        low = high - size[plain] + 1
        left = [h[s - k : s][::-1].tobytes() for s, k in zip(spot[plain], high, strict=True)]
        right = [h[s + GRAM : s + LENGTH - k].tobytes() for s, k in zip(spot[plain], low, strict=True)]
        boiling = np.flatnonzero(named & is_hot)
        hashes = gram_hashes(h, LENGTH) if len(boiling) else grams
        pad = [None] * len(boiling)
        return {
            "key": np.concatenate([grams[spot[plain]], grams[spot[boiling]]]).view(np.int64),
            "doc_id": np.concatenate([ids[owner[plain]], ids[owner[boiling]]]),
            "place": np.concatenate([spot[plain] - first[owner[plain]], begin[boiling] - first[owner[boiling]]]),
            "low": pa.array([*low.tolist(), *pad], pa.int32()),
            "high": pa.array([*high.tolist(), *pad], pa.int32()),
            "left": pa.array([*left, *(hashes[begin[k] : begin[k] + size[k]].tobytes() for k in boiling)], pa.binary()),
            "right": pa.array([*right, *pad], pa.binary()),
        }

    return mapped(texts, kernel, "key bigint, doc_id bigint, place bigint, low int, high int, left binary, right binary", "text")


def _matrix(blobs: list, width: int) -> np.ndarray:
    """Rows of 64-bit words, filled with zeros to ``width``."""
    size = np.array([len(b) // 8 for b in blobs], np.int64)
    out = np.zeros((len(blobs), width), np.uint64)
    out[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(blobs), np.uint64)
    return out


def sorted_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``matches_of`` over the rows of a partition that come ordered by key, CHUNK rows and whole keys at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield from matches_of(t.slice(0, whole))
                held = t.slice(whole).to_batches()
    if held:
        yield from matches_of(pa.Table.from_batches(held))
    released()


def matches_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """All suffixes of some keys -> (doc_id, low, high, source, distance): windows whose first words are low..high begin ``distance`` words after those of their first occurrence."""
    key, doc, place, low, high = (t.column(n).to_numpy() for n in ("key", "doc_id", "place", "low", "high"))
    left, right = _matrix(t.column("left").to_pylist(), SPREAD), _matrix(t.column("right").to_pylist(), SPREAD)
    order = np.lexsort((*[right[:, k] for k in range(SPREAD - 1, -1, -1)], key))
    key, doc, place, low, high, left, right = (x[order] for x in (key, doc, place, low, high, left, right))
    same = np.cumprod(right[1:] == right[:-1], axis=1).sum(1) if len(key) > 1 else np.zeros(0, np.int64)
    same[key[1:] != key[:-1]] = -1
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((place, doc))] = np.arange(len(key))
    to_left, out = np.full(len(key), U(7)), []
    for back in range(SPREAD + 1):
        if back:
            to_left = mix(to_left + left[:, back - 1])
        use = np.flatnonzero((low <= back) & (back <= high))
        if len(use) < 2:
            continue
        interval = np.concatenate([[0], np.cumsum(same < SPREAD - back)])[use]
        by = np.lexsort((rank[use], to_left[use], interval))
        use, interval = use[by], interval[by]
        head = np.concatenate([[True], (interval[1:] != interval[:-1]) | (to_left[use][1:] != to_left[use][:-1])])
        source = use[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = (doc[source] != doc[use]) | (place[source] != place[use])
        if later.any():
            u, s = use[later], source[later]
            out.append((doc[u], place[u] - back, doc[s], place[u] - place[s]))
    if not out:
        return
    d, s, f, gap = (np.concatenate(x) for x in zip(*out, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans_of(d, s, f, gap)], ["doc_id", "low", "high", "source", "distance"])


def windows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, doc_id and first word of every window of hot rows."""
    blobs = t.column("left").to_pylist()
    size = np.array([len(b) // 8 for b in blobs])
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.frombuffer(b"".join(blobs), np.int64), np.repeat(t.column("doc_id").to_numpy(), size), np.repeat(t.column("place").to_numpy(), size) + within


def spans_of(doc: np.ndarray, start: np.ndarray, source: np.ndarray, distance: np.ndarray) -> list[np.ndarray]:
    """Runs of adjacent windows with one source and distance: doc_id, low, high, source, distance."""
    order = np.lexsort((start, distance, source, doc))
    doc, start, source, distance = (x[order] for x in (doc, start, source, distance))
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (distance[1:] != distance[:-1]) | (start[1:] > start[:-1] + 1)])) if len(doc) else doc
    return [doc[new], start[new], start[np.append(new[1:], len(doc)) - 1] if len(doc) else start, source[new], distance[new]]


def hot_matches(rows: DataFrame) -> DataFrame:
    """Matches (MATCH) of windows of hot ``rows(doc_id, place, left)`` with their first occurrences among them."""
    parts = max(1, -(-rows.count() // PART))
    dealt = rows.select("doc_id", "place", "left", F.pmod(F.xxhash64("doc_id", "place"), F.lit(parts)).alias("part"))

    def firsts(t: pa.Table) -> pa.Table:
        key, doc, start = windows_of(t)
        order = np.lexsort((start, doc, key))
        new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        at = order[new]
        return pa.table({"part": pa.array(np.full(len(at), t.column("part")[0].as_py())), "key": pa.array(key[at]), "doc_id": pa.array(doc[at]), "place": pa.array(start[at]), "n": pa.array(np.diff(np.append(new, len(key))))})

    first = stage(dealt.groupBy("part").applyInArrow(firsts, "part bigint, key bigint, doc_id bigint, place bigint, n bigint"), "firsts")
    least = stage(first.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.sum("n").alias("n")).where("n > 1").select("key", F.col("f.doc_id").alias("source"), F.col("f.place").alias("at")), "least")
    answers = stage(first.select("part", "key").join(least, "key"), "answers")

    def told(t: pa.Table, known: pa.Table) -> pa.Table:
        key, doc, start = windows_of(t)
        order = np.argsort(keys := known.column("key").to_numpy())
        at = order[np.minimum(np.searchsorted(keys[order], key), max(len(keys) - 1, 0))] if len(keys) else np.zeros(0, np.int64)
        source, place = (known.column(c).to_numpy()[at] for c in ("source", "at"))
        late = (keys[at] == key) & ((source != doc) | (place != start)) if len(keys) else np.zeros(len(key), bool)
        picked = (x[late] for x in (doc, start, source, start - place)) if len(keys) else (doc[:0],) * 4
        return pa.table(dict(zip(("doc_id", "low", "high", "source", "distance"), map(pa.array, spans_of(*picked)), strict=True)))

    out = stage(dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(told, MATCH), "hot")
    dropped(first, least, answers)
    return out


def joined(matches: DataFrame) -> DataFrame:
    """Adjacent and overlapping matches of one source and distance as one."""
    by = Window.partitionBy("doc_id", "source", "distance").orderBy("low", "high")
    upto = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = matches.withColumn("new", F.when(F.col("low") <= upto + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "source", "distance", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def for_copies(copies: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of documents (doc_id, first_id, n_words) whose words are those of the earlier ``first_id``: its own matches, and for its other windows itself."""
    copies = copies.where(f"n_words >= {LENGTH}")
    own = matches.join(copies.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("first_id")).agg(F.collect_list(F.struct("low", "high", "source", "distance")).alias("own"))
    rows = copies.join(stage(own, "own"), "first_id", "left")  # written, so that a document of many copies is a hot key that adaptive execution can split

    def kernel(batch: pa.RecordBatch) -> dict:
        out = []
        for doc, first, n, own in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "first_id", "n_words", "own")), strict=True):
            free = 0
            for m in sorted(own or [], key=lambda m: m["low"]):
                out.append((doc, m["low"], m["high"], m["source"], m["distance"]))
                if free < m["low"]:
                    out.append((doc, free, m["low"] - 1, first, 0))
                free = max(free, m["high"] + 1)
            if free <= n - LENGTH:
                out.append((doc, free, n - LENGTH, first, 0))
        return dict(zip(("doc_id", "low", "high", "source", "distance"), map(list, zip(*out, strict=True)), strict=True))

    return mapped(rows, kernel, MATCH)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start_word): spans of at least 50 words of ``docs(doc_id, text)`` that repeat an earlier place."""
    spark = prepared(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    every = stage(outlines(docs), "outlines")
    classes = stage(every.where(f"n_words >= {LENGTH}").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("places", "doc_id").alias("places")), "classes")
    anchors = classes.select(F.col("first_id").alias("doc_id"), F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc_id", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    # written first, so that both sides of the join are plain shuffles, of which adaptive execution can split a hot key
    often = stage(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    named = anchors.join(often, "key").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("n") > HOT).alias("hot")))).alias("x"))
    named = stage(named.select("doc_id", F.col("x.place").alias("places"), F.col("x.hot").alias("hot")), "named")
    cut = stage(suffixes(passed(docs, named).join(named, "doc_id").select("doc_id", "text", "places", "hot")), "suffixes")
    plain = cut.where("low is not null").repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(sorted_matches, MATCH)
    hot = hot_matches(cut.where("low is null"))
    found = stage(joined(plain.unionAll(hot)), "matches")
    dropped(often, named, cut, hot)
    copies = every.select("doc_id", "class", "n_words").distinct().join(classes.select("class", "first_id"), "class").where("doc_id != first_id")
    columns = ["doc_id", "low", "high", "source", "distance"]
    both = found.select(columns).unionAll(for_copies(copies, found).select(columns))
    return joined(both).select("doc_id", F.col("low").alias("start_word"), (F.col("high") - F.col("low") + LENGTH).alias("n_words"), F.col("source").alias("first_doc_id"), (F.col("low") - F.col("distance")).alias("first_start_word"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: spans that repeat an earlier place are cut from the texts (n_chars follows); documents of which no word is left go. Other columns stay."""
    name = "_" * (1 + max(map(len, docs.columns))) + "cut"  # no column of the documents is called so
    spans = repeats(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(name))
    kind = spans.schema[name].dataType
    # rows without doc_id have no spans and would all meet in one task of the join
    rows = docs.where("doc_id is not null").join(spans, "doc_id", "left").unionByName(docs.where("doc_id is null").withColumn(name, F.lit(None).cast(kind)))
    names = docs.columns
    schema = StructType([f for f in rows.schema if f.name in names])
    order = schema.names

    def kernel(batch: pa.RecordBatch) -> dict:
        texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
        for i, cut in enumerate(batch.column(name).to_pylist()):
            if cut:
                raw = texts[i].encode()
                starts, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                edge, out, at = [*starts.tolist(), len(raw)], [], 0
                for x in cut:
                    a, b = x["start_word"], x["start_word"] + x["n_words"]
                    if b > at:
                        out.append(raw[edge[at] if at else 0 : edge[max(a, at)]] if a > at or not at else b"")
                        at = max(at, b)
                out.append(raw[edge[at] :])
                texts[i] = b"".join(out).decode()
                keep[i] = bool(texts[i].strip(" \t\n\r\v\f"))
        got = {n: batch.column(n).filter(pa.array(keep)) for n in order}
        got["text"] = pa.array([t for t, k in zip(texts, keep, strict=True) if k], pa.string())
        if "n_chars" in got:
            got["n_chars"] = pa.array([None if t is None else len(t) for t, k in zip(texts, keep, strict=True) if k], pa.int64())
        return got

    return mapped(rows, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "text").select(names)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every whole text of ``documents``."""
    return repeats(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, i AS s, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 50)) AS i FROM w WHERE len(ws) >= 50)
), f AS (
  SELECT doc_id, s, first_value(doc_id) OVER o AS fd, first_value(s) OVER o AS fs FROM g WINDOW o AS (PARTITION BY h ORDER BY doc_id, s)
), l AS (
  SELECT doc_id, s, fd, s - fs AS gap, s - row_number() OVER (PARTITION BY doc_id, fd, s - fs ORDER BY s) AS island FROM f WHERE doc_id <> fd OR s <> fs
)
SELECT doc_id, min(s) AS start_word, max(s) - min(s) + 50 AS n_words, fd AS first_doc_id, min(s) - gap AS first_start_word FROM l GROUP BY doc_id, fd, gap, island
"""
