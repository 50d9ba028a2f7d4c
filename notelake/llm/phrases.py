"""Phrase collocation mining by a multikey sort of suffix pointers.

Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. Everything is counted for each lang (null: ``und``). A phrase of two to LONGEST
words that occurs LEAST times or more is a candidate; of its cuts into a first part and a rest the one of the lowest score a * a / (l * r) counts.

Two passes over the corpus:

1. Every word starts a suffix of up to LONGEST words, a pointer into the text with a 32-bit key for each word (the language is part of it). Suffixes are routed over the whole cluster by their
   leading two words, equal ones added up before. The task that owns a route sorts its suffixes key by key, as multikey three-way quicksort does: at each depth only the parts of equal keys go on,
   their size is the count, and a part below LEAST is abandoned with all that is behind it (the parts of smaller and larger keys are NumPy's to sort).
   What remains is marked, with its words. Equal keys of different words only make counts larger, so no frequent phrase is lost.
2. Marked words and phrases are counted exactly, by their text, behind a bit map of the marks of at most 16 MB; a full map only costs work.

Scores are worked out in decimals from the counts of the second pass. A hot phrase is one row for each task before it is shuffled. Nothing but the bit map is collected.

null, empty texts and pieces without words count nothing. Repeated rows count again. Words of any length count whole. Within one batch words are told apart by 64-bit hashes, across batches by
their text. Tables without phrases give no rows. Other columns than text and lang are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, partitions, prepared, released, slices, stage, table, utf8
from .filters import MOST_WORDS
from .kernels import LOWER, ODD, U, mix, word_hashes, words

LEAST, LONGEST, BEST = 10, 3, 2000
#: Suffixes that are sorted and added up before they are routed, and phrases that are held before they are emitted, about.
FLUSH, HELD = 1 << 20, 1 << 20
#: Routes for each shuffle partition, of which a task holds one at a time.
ROUTES = 4
FIELDS = ["lang", "phrase", "words", "n"]
PIECE = np.zeros(256, bool)
PIECE[[*map(ord, ".,;:!?"), *range(10, 14)]] = True
BETWEEN = PIECE.copy()
BETWEEN[[9, 32]] = True


class Words:
    """The words of a batch of texts: bytes, starts, ends, 64-bit hashes (of language and word), 32-bit keys from 1, how many words of its piece begin at each word (``room``), and the language of each."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        self.data = LOWER[data]
        self.starts, self.ends, first = words(self.data, offsets, BETWEEN)
        self.names, which = languages(batch.column("lang"))
        self.lang = np.repeat(which, np.diff(first))
        salt = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in self.names], np.uint64)
        n = len(self.starts)
        self.hashes = mix(word_hashes(self.data, self.starts, self.ends) ^ salt[self.lang]) if n else np.zeros(0, np.uint64)
        self.keys = np.maximum((self.hashes >> U(32)).astype(np.uint32), 1)
        # words of one piece have one number; a text begins a new one
        piece = np.cumsum(PIECE[self.data], dtype=np.int64)[self.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = piece[1:] != piece[:-1]
        new[first[:-1][first[:-1] < n]] = True
        last = np.append(np.flatnonzero(new)[1:], n) if n else np.zeros(0, np.int64)
        self.room = np.repeat(last, np.diff(np.append(np.flatnonzero(new), n))) - np.arange(n) if n else np.zeros(0, np.int64)


def languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def marks(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, 64-bit mark) of the phrases that rows of keys begin with: of one word, of two, and so on."""
    yield 1, mix(keys[:, 0].astype(np.uint64) ^ ODD[1])
    route = routed(keys)
    yield 2, mix(route ^ ODD[2])
    for depth in range(3, keys.shape[1] + 1):
        route = mix(route + keys[:, depth - 1].astype(np.uint64) * ODD[3])
        yield depth, mix(route ^ ODD[depth % 62])


def routed(keys: np.ndarray) -> np.ndarray:
    """The route of a suffix by its leading two words, one to one."""
    return mix((keys[:, 0].astype(np.uint64) << U(32)) | keys[:, 1].astype(np.uint64))


def suffixes(w: Words, longest: int) -> np.ndarray:
    """Keys of the suffixes of two words or more, 0 behind the end of a piece."""
    at = np.flatnonzero(w.room >= 2)
    out = np.zeros((len(at), longest), np.uint32)
    for k in range(longest):
        has = w.room[at] > k
        out[has, k] = w.keys[at[has] + k]
    return out


def added(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes sorted by route and the keys behind the leading two, their weights and routes."""
    route = routed(keys)
    order = np.lexsort((*[keys[:, k] for k in range(keys.shape[1] - 1, 1, -1)], route))
    keys, route = keys[order], route[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(keys))) if weight is None else np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)
    return keys[at], total.astype(np.int64), route[at]


def equal_parts(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, keys of one suffix for each part) of the parts of equal keys, of sorted suffixes, that weigh ``least`` or more; parts that do not are abandoned before the next depth."""
    for depth in range(2, keys.shape[1] + 1):
        inside = keys[:, depth - 1] != 0
        keys, weight = keys[inside], weight[inside]
        if not len(keys):
            return
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:, :depth] != keys[:-1, :depth]).any(1)
        at = np.flatnonzero(new)
        good = np.add.reduceat(weight, at) >= least
        yield depth, keys[at[good], :depth]
        stays = np.repeat(good, np.diff(np.append(at, len(keys))))
        keys, weight = keys[stays], weight[stays]


def marked(texts: DataFrame, least: int, longest: int) -> DataFrame:
    """Staged marks (key) of all phrases of texts(text, lang) that may occur ``least`` times, and of their words."""
    parts = partitions(texts.sparkSession)
    routes = ROUTES * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, weight, route = added(np.concatenate(held))
            held.clear()
            bucket = ((route >> U(32)) * U(routes)) >> U(32)
            cut = np.searchsorted(bucket, np.arange(routes + 1, dtype=np.uint64))
            have = np.flatnonzero(np.diff(cut))
            blobs = [b"".join(np.ascontiguousarray(keys[cut[b] : cut[b + 1], k]).tobytes() for k in range(longest)) + weight[cut[b] : cut[b + 1]].astype("<u4").tobytes() for b in have]
            return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(suffixes(Words(part), longest))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if any(map(len, held)):
            yield flush()
        released()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(blobs: list[bytes]) -> pa.RecordBatch:
            size = 4 * (longest + 1)
            one = [np.frombuffer(b, "<u4").reshape(longest + 1, len(b) // size) for b in blobs]
            rows = np.concatenate(one, axis=1)
            keys, weight, _ = added(np.ascontiguousarray(rows[:longest].T), rows[longest].astype(np.int64))
            out = [np.zeros(0, np.uint64)]
            for depth, found in equal_parts(keys, weight, least):
                out.append(dict(marks(found))[depth])
                out.append(np.unique(mix(found.ravel().astype(np.uint64) ^ ODD[1])))
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], ["key"])

        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if bucket != now and blobs:
                    yield told(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield told(blobs)
        released()

    dealt = texts.mapInArrow(deal, "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return stage(dealt.mapInArrow(settle, "key bigint"), "marks")


def bit_map(keys: DataFrame) -> np.ndarray:
    """64-bit words with two bits set for each key; their number follows that of the keys, within MOST_WORDS."""
    number = 1 << min(MOST_WORDS.bit_length() - 1, max(10, (keys.count() // 4).bit_length()))
    place = lambda c: F.col("key").bitwiseAND(F.lit(number * 64 - 1)) if not c else F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(number * 64 - 1))
    bits = keys.select(F.explode(F.array(place(0), place(1))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    got, mask = bits.toArrow(), np.zeros(number, np.uint64)
    mask[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return mask


def phrase_texts(w: Words, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Texts of the phrases of ``size`` words from ``first``, joined by single spaces."""
    a, b = w.starts[first], w.ends[first + size - 1]
    length = b - a
    begin = np.cumsum(length) - length
    flat = w.data[np.arange(length.sum()) - np.repeat(begin, length) + np.repeat(a, length)]
    offsets = np.append(begin, length.sum()).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(flat))
    # what stands between is mostly one space: where it is more, or a tab, words are joined anew
    gaps = np.append(w.starts[1:] - w.ends[:-1], 0)
    odd = np.append(np.cumsum((gaps != 1) | (w.data[np.minimum(w.ends, len(w.data) - 1)] != 32)), 0)
    other = np.flatnonzero((size > 1) & (odd[first + size - 2] != np.where(first > 0, odd[first - 1], 0)))
    if not len(other):
        return out
    texts = out.to_pylist()
    for i in other.tolist():
        at = range(first[i], first[i] + size[i])
        texts[i] = b" ".join(w.data[w.starts[j] : w.ends[j]].tobytes() for j in at).decode()
    return pa.array(texts, pa.large_string())


def counted(texts: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """Staged (lang, phrase, words, n) of marked words and phrases, and of a few others; with words = 0 how many words a language has."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_map(keys))
    parts = partitions(texts.sparkSession)
    routes = ROUTES * parts

    def passes(mark: np.ndarray) -> np.ndarray:
        mask = sent.value
        most = U(64 * len(mask) - 1)
        return np.logical_and(*((mask[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == U(1) for p in (mark & most, (mark >> U(32)) & most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        held: list[tuple] = []

        def emit(rows: list[tuple], all_: bool) -> Iterator[pa.RecordBatch]:
            """Equal phrases as one; they stay here while they are few, and leave in one list for each route."""
            code, lang, size, n = (np.concatenate([r[k] for r in rows]) for k in range(4))
            texts_ = pa.concat_arrays([r[4] for r in rows])
            code, at, which = np.unique(code, return_index=True, return_inverse=True)
            one = (code, lang[at], size[at], np.bincount(which, weights=n).astype(np.int64), texts_.take(pa.array(at)))
            held.clear()
            if not all_ and len(at) < HELD // 2:
                held.append(one)
                return
            bucket = ((code >> U(32)) * U(routes)) >> U(32)  # ascending, as codes are
            cut = np.searchsorted(bucket, np.arange(routes + 1, dtype=np.uint64))
            have = np.flatnonzero(np.diff(cut))
            ends = pa.array(np.append(cut[have], len(code)), pa.int32())
            lists = [pa.array(known, pa.string()).take(pa.array(one[1])), one[4].cast(pa.string()), pa.array(one[2], pa.int32()), pa.array(one[3], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *[pa.ListArray.from_arrays(ends, x) for x in lists]], ["bucket", *FIELDS])

        known: list[str] = []
        numbers: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                w = Words(part)
                for name in w.names:
                    if name not in numbers:
                        numbers[name] = len(known)
                        known.append(name)
                mine = np.array([numbers[n] for n in w.names], np.int64)
                for name, n in zip(w.names, np.bincount(w.lang, minlength=len(w.names)).tolist(), strict=True):
                    total[name] += n
                first, size, code = [], [], []
                for depth in range(1, longest + 1):
                    at = np.flatnonzero(w.room >= depth)
                    if not len(at):
                        break
                    keys_ = np.column_stack([w.keys[at + k] for k in range(depth)]) if depth > 1 else np.column_stack([w.keys[at], w.keys[at]])
                    at = at[passes(dict(marks(keys_))[depth])]
                    whole = np.full(len(at), U(depth))
                    for k in range(depth):
                        whole = mix(whole ^ w.hashes[at + k])
                    first.append(at)
                    size.append(np.full(len(at), depth))
                    code.append(whole)
                if code:
                    at, size_, whole = np.concatenate(first), np.concatenate(size), np.concatenate(code)
                    _, one, n = np.unique(whole, return_index=True, return_counts=True)
                    held.append((whole[one], mine[w.lang[at[one]]], size_[one], n, phrase_texts(w, at[one], size_[one])))
                    if sum(len(h[0]) for h in held) >= HELD:
                        yield from emit(list(held), False)
        if held:
            yield from emit(list(held), True)
        names = [*total]
        one = [pa.array(names, pa.string()), pa.array([""] * len(names), pa.string()), pa.array([0] * len(names), pa.int32()), pa.array([total[x] for x in names], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), x) for x in one]], ["bucket", *FIELDS])
        released()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Route by route, equal texts of one language added up."""

        def told(parts_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts_).group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")])
            yield from t.select(["lang", "phrase", "words", "n_sum"]).rename_columns(FIELDS).combine_chunks().to_batches(50_000)

        now, held = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now and held:
                    yield from told(held)
                    held = []
                now = bucket
                held.append(pa.RecordBatch.from_arrays([batch.column(f).slice(i, 1).flatten() for f in FIELDS], FIELDS))
        if held:
            yield from told(held)
        released()

    lists = "bucket int, lang array<string>, phrase array<string>, words array<int>, n array<bigint>"
    dealt = texts.mapInArrow(run, lists).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return stage(dealt.mapInArrow(settle, "lang string, phrase string, words int, n bigint"), "counts")


def scored(counts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates."""
    of = lambda a, b: F.array_join(F.slice("ws", a, b), " ")
    cand = counts.where((F.col("words") >= 2) & (F.col("n") >= least)).withColumn("ws", F.split("phrase", " "))
    cuts = cand.select("lang", "phrase", "words", F.col("n").alias("a"), "ws", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", of(F.lit(1), F.col("k")).alias("first"), of(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = counts.where("words > 0").select("lang", "phrase", "n")
    cuts = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    # counts below 10^15: products stay below 10^38
    d = lambda c: f"cast({c} as decimal(15,0))"
    whole = F.expr(f"cast((cast(1000000 as decimal(7,0)) * ({d('a')} * {d('a')})) div ({d('l')} * {d('r')}) as bigint)")
    cuts = cuts.withColumn("score", whole)
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def uncontained(cand: DataFrame, share: int) -> DataFrame:
    """Candidates that are in no longer candidate of at least ``share`` percent of their occurrences."""
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))))
    longer = cand.where("words > 2").withColumn("ws", F.split("phrase", " ")).select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return cand.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = 50, best: int | None = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(text, lang): phrases of 2 to ``longest`` words that occur ``least`` times, the best of each language (None: all)."""
    prepared(docs.sparkSession)
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    keys = marked(texts, least, longest)
    counts = counted(texts, keys, longest)
    cand = stage(scored(counts, least), "candidates")
    total = stage(counts.where("words = 0").select("lang", F.col("n").alias("n")), "totals")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = uncontained(cand, share).withColumn("rank", rank)
    if best is not None:
        kept = kept.where(F.col("rank") <= best)
    out = stage(kept.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    dropped(keys, counts, cand, total)
    return out


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over every whole text of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k) GROUP BY ALL
), t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND n >= 10
), cut AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, x.n AS l, y.n AS r, ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:c.k], ' ')
), b AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), m AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n, score FROM b JOIN t USING (lang) LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase
  WHERE b.k = 3 OR m.longer IS NULL OR 100 * m.longer < 50 * a
) WHERE rank <= 2000
"""
