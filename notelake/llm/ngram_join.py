"""N-gram Jaccard join by count-vector R-trees.

A document is its set of distinct 5-word shingles; documents link when 100 * intersection >= 75 * union. Shingles are hashed into groups and a document's
group counts are a point: the sum of coordinate minima of two points bounds their overlap from above, and for a node of an R-tree the minima with its
box's upper corner bound the overlap with everything below it. Counts of unrelated long texts all look alike, so one tree over a corpus would have to
be searched whole; points are therefore dealt into trees by the groups of finest grain: documents that link share one of their ``n - ceil(3n/4) + 1`` first
shingles in any common order (rarest first), and every run of documents that share one is a tree. Steps:

1. sets: (doc_id, n, class), the class a 64-bit fingerprint of the set, so copies are one point; how frequent shingles are is counted over all documents.
2. runs: first shingles as packed arrays per bucket, sorted in the task that owns the bucket; a run is cut where sizes alone rule links out.
3. stars, for runs of more than BLOCK members only, as a third of all documents may be near copies of one: each class is verified against a few leaders of most of its long runs.
4. trees: every run whose members are not all connected yet is searched by R-tree, in pairs of blocks where it is long. The candidates' maximum spanning forest by bound is verified on whole sets.
5. families: components that candidates hang together, whole, are bounded and verified in blocks unless they are one component by now, until a link joins their components: of a document's
   candidates in a known component only the one of the best bound was verified so far, and any other may be its link.
6. connected components of all links. Links within a component that is already known need no proof, as results are components.

Empty sets (null, empty or blank texts) link with nothing. Texts with fewer than five words are one shingle. Repeated rows are copies. Shingles are compared
by 64-bit hashes and sets by 64-bit fingerprints. Rows with a null doc_id
have no name to report: they get their component when a named row has the same set, else null, and start no comparison.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, mapped, partitions, prepared, released, slices, stage, table, utf8
from .filters import passed
from .kernels import LOWER, ODD, U, mix, word_hashes, words

WIDTH = 5
#: The common order of shingles goes by the documents of their cell, so many numbers (8 MB) that are counted over the corpus and broadcast; the order never changes results.
CELLS, CELL_BLOCKS = 1 << 20, 64
#: Members of a run handled as one tree; longer runs are pairs of such blocks.
BLOCK = 512
#: Members of a family whose sets are compared with those of another block in one task.
FAMILY_BLOCK = 512
LEAF = 16
#: Stars per run, each around the least class in another order: families of borderline copies hang together by some of them.
STARS = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, their bounds, and the texts' set fingerprints."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    h, n = word_hashes(low, starts, ends), np.diff(first)
    docs, count = len(n), np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(docs), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    size = np.minimum(n[owner], WIDTH)
    value = mix(size.astype(np.uint64))
    padded = np.append(h, np.zeros(WIDTH, np.uint64))
    for j in range(WIDTH):
        value += np.where(j < size, padded[place + j] * ODD[j], U(0))
    value = mix(value)
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(docs + 1))
    total = np.concatenate([[U(0)], np.cumsum(mix(value), dtype=np.uint64)])
    return value, bounds, mix((total[bounds[1:]] - total[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64))


def group_counts(value: np.ndarray) -> bytes:
    """A set's point: counts of its shingles in groups, a power of two of about a quarter of the set (64 to 16384), capped at 65535 (see ``read_points``)."""
    groups = 1 << min(14, max(6, int(len(value) // 4).bit_length()))
    return np.bincount((value & U(groups - 1)).astype(np.int64), minlength=groups).clip(max=65535).astype("<u2").tobytes()


class CountTree:
    """A bulk-loaded R-tree of count vectors: boxes' upper corners and least set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:  # halve along the widest coordinate
            at = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append(at)
                continue
            widest = int((points[at].max(0) - points[at].min(0)).argmax())
            at = at[np.argsort(points[at, widest], kind="stable")]
            todo += [at[: len(at) // 2], at[len(at) // 2 :]]
        self.upper = [np.array([points[at].max(0) for at in self.leaves])]
        self.least = [np.array([sizes[at].min() for at in self.leaves])]
        while len(self.least[-1]) > LEAF:
            cut = np.arange(0, len(self.least[-1]), LEAF)
            self.upper.append(np.maximum.reduceat(self.upper[-1], cut))
            self.least.append(np.minimum.reduceat(self.least[-1], cut))

    def near(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may link with a set: 7 * sum of minima >= 3 * (sum of sizes), and sizes within 3 : 4; and what share of both sizes their sum of minima is."""
        nodes = np.arange(len(self.least[-1]))
        for level in range(len(self.least) - 1, -1, -1):
            keep = 7 * np.minimum(self.upper[level][nodes], point).sum(1) >= 3 * (size + np.maximum(self.least[level][nodes], -(-3 * size // 4)))
            nodes = nodes[keep]
            if level:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.least[level - 1])]
        if not len(nodes):
            return nodes, np.zeros(0)
        at = np.concatenate([self.leaves[k] for k in nodes])
        n, most = self.sizes[at], np.minimum(self.points[at], point).sum(1)
        keep = (7 * most >= 3 * (size + n)) & (3 * size <= 4 * n) & (3 * n <= 4 * size)
        return at[keep], (most / (size + n))[keep]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Edges (their places) of a maximum spanning forest of a[i] - b[i] between nodes that have equal labels only if they hang together already."""
    label, chosen, left = label.copy(), [], np.arange(len(a))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.array(sorted(chosen), np.int64)
        ends, edge = np.concatenate([label[a[left]], label[b[left]]]), np.concatenate([left, left])
        order = np.lexsort((edge, -weight[edge], ends))
        best = np.unique(edge[order[np.concatenate([[True], ends[order][1:] != ends[order][:-1]])]])
        for i in best.tolist():  # at most one an end: few
            x, y = label[a[i]], label[b[i]]
            if x != y:
                chosen.append(i)
                label[label == y] = x


def read_point(blob: bytes, groups: int | None = None) -> np.ndarray:
    """A point, folded to fewer groups if asked (both powers of two, so halves add up). Capped counts become unbounded ones, so that a bound stays one."""
    v = np.frombuffer(blob, "<u2").astype(np.int64)
    v[v == 65535] = 1 << 40
    return v if groups is None or groups == len(v) else v.reshape(-1, groups).sum(0)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class) for documents; and per task, rows with ``cells``: how many of its distinct sets hold a shingle of each cell (n: number of the block of cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = np.zeros(CELLS, np.uint32), set()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                value, bounds, print_ = shingle_sets(data, offsets)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(print_.view(np.int64), mask=n == 0), pa.nulls(len(n), pa.binary())], ["doc_id", "n", "class", "cells"])
                fresh = [value[bounds[i] : bounds[i + 1]] for i, p in enumerate(print_.tolist()) if n[i] and p not in seen and not seen.add(p)]
                if fresh:
                    counter += np.bincount(cell(np.concatenate(fresh)), minlength=CELLS).astype(np.uint32)
                if len(seen) > 1_000_000:
                    seen.clear()
        if counter.any():
            blobs = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in counter.reshape(CELL_BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(blobs), pa.int64()), pa.array(np.arange(len(blobs))), pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n", "class", "cells"])
        released()

    return docs.mapInArrow(run, "doc_id bigint, n bigint, class bigint, cells binary")


def cell(value: np.ndarray) -> np.ndarray:
    return (value >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(found: DataFrame) -> np.ndarray:
    """Documents per cell of shingles over the whole corpus: CELLS numbers, whatever its size."""

    def add(t: pa.Table, kind: str) -> pa.Table:
        total = np.zeros(CELLS // CELL_BLOCKS, np.uint64)
        for blob in t.column("cells"):
            total += np.frombuffer(zlib.decompress(blob.as_py()), kind)
        return pa.table({"n": t.column("n")[:1], "cells": pa.array([zlib.compress(total.astype("<u8").tobytes(), 1)], pa.binary())})

    # summed in two steps, so that no task reads a block of all tasks of a large corpus
    rows = found.where("cells is not null").select("n", "cells").withColumn("part", F.pmod(F.xxhash64("cells"), F.lit(64)))
    half = rows.groupBy("n", "part").applyInArrow(lambda t: add(t, "<u4"), "n bigint, cells binary")
    out = np.zeros((CELL_BLOCKS, CELLS // CELL_BLOCKS), np.uint64)
    for r in half.groupBy("n").applyInArrow(lambda t: add(t, "<u8"), "n bigint, cells binary").collect():
        out[r.n] = np.frombuffer(zlib.decompress(r.cells), "<u8")
    return out.ravel()


def runs(docs: DataFrame, times: np.ndarray) -> DataFrame:
    """(run, chunk, times, leaders, members): classes that share a first shingle, by size, in chunks of at most BLOCK; equal runs are one, found ``times`` times."""
    spark = docs.sparkSession
    buckets = 8 * partitions(spark)
    # rarest cells first, by their rank among all, whatever the size of the corpus; then the hash
    place = np.empty(CELLS, np.uint64)
    place[np.argsort(times, kind="stable")] = np.arange(CELLS, dtype=np.uint64) << U(44)
    sent = spark.sparkContext.broadcast(place)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = ((h >> U(32)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            have = np.flatnonzero(np.diff(cut))
            blobs = [b"".join(x[order[cut[b] : cut[b + 1]]].tobytes() for x in (h, c, n)) for b in have]
            return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                value, bounds, print_ = shingle_sets(data, offsets)
                rank = sent.value[cell(value)] | (value & U((1 << 44) - 1))
                for i, p in enumerate(print_.tolist()):
                    mine = value[bounds[i] : bounds[i + 1]]
                    if len(mine) and p not in seen:
                        seen.add(p)
                        most = len(mine) - -(-3 * len(mine) // 4) + 1
                        first = mine[np.argpartition(rank[bounds[i] : bounds[i + 1]], most - 1)[:most]]
                        held.append((first, np.full(most, p, np.uint64), np.full(most, len(mine), np.uint32)))
                if len(seen) > 1_000_000:
                    seen.clear()
                if sum(len(x[0]) for x in held) > 400_000:
                    yield flush()
        if held:
            yield flush()
        released()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket by bucket, as they come sorted: a task holds one at a time."""
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if bucket != now and blobs:
                    yield from met_in(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from met_in(blobs)
        released()

    def met_in(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        count = [len(x) // 20 for x in blobs]
        h, c = (np.concatenate([np.frombuffer(x, np.uint64, k, skip * k * 8) for x, k in zip(blobs, count, strict=True)]) for skip in (0, 1))
        n = np.concatenate([np.frombuffer(x, np.uint32, k, 16 * k) for x, k in zip(blobs, count, strict=True)]).astype(np.int64)
        order = np.lexsort((c, n, h))
        h, c, n = h[order], c[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n = h[new], c[new], n[new]
        cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (3 * n[1:] > 4 * n[:-1]), [True]]))
        long = np.flatnonzero(np.diff(cut) > 1)
        met: dict[int, list] = {}
        for k in long:
            a, b = int(cut[k]), int(cut[k + 1])
            key = int(mix(np.array([int(np.add.reduce(mix(c[a:b]))) ^ (b - a)], np.uint64)).view(np.int64)[0])
            if key in met:
                met[key][0] += 1
            else:
                met[key] = [1, a, b]
        rows = []
        for key, (times, a, b) in met.items():
            leaders = [c[a + int(mix(c[a:b] ^ ODD[k]).argmin())] for k in range(STARS)]
            for j in range(a, b, BLOCK):
                rows.append((key, (j - a) // BLOCK, times, leaders, c[j : min(b, j + BLOCK)].view(np.int64)))
            if len(rows) >= 20000:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    def emit(rows: list) -> pa.RecordBatch:
        key, chunk, times, leaders, members = zip(*rows, strict=True)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in members])]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(members), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(chunk, pa.int32()), pa.array(times, pa.int64()), pa.array(np.array(leaders, np.uint64).view(np.int64).tolist(), pa.list_(pa.int64())), lists], ["run", "chunk", "times", "leaders", "members"])

    dealt = docs.mapInArrow(deal, "bucket int, blob binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(meet, "run bigint, chunk int, times bigint, leaders array<bigint>, members array<bigint>")
    return found.groupBy("run", "chunk").agg(F.sum("times").alias("times"), F.first("leaders").alias("leaders"), F.first("members").alias("members"))


def points(docs: DataFrame, wanted: DataFrame, first: DataFrame, label: str) -> DataFrame:
    """(class, n, value) of the classes in ``wanted``, from one document each (``first``: class, doc_id); value: the point, or (label hashes) all shingle hashes."""
    named = stage(first.join(wanted, "class", "left_semi"), "named")
    whole = label == "hashes"

    def kernel(batch: pa.RecordBatch) -> dict:
        value, bounds, print_ = shingle_sets(*utf8(batch.column("text")))
        mine = [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {"doc_id": batch.column("doc_id"), "class": print_.view(np.int64), "n": np.diff(bounds), "value": [x.tobytes() if whole else group_counts(x) for x in mine]}

    read = passed(docs, named, kernel, "doc_id bigint, class bigint, n bigint, value binary")
    out = stage(read.join(named.select("class", "doc_id"), ["class", "doc_id"], "left_semi").drop("doc_id").dropDuplicates(["class"]), label)
    dropped(named)
    return out


def pairwise(pairs: DataFrame, known: DataFrame, links) -> DataFrame:
    """The pairs (a, b) for which ``links(n_a, value_a, n_b, value_b)`` holds."""
    both = pairs.join(known.toDF("b", "nb", "vb"), "b").join(known.toDF("a", "na", "va"), "a").where("3 * na <= 4 * nb and 3 * nb <= 4 * na")

    def kernel(batch: pa.RecordBatch) -> dict | None:
        columns = [batch.column(n) for n in ("na", "va", "nb", "vb")]
        keep = [i for i, (n, x, m, y) in enumerate(zip(*columns, strict=True)) if links(n.as_py(), x.as_buffer(), m.as_py(), y.as_buffer())]
        return {n: batch.column(n).take(pa.array(keep, pa.int64())) for n in ("a", "b")} if keep else None

    return mapped(both.select("a", "b", "na", "va", "nb", "vb"), kernel, "a bigint, b bigint", "vb")


def may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    groups = min(len(x), len(y)) // 2
    return 7 * int(np.minimum(read_point(x, groups), read_point(y, groups)).sum()) >= 3 * (n + m)


def do_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    x, y = (np.frombuffer(v, np.uint64) if not isinstance(v, np.ndarray) else v for v in (x, y))
    return 7 * int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) >= 3 * (n + m)


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link; only documents in pairs are read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    hashes = points(docs, wanted, first, "hashes")
    out = stage(pairwise(pairs, hashes, do_link), "links")
    dropped(hashes)
    return out


def candidates(left: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of the pairs within runs that lie in different components and whose bound allows a link. ``left``: (run, chunk, class, component)."""
    rows = left.join(known.toDF("class", "n", "point"), "class")
    spans = left.join(known.select("class", "n"), "class").groupBy("run", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = spans.select("run", F.col("chunk").alias("chunk2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    blocks = spans.join(other, "run").where("chunk <= chunk2 and 3 * low2 <= 4 * high and 3 * low <= 4 * high2").select("run", F.col("chunk").alias("i"), F.col("chunk2").alias("j"))
    dealt = blocks.select("run", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")).join(rows, ["run", "chunk"])

    def search(t: pa.Table) -> pa.Table:
        chunk, i, j = t.column("chunk").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        key, comp, n = (t.column(x).to_numpy() for x in ("class", "component", "n"))
        met = [(np.full(len(near), x), near, share) for x, near, share in searched(t.column("point").to_pylist(), n, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)) if len(near)]
        if not met:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y, share = (np.concatenate(v) for v in zip(*met, strict=True))
        at = forest(x, y, share, np.unique(comp, return_inverse=True)[1])
        a, b = key[x[at]], key[y[at]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return dealt.groupBy("run", "i", "j").applyInArrow(search, "a bigint, b bigint").distinct()


def searched(blobs: list[bytes], n: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each outer row with the inner rows whose bound allows a link and the bound's share of both sizes, by one tree per grain; sizes within 3 : 4 have equal or neighbouring grains."""
    groups = np.array([len(x) // 2 for x in blobs])
    for g in np.unique(groups[inner]):
        mine = inner[groups[inner] == g]
        for finer in (g // 2, g, g * 2):
            theirs, grain = outer[groups[outer] == finer], int(min(g, finer))
            if len(theirs):
                tree = CountTree(np.array([read_point(blobs[x], grain) for x in mine]), n[mine])
                for x in theirs:
                    near, share = tree.near(read_point(blobs[x], grain), int(n[x]))
                    yield int(x), mine[near], share


def family_links(families: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within families (class, family, component) of candidates; blocks of a family are compared pairwise, except those of its largest component among themselves."""
    hashes = points(docs, families.select("class"), first, "hashes")
    rows = families
    size = rows.groupBy("family", "component").agg(F.count("*").alias("c"))
    main = size.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    rows = rows.join(main, "family").withColumn("is_main", (F.col("component") == F.col("main")).cast("int"))
    number = lambda flag: F.greatest(F.ceil(F.when(flag == 1, F.col("most")).otherwise(F.col("all") - F.col("most")) / FAMILY_BLOCK), F.lit(1)).cast("int")
    rows = rows.select("family", "class", "component", "is_main", F.pmod(F.xxhash64("class"), number(F.col("is_main"))).cast("int").alias("block"), number(F.lit(0)).alias("rest"), number(F.lit(1)).alias("mains"))
    # a block is compared with every block of the rest; the key names the block of the rest and the other one
    others = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: F.struct(k.alias("x"), F.lit(1).alias("m"), F.col("block").alias("y")))
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.lit(0).alias("m"), F.greatest(k, F.col("block")).alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: F.struct(F.col("block").alias("x"), F.lit(1).alias("m"), k.alias("y"))),
    )
    dealt = rows.select("family", "class", "component", "is_main", "block", F.explode(F.when(F.col("is_main") == 1, others).otherwise(rest)).alias("k")).select("family", "k.*", "class", "component", "is_main", "block").join(hashes.toDF("class", "n", "value"), "class")

    def compare(t: pa.Table) -> pa.Table:
        key, comp, n = (t.column(x).to_numpy() for x in ("class", "component", "n"))
        x, m, y = (t.column(c)[0].as_py() for c in ("x", "m", "y"))
        main, block = t.column("is_main").to_numpy(), t.column("block").to_numpy()
        whole = [np.frombuffer(b.as_buffer(), np.uint64) for b in t.column("value").combine_chunks()]
        label, a, b = comp.copy(), [], []
        for i, near, _ in searched([group_counts(w) for w in whole], n, np.flatnonzero((main == m) & (block == y)), np.flatnonzero((main == 0) & (block == x))):
            for j in near:
                if label[i] != label[j] and do_link(int(n[i]), whole[i], int(n[j]), whole[j]):
                    a.append(key[i])
                    b.append(key[j])
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = stage(dealt.groupBy("family", "x", "m", "y").applyInArrow(compare, "a bigint, b bigint"), "links")
    dropped(hashes)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``: component_id is the least doc_id reachable by links, itself included."""
    prepared(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    found = stage(sets(docs), "sets")
    each = found.where("cells is null")
    first = stage(each.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "first")
    met = stage(runs(docs, frequencies(found)), "runs")
    wanted = met.select(F.explode("members").alias("class")).distinct()
    named = first.where("doc_id is not null")
    known = points(docs, wanted, named, "points")
    near = None
    long = stage(met.where("chunk > 0").select("run").distinct(), "long")
    if long.head(1):
        star = stage(pairwise(stars(met.join(long, "run", "left_semi")), known, may_link), "star")
        links = verified(star, docs, named)
        near = components(links)
        dropped(star, links)
    dropped(long)
    members = labelled(met.select("run", "chunk", F.explode("members").alias("class")), near)
    # written: few and small, so that long runs are not dealt out by their key to meet them
    open_ = stage(members.groupBy("run").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("run"), "open")
    left = stage(members.join(open_, "run", "left_semi").select("run", "chunk", "class", "component"), "left")
    dropped(open_)
    pairs = stage(candidates(left, known), "pairs")
    dropped(left, met, known)
    family = families_of(pairs, near)
    near = joined_to(near, verified(pairs, docs, named))
    families = labelled(family, near)
    open_ = stage(families.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("family"), "open")
    families = stage(families.join(open_, "family", "left_semi").select("class", "family", "component"), "families")
    dropped(pairs, family, open_)
    if families.head(1):
        near = joined_to(near, family_links(families, docs, named))
    dropped(families)
    owned = first.join(near.toDF("class", "component"), "class", "left").select("class", "doc_id", F.coalesce("component", "class").alias("component"))
    least = stage(owned.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    label = stage(owned.join(least, "component").select("class", "component_id"), "labels")
    dropped(near, least, first)
    # rows without shingles have no class and stay out of the join, whose sides are plain shuffles, so that a class of very many copies can be split
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    empty = each.where("class is null").withColumn("component_id", F.lit(None).cast("bigint"))
    return each.where("class is not null").join(label, "class", "left").select(columns).unionAll(empty.select(columns))


def families_of(pairs: DataFrame, near: DataFrame | None) -> DataFrame:
    """Staged (class, family) of all members of the known components, or classes in none, that candidate pairs(a, b) hang together."""
    ends = labelled(labelled(pairs.toDF("class", "b"), near).select("b", F.col("component").alias("ca")).toDF("class", "ca"), near)
    whole = components(ends.select(F.col("ca").alias("a"), F.col("component").alias("b")))
    family = whole.toDF("component", "family")
    if near is None:
        return stage(family.toDF("class", "family"), "family")
    # a component is named by one of its members, so what is no component's name is a class in none
    known = near.toDF("class", "component").join(family, "component").select("class", "family")
    alone = family.join(near.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("class"), "family")
    out = stage(known.unionAll(alone), "family")
    dropped(whole)
    return out


def joined_to(near: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links(a, b), which are dropped: known components take part as stars, so few rounds are left; without new links they stay."""
    if near is None:
        out = components(links)
    elif links.head(1):
        out = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(links.select("a", "b")))
        dropped(near)
    else:
        out = near
    dropped(links)
    return out


def stars(runs_: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes and, per order of leaders, the leader of most of a class's runs: runs of a shared passage have leaders of other families."""
    star = runs_.select(F.posexplode("leaders").alias("k", "a"), "times", "members").select("k", "a", "times", F.explode("members").alias("b")).groupBy("k", "b", "a").agg(F.sum("times").alias("times"))
    return star.groupBy("k", "b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(rows: DataFrame, near: DataFrame | None) -> DataFrame:
    """Rows with the component of their class: its own where it is in none."""
    if near is None:
        return rows.withColumn("component", F.col("class"))
    return rows.join(near.toDF("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the least doc_id stays. A doc_id names one document: of rows that repeat it with equal texts one stays, rows
    with other texts stay or go together. Rows without doc_id stay; no decision can name them."""
    found = jaccard_components(docs)
    gone = stage(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id"), "again")
    rows = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    if again.head(1):
        rows = rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return rows.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the Jaccard join over every whole text of ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
