"""Hard-negative mining by a GNAT-style tree of hyperplanes.

A vector's components become floor(256 * x); the score of a row is its integer inner product with the anchor. An anchor's positives are its best other rows of the same label; for each positive
the best rows of other labels are returned whose score lies in the window 80*positive <= 100*negative <= 100*positive. Higher scores come first, ties by smaller vec_id.

The tree: a node has up to ARITY split points, far from each other, and a row goes to the nearest (so the cells are bounded by hyperplanes). Split points are fitted on a sample of at most SAMPLE
rows a table (the least hashes of vec_id); every row is placed, and for each split point and sibling subtree the range of distances from the one to all rows of the other is taken over all rows,
with the range of the subtree's squared norms. A window of scores is an annulus around the anchor, as d^2 = |q|^2 + |x|^2 - 2 s; a subtree is left when for any split point of its node the range
that the annulus allows (triangle inequality) does not meet the stored range. Leaves that remain are searched exactly, so results are those of a search over all rows.

Two searches (positives, negatives) with the same shape: the first block of an anchor's own leaf gives the score that a result has to reach, then all leaves that remain are visited. Leaves are
cut into blocks of about BLOCK rows and the visitors of a leaf into parts of about VISITORS, so that neither copies of one vector nor many anchors in one place fill a task; every task returns a
few rows for each visitor. Only the tree, whose size is bounded by the sample, is collected and broadcast.

Rows with a null vec_id, label or vector or with any null or non-finite component take no part. Rows that repeat another in all three are one; rows that share only their vec_id are rows of their own,
and "other" rows are those with another vec_id. Vectors meet only those of the same dimension; one of dimension 0 scores 0. Scores beyond 64 bits count as the largest or least 64-bit number.
An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, prepared, released, stage, table

#: Rows on which split points are fitted, split points of a node, sample rows of a leaf, and how deep the tree is at most.
SAMPLE, ARITY, LEAF, DEPTH = 8192, 16, 48, 12
#: Rows of a leaf and anchors that visit it which meet in one task, about; and products that are worked out at once.
BLOCK, VISITORS, CHUNK = 1 << 16, 1 << 14, 1 << 22
ROWS = "dim int, leaf int, vec_id bigint, label bigint, v binary"
MOST = 2**63 - 1


def packed(v: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: 16-bit numbers where they fit, else doubles."""
    small = np.abs(v).max(1, initial=0) < 32768 if v.size else np.ones(len(v), bool)
    return [(x.astype("<i2") if s else x.astype("<f8")).tobytes() for x, s in zip(v, small, strict=True)]


def unpacked(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim))
    if dim:
        short = np.array([len(b) == 2 * dim for b in blobs])
        for kind, which in (("<i2", np.flatnonzero(short)), ("<f8", np.flatnonzero(~short))):
            if len(which):
                out[which] = np.frombuffer(b"".join(blobs[i] for i in which), kind).reshape(-1, dim)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers: by doubles where these are exact, else by Python's."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in b.tolist()]
    return np.array([[max(-MOST, min(MOST, sum(int(x) * y for x, y in zip(r, s, strict=True)))) for s in whole] for r in a.tolist()], np.int64).reshape(len(a), len(b))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


class Tree:
    """Split points by node, and what each child is: a node (its number) or a leaf (-1 - its number). Of the ranges, ``low[node][i, j]`` and ``high``: distances from split point i to the rows of child j; norms: squared norms of child j's rows."""

    def __init__(self, sample: np.ndarray):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.root = self._node(sample, DEPTH)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _node(self, x: np.ndarray, depth: int) -> int:
        if len(x) <= LEAF or not depth:
            return self._leaf()
        some = x[: 3 * ARITY]
        chosen, far = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < ARITY and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return self._leaf()
        at = len(self.points)
        self.points.append(some[chosen])
        self.child.append([])
        near = self.nearest(at, x)
        for j in range(len(chosen)):
            kid = self._node(x[near == j], depth - 1)
            self.child[at].append(kid)
        return at

    def nearest(self, node: int, x: np.ndarray) -> np.ndarray:
        p = self.points[node]
        return ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1) if len(x) else np.zeros(0, np.int64)

    def place(self, x: np.ndarray, seen: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """The leaf of each row; ``seen(node, rows, child of each)`` is told on the way."""
        leaf, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
            elif len(rows):
                near = self.nearest(node, x[rows])
                if seen:
                    seen(node, rows, near)
                todo += [(kid, rows[near == j]) for j, kid in enumerate(self.child[node])]
        return leaf

    def ranged(self, ranges: dict[int, np.ndarray]) -> Tree:
        """With the ranges of all rows: by node, least and largest distances and squared norms, one below the other (see ``Extent``)."""
        self.low, self.high, self.norms = {}, {}, {}
        for node, p in enumerate(self.points):
            m = len(p)
            r = ranges.get(node, np.concatenate([np.full((m + 1, m), np.inf), np.full((m + 1, m), -np.inf)]))
            self.low[node], self.high[node], self.norms[node] = r[:m], r[m + 1 : 2 * m + 1], (r[m], r[2 * m + 1])
        return self

    def remaining(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of q) that may hold rows with a score from ``least`` to ``most`` (infinite ones allowed)."""
        todo, size = [(self.root, np.arange(len(q)))], (q * q).sum(1)
        while todo:
            node, rows = todo.pop()
            if node < 0:
                yield -1 - node, rows
                continue
            if not len(rows):
                continue
            d = distances(q[rows], self.points[node])
            small, large = self.norms[node]
            with np.errstate(invalid="ignore", over="ignore"):
                outer = np.sqrt(np.maximum(size[rows, None] + large - 2 * least[rows, None], 0))
                inner = np.sqrt(np.maximum(size[rows, None] + small - 2 * most[rows, None], 0))
                slack = 1e-9 * (1 + d.max(1, initial=0)[:, None] + np.where(np.isfinite(outer), outer, 0))
                # what split point i says of child j; comparisons with values that are no numbers leave nothing out
                gone = np.zeros(outer.shape, bool)
                for i in range(d.shape[1]):
                    below = np.maximum(d[:, i : i + 1] - outer, inner - d[:, i : i + 1]) - slack
                    gone |= (below > self.high[node][i]) | (d[:, i : i + 1] + outer + slack < self.low[node][i])
            todo += [(kid, rows[~gone[:, j]]) for j, kid in enumerate(self.child[node])]


class Extent:
    """Least and largest distances to each split point, and squared norms, of the rows below each child: arrays of 2 (m + 1) x m numbers by node."""

    def __init__(self, tree: Tree):
        self.tree, self.at = tree, {}

    def seen(self, x: np.ndarray) -> Callable:
        def told(node: int, rows: np.ndarray, near: np.ndarray) -> None:
            with np.errstate(over="ignore", invalid="ignore"):
                d = np.column_stack([distances(x[rows], self.tree.points[node]), (x[rows] * x[rows]).sum(1)])
            m = d.shape[1] - 1
            r = self.at.setdefault(node, np.concatenate([np.full((m + 1, m), np.inf), np.full((m + 1, m), -np.inf)]))
            for j in np.unique(near):
                mine = d[near == j]
                r[: m + 1, j] = np.minimum(r[: m + 1, j], np.where(np.isfinite(mine), mine, 0).min(0))
                r[m + 1 :, j] = np.maximum(r[m + 1 :, j], np.where(np.isfinite(mine), mine, np.inf).max(0))

        return told

    def rows(self) -> Iterator[tuple[int, bytes]]:
        return ((node, r.tobytes()) for node, r in self.at.items())


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)


def whole_numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, vectors floor(256 * x)) of a list column without nulls, by dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths(), np.int64)
    flat, first = np.floor(256 * np.asarray(column.flatten(), np.float64)), np.cumsum(size) - size
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield int(dim), at, flat[(first[at][:, None] + np.arange(dim)[None, :])] if dim else np.zeros((len(at), 0))


def fitted(rows: DataFrame) -> dict[int, Tree]:
    """A tree for each dimension of a sample of rows(vec_id, label, embedding)."""
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id", F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow()  # the sample: at most SAMPLE rows
    return {dim: Tree(x) for dim, _, x in whole_numbers(some.column("embedding"))} if some.num_rows else {}


def placed(rows: DataFrame, trees: dict[int, Tree]) -> tuple[DataFrame, dict[int, Tree]]:
    """Staged (dim, leaf, vec_id, label, v) of all rows, and the trees with the ranges of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extent = {dim: Extent(t) for dim, t in sent.value.items()}
        for b in batches:
            for dim, at, x in whole_numbers(b.column("embedding")):
                tree = sent.value.get(dim)
                leaf = tree.place(x, extent[dim].seen(x)) if tree else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim), pa.int32()), pa.array(leaf, pa.int32()), b.column("vec_id").take(pa.array(at)), b.column("label").take(pa.array(at)), pa.array(packed(x), pa.binary())], ["dim", "leaf", "vec_id", "label", "v"])
        for dim, e in extent.items():
            if made := list(e.rows()):
                none = pa.nulls(len(made), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(made), pa.int32()), pa.array([-1 - n for n, _ in made], pa.int32()), none, none, pa.array([r for _, r in made], pa.binary())], ["dim", "leaf", "vec_id", "label", "v"])
        released()

    def merged(t: pa.Table) -> pa.Table:
        r = np.array([np.frombuffer(b, np.float64) for b in t.column("v").to_pylist()])
        half = r.shape[1] // 2
        one = np.concatenate([r[:, :half].min(0), r[:, half:].max(0)]).tobytes()
        return pa.table({"dim": t.column("dim")[:1], "leaf": t.column("leaf")[:1], "v": pa.array([one], pa.binary())})

    out = stage(rows.mapInArrow(run, ROWS), "placed")
    # in two steps, so that no task reads a node's ranges of all tasks of a large table; the tree bounds what is collected
    parts = out.where("leaf < 0").select("dim", "leaf", "v", F.pmod(F.xxhash64("v"), F.lit(64)).alias("part"))
    half = parts.groupBy("dim", "leaf", "part").applyInArrow(merged, "dim int, leaf int, v binary")
    ranges: dict[int, dict[int, np.ndarray]] = {}
    for r in half.groupBy("dim", "leaf").applyInArrow(merged, "dim int, leaf int, v binary").collect():
        m = len(trees[r.dim].points[-1 - r.leaf])
        ranges.setdefault(r.dim, {})[-1 - r.leaf] = np.frombuffer(r.v, np.float64).reshape(2 * (m + 1), m)
    return out.where("leaf >= 0"), {dim: t.ranged(ranges.get(dim, {})) for dim, t in trees.items()}


def visits(anchors: DataFrame, trees: dict[int, Tree], home: bool) -> DataFrame:
    """Anchors(akey, vec_id, label, dim, v, least, most: arrays of equally many scores) with each leaf that any of their windows of scores leaves, or with the leaf they belong to."""
    sent = anchors.sparkSession.sparkContext.broadcast(trees)
    columns = [c for c in anchors.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                at, tree = np.flatnonzero(dims == dim), sent.value.get(int(dim))
                q = unpacked([b.column("v")[i].as_py() for i in at], int(dim))
                if tree is None:
                    pairs = [(0, np.arange(len(at)))]
                elif home:
                    leaf = tree.place(q)
                    pairs = [(int(x), np.flatnonzero(leaf == x)) for x in np.unique(leaf)]
                else:
                    least, most = ([b.column(c)[i].as_py() for i in at] for c in ("least", "most"))
                    owner = np.repeat(np.arange(len(at)), [len(x) for x in least])
                    flat = lambda rows, none: np.array([none if y is None else float(y) for x in rows for y in x])
                    pairs = [(leaf, np.unique(owner[rows])) for leaf, rows in tree.remaining(q[owner], flat(least, -np.inf), flat(most, np.inf))]
                for leaf, rows in pairs:
                    if len(rows):
                        part = b.take(pa.array(at[rows]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf), pa.int32()), *[part.column(c) for c in columns]], ["leaf", *columns])
        released()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, f"leaf int, {kinds}")


def met(rows: DataFrame, sizes: DataFrame, visitors: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, home: bool = False) -> DataFrame:
    """``kernel(block of a leaf's rows, part of its visitors)`` over all blocks and parts, or over the first block of each leaf."""
    visitors = stage(visitors, "visitors")
    parts = F.ceil(F.count("*") / VISITORS).cast("int").alias("parts")
    number = stage(visitors.groupBy("dim", "leaf").agg(parts).join(sizes, ["dim", "leaf"]), "number")
    block = F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")
    dealt = rows.join(number, ["dim", "leaf"]).withColumn("block", block)
    dealt = (dealt.where("block = 0") if home else dealt).select("dim", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "label", "v")
    last = F.lit(0) if home else F.col("blocks") - 1
    asked = visitors.join(number, ["dim", "leaf"]).withColumn("part", F.pmod(F.col("akey"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), last))).drop("blocks", "parts")
    keys = ["dim", "leaf", "block", "part"]
    out = stage(dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(kernel, schema), "met")
    dropped(visitors, number)
    return out


def loaded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (ascending), labels and vectors of a block; rows that repeat another in all three are one."""
    dim = t.column("dim")[0].as_py()
    ids, labels, blobs = t.column("vec_id").to_numpy(), t.column("label").to_numpy(), t.column("v").to_pylist()
    order = np.argsort(ids, kind="stable")
    again, keep = set(), []
    same = np.zeros(len(ids), bool)
    same[order[1:]] = ids[order[1:]] == ids[order[:-1]]
    same[order[:-1]] |= ids[order[1:]] == ids[order[:-1]]
    for i in order.tolist():
        if same[i]:
            key = (int(ids[i]), int(labels[i]), blobs[i])
            if key in again:
                continue
            again.add(key)
        keep.append(i)
    return ids[keep], labels[keep], unpacked([blobs[i] for i in keep], dim)


def scored(t: pa.Table, q: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the visitor, scores of all rows of the block, their ids, their labels), a bounded number of products at once."""
    ids, labels, x = loaded(t)
    dim, blobs = t.column("dim")[0].as_py(), q.column("v")
    step = max(1, CHUNK // max(1, len(ids)))
    for a in range(0, q.num_rows, step):
        s = products(unpacked([b.as_py() for b in blobs[a : a + step]], dim), x)
        for i in range(len(s)):
            yield a + i, s[i], ids, labels


def best(s: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` the k of the highest scores, earlier ones first among equals."""
    if len(at) > 8 * k:
        edge = np.partition(s[at], len(at) - k)[len(at) - k]
        at = at[s[at] >= edge]
    return at[np.argsort(-s[at], kind="stable")][:k]


def top_k(rows: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors(vec_id, label, embedding) that satisfy ``anchors``, searched against all rows.

    ``positives`` and ``negatives``: how many of each; ``low``: the percentage of the positive's score that a negative's has to reach."""
    prepared(vectors.sparkSession)
    rows = taking_part(vectors)
    rows, trees = placed(rows, fitted(rows))
    sizes = stage(rows.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    own = stage(rows.where(anchors).dropDuplicates(["vec_id", "label", "v"]).select(F.xxhash64("vec_id", "label", "v").alias("akey"), "vec_id", "label", "dim", "v"), "anchors")

    def same_label(t: pa.Table, q: pa.Table) -> pa.Table:
        keys, names, labels, least = (q.column(c).to_pylist() for c in ("akey", "vec_id", "label", "least"))
        out: list[tuple] = []
        for i, s, ids, kinds in scored(t, q) if t.num_rows and q.num_rows else ():
            fits = (kinds == labels[i]) & (ids != names[i])
            if least[i][0] is not None:
                fits &= s >= least[i][0]
            out += [(keys[i], int(ids[j]), int(s[j])) for j in best(s, np.flatnonzero(fits), positives)]
        return pa.table({n: pa.array([x[k] for x in out], pa.int64()) for k, n in enumerate(("akey", "id", "score"))})

    def other_label(t: pa.Table, q: pa.Table) -> pa.Table:
        keys, labels, least, most = (q.column(c).to_pylist() for c in ("akey", "label", "least", "most"))
        out: list[tuple] = []
        for i, s, ids, kinds in scored(t, q) if t.num_rows and q.num_rows else ():
            at = np.flatnonzero((kinds != labels[i]) & (s >= min(least[i])) & (s <= max(most[i])))
            if len(at):
                at = at[np.argsort(-s[at], kind="stable")]
                down = -s[at]
                for p, (a, b) in enumerate(zip(least[i], most[i], strict=True)):
                    first, end = np.searchsorted(down, -b), np.searchsorted(down, -a, "right")
                    out += [(keys[i], p, int(ids[j]), int(s[j])) for j in at[first : min(end, first + negatives)]]
        return pa.table({n: pa.array([x[k] for x in out], pa.int64()) for k, n in enumerate(("akey", "place", "id", "score"))})

    # positives: what the fifth best of the first block of the own leaf reaches, all have to reach
    blank = F.array(F.lit(None).cast("bigint"))
    asked = own.select("*", blank.alias("least"), blank.alias("most"))
    near = met(rows, sizes, visits(asked, trees, True), same_label, "akey bigint, id bigint, score bigint", True)
    reach = top_k(near, ["akey"], positives, "r").groupBy("akey").agg(F.when(F.count("*") == positives, F.min("score")).alias("t"))
    asked = stage(own.join(reach, "akey", "left").select(*own.columns, F.array("t").alias("least"), blank.alias("most")), "asked")
    found = met(rows, sizes, visits(asked, trees, False), same_label, "akey bigint, id bigint, score bigint")
    chosen = stage(top_k(found, ["akey"], positives, "p").select("akey", F.col("p").cast("bigint").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "chosen")
    dropped(near, found, asked)

    # negatives: a window for each positive, empty below zero; again raised by what the own leaf holds
    floor_ = F.expr(f"cast(ceil(cast(positive_score as decimal(20,0)) * {low} / 100) as decimal(38,0))")
    window = chosen.withColumn("_least", floor_).where("_least <= positive_score").withColumn("_least", F.col("_least").cast("bigint"))
    window = stage(window, "window")

    def with_windows(rows_: DataFrame, least: str) -> DataFrame:
        lists = rows_.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("p", F.col(least).alias("least"), F.col("positive_score").alias("most")))).alias("w"))  # at most so many as positives
        return own.join(lists, "akey").select(*own.columns, F.col("w.p").alias("places"), F.col("w.least").alias("least"), F.col("w.most").alias("most"))

    def named(found_: DataFrame, asked_: DataFrame) -> DataFrame:
        return found_.join(asked_.select("akey", F.posexplode("places").alias("place", "p")), ["akey", "place"]).select("akey", "p", "id", "score")

    asked = stage(with_windows(window, "_least"), "asked")
    near = met(rows, sizes, visits(asked.drop("places"), trees, True), other_label, "akey bigint, place bigint, id bigint, score bigint", True)
    reach = top_k(named(near, asked), ["akey", "p"], negatives, "r").groupBy("akey", "p").agg(F.when(F.count("*") == negatives, F.min("score")).alias("t"))
    raised = window.join(reach, ["akey", "p"], "left").withColumn("_least", F.greatest("_least", F.coalesce("t", "_least")))
    again = stage(with_windows(raised, "_least"), "asked")
    found = met(rows, sizes, visits(again.drop("places"), trees, False), other_label, "akey bigint, place bigint, id bigint, score bigint")
    best_ = top_k(named(found, again), ["akey", "p"], negatives, "rank")
    out = best_.join(window, ["akey", "p"]).join(own.select("akey", F.col("vec_id").alias("anchor_id")), "akey")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of ``embeddings``, against all of them; where vec_id is divisible by 7 the label is the next one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
