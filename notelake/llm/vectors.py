"""Near-duplicate vectors by an inverted multi-index.

Codebooks of the two halves of unit vectors, fitted apart by k-means, make a grid of cells; every vector lies in one. Two vectors of cosine >= t are at most
sqrt(2 - 2t) apart, and how far a vector is from a half's Voronoi cell is bounded below by its distance to the walls, so a vector visits cells in
order of the sum of both halves' squared bounds (multi-sequence traversal with a heap). It stops at 2 - 2t, beyond which no cell can hold a linked vector, so
every pair is found (``reach`` < 1 would stop sooner and miss pairs across walls). Visited cells are verified exactly. Cells are large, and their visitors come in
rounds of about VISITS cells a vector, so that disk stays bounded where bounds are weak.

Dense cells: vectors within half the threshold angle of a pivot (from the cell's most frequent sign pattern) form a ball, all of whose pairs link. A visitor whose angle
to the pivot settles the whole ball needs its size only, so a hot group of near copies costs one comparison a vector. Everything else is compared in blocks of
bounded size with matrix products. Blocks return counts and a spanning forest of their links, never all pairs.

Vectors link only when labels are equal and not null, and only with vectors of their own dimension: dimensions share an index with those up to the next power of two, filled with zeros. Vectors
that are null, zero, or hold null or non-finite components link with nothing. Rows that repeat a vec_id, label and vector are one vector; rows that repeat a vec_id with other content are vectors
of their own under one name: each has its links (those between them count too), and components are of names. A null vec_id is left alone: 0 links. Other columns
of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, mapped, stage, table

THRESHOLD = 0.98
#: Vectors on which codebooks are fitted, chosen by hash: so many, or SAMPLE_EACH a centroid.
SAMPLE, SAMPLE_EACH = 4096, 16
#: Vectors of the largest label that a cell should hold, about, and centroids a half at most (their walls take K x K numbers); cells that hold more are compared in more blocks.
PER_CELL, MOST_CENTROIDS = 2048, 1024
#: Share of the squared threshold distance at which the traversal stops: all of it, which proves recall 1.
REACH = 1.0
#: Cells a vector visits in one round, on average.
VISITS = 4
BLOCK = 2048
PATTERN_BITS = 24


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; empty ones move to the farthest point."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None] - 2 * x @ c.T
        at = d.argmin(1)
        size = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[(d[np.arange(len(x)), at] + (x * x).sum(1)).argmax()])
    return np.unique(c, axis=0)


class Grid:
    """Two codebooks; cells of vectors and lower bounds of the distance to cells."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.cut, self.books = half, [kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)]
        self.between = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-300)) for c in self.books]

    def halves(self, x: np.ndarray):
        for book, walls, part in zip(self.books, self.between, (x[:, : self.cut], x[:, self.cut :]), strict=True):
            yield np.maximum((part * part).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * part @ book.T, 0), walls

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = (d.argmin(1) for d, _ in self.halves(x))
        return i, j

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half: squared lower bound of the distance from each vector to each Voronoi cell (its deepest wall)."""
        out = []
        for d, walls in self.halves(x):
            best = np.zeros_like(d)
            for a in range(d.shape[1]):
                np.maximum(best, (d - d[:, a : a + 1] - 1e-12) / (2 * walls[a][None]), out=best)  # rounding must not lift bounds between centroids that nearly coincide
            out.append(np.maximum(best - 1e-9, 0) ** 2)
        return out


def traverse(low1: np.ndarray, low2: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells of the product grid in order of the sum of both bounds, as far as ``most``."""
    a, b = np.argsort(low1, kind="stable"), np.argsort(low2, kind="stable")
    out, heap, met = [], [(low1[a[0]] + low2[b[0]], 0, 0)], {(0, 0)}
    while heap:
        value, p, q = heapq.heappop(heap)
        if value > most:
            break
        out.append((int(a[p]), int(b[q])))
        for nxt in ((p + 1, q), (p, q + 1)):
            if nxt[0] < len(a) and nxt[1] < len(b) and nxt not in met:
                met.add(nxt)
                heapq.heappush(heap, (low1[a[nxt[0]]] + low2[b[nxt[1]]], *nxt))
    return out


def forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id of its component) of the bipartite graph of a matrix of links between ids."""
    some_r, some_c = linked.any(1), linked.any(0)
    linked, rows, cols = linked[some_r][:, some_c], rows[some_r], cols[some_c]
    lab_r = np.where(linked.any(1), rows, np.iinfo(np.int64).max)
    lab_c = np.where(linked.any(0), cols, np.iinfo(np.int64).max)
    far = np.iinfo(np.int64).max
    while True:
        new_r = np.minimum(lab_r, np.where(linked, lab_c[None], far).min(1, initial=far))
        new_c = np.minimum(lab_c, np.where(linked, new_r[:, None], far).min(0, initial=far))
        if np.array_equal(new_r, lab_r) and np.array_equal(new_c, lab_c):
            break
        lab_r, lab_c = new_r, new_c
    ids, labels = np.concatenate([rows, cols]), np.concatenate([lab_r, lab_c])
    keep = (labels != far) & (labels != ids)
    return ids[keep], labels[keep]


def _unit(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    blobs = batch.column(name).to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``."""
    every = vectors.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) e", "label").withColumn("print", F.xxhash64("label", "e"))
    sane = "vec_id is not null and label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x != 0)"
    every = every.withColumn("sane", F.coalesce(F.expr(sane), F.lit(False)))
    sound = every.where("sane")
    # a vector's number is its vec_id, but for those of a name's vectors behind the first
    prints = sound.groupBy("vec_id").agg(F.count("*").alias("rows"), F.min("print").alias("first"), F.max("print").alias("last")).where("rows > 1")
    repeated = stage(prints.select("vec_id", "first", (F.col("first") != F.col("last")).alias("differ")), "repeated")
    several = bool(repeated.where("differ").head(1))
    number = F.when(F.col("differ") & (F.col("print") != F.col("first")), F.xxhash64("vec_id", "print", F.lit(8))).otherwise(F.col("vec_id"))
    if repeated.head(1):
        with_first = sound.join(repeated, "vec_id", "left")
        again = with_first.where("first is not null").dropDuplicates(["vec_id", "print"])
        ids = with_first.where("first is null").unionByName(again).select(number.alias("id"), "vec_id", "e", "label")
    else:
        ids = sound.select(F.col("vec_id").alias("id"), "vec_id", "e", "label")
    width = F.expr("cast(power(2, ceil(log2(size(e)))) as int)")
    widths = sorted(r[0] for r in sound.select(width.alias("w")).distinct().collect())  # 32 at most
    each = [linked_in(ids.where(width == w), w, threshold, reach) for w in widths]
    if not each:
        dropped(repeated)
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(reduce(DataFrame.unionByName, each), "links")
    dropped(*each)
    links = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("n").alias("n_links"))
    edges = found.where("vec_id != other").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    if several:
        names = stage(ids.where("id != vec_id").select("id", "vec_id"), "names")
        for end in ("a", "b"):
            edges = edges.join(names.toDF(end, "name"), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    links, group = stage(links, "counts"), components(edges)
    dropped(found)
    rows = every.join(repeated.where("differ"), "vec_id", "left").withColumn("id", number) if several else every.withColumn("id", F.col("vec_id"))
    rows = rows.select("vec_id", F.when(F.col("sane"), F.col("id")).alias("id"), F.when(F.col("sane"), F.col("vec_id")).alias("name"))
    out = rows.join(links, "id", "left").join(group.toDF("name", "component_id"), "name", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def linked_in(ids: DataFrame, dim: int, threshold: float, reach: float) -> DataFrame:
    """Staged (vec_id, other, n) of ``ids(id, e, label)`` with at most ``dim`` components: rows sum up to a vector's links, and their ids to a forest of the links."""
    spark = ids.sparkSession
    code = F.xxhash64(F.col("label").cast("string"), F.size("e")).alias("label")

    def unit(batch: pa.RecordBatch) -> dict:
        e, size = batch.column("e"), np.asarray(pc.list_value_length(batch.column("e")), dtype=np.int64)
        x = np.zeros((batch.num_rows, dim))
        x[np.arange(dim)[None] < size[:, None]] = e.flatten().to_numpy()
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return {"vec_id": batch.column("id"), "label": batch.column("label"), "v": [r.tobytes() for r in x]}

    rows = stage(mapped(ids.select("id", code, "e"), unit, "vec_id bigint, label bigint, v binary"), "unit")
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    k = 1 << max(0, min(MOST_CENTROIDS.bit_length() - 1, round(math.log2(largest / PER_CELL) / 2)))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, SAMPLE_EACH * k)).select("v").toArrow()
    grid = Grid(_unit(some) if dim > 1 else np.hstack([_unit(some), np.zeros((some.num_rows, 1))]), k)
    rng = np.random.default_rng(11)
    planes = rng.standard_normal((dim, PATTERN_BITS))
    sent = spark.sparkContext.broadcast((grid, planes))
    apart, angle = reach * (2 - 2 * threshold) + 1e-9, math.acos(threshold)

    def wide(x: np.ndarray) -> np.ndarray:
        return x if dim > 1 else np.hstack([x, np.zeros((len(x), 1))])

    def place(batch: pa.RecordBatch) -> dict:
        g, p = sent.value
        x = _unit(batch)
        i, j = g.cells(wide(x))
        pattern = ((x @ p > 0) << np.arange(PATTERN_BITS)).sum(1)
        return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "cell": i * 65536 + j, "pattern": pattern, "v": batch.column("v")}

    def visit(batch: pa.RecordBatch) -> dict:
        g, _ = sent.value
        x = _unit(batch)
        low = g.bounds(wide(x))
        met = [traverse(a, b, apart) for a, b in zip(*low, strict=True)]
        at = np.repeat(np.arange(len(met)), [len(m) for m in met])
        take = pa.array(at)
        return {"vec_id": batch.column("vec_id").take(take), "label": batch.column("label").take(take), "cell": [i * 65536 + j for m in met for i, j in m], "v": batch.column("v").take(take)}

    indexed = stage(mapped(rows, place, "vec_id bigint, label bigint, cell int, pattern bigint, v binary"), "indexed")
    pivots = indexed.groupBy("label", "cell", "pattern").agg(F.count("*").alias("n"), F.min_by("v", "vec_id").alias("p")).groupBy("label", "cell").agg(F.max_by("p", F.struct("n", "pattern")).alias("p"))

    def spread(batch: pa.RecordBatch) -> dict:
        cos = np.einsum("ij,ij->i", _unit(batch), _unit(batch, "p"))
        return {n: batch.column(n) for n in ("vec_id", "label", "cell", "v", "p")} | {"angle": np.arccos(np.clip(cos, -1, 1))}

    around = stage(mapped(indexed.join(pivots, ["label", "cell"]).select("vec_id", "label", "cell", "v", "p"), spread, "vec_id bigint, label bigint, cell int, v binary, p binary, angle double"), "around")
    within = F.col("angle") <= angle / 2 - 1e-6
    balls = around.where(within).groupBy("label", "cell").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"), F.first("p").alias("p"))
    visits = mapped(rows, visit, "vec_id bigint, label bigint, cell int, v binary")
    tried = [len(traverse(a, b, apart)) for a, b in zip(*grid.bounds(wide(_unit(some))), strict=True)]
    rounds = max(1, math.ceil(np.mean(tried) / VISITS - 0.05))

    def weigh(batch: pa.RecordBatch) -> dict:
        has = np.asarray(batch.column("p").is_valid())
        cos = np.full(batch.num_rows, -1.0)
        if has.any():
            part = batch.filter(pa.array(has))
            cos[has] = np.einsum("ij,ij->i", _unit(part), _unit(part, "p"))
        return {n: batch.column(n) for n in ("vec_id", "label", "cell", "v", "size", "radius", "least")} | {"angle": np.arccos(np.clip(cos, -1, 1))}

    inside = around.where(within).select("vec_id", F.lit(1).alias("own"))
    itself = inside.select("vec_id", F.col("vec_id").alias("other"), F.lit(-1).cast("bigint").alias("n"))

    def compare(t: pa.Table) -> pa.Table:
        member = t.column("member").to_numpy()
        x, ids = _unit(t), t.column("vec_id").to_numpy()
        a, b = ids[~member], ids[member]
        linked = (x[~member] @ x[member].T >= threshold) & (a[:, None] != b[None])
        n = linked.sum(1)
        u, v = forest(linked, a, b)
        some = n > 0
        return pa.table({"vec_id": pa.array(np.concatenate([a[some], u])), "other": pa.array(np.concatenate([a[some], v])), "n": pa.array(np.concatenate([n[some], np.zeros(len(u), np.int64)]))})

    def compared(at: int) -> DataFrame:
        """Links of all vectors with those cells that are visited in round ``at``."""
        turn = F.pmod(F.xxhash64("cell"), F.lit(rounds)) == at
        weighed = mapped(visits.where(turn).join(balls, ["label", "cell"], "left").select("vec_id", "label", "cell", "v", "p", "size", "radius", "least"), weigh, "vec_id bigint, label bigint, cell int, v binary, size bigint, radius double, least bigint, angle double")
        all_of = F.col("angle") + F.col("radius") <= angle - 1e-7
        some_of = ~all_of & (F.col("angle") - F.col("radius") <= angle + 1e-7)
        weighed = stage(weighed.select("vec_id", "label", "cell", "v", "least", F.when(all_of, F.col("size")).alias("all"), F.coalesce(some_of, F.lit(False)).alias("some")), "weighed")
        whole = weighed.where("all is not null").select("vec_id", F.col("least").alias("other"), F.col("all").alias("n"))
        seek = weighed.select("vec_id", "label", "cell", "v", F.explode(F.when(F.col("some"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
        kept = around.where(turn).select("vec_id", "label", "cell", "v", within.cast("int").alias("part"))
        key = ["label", "cell", "part"]
        sizes = kept.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nm")).join(seek.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("np")), key)
        members = kept.join(sizes, key).select(*key, "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("nm")).cast("int").alias("bm"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("bp"), F.lit(True).alias("member"))
        seekers = seek.join(sizes, key).select(*key, "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("bm"), F.pmod(F.xxhash64("vec_id"), F.col("np")).cast("int").alias("bp"), F.lit(False).alias("member"))
        found = members.unionByName(seekers).groupBy(*key, "bm", "bp").applyInArrow(compare, "vec_id bigint, other bigint, n bigint")
        found = stage(found.unionByName(whole), "found")
        dropped(weighed)
        return found

    each = []
    for at in range(rounds):
        each.append(compared(at))
        if rounds > 1:
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # lets go of the round's shuffle files
    out = stage(reduce(DataFrame.unionByName, each, itself), "found")
    dropped(rows, indexed, around, *each)
    return out


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``embeddings`` within labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id
), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, d.vec_id = c.component_id AS kept FROM embeddings d JOIN c ON c.id = d.vec_id LEFT JOIN n ON n.a = d.vec_id
"""
