"""A layout of vectors in few dimensions that keeps neighbourhoods: the fuzzy graph of exact nearest neighbours, drawn by attraction along its edges and repulsion from seeded samples.

The graph: for each vector the distance to its nearest neighbour is no distance at all, and a local scale, found by bisection, makes the memberships of its neighbours add up to log2(k); the
memberships of both ends of an edge are united (a + b - ab). The drawing starts from the principal components and goes in rounds: an edge takes part in a round with the probability of its
membership (by a hash of its ends, the seed and the round), pulls both ends together, and every vector is pushed from a bounded sample of all vectors, another one each round. A round is a join of
edges with places and a grouped sum, written once; vectors never reach the driver, only the bounded sample of places does. Equal input and seed give an equal layout.

Vectors that are null, zero or hold null or non-finite components have no place (null); equal directions share theirs. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import dot
from ..session import dropped, ship, stage
from .neighbours import neighbours, placed, unit

#: Vectors of a round that all are pushed from, pushes for each pull, largest step of a coordinate in one round.
PUSHERS, PUSHES, STEP = 64, 5, 4.0


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b) nearest to a membership that is 1 up to ``min_dist`` and falls off by ``spread`` from there: Gauss-Newton over 300 distances."""
    x = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([0.0, 0.0])  # logarithms of both, so that they stay positive
    for _ in range(100):
        a, b = np.exp(p)
        power = a * x ** (2 * b)
        y = 1 / (1 + power)
        slope = np.column_stack([-y * y * power, -y * y * power * 2 * b * np.log(x)])
        p = p + np.clip(np.linalg.lstsq(slope, want - y, rcond=None)[0], -0.5, 0.5)
    return float(np.exp(p[0])), float(np.exp(p[1]))


def memberships(d: np.ndarray) -> np.ndarray:
    """Memberships of neighbours at ascending distances d (rows of equally many): 1 for the nearest, scaled so that a row adds up to log2(its length + 1)."""
    rho = d[:, :1]
    gap, want = np.maximum(d - rho, 0), np.log2(d.shape[1] + 1)
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    scale = np.ones(len(d))
    for _ in range(64):
        total = np.exp(-gap / scale[:, None]).sum(1)
        large = total > want
        high, low = np.where(large, scale, high), np.where(large, low, scale)
        scale = np.where(np.isfinite(high), (low + high) / 2, scale * 2)
    least = 1e-3 * np.maximum(d.mean(1), 1e-12)
    return np.exp(-gap / np.maximum(scale, least)[:, None])


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, w), a < b, of neighbour lists near(id, near: array<struct<d, id, n>>): the united memberships; cosine distances are half the squared distances of unit vectors."""
    ship(near.sparkSession)
    kind = dict(near.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("near")
            size, flat = np.asarray(lists.value_lengths()), lists.flatten()
            d, first = np.asarray(flat.field("d")) ** 2 / 2, np.cumsum(size) - size
            w = np.zeros(len(d))
            for k in np.unique(size[size > 0]):
                at = first[size == k][:, None] + np.arange(k)[None, :]
                w[at] = memberships(d[at])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(len(size)), size))), flat.field("id"), pa.array(w)], ["id", "other", "w"])

    one = near.select("id", "near").mapInArrow(run, f"id {kind}, other {kind}, w double")
    both = one.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.sum("w").alias("s"), (F.min("w") * F.max("w")).alias("p"), F.count("*").alias("n"))
    return both.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def start(nodes: DataFrame, dims: int) -> DataFrame:
    """(id, y) by principal components, the longest 10 long."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = len(nodes.first()["v"])
    rows = nodes.select("id", array_to_vector("v").alias("f"))
    y = F.slice(vector_to_array("r"), 1, dims)
    made = stage(PCA(k=min(dims, size), inputCol="f", outputCol="r").fit(rows).transform(rows).select("id", y.alias("y")), "start")
    most = made.agg(F.max(F.array_max(F.transform("y", F.abs)))).first()[0] or 1.0
    pad = F.array_repeat(F.lit(0.0), dims - min(dims, size))
    # a little noise by hash, so that nothing stands on a line
    noise = lambda i: (F.pmod(F.xxhash64("id", i), F.lit(2001)) - 1000) / 1e7
    out = stage(made.select("id", F.transform(F.concat(F.transform("y", lambda x: x * (10 / most)), pad), lambda x, i: x + noise(i)).alias("y")), "places")
    dropped(made)
    return out


def reduced(vectors: DataFrame, dims: int = 10, k: int = 15, min_dist: float = 0.1, rounds: int = 40, seed: int = 7) -> DataFrame:
    """(id, y: array<double>) of vectors(id, embedding) in ``dims`` dimensions, by cosine distance and ``k`` neighbours."""
    named = vectors.select("id", "embedding").where("id is not null")
    length = F.when(F.col("embedding").isNotNull(), F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    direction = F.when((length > 0) & (length < float("inf")), F.transform("embedding", lambda x: x.cast("double") / length))
    whole = named.select("id", direction.alias("embedding"))
    nodes = stage(unit(whole), "nodes")
    rows, cells = placed(nodes)
    if not len(cells.pivots):
        return named.select("id", F.lit(None).cast("array<double>").alias("y"))
    near = neighbours(rows, cells, k)
    graph = stage(fuzzy_graph(near), "graph")
    edges = stage(graph.unionAll(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    now = start(nodes, dims)
    a, b = curve(min_dist)

    def moved(pushers: np.ndarray, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = np.asarray(batch.column("y").flatten(), np.float64).reshape(batch.num_rows, dims)
                pull = np.column_stack([np.asarray(filled(batch.column(f"f{i}"))) for i in range(dims)])
                degree = np.asarray(filled(batch.column("degree")))
                gap = y[:, None, :] - pushers[None, :, :]
                d2 = (gap**2).sum(2)
                force = np.where(d2 > 0, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0)[:, :, None] * gap
                push = np.clip(force, -STEP, STEP).mean(1) * (PUSHES * degree)[:, None]
                y = y + np.clip(rate * (pull + push), -STEP, STEP)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), dims).cast(pa.list_(pa.float64()))], ["id", "y"])

        return run

    kind = dict(now.dtypes)["id"]
    for r in range(rounds):
        some = now.orderBy(F.xxhash64("id", F.lit(seed), F.lit(r)), "id").limit(PUSHERS).select("y").collect()  # a bounded sample
        pushers = np.array([x.y for x in some])
        key = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(seed), F.lit(r)), F.lit(1 << 20)) / (1 << 20)
        ends = edges.where(key < F.col("w")).join(now.select(F.col("id").alias("b"), F.col("y").alias("z")), "b").join(now.select(F.col("id").alias("a"), "y"), "a")
        gap = [F.col("y")[i] - F.col("z")[i] for i in range(dims)]
        d2 = sum((g * g for g in gap[1:]), gap[0] * gap[0])
        placed_ = ends.select("a", *[g.alias(f"g{i}") for i, g in enumerate(gap)], d2.alias("d2"))
        pull = F.when(F.col("d2") > 0, -2 * a * b * F.pow("d2", F.lit(b - 1)) / (1 + a * F.pow("d2", F.lit(b)))).otherwise(0.0)
        forces = [F.sum(F.greatest(F.least(pull * F.col(f"g{i}"), F.lit(STEP)), F.lit(-STEP))).alias(f"f{i}") for i in range(dims)]
        each = placed_.groupBy(F.col("a").alias("id")).agg(*forces, F.count("*").cast("double").alias("degree"))
        then = stage(now.join(each, "id", "left").mapInArrow(moved(pushers, 1 - r / rounds), f"id {kind}, y array<double>"), "places")
        dropped(now)
        now = then
    told = stage(nodes.select("id", "v").join(now, "id").select("v", "y"), "layout")
    dropped(nodes, rows, near, graph, edges, now)
    return whole.join(told, F.transform("embedding", lambda x: x + F.lit(0.0)) == F.col("v"), "left").select("id", "y")


def filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, 0.0)


def trustworthiness(near: DataFrame, drawn: DataFrame, n: int, k: int) -> DataFrame:
    """One row: how far the ``k`` neighbours in a drawing(id, near) are neighbours in the full ranks: near(id, near), lists of all others by distance; 1 when no stranger came near."""
    rank = near.select("id", F.posexplode("near").alias("r", "x")).select("id", F.col("x.id").alias("other"), "r")
    seen = drawn.select("id", F.explode(F.slice("near", 1, k)).alias("x")).select("id", F.col("x.id").alias("other"))
    far = seen.join(rank, ["id", "other"]).where(F.col("r") >= k).agg(F.coalesce(F.sum(F.col("r") + 1 - k), F.lit(0)).alias("s"))
    return far.select((1 - F.col("s") * (2.0 / (n * k * (2 * n - 3 * k - 1)))).alias("trustworthiness"))
