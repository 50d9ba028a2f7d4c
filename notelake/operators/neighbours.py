"""Exact nearest neighbours of all vectors by Euclidean distance: cells around pivots, searched only where a bound allows.

Pivots are fitted on a bounded sample; every vector belongs to the cell of its nearest pivot, and a cell keeps the distance of its farthest vector. Cells that lie together make a block, large ones
are cut into several. What a vector has found in its own block bounds what it still looks for; it visits the other blocks whose cells may hold something nearer (triangle inequality, and the wall
between two pivots), once each. Visitors of a block are cut into parts, so no group grows with the data; a block and a part meet in one task, as a matrix product in single precision that leaves out
what is too far by more than its error. Where no bound helps (unrelated vectors of many dimensions) that is the product of all vectors with all, dealt out: work grows with the square of the rows,
copies of a vector between tasks with its count over BLOCK. Distances are sums of squared differences in one order, so that they are the same from both ends, wherever they are worked out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import dropped, ship, stage

#: Rows that pivots are fitted on, pivots, rows of a block, and visitors of a block that meet in one task, about; smaller tables are cut into some PARTS blocks of LEAST rows or more.
SAMPLE, PIVOTS, BLOCK, VISITORS, PARTS, LEAST = 4096, 256, 32768, 32768, 8, 1024
#: Numbers that are worked out at once.
CHUNK = 1 << 22


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a to the rows of b at the same place."""
    return np.sqrt(((a - b) ** 2).sum(1))


def rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows by a matrix product, and how far off they may be."""
    x, y = (a * a).sum(1), (b * b).sum(1)
    scale = float(x.max(initial=0) + y.max(initial=0))
    return np.maximum(x[:, None] + y[None, :] - 2 * (a @ b.T), 0), 1e-12 * (scale + 1e-300)


class Cells:
    """Pivots with the radius, blocks and rows of their cells; small, and the same on every worker."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.gap = np.sqrt(rough(pivots, pivots)[0]) if len(pivots) else np.zeros((0, 0))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance to it."""
        d, _ = rough(x, self.pivots)
        at = d.argmin(1)
        return at, exact(x, self.pivots[at])

    def sized(self, radius: dict[int, float], count: dict[int, int]) -> Cells:
        """With the farthest distance and the rows of each cell; deals cells into blocks: those of one of the first pivots, which are far apart, come together."""
        total, k = sum(count.values()), len(self.pivots)
        most = min(BLOCK, max(LEAST, -(-total // PARTS)))
        self.visitors = min(VISITORS, most)
        self.radius = np.array([radius.get(c, -np.inf) for c in range(k)])
        self.blocks, self.first = np.zeros(k, np.int64), np.zeros(k, np.int64)
        coarse = self.gap[:, : max(1, int(k**0.5))].argmin(1) if k else []
        self.number, room = 0, 0
        for c in sorted(count, key=lambda c: (coarse[c], c)):
            if count[c] > room:
                self.number += -(-count[c] // most)
                self.first[c], self.blocks[c] = self.number - -(-count[c] // most), -(-count[c] // most)
                room = most - count[c] if count[c] < most else 0
            else:
                self.first[c], self.blocks[c] = self.number - 1, 1
                room -= count[c]
        return self

    def reached(self, x: np.ndarray, home: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that may hold something within a distance of each row."""
        out = []
        for a in range(0, len(x), 4096):
            d2, off = rough(x[a : a + 4096], self.pivots)
            d, mine = np.sqrt(d2), np.arange(len(d2))
            own = home[a : a + 4096]
            slack = np.sqrt(off) + 1e-9 * (1 + d)
            with np.errstate(divide="ignore", invalid="ignore"):
                wall = (d2 - d2[mine, own][:, None]) / (2 * self.gap[own])
            low = np.fmax(d - self.radius[None, :], np.nan_to_num(wall, nan=-np.inf, posinf=-np.inf, neginf=-np.inf))
            row, cell = np.nonzero((self.blocks[None, :] > 0) & (low - slack <= within[a : a + 4096, None]))
            out.append((row + a, cell))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def unit(vectors: DataFrame) -> DataFrame:
    """(id, v, n) of the distinct vectors of vectors(id, embedding) as doubles: the least id of equal ones and how many they are; null vectors and those with null or non-finite components are left out."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    good = vectors.where("id is not null and embedding is not null").where(finite).select("id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))  # + 0.0: -0.0 is 0.0
    return good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n")


def pivots_of(rows: DataFrame) -> np.ndarray:
    """Far-apart rows of a sample of at most SAMPLE rows(id, v)."""
    some = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    sizes = {len(v) for v in some}
    if len(sizes) > 1:
        raise ValueError("vectors have different dimensions")
    if not some:
        return np.zeros((0, 0))
    x = np.array(some, np.float64).reshape(len(some), -1)
    chosen, far = [0], exact(x, x[:1])
    while len(chosen) < PIVOTS and len(chosen) < max(1, len(x) // 8) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, exact(x, x[chosen[-1:]]))
    return x[chosen]


def placed(rows: DataFrame) -> tuple[DataFrame, Cells]:
    """Staged (id, n, v: binary, cell, block) of rows(id, v, n), and the cells."""
    ship(rows.sparkSession)
    cells = Cells(pivots_of(rows))
    sent = rows.sparkSession.sparkContext.broadcast(cells)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column("v")
                x = np.asarray(lists.flatten(), np.float64)
                if len(set(np.asarray(lists.value_lengths()).tolist())) > 1 or len(x) != b.num_rows * sent.value.pivots.shape[1]:
                    raise ValueError("vectors have different dimensions")
                x = x.reshape(b.num_rows, -1)
                cell, d = sent.value.home(x)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell, pa.int32()), pa.array(d)], ["id", "n", "v", "cell", "d"])

    if not len(cells.pivots):
        none = rows.select("id", "n", F.lit(None).cast("binary").alias("v"), F.lit(0).alias("cell"), F.lit(0).alias("block")).where("false")
        return none, cells.sized({}, {})
    first = stage(rows.mapInArrow(run, f"id {kind}, n bigint, v binary, cell int, d double"), "cells")
    size = first.groupBy("cell").agg(F.max("d").alias("r"), F.count("*").alias("rows")).collect()  # at most PIVOTS rows
    cells.sized({r.cell: r.r for r in size}, {r.cell: r.rows for r in size})
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for r in size for x in (r.cell, int(values[r.cell]))]), F.col("cell")) if size else F.lit(1)
    out = stage(first.withColumn("block", (of(cells.first) + F.pmod(F.xxhash64("id"), of(cells.blocks))).cast("int")).drop("d"), "placed")
    dropped(first)
    return out, cells


def visited(rows: DataFrame, askers: DataFrame, cells: Cells, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, skip: np.ndarray | None = None, own: str | None = None) -> DataFrame:
    """``kernel(block of rows, part of its visitors)`` for all blocks of the cells that askers(id, v, cell, within, ...) reach, but for their own ``block`` where askers have such a column. ``skip``: for each cell the value of column ``own`` all whose rows have, whom it tells nothing."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((cells, skip))
    carried = [c for c in askers.columns if c not in ("cell", "block")]

    def calls(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, block), each once."""
        known, same = sent.value
        row, cell = known.reached(matrix(b.column("v")), np.asarray(b.column("cell")), np.asarray(b.column("within"), np.float64))
        if same is not None:
            mine = np.array(b.column(own).to_pylist(), object)
            keep = same[cell] != mine[row]
            row, cell = row[keep], cell[keep]
        times = known.blocks[cell]
        at = np.repeat(np.arange(len(row)), times)
        block = known.first[cell[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        key = np.unique(row[at] * known.number + block)
        row, block = key // known.number, key % known.number
        if "block" in b.schema.names:
            other = np.asarray(b.column("block"))[row] != block
            row, block = row[other], block[other]
        return row, block

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(sent.value[0].number, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(calls(b)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["block", "n"])

    sums = askers.mapInArrow(counted, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect()  # as many rows as blocks
    many = np.zeros(cells.number, np.int64)
    for r in sums:
        many[r.block] = -(-r.n // cells.visitors)
    parts = spark.sparkContext.broadcast(many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, block = calls(b)
            part = np.asarray(b.column("_h"))[row] % parts.value[block]
            for a in range(0, len(row), 20_000):
                some = b.take(pa.array(row[a : a + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 20_000], pa.int32()), pa.array(part[a : a + 20_000], pa.int32()), *[some.column(c) for c in carried]], ["block", "part", *carried])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in askers.schema if f.name in carried)
    asked = askers.withColumn("_h", F.xxhash64("id").bitwiseAND((1 << 62) - 1)).mapInArrow(run, f"block int, part int, {kinds}")
    sizes = spark.createDataFrame([(r.block, int(many[r.block])) for r in sums], "block int, parts int")
    dealt = rows.join(F.broadcast(sizes), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys, tasks = ["block", "part"], max(min(int(many.sum()), sum(r.n for r in sums) // LEAST), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stage(dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(kernel, schema), "told")


def candidates(x: np.ndarray, y: np.ndarray, within: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of y, row of x): among others all x that are one of the k + 1 nearest of a y and within its distance."""
    middle = x.mean(0)
    raw = float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    x, y = x - middle, y - middle
    far, from_ = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    band = np.floor(np.log2(np.maximum(far, 1e-300)) / 4)
    for one in np.unique(band):  # an error follows the longest vector: few far ones must not blur the rest
        of = np.flatnonzero(band == one)
        part, length = x[of], far[of]
        longest = float(length.max())
        right = np.concatenate([part, -(length * length)[:, None] / 2], 1)
        step = max(1, CHUNK // len(of))
        for a in range(0, len(y), step):
            left = np.concatenate([y[a : a + step], np.ones((len(y[a : a + step]), 1))], 1)
            size = from_[a : a + step]
            calm = 1e-12 < longest < 1e12 and size.max() < 1e12
            for kind, unit_ in ((np.float32, 2.0**-24), (np.float64, 2.0**-53)) if calm else ((np.float64, 2.0**-53),):
                s = left.astype(kind) @ right.astype(kind).T  # (|y|^2 - d^2) / 2
                shift = 8 * 2.0**-53 * raw * x.shape[1] ** 0.5
                off = 3 * (x.shape[1] + 12) * unit_ * (size * longest + longest * longest) + 4 * (size + longest) * shift + shift * shift + 1e-300
                bound = (within[a : a + step] * (1 + 1e-9)) ** 2 + off
                fold = min(64, len(of) // (k + 1))
                if fold and not np.isfinite(bound).all():  # the (k + 1)st best of the best of each fold
                    best = s[:, : len(of) // fold * fold].reshape(len(s), fold, -1).max(1)
                    kth = np.partition(best, best.shape[1] - k - 1, 1)[:, best.shape[1] - k - 1].astype(np.float64)
                    bound = np.minimum(bound, size * size - 2 * kth + 2 * off)
                low = (size * size - bound) / 2
                low = np.nextafter((low - 2 * unit_ * np.abs(low)).astype(kind), kind(-np.inf))
                row, at = np.divmod(np.flatnonzero(s >= low[:, None]), len(of))
                if len(row) <= 16 * (k + 4) * len(s):
                    break
            yield row + a, of[at]


def nearest_of(t: pa.Table, q: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(visitor, place of row, exact distance) of the k nearest rows of each visitor within its distance, by visitor and distance, ties by id; the visitor itself is left out."""
    x, y = matrix(t.column("v")), matrix(q.column("v"))
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    within = q.column("within").to_numpy()
    code = pd.factorize(np.concatenate([as_array(t.column("id")), as_array(q.column("id"))]), sort=True)[0]
    mine, theirs = code[: len(x)], code[len(x) :]
    kept, step = [], max(1, CHUNK // max(1, x.shape[1]) // 4)
    for row, at in candidates(x, y, within, k):
        other = mine[at] != theirs[row]
        row, at = row[other], at[other]
        d = np.concatenate([exact(x[at[a : a + step]], y[row[a : a + step]]) for a in range(0, len(row), step)] or [np.zeros(0)])
        good = d <= within[row]
        kept.append(first_k(row[good], at[good], d[good], mine, k))
    return first_k(*map(np.concatenate, zip(*kept, strict=True)), mine, k)


def first_k(row: np.ndarray, at: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((rank[at], d, row))
    row, at, d = row[order], at[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k], d[place < k]


def as_array(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)


def neighbours(rows: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Staged (id, near: array<struct<d, id, n>>) of placed rows: the k nearest distinct other vectors (fewer where there are not so many), nearest first, ties by id."""
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, near array<struct<d:double,id:{kind},n:bigint>>"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def told(t: pa.Table, q: pa.Table) -> pa.Table:
        if not t.num_rows or not q.num_rows:
            return target.empty_table()
        row, at, d = nearest_of(t, q, k)
        who, first = np.unique(row, return_index=True)
        at_ = pa.array(at)
        flat = pa.StructArray.from_arrays([pa.array(d), one_chunk(t.column("id").take(at_)), one_chunk(t.column("n").take(at_))], ["d", "id", "n"])
        near = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), flat)
        return pa.table([one_chunk(q.column("id").take(pa.array(who))), near], ["id", "near"]).cast(target)

    def home(t: pa.Table) -> pa.Table:
        q = t.append_column("within", pa.array(np.full(t.num_rows, np.inf)))
        return told(t, q)

    first = stage(rows.repartition(max(cells.number, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").groupBy("block").applyInArrow(home, schema), "home")
    bound = first.select("id", F.when(F.size("near") == k, F.element_at("near", -1)["d"]).alias("within"))
    askers = rows.join(bound, "id", "left").select("id", "v", "cell", "block", F.coalesce("within", F.lit(float("inf"))).alias("within"))
    found = visited(rows, askers, cells, told, schema)
    out = stage(first.unionAll(found).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")), "near")
    dropped(first, found)
    return out


def one_chunk(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
