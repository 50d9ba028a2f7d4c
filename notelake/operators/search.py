"""Exact vector search: the query side is stated and goes in blocks, the other side is scanned once for each."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scores import dot
from ..session import prepared

#: Queries that are broadcast against all vectors at once.
MOST_QUERIES = 10_000
#: Similarities that a task works out at once.
AT_ONCE = 1 << 16


def blocks(queries: DataFrame, query_id: str = "query_id") -> list[DataFrame]:
    """The queries in disjoint parts of at most MOST_QUERIES rows: by hash, and by rank within a hash that has more."""
    queries = queries.select(query_id, "query")
    n = queries.count()
    if n <= MOST_QUERIES:
        return [queries]
    dealt = queries.withColumn("_hash", F.pmod(F.xxhash64(query_id, "query"), F.lit(math.ceil(n / (0.9 * MOST_QUERIES)))))
    rank = F.row_number().over(Window.partitionBy("_hash").orderBy(query_id, "query"))
    dealt = dealt.withColumn("_part", F.floor((rank - 1) / MOST_QUERIES))
    parts = dealt.select("_hash", "_part").distinct().collect()  # about one row a block
    return [dealt.where((F.col("_hash") == h) & (F.col("_part") == p)).select(query_id, "query") for h, p in sorted(parts)]


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them lack components."""
    size = np.asarray(lists.value_lengths().fill_null(-1))
    if len(size) and (size[0] < 0 or (size != size[0]).any()):
        raise ValueError("vectors have different dimensions")
    flat, shape = lists.flatten(), (len(size), int(size[0]) if len(size) else 0)
    gone = np.asarray(flat.is_null()).reshape(shape).any(1)
    return np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(shape), gone


def _dots(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of rows of ``v`` with columns of ``q``, summed component by component in order, as ``dot`` does."""
    total = np.zeros((len(v), q.shape[1]))
    for k in range(v.shape[1]):
        total += v[:, k, None] * q[k]
    return total


def _against(vectors: DataFrame, queries: DataFrame, query_id: str, k: int | None, by: list[str]) -> DataFrame:
    """Vectors with a block of at most MOST_QUERIES queries; with ``k``, of a batch only what can be among the k best of a query and value of ``by``."""
    rest = [c for c in vectors.columns if c not in (query_id, "embedding")]
    schema = StructType([queries.schema[query_id], *[vectors.schema[c] for c in rest], StructField("similarity", DoubleType())])
    held = vectors.sparkSession.sparkContext.broadcast(queries.select(query_id, "query").toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = held.value.column(0), held.value.column(1).combine_chunks()
        if not len(ids):
            return
        q, no_query = _matrix(asked)
        q = np.ascontiguousarray(q.T)
        for batch in batches:
            v, no_vector = _matrix(batch.column("embedding"))
            if len(v) and v.shape[1] != len(q):
                raise ValueError("vectors have different dimensions")
            groups = [np.arange(at, min(at + 64, len(v))) for at in range(0, len(v), 64)]
            if k is not None:
                values: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else [()] * len(v)):
                    values.setdefault(key, []).append(i)
                groups = list(map(np.array, values.values()))
            for rows in groups:
                step = max(1, AT_ONCE // len(rows))
                for at in range(0, q.shape[1], step):
                    found = _dots(v[rows], q[:, at : at + step])
                    none = no_vector[rows, None] | no_query[None, at : at + step]
                    wanted = np.ones(found.shape, bool)
                    if k is not None and len(rows) > k > 0:  # missing ones rank last, those that are not numbers first, ties stay
                        order = np.where(none, -np.inf, np.where(np.isnan(found), np.inf, found))
                        wanted = order >= np.partition(order, len(rows) - k, axis=0)[len(rows) - k]
                    r, c = np.nonzero(wanted)
                    own = batch.take(pa.array(rows[r]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(c + at)).combine_chunks(), *[own.column(x) for x in rest], pa.array(found[r, c], mask=none[r, c])], [query_id, *rest, "similarity"])

    return vectors.mapInArrow(run, schema)


def similarities(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", query_id: str = "query_id", k: int | None = None, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(query_id, id, similarity) of every query with every vector; queries(query_id, query) are broadcast in blocks, each of which scans the vectors once. With ``k``, at least the k best of each query and value of ``by``."""
    prepared(vectors.sparkSession)
    return reduce(DataFrame.unionAll, [_against(vectors, q, query_id, k, list(by)) for q in blocks(queries, query_id)])


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k most similar vectors, ties by id: a bounded heap per task, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, dot(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(max(k, 0))


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, by: list[str], id_col: str = "vec_id") -> DataFrame:
    """The k most similar vectors for each query and value of ``by``; only k rows a task and group are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("similarity"), id_col))
    return similarities(vectors, queries, id_col, k=k, by=by).withColumn("rank", rank).where(F.col("rank") <= k)
