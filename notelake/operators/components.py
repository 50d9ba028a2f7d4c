"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, stage


def components(edges: DataFrame, label: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (of any type that can be ordered; a null end or a = b is no edge) as a staged table ``(id, component)`` with the smallest id as component; alternating large-star and small-star.

    Each round is two grouped minima with map-side combine and two joins that AQE can split, so a hub of any degree is dealt out; rounds end when
    the edge set stands still (O(log^2 n) at worst, an error after ``most``). Only counts reach the driver. Nodes without edges do not appear."""
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = _print(now)
    for _ in range(most):
        if before[0] == 0:
            break
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = stage(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), label)
        dropped(now)
        now, after = then, _print(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = stage(stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct()), label)
    dropped(now)
    return out


def _print(edges: DataFrame) -> tuple:
    """Count and an order-free fingerprint of an edge set."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return int(row[0]), row[1]
