"""Numbers of rows over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, stage


def numbered(rows: DataFrame, name: str = "row", order: list[str] | None = None) -> DataFrame:
    """Staged rows with ``name``: 0, 1, 2 ... over the whole table, by ``order`` (ties in any order) or in any. Two passes: rows are numbered within their partition as they are written, then each
    partition's numbers move behind those of the partitions before it, whose counts are all that meets in one place."""
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = stage(rows.withColumn("_m", F.monotonically_increasing_id()), "rows")  # partition and place within it
    part = F.shiftright("_m", 33)
    count = made.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = stage(count.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before")), "counts")  # one row a partition
    out = stage(made.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_before"), "numbered")
    dropped(made, before)
    return out
