"""Session helpers: shipping this package to executors, a local session, tables staged in the cluster's shared folder, partitions replaced."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's own modules to Python workers, once per application, so that functions in it can run there."""
    sc = spark.sparkContext
    if getattr(sc, "_notelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not when the package itself was imported from a zip file that is already shipped
        target = Path(tempfile.mkdtemp(prefix="notelake-ship-")) / "notelake_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"notelake/{f.relative_to(root)}")
        sc.addPyFile(str(target))
    sc._notelake_shipped = True


#: Rows and bytes handed to Python at once: texts are long, so far fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and, unless set otherwise, batches of BATCH_ROWS rows and BATCH_BYTES (one row at least) for Python."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("notelake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache(1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="notelake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given.

    Where neither is set, a temporary folder of this process for a local master, whose executors share its disk; on a cluster an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("staged tables need a folder that the driver and all executors share: set spark.checkpoint.dir when the application starts")
    return _local_dir()


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` into as many tasks as the session shuffles into (``spark.sql.shuffle.partitions``), for what is grouped by these keys next.

    The number holds: adaptive execution else merges tasks up to 64 MB of compressed keys, which are many times that in the tables they are grouped in. Nor is a table of sums built before the shuffle, which is of no use where keys seldom repeat."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back. ``dropped`` removes it."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_partitions(df: DataFrame, location: str, by: str) -> None:
    """Write ``df`` over those partitions of a Parquet table that it has rows of, and leave the others alone; ``df`` may read the table.

    All rows are written beside the table first: a job that fails changes nothing, and the swap that ends it only renames finished files, partition by partition."""
    ready = stage(df, "partitions")
    ready.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(location)
    dropped(ready)
    df.sparkSession.catalog.refreshByPath(location)
