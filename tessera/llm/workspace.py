"""Shared scratch folders, materialised cut points and code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Arrow batches hold whole texts of any length, so rows alone do not bound them.
BATCH_BYTES = 4 << 20
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master without that setting (tests) gets a private folder of
    its own; a cluster falls back to the shared warehouse, never to local disk.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(_drop_local)
        return _local_root
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def _drop_local() -> None:
    import shutil

    if _local_root:
        shutil.rmtree(_local_root, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_apart(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by columns other than those it is joined on next. A grouped
    frame keeps its groups' partitioning, and a join with it then needs all rows
    of a key in that key's one task; dealt anew, both sides of the join are
    shuffles of its own, whose large partitions adaptive execution splits."""
    return df.repartition(*columns)


def file_order(df: DataFrame) -> Column:
    """The place of a row in a stored table, as a number that rises in the order in
    which it was written: the number of the partition and of its file, and the row
    in it. Reading a table back keeps no order by itself. Null for rows that do not
    come from files that Spark has written."""
    try:
        meta = df.metadataColumn("_metadata")
        name = meta["file_name"]
        df.select(name)
    except AnalysisException:  # not a stored table
        return F.lit(None).cast("long")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    part, file = number(r"^part-(\d+)-"), F.coalesce(number(r"-c(\d+)[^/]*$"), F.lit(0))
    return F.shiftleft(part, 39) + F.shiftleft(file, 32) + meta["row_index"]


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def steady_splits(spark: SparkSession) -> None:
    """Have scans of one table cut alike all through a job: their number of
    splits otherwise follows the cores that are there just then, and changes
    when executors are lost or added between two scans."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so
    that they need no copy of the repository; and bound Arrow batches in bytes
    where the session does not."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tessera-code-")
    path = os.path.join(folder, "tessera_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
