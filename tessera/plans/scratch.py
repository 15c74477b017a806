"""A fresh folder for stores that queries and tests build."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """Below ``spark.checkpoint.dir``; without that setting, a private folder
    under a local master and the shared warehouse elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-store-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = _own[0]
    root = root or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
