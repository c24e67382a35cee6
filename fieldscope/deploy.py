"""Readying a session: the package for its Python workers, and batches of bounded size for texts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Most rows, and most bytes, that a Python worker gets at once: texts can be long.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def ready(spark: SparkSession) -> None:
    """Give Python workers this package, and small batches where the session says nothing of their size."""
    given = spark._jsparkSession.sessionState().conf()
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not given.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send the package once per application: Spark serves the archive to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
